"""Near-duplicate embeddings by a forest of random-projection trees with spill overlap.

Each tree splits at the median of a random projection, again and again; a vector near a split goes to both sides.
Vectors of one leaf are compared, pairs are verified by cosine in double precision, counted once, and united.
The trees are fitted on a bounded sample, every vector is indexed, and equal vectors are handled as one class.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.llm.common import materialise
from themeloom.llm.components import components

TREES = 4
SAMPLE_ROWS = 20_000  # the documented bound of the sample that the splits are fitted on
LEAF_ROWS = 512
BLOCK_ROWS = 2048
SPILL = 0.6  # in standard deviations of the projected difference of two vectors at the threshold
SEED = 11


@dataclass
class Tree:
    """Nodes in arrays: direction and threshold of a split, its children; a leaf has children -1 and a code."""

    directions: np.ndarray
    thresholds: np.ndarray
    left: list[int]
    right: list[int]
    codes: list[int]
    margin: float

    def leaves(self, unit: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Leaf codes with the rows of `unit` that fall into them; a row falls into one leaf or more."""
        stack = [(0, np.arange(len(unit)))]
        while stack:
            node, rows = stack.pop()
            if self.left[node] < 0:
                yield self.codes[node], rows
                continue
            place = unit[rows] @ self.directions[node]
            for child, inside in (
                (self.left[node], place <= self.thresholds[node] + self.margin),
                (self.right[node], place >= self.thresholds[node] - self.margin),
            ):
                if inside.any():
                    stack.append((child, rows[inside]))


def grow_forest(sample: np.ndarray, n_rows: int, threshold: float, trees: int = TREES, leaf_rows: int = LEAF_ROWS, spill: float = SPILL,
                seed: int = SEED) -> list[Tree]:
    """Trees for n_rows unit vectors; depth follows n_rows, splits come from the sample while it has rows left."""
    size = sample.shape[1]
    depth = max(0, math.ceil(math.log2(max(n_rows, 1) / leaf_rows)))
    margin = spill * math.sqrt(max(2.0 - 2.0 * threshold, 0.0) / size)
    draw, forest, code = np.random.default_rng(seed), [], 0
    for _ in range(trees):
        directions, thresholds, left, right, codes = [], [], [], [], []
        stack = [(sample, 0, -1, False)]
        while stack:
            rows, level, parent, is_right = stack.pop()
            node = len(left)
            if parent >= 0:
                (right if is_right else left)[parent] = node
            left.append(-1)
            right.append(-1)
            codes.append(-1)
            direction = draw.normal(size=size)
            direction /= np.linalg.norm(direction)
            place = rows @ direction
            cut = float(np.median(place)) if len(rows) else 0.0
            directions.append(direction)
            thresholds.append(cut)
            if level >= depth or len(rows) < 8:
                codes[node], code = code, code + 1
                continue
            stack.append((rows[place > cut], level + 1, node, True))
            stack.append((rows[place <= cut], level + 1, node, False))
        forest.append(Tree(np.array(directions), np.array(thresholds), left, right, codes, margin))
    return forest


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def vector_classes(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """node (smallest id, hash), _v, size and n for each distinct usable vector."""
    v = F.col("_v")
    usable = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    classes = vectors.select(F.col(id_col).alias("_id"), F.col(vector).alias("_v")).where(usable & F.col("_id").isNotNull())
    grouped = classes.groupBy("_v").agg(F.min("_id").alias("_rep"), F.count("*").alias("n"))
    return grouped.select(F.struct(F.col("_rep").alias("id"), F.xxhash64("_v").alias("h")).alias("node"), "_v", F.size("_v").alias("size"), "n")


def _index(classes: DataFrame, forests: dict[int, list[Tree]]) -> DataFrame:
    """One row per class and leaf: the leaf, all leaves of the class, its id, hash, count and vector."""
    shared = classes.sparkSession.sparkContext.broadcast(forests)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = whole.column(4).to_numpy(zero_copy_only=False)
            for size in np.unique(sizes):
                of_size = whole.filter(pa.array(sizes == size))
                for begin in range(0, of_size.num_rows, 2048):
                    part = of_size.slice(begin, 2048)
                    rows = _matrix(part.column(3))
                    unit = rows / np.linalg.norm(rows / np.abs(rows).max(1, keepdims=True), axis=1, keepdims=True) / np.abs(rows).max(1, keepdims=True)
                    row, leaf = [], []
                    for tree in shared.value.get(int(size), []):
                        for code, inside in tree.leaves(unit):
                            row.append(inside)
                            leaf.append(np.full(len(inside), code))
                    if not row:  # a length that the sample has not met: one leaf for all
                        row, leaf = [np.arange(len(unit))], [np.zeros(len(unit), int)]
                    row, leaf = np.concatenate(row), np.concatenate(leaf)
                    order = np.lexsort((leaf, row))
                    row, leaf = row[order], leaf[order]
                    many = np.bincount(row, minlength=len(unit))
                    ends = np.cumsum(many)
                    all_leaves = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(leaf, pa.int32())).take(pa.array(row))
                    take = pa.array(row)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(row), size), pa.int32()), pa.array(leaf, pa.int32()), all_leaves,
                         *[part.column(k).take(take) for k in (0, 1, 2)], part.column(3).take(take).cast(pa.list_(pa.float64()))],
                        names=["size", "leaf", "leaves", "id", "h", "n", "v"],
                    )

    source = classes.select("node.id", "node.h", "n", F.col("_v").cast("array<double>").alias("v"), "size")
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"size int, leaf int, leaves array<int>, id {kind}, h long, n long, v array<double>")


def _compare(threshold: float):
    """Links among the vectors of a leaf, or between two of its blocks, that no earlier leaf has compared."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        leaf, first, second = table["leaf"][0].as_py(), table["a"][0].as_py(), table["b"][0].as_py()
        block = table["block"].to_numpy()
        rows = _matrix(table["v"].combine_chunks() if isinstance(table["v"], pa.ChunkedArray) else table["v"])
        norms = np.linalg.norm(rows, axis=1)
        unit = rows / norms[:, None]
        weights = table["n"].to_numpy()
        lists = table["leaves"].to_pylist()
        earlier = sorted({c for own in lists for c in own if c < leaf})
        column = {c: k for k, c in enumerate(earlier)}
        member = np.zeros((len(rows), max(len(earlier), 1)), np.float32)
        for k, own in enumerate(lists):
            for c in own:
                if c < leaf:
                    member[k, column[c]] = 1.0
        n = len(rows)
        links, label = np.zeros(n, np.int64), np.arange(n)
        left, right = [], []
        for begin in range(0, n, 512):
            part = slice(begin, min(begin + 512, n))
            near = unit[part] @ unit.T >= threshold - 1e-9
            if first != second:
                near &= block[part][:, None] != block[None, :]
            near[np.arange(part.stop - begin), np.arange(begin, part.stop)] = False
            if near.any():
                near &= member[part] @ member.T < 0.5
            i, j = np.nonzero(near)
            i = i + begin
            exact = np.einsum("ij,ij->i", rows[i], rows[j]) / (norms[i] * norms[j]) >= threshold
            left.append(i[exact])
            right.append(j[exact])
        i, j = np.concatenate(left), np.concatenate(right)
        np.add.at(links, i, weights[j])
        while len(i):  # smallest label among linked ones, until nothing changes
            before = label.copy()
            np.minimum.at(label, i, label[j])
            label = label[label]
            if (before == label).all():
                break
        linked = np.unique(i)
        root = pa.array(label[linked])
        chosen = pa.array(linked)
        return pa.table({
            "id": table["id"].take(chosen), "h": table["h"].take(chosen), "links": pa.array(links[linked], pa.int64()),
            "root_id": table["id"].take(root), "root_h": table["h"].take(root),
        })

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", threshold: float = 0.95, trees: int = TREES,
                 sample_rows: int = SAMPLE_ROWS, leaf_rows: int = LEAF_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per vector: the id column, n_links, component_id and kept.

    n_links counts the other rows linked directly, equal vectors included; component_id is the smallest id that
    links reach; kept is id = component_id. Null or empty vectors, zero vectors, and those with null or non-finite
    components link with nothing, and so do rows without an id, whose component and kept are null and false. Vectors
    of different length never link. A pair is counted in the first leaf that both share, so nothing is expanded or
    deduplicated; leaves over block_rows are compared block by block. Other columns are not read.
    """
    spark = vectors.sparkSession
    classes = materialise(vector_classes(vectors, id_col, vector), "classes")
    sizes = {r["size"]: r["count"] for r in classes.groupBy("size").count().orderBy(F.desc("count"), "size").limit(16).collect()}
    sample = classes.orderBy(F.col("node.h"), "node").limit(sample_rows).select("size", F.col("_v").cast("array<double>").alias("v")).toArrow()
    forests = {}
    for size, count in sizes.items():
        rows = np.array([v for s, v in zip(sample["size"].to_pylist(), sample["v"].to_pylist()) if s == size], np.float64).reshape(-1, size)
        if len(rows):
            rows /= np.linalg.norm(rows, axis=1, keepdims=True)
            forests[size] = grow_forest(rows, count, threshold, trees, leaf_rows)
    indexed = materialise(_index(classes, forests), "leaves")
    # A row per leaf of the forest at most; only those that need blocks are sent out.
    large = indexed.groupBy("size", "leaf").count().where(F.col("count") > block_rows).select(
        "size", "leaf", F.ceil(F.col("count") / block_rows).cast("int").alias("blocks")
    )
    dealt = indexed.join(large, ["size", "leaf"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("id", "h"), F.col("blocks")).cast("int")).select(
        "*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    ).withColumns({"a": F.least("block", "other"), "b": F.greatest("block", "other")})
    kind = indexed.schema["id"].dataType.simpleString()
    found = materialise(
        dealt.groupBy("size", "leaf", "a", "b").applyInArrow(_compare(threshold), f"id {kind}, h long, links long, root_id {kind}, root_h long"),
        "links",
    )
    node = F.struct("id", "h").alias("u")
    united = components(found.select(node, F.struct(F.col("root_id").alias("id"), F.col("root_h").alias("h")).alias("v")), "vector-components")
    counts = found.groupBy(F.struct("id", "h").alias("node")).agg(F.sum("links").alias("links"))
    whole = classes.join(counts, "node", "left").join(united, "node", "left").select(
        F.col("_v").alias("_class"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("_links"),
        F.coalesce("component.id", "node.id").alias("_component"),
    )
    rows = vectors.select(F.col(id_col).alias("_id"), F.when(F.col(id_col).isNotNull(), F.col(vector)).alias("_v"))
    met = rows.join(whole, F.col("_v") == F.col("_class"), "left")
    component = F.coalesce("_component", "_id")
    return met.select(
        F.col("_id").alias(id_col), F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("_id") == component, F.lit(False)).alias("kept"),
    )
