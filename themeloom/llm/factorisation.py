"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

The model is w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j. The pairwise part is taken in linear time as half of
the sum over factors of (sum v x)^2 - sum (v x)^2. It is fitted on a bounded sample of labelled rows; scoring is a
narrow pass over whole texts with a model of fixed size.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from themeloom.llm.common import WORD, BoundedCache, remainder

BUCKETS = 1 << 14
FACTORS = 8
MAX_TRAINING_ROWS = 4096  # the documented bound of the sample that a model is fitted on
STATISTICS = (
    "length", "word_length", "symbols", "exclamations", "upper", "digits", "punctuation", "distinct_words",
    "distinct_windows", "repeated_words", "repeated_lines", "lines",
)
_WORD_LIMIT = 200_000
_SYMBOLS = set("#*$%&|<>")


def _statistics(text: str, words: list[str]) -> list[float]:
    """Ratios between 0 and about 1, in the order of STATISTICS; all 0 for an empty text."""
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    chars = Counter(text)
    size = sum(map(len, words))
    lines = [line for line in text.split("\n") if line.strip()]
    return [
        math.log1p(n) / 10.0,
        min(size / n / 10.0, 2.0),
        min(sum(chars[c] for c in _SYMBOLS) / n, 3.0),
        min(chars["!"] / n, 3.0),
        sum(k for c, k in chars.items() if c.isupper()) / size,
        sum(k for c, k in chars.items() if c.isdigit()) / size,
        min((chars["."] + chars[","]) / n, 2.0),
        len(set(words)) / n,
        len(set(zip(words, words[1:], words[2:]))) / max(n - 2, 1),
        sum(map(str.__eq__, words, words[1:])) / n,
        (len(lines) - len(set(lines))) / max(len(lines), 1),
        min(len(lines) / n, 1.0),
    ]


class Features:
    """Index and value arrays of a text: hashed words with unit length, then statistics, then metadata."""

    def __init__(self, n_metadata: int):
        self.size = BUCKETS + len(STATISTICS) + n_metadata
        self.bucket = BoundedCache(lambda w: zlib.crc32(w.encode()) % BUCKETS, _WORD_LIMIT)
        self.tail = np.arange(BUCKETS, self.size)

    def __call__(self, text: str, metadata: list[float | None]) -> tuple[np.ndarray, np.ndarray]:
        words = WORD.findall(text)
        places, counts = np.unique(np.fromiter(map(self.bucket.__getitem__, words), np.int64, len(words)), return_counts=True)
        values = np.sqrt(counts)
        values /= max(math.sqrt(float(counts.sum())), 1.0)
        extra = [0.0 if m is None or not math.isfinite(m) else math.log1p(abs(m)) / 10.0 for m in metadata]
        return np.concatenate([places, self.tail]), np.concatenate([values, _statistics(text, words), extra])


@dataclass
class Machine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray
    n_metadata: int

    def margin(self, places: np.ndarray, values: np.ndarray) -> float:
        scaled = self.factors[places] * values[:, None]
        total = scaled.sum(0)
        return self.bias + float(self.weights[places] @ values) + 0.5 * float(total @ total - (scaled * scaled).sum())


def _sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35.0, 35.0)))


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, n_metadata: int, epochs: int = 12, batch: int = 64,
          rate: float = 0.1, decay: float = 1e-4, seed: int = 7) -> Machine:
    """Logistic loss by adaptive gradient steps over shuffled mini-batches, both classes weighted alike.

    Without rows, the machine gives every text 0.5.
    """
    size = BUCKETS + len(STATISTICS) + n_metadata
    draw = np.random.default_rng(seed)
    machine = Machine(0.0, np.zeros(size), draw.normal(0.0, 0.01, (size, FACTORS)), n_metadata)
    if not len(labels):
        machine.factors[:] = 0.0
        return machine
    positive = max(labels.mean(), 1e-6)
    weight = np.where(labels > 0, 0.5 / positive, 0.5 / max(1.0 - positive, 1e-6))
    seen_bias, seen_w, seen_v = 1e-8, np.full(size, 1e-8), np.full((size, FACTORS), 1e-8)
    for _ in range(epochs):
        order = draw.permutation(len(labels))
        for begin in range(0, len(order), batch):
            chosen = order[begin : begin + batch]
            places = np.concatenate([rows[k][0] for k in chosen])
            values = np.concatenate([rows[k][1] for k in chosen])
            lengths = np.array([len(rows[k][0]) for k in chosen])
            edges = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            scaled = machine.factors[places] * values[:, None]
            totals = np.add.reduceat(scaled, edges)
            pairs = 0.5 * ((totals * totals).sum(1) - np.add.reduceat((scaled * scaled).sum(1), edges))
            z = machine.bias + np.add.reduceat(machine.weights[places] * values, edges) + pairs
            error = (_sigmoid(z) - labels[chosen]) * weight[chosen] / len(chosen)
            spread = np.repeat(error, lengths)
            used, where = np.unique(places, return_inverse=True)
            grad_w = np.bincount(where, spread * values, len(used)) + decay * machine.weights[used]
            change = spread[:, None] * values[:, None] * (np.repeat(totals, lengths, 0) - scaled)
            grad_v = np.stack([np.bincount(where, change[:, f], len(used)) for f in range(FACTORS)], 1) + decay * machine.factors[used]
            seen_bias += error.sum() ** 2
            seen_w[used] += grad_w**2
            seen_v[used] += grad_v**2
            machine.bias -= rate * error.sum() / math.sqrt(seen_bias)
            machine.weights[used] -= rate * grad_w / np.sqrt(seen_w[used])
            machine.factors[used] -= 0.5 * rate * grad_v / np.sqrt(seen_v[used])
    return machine


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, label: str, held_out: Column, max_rows: int) -> DataFrame:
    """At most max_rows labelled documents, as many of either class as there are, drawn by a hash of the id.

    Ids labelled twice take the majority. Labels meet the documents' ids first, so those without a document take no
    place in the sample; each class is sorted down to max_rows ids, and the chosen ones meet the texts by broadcast.
    """
    one = (
        labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(id_col).agg((F.avg(label) >= 0.5).cast("double").alias("_label"))
        .where(~held_out)
        .join(docs.select(id_col), id_col, "left_semi")
        .withColumn("_draw", F.xxhash64(id_col))
    )
    low, high = (one.where(F.col("_label") == k).orderBy("_draw", id_col).limit(max_rows) for k in (0.0, 1.0))
    nth = F.row_number().over(Window.partitionBy("_label").orderBy("_draw", id_col))  # of at most max_rows each
    chosen = low.unionByName(high).withColumn("_nth", nth).orderBy("_nth", "_label").limit(max_rows)
    chosen = chosen.select(F.col(id_col).alias("_labelled"), "_label")
    return docs.join(F.broadcast(chosen), F.col(id_col) == F.col("_labelled"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality",
        metadata: tuple[str, ...] = ("n_chars",), held_out: Column | None = None, max_rows: int = MAX_TRAINING_ROWS) -> Machine:
    """Fits a machine on a bounded sample of labelled rows whose held_out is false."""
    held = F.lit(False) if held_out is None else held_out
    chosen = training_rows(docs, labels, id_col, label, held, max_rows)
    n_metadata = len(metadata)

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(n_metadata)
        for whole in batches:
            for begin in range(0, whole.num_rows, 256):
                part = whole.slice(begin, 256).to_pydict()
                rows = [features(t or "", list(m)) for t, *m in zip(part["text"], *[part[f"m{k}"] for k in range(n_metadata)])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part["id"], pa.string()), pa.array(part["label"]), pa.array([r[0] for r in rows], pa.list_(pa.int64())),
                     pa.array([r[1] for r in rows], pa.list_(pa.float64()))],
                    names=["id", "label", "places", "values"],
                )

    source = chosen.select(
        F.col(id_col).cast("string").alias("id"), F.col("_label").alias("label"), F.col(text).alias("text"),
        *[_metadata(F.col(m), m, text).alias(f"m{k}") for k, m in enumerate(metadata)],
    )
    table = source.mapInArrow(featurise, "id string, label double, places array<long>, values array<double>").toArrow()
    # One row per id, in a fixed order, however the tasks ran: repeated documents add nothing.
    rows = {r["id"]: r for r in sorted(table.to_pylist(), key=lambda r: (r["id"], len(r["places"]), r["places"], r["values"]))}
    found = [(np.array(r["places"]), np.array(r["values"])) for r in rows.values()]
    return train(found, np.array([r["label"] for r in rows.values()]), n_metadata)


def _metadata(column: Column, name: str, text: str) -> Column:
    value = column.cast("double")
    return F.coalesce(value, F.length(F.col(text)).cast("double")) if name == "n_chars" else value


def score(docs: DataFrame, machine: Machine, text: str = "text", metadata: tuple[str, ...] = ("n_chars",)) -> DataFrame:
    """Adds score (0 to 1) and predicted (1 if score >= 0.5, else 0) to every row; rows are never dropped.

    Null and empty texts have neither words nor statistics and get the score of that. Repeated rows score alike,
    missing metadata counts as 0 (n_chars: as the text's length), and clashing columns are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(columns: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        own = shared.value
        features = Features(own.n_metadata)
        for texts, *extra in columns:
            out = []
            for begin in range(0, len(texts), 256):
                many = [c.slice(begin, 256).to_pylist() for c in extra]
                for t, *m in zip(texts.slice(begin, 256).to_pylist(), *many):
                    out.append(float(_sigmoid(own.margin(*features(t or "", m)))))
            yield pa.array(out, pa.float64())

    scorer = F.arrow_udf(run, "double", F.ArrowUDFType.SCALAR_ITER)
    kept = [docs[c] for c in docs.columns if c not in ("score", "predicted")]
    inputs = [F.coalesce(docs[text], F.lit("")), *[_metadata(docs[m], m, text) for m in metadata]]
    return docs.select(*kept, scorer(*inputs).alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality",
             metadata: tuple[str, ...] = ("n_chars",), folds: int = 3, held: int = 1,
             training: DataFrame | None = None) -> DataFrame:
    """Learns from the labelled rows of `training` (None: docs) outside the held-out fold and scores all of docs.

    Adds held_out, score and predicted.
    """
    held_out = remainder(F.col(id_col), folds) == held
    machine = fit(docs if training is None else training, labels, id_col, text, label, metadata, held_out)
    source = docs.drop("held_out")
    return score(source.withColumn("held_out", held_out), machine, text, metadata)
