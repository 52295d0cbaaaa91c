"""Sums over sparse rows: every task adds up its blocks, and only arrays of topics x vocabulary size leave it."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.functions import sparse as S

_STRAIGHT = 16  # tasks whose arrays go straight to the driver


def summed(cells: DataFrame, per_block: Callable[[S.Rows], list[np.ndarray]], at_once: int | None = None) -> list[np.ndarray]:
    """Sums the arrays that `per_block` returns over all rows of `(indices, values)`, one output row per array."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: list[np.ndarray] | None = None
        for batch in batches:
            for rows in S.row_blocks(batch.column(0), batch.column(1), at_once):
                parts = per_block(rows)
                if sums is None:
                    sums = parts
                else:
                    for total, part in zip(sums, parts):
                        total += part
        if sums is not None:
            ends = np.cumsum([0] + [len(s) for s in sums]).astype(np.int32)
            arrays = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sums)))
            yield pa.RecordBatch.from_arrays([pa.array(range(len(sums)), pa.int32()), arrays], ["slot", "part"])

    parts = cells.mapInArrow(partial, "slot int, part array<double>")
    tasks = cells.rdd.getNumPartitions()
    # Arrays of topics x vocabulary size, whatever the corpus holds: a few are added up here, more of them in Spark first.
    table = (parts if tasks <= _STRAIGHT else _combined(parts, math.isqrt(tasks) + 1)).toArrow()
    sums: dict[int, np.ndarray] = {}
    for batch in table.to_batches():
        for slot, part in zip(batch["slot"].to_pylist(), batch["part"]):
            values = part.values.to_numpy()
            sums[slot] = sums[slot] + values if slot in sums else values
    return [sums[slot] for slot in sorted(sums)]


def _combined(parts: DataFrame, combiners: int) -> DataFrame:
    """Adds up the tasks' arrays in two steps of about equal width, so that no reducer receives one from every task."""
    vectors = parts.select(
        "slot", F.pmod(F.spark_partition_id(), F.lit(combiners)).alias("combiner"), array_to_vector("part").alias("part")
    )
    first = vectors.groupBy("slot", "combiner").agg(Summarizer.sum(F.col("part")).alias("part"))
    return first.groupBy("slot").agg(vector_to_array(Summarizer.sum(F.col("part"))).alias("part"))
