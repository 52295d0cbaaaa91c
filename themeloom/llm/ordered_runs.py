"""Ranks and prefix sums within groups of any size, over range-sorted partitions.

A window would read each group in one task. Here rows are range-sorted by (group, order), every partition counts its
own stretch of a group, and one summary row per partition says what the stretches before it add.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.llm.common import materialise

_MASK = (1 << 64) - 1


def _signed(x: int) -> int:
    x &= _MASK
    return x - (1 << 64) if x >> 63 else x


def _counter(group: str, sums: tuple[str, ...]):
    """Per sorted partition: `_rank` from 1 and running sums within the group, and whether the group goes on."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_group, rank, totals = None, 0, np.zeros(len(sums), np.uint64)
        waiting = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            g = table[group].to_numpy(zero_copy_only=False)
            fresh = np.concatenate([[last_group is None or g[0] != last_group], g[1:] != g[:-1]])
            if waiting is not None:
                waiting[1][-1] = bool(fresh[0])
                yield _with_last(*waiting)
            n = len(g)
            start = np.maximum.accumulate(np.where(fresh, np.arange(n), -1))
            ranks = np.arange(n) - start + 1
            ranks[start < 0] += rank - 1
            extra = [ranks]
            for j, name in enumerate(sums):
                run = np.cumsum(table[name].to_numpy(zero_copy_only=False).view(np.uint64), dtype=np.uint64)
                before = np.where(start > 0, run[np.maximum(start - 1, 0)], np.uint64(0))
                run = run - before + np.where(start < 0, totals[j], np.uint64(0))
                totals[j] = run[-1]
                extra.append(run.view(np.int64))
            last_group, rank = g[-1], int(ranks[-1])
            waiting = (batch, np.append(fresh[1:], True), extra)
        if waiting is not None:
            yield _with_last(*waiting)

    def _with_last(batch, ends, extra):
        columns = [pa.array(x, pa.int64()) for x in extra] + [pa.array(ends, pa.bool_())]
        names = ["_rank", *[f"_sum_{s}" for s in sums], "_last"]
        return pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *names])

    return count


def _carries(summary, sums: tuple[str, ...]) -> dict[int, tuple]:
    """part -> (its first group, rank and sums that earlier parts add to it, its last group, whether that goes on)."""
    parts, found = sorted(summary, key=lambda r: r["_part"]), {}
    group, total = None, [0] * (1 + len(sums))
    for k, row in enumerate(parts):
        carry = total if row["_first"] == group else [0] * (1 + len(sums))
        own = [row["_end"]["_rank"], *[row["_end"][f"_sum_{s}"] for s in sums]]
        group = row["_end"]["_g"]
        total = [a + b for a, b in zip(own, carry)] if row["_first"] == group else own
        goes_on = k + 1 < len(parts) and parts[k + 1]["_first"] == group
        found[row["_part"]] = (row["_first"], carry[0], [_signed(c) for c in carry[1:]], group, goes_on)
    return found


def _carrier(group: str, sums: tuple[str, ...], carries: dict[int, tuple], columns: list[str]):
    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            table = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            g, parts = (table[c].to_numpy(zero_copy_only=False) for c in (group, "_part"))
            rank, last = (table[c].to_numpy(zero_copy_only=False).copy() for c in ("_rank", "_last"))
            runs = [table[f"_sum_{s}"].to_numpy(zero_copy_only=False).copy() for s in sums]
            for part in np.unique(parts):
                first, add, more, end, goes_on = carries[int(part)]
                here = (parts == part) & (g == first)
                rank[here] += add
                for run, m in zip(runs, more):
                    run[here] += np.int64(m)
                if goes_on:
                    last[(parts == part) & (g == end)] = False
            table["_rank"], table["_last"] = pa.array(rank, pa.int64()), pa.array(last, pa.bool_())
            for s, run in zip(sums, runs):
                table[f"_sum_{s}"] = pa.array(run, pa.int64())
            yield pa.RecordBatch.from_arrays([table[c] for c in columns], names=columns)

    return carry


def running(rows: DataFrame, group: str, order: Sequence[str], sums: Sequence[str] = (), purpose: str = "runs") -> DataFrame:
    """Adds `_rank` (from 1), `_sum_<column>` (wrapping at 64 bits) and `_last` within each group, by `order`.

    `group` and `sums` are long columns without nulls. Rows with equal group and order must be interchangeable or told
    apart by a further order column; when that makes (group, order) unique, no partition is larger than another however
    many rows a group has. `rows` is read twice (to sample ranges, to sort), so give a stored or cheap table. What
    reaches the driver is one row per partition.
    """
    sums = tuple(sums)
    sorted_rows = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("_part", F.spark_partition_id().cast("long"))
    names = sorted_rows.columns
    extra = ", ".join(["_rank long", *[f"`_sum_{s}` long" for s in sums], "_last boolean"])
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sorted_rows.schema.fields) + ", " + extra
    counted = materialise(sorted_rows.mapInArrow(_counter(group, sums), kind), purpose)
    end = F.struct(F.col(group).alias("_g"), "_rank", *[f"_sum_{s}" for s in sums])
    summary = counted.groupBy("_part").agg(F.min(group).alias("_first"), F.max(end).alias("_end")).collect()
    columns = [c for c in names if c != "_part"] + ["_rank", *[f"_sum_{s}" for s in sums], "_last"]
    out = counted.select(*columns).schema
    return counted.mapInArrow(_carrier(group, sums, _carries(summary, sums), columns), out)
