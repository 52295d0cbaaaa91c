"""Column expressions over a document's topic weights (`array<double>`)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(weights: Column) -> Column:
    return F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)


def assigned_topic(weights: Column) -> Column:
    """Index of the largest weight, the lowest index on ties."""
    return (F.array_position(weights, F.array_max(weights)) - 1).cast("int")


def shares(weights: Column) -> Column:
    """Weights divided by their total; an all-zero row is left as it is."""
    whole = total(weights)
    return F.when(whole > 0, F.transform(weights, lambda x: x / whole)).otherwise(weights)


def confidence(weights: Column) -> Column:
    """Share of the assigned topic, zero for an all-zero row."""
    return F.coalesce(F.try_divide(F.array_max(weights), F.nullif(total(weights), F.lit(0.0))), F.lit(0.0))


def top_topics(weights: Column, n: int = 3) -> Column:
    """The n largest shares as `array<struct<topic, share>>`, lowest index first on ties."""
    ranked = F.array_sort(
        F.transform(shares(weights), lambda s, i: F.struct((-s).alias("order"), i.alias("topic"), s.alias("share")))
    )
    return F.transform(
        F.slice(ranked, 1, n), lambda r: F.struct(r["topic"].alias("topic"), r["share"].alias("share"))
    )
