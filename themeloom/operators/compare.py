"""Choosing between models: the sweep over topic numbers and the criteria table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.functions import constants as C

# Criteria in report order, and whether a higher value is better (None: informational).
CRITERIA = [
    ("Coherence (c_v)", True),
    ("Diversity", True),
    ("Interpretability (1 to 5)", True),
    ("Distribution evenness (0 to 1)", True),
    ("Largest topic", None),
    ("Topics under 2%", None),
]
TIE = 1e-9  # fixed value: a smaller difference leads to no leader


def best_k(sweep: DataFrame) -> DataFrame:
    """`(model, n_topics, coherence)` of the best coherence, the smallest number of topics on ties."""
    long = sweep.select(
        "n_topics",
        F.explode(
            F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"{m.lower()}_coherence").alias("coherence")) for m in C.MODELS])
        ).alias("m"),
    ).select("n_topics", "m.model", "m.coherence").where(F.col("coherence").isNotNull())
    return long.groupBy("model").agg(
        F.max_by("n_topics", F.struct("coherence", -F.col("n_topics"))).alias("n_topics"),
        F.max("coherence").alias("coherence"),
    )


def criteria_values(
    metrics: DataFrame | None = None, interpretability: DataFrame | None = None, summary: DataFrame | None = None
) -> list[DataFrame]:
    """The measured criteria as long tables `(criterion, model, value)`; what is absent is not measured."""
    out = []
    if metrics is not None:  # (model, coherence, diversity)
        out += [_long(metrics, "coherence", "Coherence (c_v)"), _long(metrics, "diversity", "Diversity")]
    if interpretability is not None:  # (model, overall)
        out.append(_long(interpretability, "overall", "Interpretability (1 to 5)"))
    if summary is not None:
        out += [
            _long(summary, "evenness", "Distribution evenness (0 to 1)"),
            _long(summary, "largest_share", "Largest topic"),
            _long(summary, "topics_under_2pct", "Topics under 2%"),
        ]
    return out


def _long(df: DataFrame, column: str, criterion: str) -> DataFrame:
    return df.select(F.lit(criterion).alias("criterion"), "model", F.col(column).cast("double").alias("value"))


def comparison(values: list[DataFrame]) -> DataFrame:
    """One row per criterion with both models' values, null where not measured, and who is ahead."""
    first, *rest = values
    long = first
    for df in rest:
        long = long.unionByName(df)
    criteria = first.sparkSession.createDataFrame(
        [(i, c, h) for i, (c, h) in enumerate(CRITERIA)], "position int, criterion string, higher boolean"
    )
    wide = long.groupBy("criterion").pivot("model", sorted(C.MODELS)).agg(F.first("value"))
    lda, nmf = F.col("LDA"), F.col("NMF")
    ahead = F.when(
        F.col("higher").isNull() | lda.isNull() | nmf.isNull() | (F.abs(lda - nmf) < TIE), F.lit("")
    ).otherwise(F.when((nmf > lda) == F.col("higher"), "NMF").otherwise("LDA"))
    return criteria.join(wide, "criterion", "left").select("position", "criterion", "LDA", "NMF", ahead.alias("ahead"))


def leads(compared: DataFrame) -> DataFrame:
    """`(model, criteria)`: what each model is ahead on, in report order, as prose."""
    short = F.lower(F.substring_index("criterion", " (", 1))
    grouped = compared.where(F.col("ahead") != "").groupBy(F.col("ahead").alias("model")).agg(
        F.array_sort(F.collect_list(F.struct("position", short.alias("name"))))["name"].alias("names")
    )
    listed = F.when(F.size("names") == 1, F.get("names", F.lit(0))).otherwise(
        F.concat(
            F.array_join(F.slice("names", F.lit(1), F.size("names") - 1), ", "), F.lit(" and "),
            F.element_at("names", -1),
        )
    )
    return grouped.select("model", listed.alias("criteria"))
