"""Human interpretability ratings: validation, join to the key, and the two levels of aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CODE_PATTERN = r"^T\d{2,}$"  # a code has two digits or, past 99 topics, more


def _score(column: str) -> Column:
    """A number from 1 to 5, or null."""
    number = F.col(column).try_cast("double")
    return F.when(number.between(1, 5), number)


def _scored(sheets: DataFrame) -> DataFrame:
    return sheets.where(F.col("code").rlike(CODE_PATTERN)).select(
        "rater", "code", _score("word_clarity").alias("word_clarity"), _score("example_fit").alias("example_fit"),
        F.trim(F.coalesce(F.col("suggested_name").cast("string"), F.lit(""))).alias("suggested_name"),
    )


def split_ratings(sheets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid ratings with their overall score, and the rejected ones as `rater code` notes."""
    scored = _scored(sheets)
    complete = F.col("word_clarity").isNotNull() & F.col("example_fit").isNotNull()
    valid = scored.where(complete).withColumn("overall", (F.col("word_clarity") + F.col("example_fit")) / 2)
    rejected = scored.where(~complete).select(
        "rater", "code", F.concat_ws(" ", "rater", "code").alias("problem")
    )
    return valid, rejected


def with_key(valid: DataFrame, key: DataFrame) -> DataFrame:
    """Ratings joined to model and topic. Valid codes number at most 100, so the key is broadcast."""
    codes = key.where(F.col("code").rlike(CODE_PATTERN)).select("code", "model", "topic").dropDuplicates(["code"])
    return valid.join(F.broadcast(codes), "code")


def suggested_names(keyed: DataFrame) -> DataFrame:
    """`(model, topic, code, suggested_name)`, one row per different name: a topic that most ratings name is no hot group."""
    return keyed.where(F.col("suggested_name") != "").select("model", "topic", "code", "suggested_name").distinct()


def by_topic(keyed: DataFrame, digits: int | None = 2) -> DataFrame:
    """Per topic: raters, mean scores, spread of the overall score and the names raters suggested.

    Only different names meet in one row; where they are too many for that, take `suggested_names`.
    """
    r = _rounder(digits)
    names = suggested_names(keyed).groupBy("model", "topic", "code").agg(
        F.array_join(F.array_sort(F.collect_list("suggested_name")), "; ").alias("suggested_names")
    )
    scores = keyed.groupBy("model", "topic", "code").agg(
        F.count_distinct("rater").alias("raters"),
        r(F.avg("word_clarity")).alias("word_clarity"),
        r(F.avg("example_fit")).alias("example_fit"),
        r(F.avg("overall")).alias("overall"),
        r(F.stddev_samp("overall")).alias("spread"),
    )
    return scores.join(names, ["model", "topic", "code"], "left").fillna("", ["suggested_names"])


def by_model(keyed: DataFrame, topics: DataFrame, digits: int | None = 2) -> DataFrame:
    """Per model: raters, ratings, mean scores and the mean of the per-topic spreads in `topics`."""
    r = _rounder(digits)
    spread = topics.groupBy("model").agg(r(F.avg("spread")).alias("rater_spread"))
    return keyed.groupBy("model").agg(
        F.count_distinct("rater").alias("raters"),
        F.count("*").alias("ratings"),
        r(F.avg("word_clarity")).alias("word_clarity"),
        r(F.avg("example_fit")).alias("example_fit"),
        r(F.avg("overall")).alias("overall"),
    ).join(spread, "model", "left")


def _rounder(digits: int | None):
    return (lambda c: c) if digits is None else (lambda c: F.bround(c, digits))


def score_ratings(sheets: DataFrame, key: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The by-topic table in topic order, the by-model table and the rejected rows."""
    valid, rejected = split_ratings(sheets)
    keyed = with_key(valid, key)
    topics = by_topic(keyed)
    return topics.orderBy("model", "topic"), by_model(keyed, topics), rejected
