"""Topic names and writing styles, kept per model because topic numbers are unrelated across models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LABEL_SCHEMA = "map<string, map<string, struct<name: string, style: string>>>"


def parse_labels(documents: DataFrame, json_col: str = "value") -> DataFrame:
    """`(model, topic, name, style)` from whole label documents; broken or empty ones give no rows."""
    models = documents.select(F.explode(F.from_json(json_col, LABEL_SCHEMA)).alias("model", "entries"))
    return models.select("model", F.explode("entries").alias("topic", "entry")).select(
        "model",
        F.col("topic").cast("int").alias("topic"),
        F.coalesce("entry.name", default_name(F.col("topic"))).alias("name"),
        F.nullif(F.col("entry.style"), F.lit("")).alias("style"),
    )


def default_name(topic: Column) -> Column:
    return F.concat(F.lit("Topic "), topic.cast("string"))


def with_labels(df: DataFrame, labels: DataFrame, topics: int | None = None) -> DataFrame:
    """Adds `topic_name` (default `Topic N`) and `writing_style` by `(model, topic)`.

    A label table has one row per topic, so it is broadcast when the number of topics is given and
    otherwise left to the optimizer's own size check.
    """
    side = labels.select("model", "topic", F.col("name").alias("_name"), F.col("style").alias("writing_style"))
    if topics is not None:
        side = F.broadcast(side.where(F.col("topic").between(0, topics - 1)).dropDuplicates(["model", "topic"]))
    return (
        df.join(side, ["model", "topic"], "left")
        .withColumn("topic_name", F.coalesce("_name", default_name(F.col("topic"))))
        .drop("_name")
    )


def export_labels(labels: DataFrame, models: list[str]) -> DataFrame:
    """One row holding the label document: only topics with a name of their own or a style."""
    kept = labels.where((F.col("name") != default_name(F.col("topic"))) | F.col("style").isNotNull())
    entry = F.struct("name", F.nullif(F.col("style"), F.lit("")).alias("style"))
    per_model = kept.groupBy("model").agg(
        F.map_from_entries(
            F.transform(
                F.array_sort(F.collect_list(F.struct("topic", entry.alias("entry")))),
                lambda e: F.struct(e["topic"].cast("string"), e["entry"]),
            )
        ).alias("entries")
    )
    empty = F.from_json(F.lit("{}"), "map<string, struct<name: string, style: string>>")
    named = per_model.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("model", "entries"))).alias("m"))
    document = F.map_from_entries(
        F.array(*[F.struct(F.lit(m), F.coalesce(F.try_element_at("m", F.lit(m)), empty)) for m in models])
    )
    return named.select(F.to_json(document).alias("value"))
