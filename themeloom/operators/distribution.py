"""How documents spread over topics: counts, shares, evenness and the facts reports quote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from themeloom.functions import constants as C
from themeloom.operators.labels import with_labels
from themeloom.operators.topics import assign


def topic_counts(doc_topic: DataFrame, topics: int | dict[str, int] | None = None) -> DataFrame:
    """`(model, topic, documents)`. With `topics`, one number or one per model, every topic appears, empty ones as 0."""
    counts = assign(doc_topic).groupBy("model", "topic").agg(F.count("*").alias("documents"))
    if topics is None:
        return counts
    held = counts.groupBy("model").agg(
        F.map_from_entries(F.collect_list(F.struct("topic", "documents"))).alias("held")  # one entry per topic
    )
    last = F.create_map(*[F.lit(x) for pair in topics.items() for x in pair])[F.col("model")] if isinstance(topics, dict) else F.lit(topics)
    return held.select("model", "held", F.explode(F.sequence(F.lit(0), last - 1)).alias("topic")).select(
        "model", "topic", F.coalesce(F.try_element_at("held", F.col("topic")), F.lit(0)).cast("long").alias("documents")
    )


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def distribution_table(counts: DataFrame, labels: DataFrame) -> DataFrame:
    """Per topic: name, style, documents and `share_pct` to two decimals."""
    whole = F.sum("documents").over(Window.partitionBy("model"))
    return (
        with_labels(counts, labels)
        .withColumn("share_pct", F.bround(_share(F.col("documents") * 100.0, whole), 2))
        .select("model", "topic", "topic_name", F.coalesce("writing_style", F.lit("")).alias("writing_style"),
                "documents", "share_pct")
    )


def summarize(counts: DataFrame) -> DataFrame:
    """Per model: total, largest and smallest topic, evenness and near-empty topics.

    Evenness is the entropy of the shares over its maximum; 1 when there is a single topic.
    """
    whole = F.sum("documents").over(Window.partitionBy("model"))
    shared = counts.withColumn("share", _share(F.col("documents").cast("double"), whole))
    entropy = F.sum(F.when(F.col("share") > 0, -F.col("share") * F.ln("share")).otherwise(0.0))
    k = F.count("*")
    return shared.groupBy("model").agg(
        F.sum("documents").alias("documents"),
        F.max_by("topic", F.struct("share", -F.col("topic"))).alias("largest_topic"),
        F.max("share").alias("largest_share"),
        F.min_by("topic", F.struct("share", F.col("topic"))).alias("smallest_topic"),
        F.min("share").alias("smallest_share"),
        F.when(k > 1, entropy / F.ln(F.greatest(k, F.lit(2)))).otherwise(1.0).alias("evenness"),
        F.count_if(F.col("share") < C.NEAR_EMPTY_SHARE).alias("topics_under_2pct"),
    )


def summary_table(counts: DataFrame, labels: DataFrame) -> DataFrame:
    """The summary as published: topics by name, shares in percent, rounded."""
    s = summarize(counts)
    for end in ("largest", "smallest"):
        s = with_labels(s.withColumn("topic", F.col(f"{end}_topic")), labels).drop("topic", "writing_style", f"{end}_topic")
        s = s.withColumnRenamed("topic_name", f"{end}_topic").withColumn(
            f"{end}_share_pct", F.bround(F.col(f"{end}_share") * 100, 1)
        )
    return s.select(
        "model", "documents", "largest_topic", "largest_share_pct", "smallest_topic", "smallest_share_pct",
        F.bround("evenness", 3).alias("evenness"), "topics_under_2pct",
    )


def style_share(counts: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents per writing style; the share is of all documents, also those of topics without a style."""
    styled = with_labels(counts, labels).withColumn("total", F.sum("documents").over(Window.partitionBy("model")))
    return (
        styled.where(F.col("writing_style").isNotNull())
        .groupBy("model", "writing_style")
        .agg(F.sum("documents").alias("documents"), F.max("total").alias("_total"))
        .withColumn("share", _share(F.col("documents").cast("double"), F.col("_total")))
        .drop("_total")
    )


def executive_facts(counts: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per model: the largest topic and what is left, with the sentence reports print."""
    top = counts.groupBy("model").agg(
        F.sum("documents").alias("total"),
        F.max_by("topic", F.struct("documents", -F.col("topic"))).alias("topic"),
        F.max("documents").alias("top_documents"),
        (F.count("*") - 1).alias("other_topics"),
    )
    facts = with_labels(top, labels).select(
        "model", "topic", "topic_name", "total", "top_documents",
        (_share(F.col("top_documents") * 100.0, F.col("total"))).alias("top_pct"),
        (F.col("total") - F.col("top_documents")).alias("remaining"), "other_topics",
    )
    number = lambda c: F.format_number(F.col(c), 0)
    sentence = F.format_string(
        C.SUMMARY_SENTENCE, number("total"), "model", "topic_name", F.bround("top_pct", 0).cast("long"),
        number("top_documents"), number("remaining"), F.col("other_topics"),
    )
    return facts.withColumn("sentence", sentence)
