"""Rankings over topic-term weights `(model, topic, term, weight)` and document weights `(model, doc_id, weights)`."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from themeloom.functions import constants as C
from themeloom.functions import text as T
from themeloom.functions import weights as W


def top_terms(topic_term: DataFrame, n: int = C.TOP_WORDS) -> DataFrame:
    """The n heaviest terms of each topic with their rank; ties follow term order."""
    order = Window.partitionBy("model", "topic").orderBy(F.desc("weight"), "term")
    return topic_term.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def top_word_lists(topic_term: DataFrame, n: int = C.TOP_WORDS) -> DataFrame:
    """`(model, topic, words)`: the top terms as one comma-joined string per topic."""
    return top_terms(topic_term, n).groupBy("model", "topic").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("rank", "term")))["term"], ", ").alias("words")
    )


def diversity(terms: DataFrame) -> DataFrame:
    """Distinct top terms over all top terms, per model."""
    return terms.groupBy("model").agg(
        F.try_divide(F.count_distinct("term").cast("double"), F.count("*")).alias("diversity")
    )


def assign(doc_topic: DataFrame) -> DataFrame:
    """Each document's heaviest topic; a narrow step."""
    return doc_topic.withColumn("topic", W.assigned_topic(F.col("weights")))


def alignment(corpus: DataFrame, doc_topic: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Keys present on one side only: both counts are zero when corpus and weights fit together."""
    left = corpus.select(id_col, F.lit(1).alias("in_corpus"))
    right = doc_topic.select(id_col, F.lit(1).alias("in_weights"))
    return left.join(right, id_col, "full").agg(
        F.count_if(F.col("in_weights").isNull()).alias("without_weights"),
        F.count_if(F.col("in_corpus").isNull()).alias("without_text"),
    )


def size_rank(counts: DataFrame) -> DataFrame:
    """Topics by document count, 1 for the largest, with their share of the model's documents."""
    whole = Window.partitionBy("model")
    order = whole.orderBy(F.desc("documents"), "topic")
    share = F.coalesce(F.try_divide(F.col("documents"), F.sum("documents").over(whole)), F.lit(0.0))
    return counts.withColumn("size_rank", F.row_number().over(order)).withColumn("share", share)


def representatives(doc_topic: DataFrame, n: int = C.SHEET_EXAMPLES, id_col: str = "doc_id") -> DataFrame:
    """The n documents with the largest raw weight on each topic, with the share it is of their total.

    Each task keeps its own n best per topic before the shuffle, so a topic that owns most documents
    still sends n rows per task.
    """
    order = Window.partitionBy("model", "topic").orderBy(F.desc("weight"), id_col)
    spread = doc_topic.select(
        "model", id_col, W.total(F.col("weights")).alias("_total"), F.posexplode("weights").alias("topic", "weight")
    )
    return (
        spread.withColumn("example", F.row_number().over(order))
        .where(F.col("example") <= n)
        .withColumn("share", F.when(F.col("_total") > 0, F.col("weight") / F.nullif(F.col("_total"), F.lit(0.0))).otherwise(0.0))
        .select("model", "topic", "example", id_col, "weight", "share")
    )


def with_texts(examples: DataFrame, corpus: DataFrame, text_col: str = "raw_text", id_col: str = "doc_id") -> DataFrame:
    """Adds the narrative of each example. Examples number n per topic, so they are the side broadcast."""
    return corpus.select(id_col, text_col).join(F.broadcast(examples), id_col)


def top_topics(doc_topic: DataFrame, n: int = 3, id_col: str = "doc_id") -> DataFrame:
    """The n largest shares of each document, one row each; a narrow step."""
    return doc_topic.select(
        "model", id_col, F.posexplode(W.top_topics(F.col("weights"), n)).alias("pos", "t")
    ).select("model", id_col, (F.col("pos") + 1).alias("rank"), "t.topic", "t.share")


def blind_items(
    topic_term: DataFrame, doc_topic: DataFrame, corpus: DataFrame, seed: int = C.SHEET_SEED, text_col: str = "raw_text"
) -> tuple[DataFrame, DataFrame]:
    """Topics of all models in a seeded order under neutral codes: the item table and, apart, its key."""
    topics = topic_term.select("model", "topic").distinct()
    shuffled = Window.orderBy(F.md5(F.concat_ws(":", F.lit(seed), "model", "topic")), "model", "topic")
    key = topics.select(
        F.format_string("T%02d", F.row_number().over(shuffled)).alias("code"), "model", "topic"
    )
    shown = with_texts(representatives(doc_topic), corpus, text_col).select(
        "model", "topic", "example", T.sheet_example(F.col(text_col)).alias("text")
    )
    examples = shown.groupBy("model", "topic").agg(
        *[F.max(F.when(F.col("example") == i, F.col("text"))).alias(f"example_{i}") for i in range(1, C.SHEET_EXAMPLES + 1)]
    )
    items = (
        key.join(top_word_lists(topic_term), ["model", "topic"])
        .join(examples, ["model", "topic"], "left")
        .drop("model", "topic")
    )
    return items, key
