"""The tables behind an interactive topic map: normalised weights, prevalence, saliency, relevance, distances."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from themeloom.functions import constants as C
from themeloom.functions import weights as W


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def _tied(score: str) -> Column:
    """Scores that differ only by the order of additions count as ties, which follow term order."""
    return F.round(score, 9)


def topic_term_shares(topic_term: DataFrame) -> DataFrame:
    """Adds `phi`: each topic's weights as shares of the topic."""
    return topic_term.withColumn(
        "phi", _ratio(F.col("weight"), F.sum("weight").over(Window.partitionBy("model", "topic")))
    )


def mapped_documents(doc_topic: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Documents with topic weight and known vocabulary: `(model, doc_id, theta, length)`.

    Inference leaves each document's length next to its weights, so nothing is joined here.
    """
    return doc_topic.where((W.total(F.col("weights")) > 0) & (F.col("length") > 0)).select(
        "model", id_col, W.shares(F.col("weights")).alias("theta"), "length"
    )


def prevalence(documents: DataFrame) -> DataFrame:
    """`(model, topic, frequency, proportion)`: shares weighted by document length."""
    spread = documents.select("model", "length", F.posexplode("theta").alias("topic", "theta"))
    summed = spread.groupBy("model", "topic").agg(F.sum(F.col("theta") * F.col("length")).alias("frequency"))
    return summed.withColumn(
        "proportion", _ratio(F.col("frequency"), F.sum("frequency").over(Window.partitionBy("model")))
    )


def term_frequencies(shares: DataFrame, topics: DataFrame) -> DataFrame:
    """`(model, topic, term, phi, topic_frequency, frequency, term_proportion)`.

    Term frequencies are the ones the model implies: topic shares times topic frequencies.
    """
    of_term = Window.partitionBy("model", "term")
    joined = shares.select("model", "topic", "term", "phi").join(
        F.broadcast(topics.select("model", "topic", F.col("frequency").alias("_f"), "proportion")), ["model", "topic"]
    )
    whole = topics.groupBy("model").agg(F.sum("frequency").alias("_whole"))
    return (
        joined.withColumn("topic_frequency", F.col("phi") * F.col("_f"))
        .withColumn("frequency", F.sum("topic_frequency").over(of_term))
        .withColumn("phi_of_term", _ratio(F.col("phi"), F.sum("phi").over(of_term)))
        .join(F.broadcast(whole), "model")
        .withColumn("term_proportion", _ratio(F.col("frequency"), F.col("_whole")))
        .drop("_f", "_whole")
    )


def saliency(frequencies: DataFrame, n: int | None = C.MAP_TERMS) -> DataFrame:
    """`(model, term, frequency, saliency)`: term share times how unlike the corpus its topics are."""
    lean = F.when(
        F.col("phi_of_term") > 0, F.col("phi_of_term") * F.ln(F.try_divide("phi_of_term", "proportion"))
    ).otherwise(0.0)
    scored = frequencies.groupBy("model", "term").agg(
        F.max("frequency").alias("frequency"),
        (F.max("term_proportion") * F.sum(lean)).alias("saliency"),
    )
    if n is None:
        return scored
    order = Window.partitionBy("model").orderBy(F.desc(_tied("saliency")), "term")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def _candidates(steps: np.ndarray, n: int):
    """Of each task's rows, those among the n best of their topic for some lambda; ties go by term.

    A row that n others of its task beat at every lambda is beaten by them on the whole, so nothing is lost.
    """

    def best(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("term", kind="stable")
        kept = np.zeros(len(rows), bool)
        probability, lift = rows["logprob"].to_numpy(), rows["loglift"].to_numpy()
        for step in steps if len(rows) > n else ():
            score = -np.floor((step * probability + (1 - step) * lift) * 1e9 + 0.5)
            kept[np.argsort(score, kind="stable")[:n]] = True
        return rows[kept] if len(rows) > n else rows

    def prune(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, pd.DataFrame] = {}
        for batch in batches:
            for key, rows in batch.groupby(["model", "topic"], sort=False):
                held[key] = best(pd.concat([held[key], rows]) if key in held else rows)
        yield from held.values()

    return prune


def relevance(frequencies: DataFrame, lambdas: list[float] | None = None, n: int = C.MAP_TERMS) -> DataFrame:
    """The n most relevant terms per topic and lambda: lambda ln(phi) + (1 - lambda) ln(phi / p).

    Each task first keeps the terms that can be among them, so that only those are ranked once per lambda.
    """
    steps = [float(s) for s in ([i / 100 for i in range(101)] if lambdas is None else lambdas)]
    scored = (
        frequencies.where((F.col("phi") > 0) & (F.col("term_proportion") > 0))
        .select("model", "topic", "term", "topic_frequency", "frequency", F.ln("phi").alias("logprob"),
                F.ln(F.col("phi") / F.col("term_proportion")).alias("loglift"))
    )
    ranked = (
        scored.mapInPandas(_candidates(np.array(steps), n), scored.schema)
        .withColumn("lambda", F.explode(F.array(*[F.lit(s) for s in steps])))
        .withColumn("relevance", F.col("lambda") * F.col("logprob") + (1 - F.col("lambda")) * F.col("loglift"))
    )
    order = Window.partitionBy("model", "topic", "lambda").orderBy(F.desc(_tied("relevance")), "term")
    return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def token_table(frequencies: DataFrame, shown: DataFrame) -> DataFrame:
    """For the terms shown on the map: the share of each term that falls to each topic."""
    terms = shown.select("model", "term").distinct()
    return (
        frequencies.where(F.col("topic_frequency") >= 0.5)
        .join(terms, ["model", "term"], "left_semi")
        .select("model", "term", "topic", _ratio(F.col("topic_frequency"), F.col("frequency")).alias("share"))
    )


def topic_distances(shares: DataFrame) -> DataFrame:
    """Jensen-Shannon divergence of every two topics of a model, `(model, topic1, topic2, distance)`.

    Where only one topic has a term, that topic's part is phi ln 2, so the join needs only the terms
    two topics share; the rest of each topic's mass is added afterwards.
    """
    positive = shares.where(F.col("phi") > 0).select("model", "topic", "term", "phi")
    one = positive.select("model", "term", F.col("topic").alias("topic1"), F.col("phi").alias("p"))
    two = positive.select("model", "term", F.col("topic").alias("topic2"), F.col("phi").alias("q"))
    middle = (F.col("p") + F.col("q")) / 2
    common = (
        one.join(two, ["model", "term"]).where(F.col("topic1") < F.col("topic2"))
        .groupBy("model", "topic1", "topic2")
        .agg(
            F.sum((F.col("p") * F.ln(F.col("p") / middle) + F.col("q") * F.ln(F.col("q") / middle)) / 2).alias("inside"),
            F.sum(F.col("p") + F.col("q")).alias("mass"),
        )
    )
    mass = positive.groupBy("model", "topic").agg(F.sum("phi").alias("m"))
    every = (
        mass.select("model", F.col("topic").alias("topic1"), F.col("m").alias("m1"))
        .join(mass.select("model", F.col("topic").alias("topic2"), F.col("m").alias("m2")), "model")
        .where(F.col("topic1") < F.col("topic2"))
    )
    outside = (F.col("m1") + F.col("m2") - F.coalesce("mass", F.lit(0.0))) * F.ln(F.lit(2.0)) / 2
    return every.join(common, ["model", "topic1", "topic2"], "left").select(
        "model", "topic1", "topic2", (F.coalesce("inside", F.lit(0.0)) + outside).alias("distance")
    )
