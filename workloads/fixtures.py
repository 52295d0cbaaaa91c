"""Inputs for the registered queries, derived by Spark from the given tables.

Where the analytics needs a trained model or human ratings, a deterministic stand-in is derived from
a given table, so that every query grows with its data and has an independent SQL counterpart.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.operators import corpus as K
from themeloom.operators import features as V
from themeloom.operators import lemmas as LM
from themeloom.operators import models as M
from themeloom.session import materialise, spread

TOPICS = 11


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clean corpus of all documents with enough words."""
    return K.prepare(documents(spark, sf_dir), "text", sample_size=None)


def stored_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same corpus written once, for queries that read it several times."""
    return materialise(corpus(spark, sf_dir).select("doc_id", "clean_text"), "corpus")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and styles of the stand-in topics, from the sources of documents.

    Topic 4 has the default name, topic 5 no style, topic 9 no label, and the second model labels for two topics only.
    """
    topic = F.substring("source", 4, 9).cast("int")
    named = table(spark, sf_dir, "documents").select("source", topic.alias("topic")).distinct().where("topic < 11 AND topic <> 9")
    return named.select(
        F.explode(F.array(F.lit("NMF"), F.lit("LDA"))).alias("model"), "topic",
        F.when(F.col("topic") == 4, "Topic 4").otherwise(F.concat(F.lit("Source "), "source")).alias("name"),
        F.when(F.col("topic") != 5, F.concat(F.lit("Style "), (F.col("topic") % 3).cast("string"))).alias("style"),
    ).where("model = 'NMF' OR topic < 2")


def doc_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stand-in models: the positive parts of embedding dimensions 1-11 and 12-22."""
    e = table(spark, sf_dir, "embeddings")
    parts = [
        e.select(
            F.lit(model).alias("model"), F.col("vec_id").alias("doc_id"),
            F.transform(F.slice("embedding", start, TOPICS), lambda x: F.greatest(x.cast("double"), F.lit(0.0))).alias("weights"),
        )
        for model, start in (("NMF", 1), ("LDA", 1 + TOPICS))
    ]
    return parts[0].unionByName(parts[1])


def topic_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stand-in models: word counts by document source ("NMF", 20 topics) and by language ("LDA")."""
    d = documents(spark, sf_dir).select("doc_id", "source", "lang", "text")
    words = K.preprocess(d, "text").select(
        F.explode(F.array(
            F.struct(F.lit("NMF").alias("model"), F.substring("source", 4, 9).cast("int").alias("topic")),
            F.struct(F.lit("LDA").alias("model"), F.when(F.col("lang") == "de", 0).when(F.col("lang") == "en", 1)
                     .when(F.col("lang") == "es", 2).otherwise(3).alias("topic")),
        )).alias("t"), "clean_text",
    ).select("t.model", "t.topic", F.explode(F.split("clean_text", " ")).alias("term")).where("term <> ''")
    return words.groupBy("model", "topic", "term").agg(F.count("*").cast("double").alias("weight"))


def rating_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    code = F.when(F.col("l_linenumber") == 7, "EX").otherwise(
        F.concat(F.lit("T"), F.lpad((F.col("l_partkey") % 24 + 1).cast("string"), 2, "0"))
    )
    clarity = F.when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 6), "n/a").otherwise(
        (F.col("l_quantity").cast("int") % 7).cast("string")
    )
    return l.select(
        F.concat(F.lit("r"), (F.col("l_suppkey") % 7).cast("string")).alias("rater"), code.alias("code"),
        clarity.alias("word_clarity"), F.col("l_linenumber").cast("string").alias("example_fit"),
        F.concat(F.lit(" "), "l_linestatus", F.lit(" ")).alias("suggested_name"),
    )


def rating_key(spark: SparkSession) -> DataFrame:
    rows = [(f"T{i:02d}", "NMF" if i <= 11 else "LDA", (i - 1) % 11) for i in range(1, 23)]
    return spark.createDataFrame(rows, "code string, model string, topic int")


def lemmatised(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The lemma table of the narratives' own words, and the lemmatised corpus, each written once."""
    chosen = K.select_narratives(documents(spark, sf_dir), "text")
    table = materialise(LM.lemma_table(chosen), "lemmas")
    clean = K.preprocess(chosen, lemmas=table, keep_empty=False).select("doc_id", "clean_text")
    return table, materialise(clean, "lemmatised")


def scoring_model(spark: SparkSession, sf_dir: str) -> M.TopicModel:
    """A stand-in model over the vocabulary of the lemmatised corpus, with its lemmas.

    Term t has weight 1 + t / 1000 in topic t % 11 and none elsewhere, so the weights of a text have a closed form.
    """
    table, clean = lemmatised(spark, sf_dir)
    vectorizer = V.fit_vectorizer(clean)
    ids = np.arange(len(vectorizer.terms))
    weights = np.zeros((TOPICS, len(ids)))
    weights[ids % TOPICS, ids] = 1 + ids / 1000.0
    return M.TopicModel("NMF", vectorizer, weights, lemmas=LM.pairs_for(table, vectorizer.terms))


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn as a recording whose bytes are its text; some have no byte."""
    c = table(spark, sf_dir, "conversations")
    said = F.when(F.col("conv_id") % 17 == 0, F.lit("")).otherwise(F.coalesce("text", F.lit("")))
    return c.select(F.concat_ws("_", "conv_id", "turn").alias("recording"), said.cast("binary").alias("content"))


def speech(content: bytes) -> tuple[str, float]:
    """A stand-in for speech recognition: reads the bytes back, hears nothing in some, and fails without any."""
    if not content:
        raise ValueError("no sound")
    text = content.decode()
    return "" if len(text) % 10 == 0 else text, len(text) / 15.0
