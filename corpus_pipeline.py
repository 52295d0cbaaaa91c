"""Documents to packed training sequences: five stages, each written as Parquet and read again for the next.

Quality rules and the classifier drop the documents they reject, the Jaccard join keeps one row of each group of near
duplicates, substring dedup cuts passages that occur earlier, and packing lays what is left into sequences.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.llm import factorisation, jaccard_join, line_dedup, packing, quality_rules
from themeloom.llm.common import materialise

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the threshold table, with their own columns."""
    judged = quality_rules.judge(docs.select(F.struct("*").alias("_row"), F.col("text").alias("_text")), "_text")
    return judged.where("kept").select("_row.*")


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on labelled ones of the whole input, takes for good.

    Those that are left have passed the rules, so few or none of the bad examples are among them.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    whole = docs.select(F.struct("*").alias("_row"), "doc_id", "text", "n_chars")
    every = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "n_chars")
    return factorisation.classify(whole, labels, training=every).where("predicted = 1").select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: the first as the rows are stored.

    Groups are of rows, not of ids: rows that repeat an id, or have none, are each judged by their own text, so copies
    go whatever their ids and a text of its own stays. Rows without words stay. A row is known by its place in the
    stored table, which every scan of it finds the same.
    """
    placed = docs.select(F.struct("*").alias("_row"), F.col("text").alias("_text"), F.monotonically_increasing_id().alias("_place"))
    groups = jaccard_join.near_duplicates(placed.select("_place", "_text"), "_place", "_text")
    gone = groups.where("_place != component_id").select("_place")
    return placed.join(gone, "_place", "left_anti").select("_row.*")


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts less the passages that an earlier document or place holds; n_chars follows."""
    cut = line_dedup.dedup_passages(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", rules),
    ("quality_classifier", classifier),
    ("jaccard_join", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("best_fit_packing", packed),
]

# The classifier's training and the packing rounds have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; every stage but the last is written to the shared folder and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"pipeline-{name}")
    return docs
