"""The registered queries of this package and, where SQL can express them, the same rows in SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.llm import (
    conversation_repair, factorisation, jaccard_join, licences, line_dedup, packing, piece_encoding, prefix_trie, quality_rules,
    sharding, suffix_tree, token_transducer, vector_dedup,
)

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(build: Query) -> Query:
    REGISTRY[build.__name__] = build
    return build


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query
def op1_line_dedup(spark, sf_dir):
    """doc_id, the text that stays, its md5, and the spans that went, one row per document."""
    cut = line_dedup.dedup_passages(documents(spark, sf_dir).select("doc_id", "text"))
    return cut.select(
        "doc_id", "text", F.size("removed").cast("long").alias("n_removed"),
        F.array_join(F.transform(F.array_sort("removed"), lambda s: F.format_string("%d-%d:%d", s["start"], s["end"], s["kept_doc_id"])), ",").alias("removed_spans"),
    )


@query
def op2_quality_rules(spark, sf_dir):
    judged = quality_rules.judge(documents(spark, sf_dir).select("doc_id", "text"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_lines", "n_stop_words", "failed_rules",
    )


@query
def op9_licences(spark, sf_dir):
    found = licences.scan(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_sentences", "n_known", "n_matches", "first_sentence", "licences")


@query
def op3_sentencepiece(spark, sf_dir):
    return piece_encoding.encode_digests(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op6_token_counts(spark, sf_dir):
    return token_transducer.count_tokens(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op8_best_fit(spark, sf_dir):
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


@query
def op5_quality_classifier(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    scored = factorisation.classify(documents(spark, sf_dir).select("doc_id", "text", "n_chars"), labels)
    return scored.select("doc_id", "held_out", "score", "predicted")


@query
def op10_near_vectors(spark, sf_dir):
    return vector_dedup.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query
def op7_jaccard_join(spark, sf_dir):
    return jaccard_join.near_duplicates(documents(spark, sf_dir))


@query
def op4_suffix_tree(spark, sf_dir):
    return suffix_tree.score_documents(documents(spark, sf_dir))


@query
def op11_rendezvous_shards(spark, sf_dir):
    placed = sharding.place(documents(spark, sf_dir), sharding.equal_weights(8), grown=sharding.equal_weights(9))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


@query
def op12_prefix_trie(spark, sf_dir):
    return prefix_trie.graft(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


@query
def op13_structure_repair(spark, sf_dir):
    damaged = conversation_repair.damage(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return conversation_repair.repair(damaged)
