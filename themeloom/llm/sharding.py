"""Sharding by weighted rendezvous hashing of stable record keys.

A shard's score for a key is -weight / ln(u), u uniform from a hash of key and shard name; the highest score wins.
A key's scores for other shards do not change when shards come or go, so a new shard only takes rows into itself, a
removed one only gives its own away, and each holds its share of the weights. Native, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.llm.common import materialise
from themeloom.llm.ordered_runs import running

# 13 hexadecimal digits are 52 bits: exact as a double.
_DIGITS = 13


def equal_weights(n: int) -> dict[int, float]:
    return {k: 1.0 for k in range(n)}


def _score(key: Column, shard: int, weight: float) -> Column:
    digest = F.md5(F.concat(key, F.lit(f":{shard}")).cast("binary"))
    uniform = (F.conv(F.substring(digest, 1, _DIGITS), 16, 10).cast("double") + 0.5) / float(16**_DIGITS)
    return -F.lit(float(weight)) / F.ln(uniform)


def shard_of(key: Column, weights: Mapping[int, float]) -> Column:
    """The shard number of a key as int; null and '' keys count as one key. Equal scores go to the larger number."""
    if not weights or any(w <= 0 for w in weights.values()):
        raise ValueError("weights: one positive weight per shard")
    text = F.coalesce(key.cast("string"), F.lit(""))
    scores = [F.struct(_score(text, k, w).alias("score"), F.lit(int(k)).alias("shard")) for k, w in weights.items()]
    return (F.greatest(*scores) if len(scores) > 1 else scores[0])["shard"].cast("int")


def assign(docs: DataFrame, weights: Mapping[int, float], key: str = "doc_id", into: str = "shard") -> DataFrame:
    """Every row with its shard in `into` (which replaces a column of that name). Rows with equal keys stay together."""
    names = [c for c in docs.columns if c != into]
    return docs.select(*[docs[c] for c in names], shard_of(docs[key], weights).alias(into))


def place(docs: DataFrame, weights: Mapping[int, float], grown: Mapping[int, float] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size (UTF-8 bytes plus 1, null text: 1), text_crc32 (null text: of ''), shard, slot and grown_shard per row.

    Slots are gapless from 0 in each shard, by key (null first), text_crc32 and size; rows equal in all three are
    interchangeable, so the result is the same for every layout of the input. `grown` is a second table of weights
    whose shard is reported beside. Only these columns move, never texts; a key that a third of all rows carry is
    spread over many tasks. Other columns of docs are left out; an empty table gives no rows.
    """
    body = F.coalesce(docs[text], F.lit(""))
    narrow = docs.select(
        docs[key].alias(key), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"),
        shard_of(docs[key], weights).cast("long").alias("_shard"),
        (shard_of(docs[key], grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
        F.monotonically_increasing_id().alias("_salt"),
    )
    stored = materialise(narrow, "shard-keys")
    numbered = running(stored, "_shard", [key, "text_crc32", "size", "_salt"], purpose="shard-slots")
    return numbered.select(
        key, "size", "text_crc32", F.col("_shard").cast("int").alias("shard"), (F.col("_rank") - 1).alias("slot"), "grown_shard",
    )


def write_shards(docs: DataFrame, path: str, weights: Mapping[int, float], key: str = "doc_id") -> None:
    """Writes whole rows as Parquet, one folder `shard=<number>` per shard, with rows of a shard spread over tasks."""
    placed = assign(docs, weights, key).withColumn("_salt", F.monotonically_increasing_id())
    placed.repartitionByRange("shard", "_salt").drop("_salt").write.partitionBy("shard").parquet(path)
