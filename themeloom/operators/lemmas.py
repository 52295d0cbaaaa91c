"""Noun lemmas as a table: derived once per distinct word, then applied to every document."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.functions import constants as C
from themeloom.functions import sparse as S
from themeloom.functions import text as T
from themeloom.session import materialise

TASK_WORDS = 200_000  # words that travel with the tasks at most, the most frequent ones; rarer ones are joined
BASE_SHARE = 0.1  # a base form must occur in this share of the documents its inflected form occurs in


def lexicon_of(df: DataFrame, text_col: str = "raw_text") -> DataFrame:
    """Words of the cleaned text, stopwords and short words included, and the documents that hold each."""
    cleaned = df.select(T.clean_text(F.col(text_col)).alias("text"))
    counted = cleaned.mapInArrow(S.word_counter(1), "term string, df long, tf long")
    return counted.groupBy(F.col("term").alias("word")).agg(F.sum("df").alias("df"))


def _forms(word: Column, irregular: dict[str, str]) -> Column:
    """Candidate base forms: one per matching ending, then the word itself. Irregular nouns have one.

    The word comes last because the default lexicon holds every surface form, also `firemen`.
    """
    endings = [
        F.when(F.endswith(word, F.lit(end)) & (F.lit(end != "s") | ~F.endswith(word, F.lit("ss"))), F.concat(F.substr(word, F.lit(1), F.length(word) - len(end)), F.lit(new)))
        for end, new in C.NOUN_ENDINGS
    ]
    regular = F.filter(F.array(*endings, word), lambda f: f.isNotNull())
    if not irregular:
        return regular
    pairs = F.create_map(*[F.lit(x) for pair in irregular.items() for x in pair])
    special = F.try_element_at(pairs, word)
    return F.when(special.isNotNull(), F.array(special)).otherwise(regular)


def lemma_table(
    df: DataFrame,
    text_col: str = "raw_text",
    lexicon: DataFrame | None = None,
    irregular: dict[str, str] | None = None,
) -> DataFrame:
    """`(word, lemma)` for the words that change: the shortest candidate that the lexicon holds.

    Of the corpus' own words, a base form counts only if it is in BASE_SHARE as many documents as the word itself, so
    a rare typo changes nothing however large the corpus. A lexicon that is given is taken as it is.
    """
    irregular = C.IRREGULAR_NOUNS if irregular is None else irregular
    words = materialise(lexicon_of(df, text_col), "lexicon")
    known = words if lexicon is None else lexicon.select("word").distinct().withColumn("df", F.lit(None).cast("long"))
    inflected = words.where(F.col("word").rlike("(?:s|men)$") | F.col("word").isin(list(irregular))).where(
        ~F.col("word").isin(C.INVARIANT_NOUNS)
    )
    forms = inflected.select("word", "df", F.posexplode(_forms(F.col("word"), irregular)).alias("rank", "form"))
    return (
        forms.join(known.select(F.col("word").alias("form"), F.col("df").alias("base_df")), "form")
        .where((F.col("form") == F.col("word")) | F.col("base_df").isNull() | (F.col("base_df") >= BASE_SHARE * F.col("df")))
        .groupBy("word")
        .agg(F.min_by("form", F.struct(F.length("form"), F.col("rank"))).alias("lemma"))
        .where(F.col("lemma") != F.col("word"))
    )


def _in_task(keys: pa.Array, lemmas: pa.Array):
    def replace_block(texts: pa.Array) -> pa.Array:
        words = pc.split_pattern(texts, " ")
        flat = pc.list_flatten(words)
        mapped = pc.coalesce(pc.take(lemmas, pc.index_in(flat, value_set=keys)), flat)
        joined = pc.binary_join(pa.ListArray.from_arrays(words.offsets, mapped), " ")
        return pc.if_else(pc.is_valid(texts), joined, pa.scalar(None, joined.type))

    def replace(texts: pa.Array) -> pa.Array:
        return pa.concat_arrays([replace_block(block) for block in S.text_blocks(texts)] or [texts])

    return F.arrow_udf(replace, "string")


def _hot_words(hot: pa.Table):
    """The words of a text with those of a dictionary replaced, and the ones that the dictionary lacks."""
    keys, lemmas = hot["word"].combine_chunks(), pc.coalesce(hot["lemma"], hot["word"]).combine_chunks()
    kind = pa.struct([("words", pa.list_(pa.string())), ("rare", pa.list_(pa.string()))])

    def replace_block(texts: pa.Array) -> pa.Array:
        words = pc.split_pattern(pc.fill_null(texts, ""), " ")
        flat = pc.list_flatten(words)
        at = pc.index_in(flat, value_set=keys)
        known = pc.is_valid(at)
        mapped = pa.ListArray.from_arrays(words.offsets, pc.coalesce(pc.take(lemmas, at), flat))
        before = np.concatenate([[0], np.cumsum(~known.to_numpy(zero_copy_only=False))])
        ends = before[words.offsets.to_numpy() - words.offsets[0].as_py()].astype(np.int32)
        rare = pa.ListArray.from_arrays(pa.array(ends), flat.filter(pc.invert(known)))
        return pa.StructArray.from_arrays([mapped, rare], fields=list(kind))

    def replace(texts: pa.Array) -> pa.Array:
        return pa.concat_arrays([replace_block(block) for block in S.text_blocks(texts)] or [replace_block(texts)])

    return F.arrow_udf(replace, "struct<words:array<string>,rare:array<string>>")


def _hot_then_joined(df: DataFrame, pairs: DataFrame, task_words: int) -> DataFrame:
    """The most frequent `task_words` words of the texts, changed or not, are looked up in the tasks; the rest is joined.

    What is joined occurs less often than every word of that dictionary, so no word of the join is hot, and only
    texts' rare words are shuffled. Rows are known by a key of their own, stored with them.
    """
    other = [c for c in df.columns if c != "clean_text"]
    held = materialise(
        df.select(F.struct(*[df[f"`{c}`"] for c in other], F.lit(0).alias("_")).alias("_row"), "clean_text", F.monotonically_increasing_id().alias("_key")),
        "lemma-rows",
    )
    words = held.select(F.explode(F.split("clean_text", " ")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    dictionary = materialise(words.join(pairs.dropDuplicates(["word"]), "word", "left"), "lemma-dictionary")
    hot = dictionary.orderBy(F.desc("n"), "word").limit(task_words).toArrow()
    if not hot.num_rows:
        return df
    least, last = hot["n"][-1].as_py(), hot["word"][-1].as_py()
    rest = dictionary.where(F.col("lemma").isNotNull() & ((F.col("n") < least) | ((F.col("n") == least) & (F.col("word") > last))))
    marked = held.withColumn("_w", F.explode(F.array(_hot_words(hot)("clean_text"))))
    changed = (
        marked.select("_key", F.explode(F.array_distinct("_w.rare")).alias("word"))
        .join(rest.select("word", "lemma"), "word")
        .groupBy("_key").agg(F.map_from_entries(F.collect_list(F.struct("word", "lemma"))).alias("_lemmas"))
    )
    both = F.zip_with(F.split("clean_text", " "), F.col("_w.words"), lambda w, h: F.coalesce(F.try_element_at("_lemmas", w), h))
    text = F.when(F.col("clean_text").isNotNull(), F.array_join(F.when(F.col("_lemmas").isNull(), F.col("_w.words")).otherwise(both), " "))
    joined = marked.join(changed, "_key", "left")
    return joined.select(*[F.col("_row")[c].alias(c) for c in other], text.alias("clean_text"))


def apply_lemmas(df: DataFrame, table: DataFrame, in_task_rows: int = TASK_WORDS) -> DataFrame:
    """Replaces the words of `clean_text` by their lemmas, for rows of any columns, repeated or not; null stays null.

    At most `in_task_rows` words travel with the tasks. A table that has no more adds no shuffle; of a larger one, or
    of a corpus with more words, the most frequent travel and only rare words are joined. The rows are the same.
    """
    pairs = table.select("word", "lemma")
    found = pairs.limit(in_task_rows + 1).toArrow()
    if found.num_rows == 0:
        return df
    if found.num_rows > in_task_rows:
        return _hot_then_joined(df, pairs, in_task_rows)
    return apply_pairs(df, list(zip(found["word"].to_pylist(), found["lemma"].to_pylist())))


def apply_pairs(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """The same with a list of bounded length, such as the words a model keeps; narrow, for any columns.

    The array of one text is a barrier: later Arrow functions see a plain column and are not chained to this one.
    """
    if not pairs:
        return df
    words, lemmas = zip(*pairs)
    replace = _in_task(pa.array(words, pa.string()), pa.array(lemmas, pa.string()))
    kept = [c for c in df.columns if c != "clean_text"]
    return df.select(*[F.col(f"`{c}`") for c in kept], F.explode(F.array(replace("clean_text"))).alias("clean_text"))


def pairs_for(table: DataFrame, terms: list[str]) -> list[tuple[str, str]]:
    """The pairs whose lemma is one of the terms' words: at most one per term, ending and irregular form."""
    words = sorted({w for term in terms for w in term.split(" ")})
    held = table.sparkSession.createDataFrame([(w,) for w in words], "lemma string")
    found = table.select("word", "lemma").join(F.broadcast(held), "lemma", "left_semi").orderBy("word").collect()
    return [(r["word"], r["lemma"]) for r in found]
