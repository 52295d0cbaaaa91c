"""From raw narratives to the clean corpus, and the overview tables of that corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from themeloom.functions import constants as C
from themeloom.functions import text as T
from themeloom.operators import lemmas as L

_BUCKET_DIGITS = 5  # 16^5 hash buckets: the cut-off bucket holds a millionth of the rows


def exact_sample(df: DataFrame, n: int, id_col: str = "doc_id", seed: int = C.SEED) -> DataFrame:
    """Exactly n rows without replacement, the same ones however the data is partitioned.

    Rows are ordered by a seeded hash of their id. A first job counts rows per hash bucket to find the
    bucket in which the n-th row falls; then only about n rows are shuffled, spread over the buckets.
    A table of at most n rows is returned as it is.
    """
    keyed = df.withColumn("_key", F.md5(F.concat_ws(":", F.lit(seed), F.col(id_col)))).withColumn(
        "_bucket", F.substring("_key", 1, _BUCKET_DIGITS)
    )
    running = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = (
        keyed.groupBy("_bucket").agg(F.count("*").alias("rows"))
        .withColumn("upto", F.sum("rows").over(running))
        .where(F.col("upto") >= n)
        .agg(F.min("_bucket").alias("bucket"), F.min_by(F.col("upto") - F.col("rows"), "_bucket").alias("before"), F.max("upto").alias("total"))
        .first()
    )
    if cut["bucket"] is None or cut["total"] == n:
        return df
    within = Window.partitionBy("_bucket").orderBy("_key", id_col)
    return (
        keyed.where(F.col("_bucket") <= cut["bucket"])
        .withColumn("_rank", F.row_number().over(within))
        .where((F.col("_bucket") < cut["bucket"]) | (F.col("_rank") <= n - cut["before"]))
        .drop("_key", "_bucket", "_rank")
    )


def select_narratives(
    raw: DataFrame,
    text_col: str,
    product_col: str | None = None,
    product: str | None = None,
    id_col: str = "doc_id",
    min_words: int = C.MIN_WORDS,
    sample_size: int | None = None,
    seed: int = C.SEED,
) -> DataFrame:
    """Non-null narratives of one product with enough words; with a sample size, that many of them at most."""
    kept = raw.where(F.col(text_col).isNotNull())
    if product:
        kept = kept.where(F.col(product_col) == product)
    kept = kept.where(T.has_words(F.col(text_col), min_words)).select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("raw_text")
    )
    return exact_sample(kept, sample_size, seed=seed) if sample_size else kept


def preprocess(
    df: DataFrame, text_col: str = "raw_text", lemmas: DataFrame | list[tuple[str, str]] | None = None, keep_empty: bool = True
) -> DataFrame:
    """Adds `clean_text`: content words joined by single spaces, lemmatised if a table is given.

    Without `keep_empty`, rows left with no word go. Exploding an array of at most one text does that
    in the same pass; a filter would be pushed below the projection and clean every text twice.
    """
    clean = F.array_join(T.content_tokens(T.clean_text(F.col(text_col).cast("string"))), " ")
    if not keep_empty:
        clean = F.explode(F.filter(F.array(clean), lambda t: t != ""))
    cleaned = df.select("*", clean.alias("clean_text"))
    if lemmas is None:
        return cleaned
    return L.apply_pairs(cleaned, lemmas) if isinstance(lemmas, list) else L.apply_lemmas(cleaned, lemmas)


def prepare(
    raw: DataFrame,
    text_col: str,
    product_col: str | None = None,
    product: str | None = None,
    id_col: str = "doc_id",
    min_words: int = C.MIN_WORDS,
    sample_size: int | None = None,
    seed: int = C.SEED,
    lemmatise: bool | DataFrame = False,
) -> DataFrame:
    """The clean corpus `(doc_id, raw_text, clean_text)`.

    `lemmatise=True` derives the lemma table from the corpus' own words; a table may be given.
    """
    chosen = select_narratives(raw, text_col, product_col, product, id_col, min_words, sample_size, seed)
    lemmas = L.lemma_table(chosen) if lemmatise is True else (None if lemmatise is False else lemmatise)
    return preprocess(chosen, lemmas=lemmas, keep_empty=False).select("doc_id", "raw_text", "clean_text")


def word_counts(corpus: DataFrame, n: int | None = 200) -> DataFrame:
    """Most frequent words; counts are combined before the shuffle, so a hot word is one row per task."""
    counts = (
        corpus.select(F.explode(T.words_of(F.col("clean_text"))).alias("word"))
        .groupBy("word").agg(F.count("*").alias("n"))
    )
    return counts.orderBy(F.desc("n"), "word").limit(n) if n else counts


def summary(corpus: DataFrame, approximate: bool = False) -> DataFrame:
    """One row: documents, mean words, distinct words."""
    distinct = F.approx_count_distinct("word") if approximate else F.count_distinct("word")
    vocabulary = corpus.select(F.explode(T.words_of(F.col("clean_text"))).alias("word")).agg(distinct)
    return corpus.agg(
        F.count("*").alias("documents"),
        F.avg(F.size(T.words_of(F.col("clean_text")))).alias("mean_words"),
    ).withColumn("vocabulary", vocabulary.scalar())


def _length_counts(corpus: DataFrame) -> DataFrame:
    return corpus.groupBy(F.size(T.words_of(F.col("clean_text"))).cast("long").alias("words")).agg(
        F.count("*").alias("n")
    )


def median_length(corpus: DataFrame) -> DataFrame:
    """Exact median of the words per document, from the count of each length."""
    return _length_counts(corpus).agg(F.percentile("words", 0.5, F.col("n")).alias("median_words"))


def length_histogram(corpus: DataFrame, bins: int = C.LENGTH_BINS) -> DataFrame:
    """Documents per equal-width bin of word count over [min, max], the last bin closed."""
    lengths = _length_counts(corpus)
    ends = lengths.agg(F.min("words").alias("lo"), F.max("words").alias("hi"))
    span = lengths.agg(F.struct(F.min("words").alias("lo"), F.max("words").alias("hi"))).scalar()
    spread = span["hi"] - span["lo"]
    position = F.floor((F.col("words") - span["lo"]) * bins / F.nullif(spread, F.lit(0)))
    counted = (
        lengths.select(
            "n",
            # A single length sits in the middle of a unit-wide range.
            F.when(spread == 0, F.lit(bins // 2)).otherwise(F.least(position, F.lit(bins - 1))).cast("int").alias("bin"),
        )
        .groupBy("bin").agg(F.sum("n").alias("n"))
    )
    one = F.col("hi") == F.col("lo")
    edges = ends.select(
        F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"),
        F.when(one, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("low"),
        (F.when(one, F.lit(1.0)).otherwise(F.col("hi") - F.col("lo")) / bins).alias("width"),
    )
    return edges.join(counted, "bin", "left").select(
        "bin",
        (F.col("low") + F.col("bin") * F.col("width")).alias("from_words"),
        (F.col("low") + (F.col("bin") + 1) * F.col("width")).alias("to_words"),
        F.coalesce("n", F.lit(0)).cast("long").alias("documents"),
    )
