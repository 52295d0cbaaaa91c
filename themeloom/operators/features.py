"""Vocabulary, count vectors and TF-IDF vectors over unigrams and bigrams.

The vocabulary is the only thing that crosses the driver, and `max_features` bounds it. Vectors are
made row by row against it, so vectorising a corpus of any size adds no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from themeloom.functions import constants as C
from themeloom.functions import sparse as S
from themeloom.functions import text as T
from themeloom.session import materialise

CELLS = "struct<indices:array<int>,values:array<double>>"
_HEAD_SPARE = 1024  # words read beyond the limit, for those that are in too many documents
_TASK_WORDS = 1 << 20  # words that phrase counting numbers in the tasks; with more, phrases are counted as text


def with_terms(df: DataFrame, ngram_range: tuple[int, int] = (1, 2), text_col: str = "clean_text") -> DataFrame:
    """Adds `terms`, the n-grams that vectorising counts."""
    return df.withColumn("terms", T.vector_terms(F.split(F.col(text_col), " "), ngram_range))


def term_statistics(df: DataFrame, ngram_range: tuple[int, int] = (1, 2), count_documents: bool = False) -> DataFrame:
    """`(term, df, tf)`: documents holding the term and total occurrences; if asked, a null term counts documents.

    Single words are added up per block of texts before they are grouped. For longer terms, sorting a document's terms
    puts repeats side by side, so both numbers come from one explode and one combined aggregate, without grouping by
    document.
    """
    if ngram_range == (1, 1):
        counted = df.select("clean_text").mapInArrow(S.word_counter(2, count_documents), "term string, df long, tf long")
        return counted.groupBy("term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"))

    def mark_first(terms: Column) -> Column:
        return F.transform(
            terms,
            lambda t, i: F.struct(t.alias("term"), F.when(t == F.get(terms, i - 1), 0).otherwise(1).alias("first")),
        )

    marked = T.bind(F.sort_array("terms"), mark_first)
    if count_documents:
        one = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(1).alias("first")))
        marked = F.coalesce(F.concat(marked, one), one)
    return (
        with_terms(df, ngram_range)
        .select(F.inline(marked))
        .groupBy("term")
        .agg(F.sum("first").cast("long").alias("df"), F.count("*").alias("tf"))
    )


def _kept(statistics: DataFrame, documents: int, min_df: int | float, max_df: int | float) -> DataFrame:
    """Terms within the document-frequency limits: integers are documents, floats shares of the corpus."""
    low, high = (documents * limit if isinstance(limit, float) else limit for limit in (min_df, max_df))
    return statistics.where((F.col("df") >= low) & (F.col("df") <= high))


def _phrase_counter(words: list[str], size: int):
    """`(code, df, tf)` of phrases of `size` neighbouring words, all of the given ones, added up per block of texts.

    Words are numbered and a phrase is one number, so that no text of a phrase is built, grouped or sent.
    """
    held = pa.array(words, pa.string())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in (block for batch in batches for block in S.text_blocks(batch.column(0))):
            texts = pc.split_pattern(pc.fill_null(block, ""), " ")
            flat, ends = pc.list_flatten(texts), texts.offsets.to_numpy()
            # One-letter words are no terms: their neighbours are next to each other.
            long = pc.greater_equal(pc.utf8_length(flat), 2).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(texts)), np.diff(ends))[long]
            code = pc.fill_null(pc.index_in(flat.filter(pa.array(long)), value_set=held), -1).to_numpy().astype(np.int64)
            if len(code) < size:
                continue
            phrase, whole = np.zeros(len(code) - size + 1, np.int64), np.ones(len(code) - size + 1, bool)
            for k in range(size):
                part = slice(k, len(code) - size + 1 + k)
                phrase = phrase * len(words) + code[part]
                whole &= (code[part] >= 0) & (row[part] == row[: len(whole)])
            phrase, row = phrase[whole], row[: len(whole)][whole]
            order = np.lexsort((row, phrase))
            phrase, row = phrase[order], row[order]
            if not len(phrase):
                continue
            first = np.concatenate([[True], phrase[1:] != phrase[:-1]])
            fresh = first | np.concatenate([[True], row[1:] != row[:-1]])
            starts = np.flatnonzero(first)
            yield pa.RecordBatch.from_arrays(
                [pa.array(phrase[starts]), pa.array(np.add.reduceat(fresh.astype(np.int64), starts)), pa.array(np.diff(np.append(starts, len(phrase))))],
                ["code", "df", "tf"],
            )

    return count


def _phrases(df: DataFrame, words: list[str], size: int) -> DataFrame:
    """`(term, df, tf)` of phrases of `size` words, each of them one of `words`."""
    counted = (
        df.select("clean_text").mapInArrow(_phrase_counter(words, size), "code long, df long, tf long")
        .groupBy("code").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"))
    )
    listed = df.sparkSession.createDataFrame(pa.table({"_id": pa.array(range(len(words)), pa.int64()), "_word": pa.array(words, pa.string())}), "_id long, _word string")
    spelled, names = counted, []
    for k in range(size):
        names.append(f"_word{k}")
        place = F.floor(F.col("code") / F.lit(len(words) ** (size - 1 - k)).cast("decimal(38,0)")).cast("long") % len(words)
        spelled = spelled.withColumn("_id", place).join(listed.withColumnRenamed("_word", names[-1]), "_id").drop("_id")
    return spelled.select(F.concat_ws(" ", *names).alias("term"), "df", "tf")


def counted_vocabulary(
    df: DataFrame,
    max_features: int | None = C.MAX_FEATURES,
    min_df: int | float = C.MIN_DF,
    max_df: int | float = C.MAX_DF,
    ngram_range: tuple[int, int] = (1, 2),
) -> tuple[DataFrame, int]:
    """The vocabulary and the number of documents, in two reads of the corpus.

    Words are counted first, documents in the same pass. A phrase occurs at most as often, and in at most as many
    documents, as the rarest of its words; so once `max_features` words fit, a phrase can only enter if all its words
    reach the total of the last of them. Only phrases of such words are counted at all.
    """
    low, high = ngram_range
    stored = materialise(term_statistics(df, (1, 1), count_documents=True), "word-counts")
    words = stored.where("term IS NOT NULL")
    # The row that counts documents comes first, then the most frequent words: usually all that is to be known here.
    size_of_head = 1 + (max_features or 0) + _HEAD_SPARE
    head = stored.orderBy(F.col("term").isNotNull(), F.desc("tf"), "term").limit(size_of_head).toArrow().to_pylist()
    documents = head.pop(0)["df"] if head and head[0]["term"] is None else 0
    fit = _kept(words, documents, min_df, max_df)
    fewest, most = (documents * limit if isinstance(limit, float) else limit for limit in (min_df, max_df))
    least = 0
    if max_features and low == 1:
        totals = [r["tf"] for r in head if fewest <= r["df"] <= most]
        if len(totals) < max_features and len(head) + 1 == size_of_head:
            totals = [r["tf"] for r in fit.orderBy(F.desc("tf"), "term").limit(max_features).select("tf").collect()]
        least = totals[max_features - 1] if len(totals) >= max_features else 0
    found = fit if low == 1 else None
    if high > 1:
        if len(head) + 1 < size_of_head or (head and head[-1]["tf"] < least):
            frequent = [r["term"] for r in head if r["tf"] >= least and r["df"] >= fewest]
        else:
            listed = words.where((F.col("tf") >= least) & (F.col("df") >= fewest)).select("term")
            frequent = listed.limit(_TASK_WORDS + 1).toArrow()["term"].to_pylist()
        for size in range(max(low, 2), high + 1):
            fits = len(frequent) <= _TASK_WORDS and len(frequent) ** size < 1 << 62
            phrases = _phrases(df, sorted(frequent), size) if fits and frequent else term_statistics(df, (size, size))
            phrases = _kept(phrases, documents, min_df, max_df)
            found = phrases if found is None else found.unionByName(phrases)
    if max_features:
        found = found.orderBy(F.desc("tf"), "term").limit(max_features)
    ranked = (F.row_number().over(Window.orderBy("term")) - 1).cast("int")
    return found.select(ranked.alias("term_id"), "term", "df", "tf"), documents


def vocabulary(
    df: DataFrame,
    max_features: int | None = C.MAX_FEATURES,
    min_df: int | float = C.MIN_DF,
    max_df: int | float = C.MAX_DF,
    ngram_range: tuple[int, int] = (1, 2),
) -> DataFrame:
    """`(term_id, term, df, tf)`: document-frequency limits first, then the most frequent terms.

    Integers are document counts and floats are fractions of the corpus. Ids follow term order.
    """
    return counted_vocabulary(df, max_features, min_df, max_df, ngram_range)[0]


def _cell_maker(terms: list[str], ngram_range: tuple[int, int], idf: np.ndarray | None):
    """Texts to the cells of their sparse rows: counts of the terms in term order, with `idf` normalised TF-IDF."""
    words = sorted({w for term in terms for w in term.split(" ")})
    number = {w: k for k, w in enumerate(words)}
    held = pa.array(words, pa.string())
    by_size: dict[int, dict[int, int]] = {}
    for k, term in enumerate(terms):
        code, parts = 0, term.split(" ")
        for w in parts:
            code = code * len(words) + number[w]
        if ngram_range[0] <= len(parts) <= ngram_range[1]:
            by_size.setdefault(len(parts), {})[code] = k
    tables = {}
    for size, ids in by_size.items():
        codes = np.array(sorted(ids), np.int64)
        tables[size] = codes, np.array([ids[c] for c in codes.tolist()], np.int64)

    def make_block(block: pa.Array) -> pa.Array:
        flat, row = S.block_words(block, 2)
        code = pc.fill_null(pc.index_in(flat, value_set=held), -1).to_numpy().astype(np.int64)
        found = [np.zeros(0, np.int64)]
        for size, (codes, ids) in tables.items():
            many = len(code) - size + 1
            if many <= 0:
                continue
            phrase, whole = np.zeros(many, np.int64), np.ones(many, bool)
            for k in range(size):
                part = slice(k, many + k)
                phrase = phrase * len(words) + code[part]
                whole &= (code[part] >= 0) & (row[part] == row[:many])
            phrase, at_row = phrase[whole], row[:many][whole]
            at = np.minimum(np.searchsorted(codes, phrase), len(codes) - 1)
            hit = codes[at] == phrase
            found.append(at_row[hit] * len(terms) + ids[at[hit]])
        cell, values = np.unique(np.concatenate(found), return_counts=True)
        row, column = np.divmod(cell, max(len(terms), 1))
        values = values.astype(np.float64)
        if idf is not None:
            values *= idf[column]
            norm = np.sqrt(np.bincount(row, weights=values * values, minlength=len(block)))
            values /= np.where(norm == 0, 1.0, norm)[row]
        ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(block)))]).astype(np.int32))
        return pa.StructArray.from_arrays(
            [pa.ListArray.from_arrays(ends, pa.array(column.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(values))],
            ["indices", "values"],
        )

    def make(texts: pa.Array) -> pa.Array:
        return pa.concat_arrays([make_block(block) for block in S.text_blocks(texts)] or [make_block(texts)])

    return make


@dataclass
class Vectorizer:
    """A fitted vocabulary with document frequencies; makes count and TF-IDF vectors."""

    terms: list[str]
    df: list[int]
    documents: int
    ngram_range: tuple[int, int] = (1, 2)
    _model: CountVectorizerModel | None = field(default=None, repr=False, compare=False)

    @property
    def idf(self) -> np.ndarray:
        return np.log((1.0 + self.documents) / (1.0 + np.asarray(self.df, dtype=float))) + 1.0

    def counts(self, df: DataFrame, output: str = "counts") -> DataFrame:
        """Adds the sparse count vector; terms outside the vocabulary are ignored."""
        if self._model is None:
            self._model = CountVectorizerModel.from_vocabulary(self.terms, "terms", "counts")
        model = self._model.copy({self._model.outputCol: output})
        return model.transform(with_terms(df, self.ngram_range)).drop("terms")

    def tfidf(self, df: DataFrame, output: str = "tfidf") -> DataFrame:
        """Adds the sparse row-normalised TF-IDF vector."""
        scaled = ElementwiseProduct(
            scalingVec=Vectors.dense(self.idf), inputCol="_counts", outputCol="_scaled"
        ).transform(self.counts(df, "_counts"))
        return Normalizer(p=2.0, inputCol="_scaled", outputCol=output).transform(scaled).drop("_counts", "_scaled")

    def cells(self, df: DataFrame, output: str, weighted: bool) -> DataFrame:
        """Adds the `indices` and `values` of the same vectors as one struct, TF-IDF if weighted, else counts.

        For steps that need no vector column: words are numbered, a phrase is one number, and no text of a term is built.
        """
        size = len({w for term in self.terms for w in term.split(" ")})
        if size ** self.ngram_range[1] >= 1 << 62:
            made = self.tfidf(df, "_made") if weighted else self.counts(df, "_made")
            indices, values = cells("_made")
            return made.withColumn(output, F.struct(indices.alias("indices"), values.alias("values"))).drop("_made")
        made = F.arrow_udf(_cell_maker(self.terms, self.ngram_range, self.idf if weighted else None), CELLS)("clean_text")
        # The array of one is a barrier: what reads the cells sees a plain column, and they are made once.
        return df.select("*", F.explode(F.array(made)).alias(output))

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, t, int(d)) for i, (t, d) in enumerate(zip(self.terms, self.df))]
        return spark.createDataFrame(rows, "term_id int, term string, df long")


def fit_vectorizer(
    corpus: DataFrame,
    max_features: int | None = C.MAX_FEATURES,
    min_df: int | float = C.MIN_DF,
    max_df: int | float = C.MAX_DF,
    ngram_range: tuple[int, int] = (1, 2),
) -> Vectorizer:
    """Runs the vocabulary aggregate and keeps its rows, at most `max_features` of them."""
    table, documents = counted_vocabulary(corpus, max_features, min_df, max_df, ngram_range)
    rows = table.orderBy("term_id").collect()
    if not rows:
        raise ValueError("no terms remain: lower min_df or raise max_df")
    return Vectorizer([r["term"] for r in rows], [r["df"] for r in rows], documents, ngram_range)


def cells(vector_col: str) -> tuple[Column, Column]:
    """Index and value arrays of a sparse vector column."""
    parts = F.unwrap_udt(vector_col)
    return parts["indices"], parts["values"]


def known_terms(vector_col: str) -> Column:
    """Number of vocabulary terms in the row; zero marks a text the model cannot place."""
    return F.size(F.unwrap_udt(vector_col)["indices"])


def long_form(df: DataFrame, vector_col: str, id_col: str = "doc_id") -> DataFrame:
    """`(doc_id, term_id, value)` of the stored cells; a narrow step."""
    indices, values = cells(vector_col)
    return df.select(id_col, F.explode(F.arrays_zip(indices.alias("term_id"), values.alias("value"))).alias("c")).select(
        id_col, "c.term_id", "c.value"
    )


def term_frequency(df: DataFrame, vector_col: str) -> DataFrame:
    """Column sums of the document-term matrix, `(term_id, frequency)`."""
    return long_form(df, vector_col).groupBy("term_id").agg(F.sum("value").alias("frequency"))
