"""A fitted topic model: vectoriser, topic-term weights, inference, and persistence as tables."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.functions import constants as C
from themeloom.operators import features as X
from themeloom.operators import lda, nmf

TOPIC_TERM_SCHEMA = "model string, topic int, term string, weight double"


@dataclass
class TopicModel:
    name: str
    vectorizer: X.Vectorizer
    topic_term: np.ndarray  # topics x terms, bounded by the vocabulary limit
    objective: list[float] | None = None
    lemmas: list[tuple[str, str]] = field(default_factory=list)  # words of new texts to put in place, bounded by the terms

    @property
    def n_topics(self) -> int:
        return self.topic_term.shape[0]

    def vectors(self, df: DataFrame, output: str = "vector") -> DataFrame:
        """Counts for LDA, TF-IDF for NMF."""
        return self.vectorizer.counts(df, output) if self.name == "LDA" else self.vectorizer.tfidf(df, output)

    def infer(self, df: DataFrame) -> DataFrame:
        """Adds `known_terms`, `length` (row sum of the model's own matrix) and `weights`; no shuffle."""
        made = self.vectorizer.cells(df, "_cells", weighted=self.name != "LDA")
        indices, values = F.col("_cells")["indices"], F.col("_cells")["values"]
        measured = made.withColumn("known_terms", F.size(indices)).withColumn(
            "length", F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
        )
        weights = (lda if self.name == "LDA" else nmf).infer(indices, values, self.topic_term)
        return measured.withColumn("weights", weights).drop("_cells")

    def doc_topic(self, corpus: DataFrame, id_col: str = "doc_id") -> DataFrame:
        """`(model, doc_id, length, weights)` for a corpus."""
        return self.infer(corpus.select(id_col, "clean_text")).select(
            F.lit(self.name).alias("model"), id_col, "length", "weights"
        )

    def topic_terms(self, spark: SparkSession) -> DataFrame:
        """`(model, topic, term, weight)`, topics x vocabulary rows."""
        k, v = self.topic_term.shape
        table = pa.table({
            "model": pa.array([self.name] * (k * v)),
            "topic": pa.array(np.repeat(np.arange(k, dtype=np.int32), v)),
            "term": pa.array(list(self.vectorizer.terms) * k),
            "weight": pa.array(self.topic_term.ravel().astype(float)),
        })
        return spark.createDataFrame(table, TOPIC_TERM_SCHEMA)

    def save(self, spark: SparkSession, path: str) -> None:
        v = self.vectorizer
        v.table(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/vocabulary")
        spark.createDataFrame(
            [(i, row.tolist()) for i, row in enumerate(self.topic_term)], "topic int, weights array<double>"
        ).coalesce(1).write.mode("overwrite").parquet(f"{path}/topic_term")
        spark.createDataFrame(
            [(self.name, v.documents, list(v.ngram_range))], "name string, documents long, ngrams array<int>"
        ).coalesce(1).write.mode("overwrite").parquet(f"{path}/about")
        spark.createDataFrame(self.lemmas, "word string, lemma string").coalesce(1).write.mode("overwrite").parquet(f"{path}/lemmas")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TopicModel:
        about = spark.read.parquet(f"{path}/about").first()
        words = spark.read.parquet(f"{path}/vocabulary").orderBy("term_id").collect()
        topics = spark.read.parquet(f"{path}/topic_term").orderBy("topic").collect()
        vectorizer = X.Vectorizer(
            [w["term"] for w in words], [w["df"] for w in words], about["documents"], tuple(about["ngrams"])
        )
        lemmas = [(r["word"], r["lemma"]) for r in spark.read.parquet(f"{path}/lemmas").orderBy("word").collect()]
        return cls(about["name"], vectorizer, np.asarray([t["weights"] for t in topics]), lemmas=lemmas)


def fit_models(
    name: str, vectored: DataFrame, vectorizer: X.Vectorizer, topics: Iterable[int], seed: int = C.SEED
) -> dict[int, TopicModel]:
    """Fits one kind of model for each number of topics on rows that hold the cells of `counts` (LDA) or `tfidf` (NMF)."""
    width = len(vectorizer.terms)
    column = "counts" if name == "LDA" else "tfidf"
    indices, values = F.col(column)["indices"], F.col(column)["values"]
    if name == "LDA":
        found = lda.fit_many(vectored, indices, values, width, topics, seed, leaps=True)
        return {k: TopicModel("LDA", vectorizer, t) for k, t in found.items()}
    found = nmf.fit_many(vectored, indices, values, width, topics, seed)
    return {k: TopicModel("NMF", vectorizer, f.topic_term, objective=f.objective) for k, f in found.items()}


def fit_model(
    name: str, vectored: DataFrame, vectorizer: X.Vectorizer, n_topics: int = C.N_TOPICS, seed: int = C.SEED
) -> TopicModel:
    """Fits one model on rows that hold the cells of `counts` (LDA) or `tfidf` (NMF)."""
    return fit_models(name, vectored, vectorizer, [n_topics], seed)[n_topics]
