"""Corpus to fitted models: one vocabulary, vectors stored once per kind, and the models asked for."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from themeloom.functions import constants as C
from themeloom.operators import features as X
from themeloom.operators import lemmas as L
from themeloom.operators.models import TopicModel, fit_model
from themeloom.session import spread

_VECTORS = {"LDA": "counts", "NMF": "tfidf"}


@dataclass
class Fitted:
    vectorizer: X.Vectorizer
    models: dict[str, TopicModel]

    def topic_terms(self, spark: SparkSession) -> DataFrame:
        first, *rest = [m.topic_terms(spark) for m in self.models.values()]
        for df in rest:
            first = first.unionByName(df)
        return first

    def doc_topic(self, corpus: DataFrame) -> DataFrame:
        first, *rest = [m.doc_topic(corpus) for m in self.models.values()]
        for df in rest:
            first = first.unionByName(df)
        return first

    def save(self, spark: SparkSession, path: str) -> None:
        for name, model in self.models.items():
            model.save(spark, f"{path}/{name.lower()}")


def vectors(corpus: DataFrame, vectorizer: X.Vectorizer, name: str) -> DataFrame:
    """The cells that a kind of model is fitted on, `counts` or `tfidf`; the fit stores what it reads more than once."""
    made = vectorizer.cells(spread(corpus.select("clean_text")), _VECTORS[name], weighted=name != "LDA")
    return made.select(_VECTORS[name])


def fit(
    corpus: DataFrame, n_topics: int = C.N_TOPICS, models: list[str] = C.MODELS, seed: int = C.SEED,
    lemmas: DataFrame | None = None, **vocabulary,
) -> Fitted:
    """Fits the named models on a clean corpus; `vocabulary` passes limits to the vectoriser.

    `lemmas` is the table the corpus was lemmatised with; the models keep the part that new texts need.
    """
    vectorizer = X.fit_vectorizer(corpus, **vocabulary)
    pairs = [] if lemmas is None else L.pairs_for(lemmas, list(vectorizer.terms))
    fitted = {name: fit_model(name, vectors(corpus, vectorizer, name), vectorizer, n_topics, seed) for name in models}
    for model in fitted.values():
        model.lemmas = pairs
    return Fitted(vectorizer, fitted)


def load(spark: SparkSession, path: str, models: list[str] = C.MODELS) -> Fitted:
    """Models saved before."""
    loaded = {name: TopicModel.load(spark, f"{path}/{name.lower()}") for name in models}
    return Fitted(next(iter(loaded.values())).vectorizer, loaded)
