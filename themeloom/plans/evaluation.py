"""Quality numbers of fitted models, and the sweep over the number of topics."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.functions import constants as C
from themeloom.operators import coherence as H
from themeloom.operators import features as X
from themeloom.operators import topics as TP
from themeloom.operators.models import fit_models
from themeloom.plans.training import Fitted, vectors
from themeloom.session import materialise


def final_metrics(fitted: Fitted, corpus: DataFrame) -> DataFrame:
    """`(Metric, LDA, NMF)`: coherence and diversity of the models' top words, to four decimals."""
    terms = TP.top_terms(fitted.topic_terms(corpus.sparkSession))
    measured = H.coherence_cv(terms, corpus).join(TP.diversity(terms), "model")
    # The metric names of the published table.
    named = measured.select(
        "model",
        F.explode(F.create_map(F.lit("Topic Coherence (c_v)"), "coherence", F.lit("Topic Diversity"), "diversity"))
        .alias("Metric", "value"),
    )
    return named.groupBy("Metric").pivot("model", sorted(C.MODELS)).agg(F.bround(F.first("value"), 4))


def sweep(
    corpus: DataFrame, topics: Iterable[int] = C.SWEEP_RANGE, models: list[str] = C.MODELS, seed: int = C.SEED, **vocabulary
) -> DataFrame:
    """`(n_topics, lda_coherence, nmf_coherence)` for every number of topics.

    The corpus is written once. All fits share one vocabulary, and all fits of a kind the same stored vectors and scans: a
    scan updates the topics of every number of topics. One pass over the corpus then counts the windows for every fit
    together.
    """
    spark = corpus.sparkSession
    corpus = materialise(corpus.select("doc_id", "clean_text"), "corpus")
    vectorizer = X.fit_vectorizer(corpus, **vocabulary)
    found = []
    for name in models:
        for k, fitted in fit_models(name, vectors(corpus, vectorizer, name), vectorizer, topics, seed).items():
            best = np.argsort(-fitted.topic_term, axis=1, kind="stable")[:, : C.TOP_WORDS]
            found += [(f"{name}:{k}", t, vectorizer.terms[i]) for t, row in enumerate(best) for i in row]
    terms = spark.createDataFrame(found, "model string, topic int, term string")
    scored = H.coherence_cv(terms, corpus)
    split = F.split("model", ":")
    wide = scored.select(
        split[1].cast("int").alias("n_topics"), F.concat(F.lower(split[0]), F.lit("_coherence")).alias("m"), "coherence"
    ).groupBy("n_topics").pivot("m", [f"{m.lower()}_coherence" for m in sorted(models)]).agg(F.first("coherence"))
    return spark.createDataFrame(wide.orderBy("n_topics").toArrow(), wide.schema)
