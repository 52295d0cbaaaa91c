"""Fits and the sweep read stored tables: no executor holds rows in its memory between scans."""

import numpy as np
import pytest
from pyspark.sql.classic.dataframe import DataFrame

from themeloom.plans import evaluation, training


@pytest.fixture
def corpus(spark):
    rng = np.random.default_rng(8)
    words = [[f"{theme}{chr(97 + k)}word" for k in range(12)] for theme in ("bank", "card", "loan")]
    rows = [(i, " ".join(rng.choice(words[i % 3], 15))) for i in range(90)] + [(90, "unseen"), (91, "")]
    return spark.createDataFrame(rows, "doc_id long, clean_text string")


def _held(monkeypatch):
    kept = []
    for name in ("persist", "cache"):
        monkeypatch.setattr(DataFrame, name, lambda self, *a, f=getattr(DataFrame, name), **b: kept.append(self.columns) or f(self, *a, **b))
    return kept


def test_a_fit_holds_no_rows_in_memory(corpus, monkeypatch):
    kept = _held(monkeypatch)
    fitted = training.fit(corpus, n_topics=3, min_df=2)
    assert not kept, kept
    for model in fitted.models.values():
        assert model.topic_term.shape == (3, len(fitted.vectorizer.terms))
        best = np.argmax(model.topic_term, axis=0)
        themes = {}
        for term, topic in zip(fitted.vectorizer.terms, best):
            if " " not in term:
                themes.setdefault(term[:4], set()).add(int(topic))
        assert all(len(t) == 1 for t in themes.values()) and len(set.union(*themes.values())) == 3


def test_the_sweep_holds_no_rows_in_memory(corpus, monkeypatch):
    kept = _held(monkeypatch)
    found = evaluation.sweep(corpus, topics=[2, 3], min_df=2).collect()
    assert not kept, kept
    assert [r["n_topics"] for r in found] == [2, 3]
    assert all(-1 <= r[c] <= 1 for r in found for c in ("lda_coherence", "nmf_coherence"))
