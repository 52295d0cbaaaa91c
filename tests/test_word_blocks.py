"""Words counted and weighed per block of texts: the same numbers as from texts of terms."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from themeloom.functions import sparse as S
from themeloom.operators import features as V
from themeloom.operators import lemmas as LM
from themeloom.operators.models import TopicModel

TEXTS = ["", None, "a", "loan fee loan", "fee a loan fee", "late  fee", " late", "été fee é loan", "unknown words only"]


def _frame(spark, texts):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id int, clean_text string").repartition(3)


def _drawn(seed, many):
    draw = random.Random(seed)
    words = ["loan", "fee", "late", "card", "x", "été", "bank", "rate"]
    return [" ".join(draw.choices(words, k=draw.randint(0, 12))) for _ in range(many)]


def _by_hand(texts):
    tf, df = Counter(), Counter()
    for text in texts:
        words = [w for w in (text or "").split(" ") if len(w) >= 2]
        tf.update(words)
        df.update(set(words))
    return {w: (df[w], tf[w]) for w in tf}


def test_word_statistics_match_a_count_by_hand(spark):
    texts = TEXTS + _drawn(1, 60)
    found = {r["term"]: (r["df"], r["tf"]) for r in V.term_statistics(_frame(spark, texts), (1, 1), count_documents=True).collect()}
    assert found.pop(None) == (len(texts), len(texts))
    assert found == _by_hand(texts)
    assert None not in {r["term"] for r in V.term_statistics(_frame(spark, texts), (1, 1)).collect()}


@pytest.mark.parametrize("block", [1, 40, 1 << 22])
def test_counts_do_not_depend_on_the_size_of_blocks(monkeypatch, block):
    monkeypatch.setattr(S, "TEXT_AT_ONCE", block)
    texts, df, tf = TEXTS + _drawn(3, 40), Counter(), Counter()
    for part in S.word_counter(2)(pa.RecordBatch.from_arrays([pa.array(texts[k : k + 9])], ["t"]) for k in range(0, len(texts), 9)):
        for term, d, t in zip(*[column.to_pylist() for column in part.columns]):
            df[term] += d
            tf[term] += t
    assert {w: (df[w], tf[w]) for w in tf} == _by_hand(texts)


def test_lexicon_counts_documents_of_every_word(spark):
    raw = spark.createDataFrame([("A fee, a FEE!",), ("a loan",), (None,), ("12 ...",)], "raw_text string")
    assert {r["word"]: r["df"] for r in LM.lexicon_of(raw).collect()} == {"a": 2, "fee": 1, "loan": 1}


@pytest.mark.parametrize("ngrams", [(1, 1), (1, 2), (2, 3)])
def test_cells_are_those_of_the_vectors(spark, ngrams):
    texts = [t for t in TEXTS if t is not None] + _drawn(2, 80)
    terms = ["bank", "card loan", "fee", "fee late", "late", "loan", "loan  fee", "loan fee", "loan fee late", "x", "été"]
    vectorizer = V.Vectorizer(terms, list(range(3, 3 + len(terms))), 90, ngrams)
    frame = _frame(spark, texts)
    for weighted in (False, True):
        made = (vectorizer.tfidf if weighted else vectorizer.counts)(frame, "v")
        want = {r["doc_id"]: (r["v"].indices.tolist(), r["v"].values.tolist()) for r in made.collect()}
        got = {r["doc_id"]: (list(r["c"]["indices"]), list(r["c"]["values"])) for r in vectorizer.cells(frame, "c", weighted).collect()}
        assert got == want


def test_inference_builds_no_text_of_terms(spark):
    model = TopicModel("NMF", V.Vectorizer(["fee", "fee loan"], [2, 1], 4), np.eye(2))
    inferred = model.infer(_frame(spark, TEXTS))
    assert "concat_ws" not in inferred._jdf.queryExecution().optimizedPlan().toString()
    rows = {r["doc_id"]: r for r in inferred.collect()}
    assert rows[0]["known_terms"] == rows[1]["known_terms"] == 0 and list(rows[1]["weights"]) == [0.0, 0.0]
    assert rows[4]["known_terms"] == 2 and rows[5]["known_terms"] == 1
