import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from themeloom.functions import constants as C
from themeloom.functions import sparse as S
from themeloom.operators import coherence as H
from themeloom.operators import features as V
from themeloom.operators import lda as LDA
from themeloom.operators import nmf
from themeloom.operators import scoring as SC
from themeloom.operators import topics as TP
from themeloom.operators import topicmap as TM
from themeloom.operators.models import TopicModel
from themeloom.plans import evaluation, training
from themeloom.streaming import scoring as streaming

THEMES = [["loan", "bank", "rate", "mortgage"], ["phone", "calls", "work", "stop"], ["theft", "police", "identity", "stolen"]]


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice(THEMES[i % 3], 12)), i % 3) for i in range(180)]
    return spark.createDataFrame(rows, "doc_id long, clean_text string, theme int").persist()


@pytest.fixture(scope="module")
def fitted(planted):
    return training.fit(planted.select("doc_id", "clean_text"), n_topics=3)


def test_vocabulary_limits(spark):
    docs = ["a1 b1 a1", "a1 c1", "a1 b1", "a1 zz"]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, clean_text string")
    got = {r["term"]: (r["df"], r["tf"]) for r in V.vocabulary(df, min_df=1, max_df=1.0).collect()}
    assert got["a1"] == (4, 5) and got["b1 a1"] == (1, 1)
    assert {r["term"] for r in V.vocabulary(df, min_df=2, max_df=0.9).collect()} == {"a1 b1", "b1"}
    assert [r["term"] for r in V.vocabulary(df, max_features=2, min_df=1, max_df=1.0).orderBy("term_id").collect()] == ["a1", "a1 b1"]


def test_vocabulary_counts_only_phrases_that_can_enter(spark):
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(40)] + ["q", "é"]  # one-letter words are no terms
    docs = [" ".join(rng.choice(words, rng.integers(0, 30), p=(p := 1 / np.arange(1, 43)) / p.sum())) for _ in range(300)] + ["w0"] * 40 + [""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(docs)] + [(900, None)], "doc_id long, clean_text string").repartition(3)

    def brute(limit, low_df, high_df, sizes):
        total, held, n = {}, {}, len(docs) + 1
        for d in docs:
            kept = [w for w in d.split(" ") if len(w) >= 2]
            terms = [" ".join(kept[i : i + s]) for s in range(sizes[0], sizes[1] + 1) for i in range(len(kept) - s + 1)]
            for t in terms:
                total[t] = total.get(t, 0) + 1
            for t in set(terms):
                held[t] = held.get(t, 0) + 1
        floor, cap = (x * n if isinstance(x, float) else x for x in (low_df, high_df))
        fit = sorted((t for t in total if floor <= held[t] <= cap), key=lambda t: (-total[t], t))[:limit]
        return [(t, held[t], total[t]) for t in sorted(fit)]

    for limit, low_df, high_df, sizes in ((25, 2, 0.9, (1, 2)), (60, 0.02, 0.3, (1, 3)), (None, 3, 1.0, (1, 2)), (5, 1, 0.9, (2, 2)), (2000, 1, 200, (1, 2)), (12, 5, 0.9, (1, 1))):
        for spare in (1024, 0):
            V._HEAD_SPARE = spare
            table, documents = V.counted_vocabulary(df, limit, low_df, high_df, sizes)
            got = [(r["term"], r["df"], r["tf"]) for r in table.orderBy("term_id").collect()]
            assert got == brute(limit, low_df, high_df, sizes) and documents == len(docs) + 1
    V._HEAD_SPARE = 1024
    assert V.vocabulary(df.where("false")).count() == 0


def test_tfidf_rows_have_unit_length(planted, fitted):
    vectored = V.long_form(fitted.vectorizer.tfidf(planted), "tfidf")
    norms = vectored.groupBy("doc_id").agg(F.sum(F.col("value") ** 2).alias("n")).agg(F.min("n"), F.max("n")).first()
    assert norms[0] == pytest.approx(1) and norms[1] == pytest.approx(1)


@pytest.mark.parametrize("name", ["NMF", "LDA"])
def test_planted_topics_are_found(planted, fitted, name):
    placed = TP.assign(fitted.models[name].doc_topic(planted)).join(planted, "doc_id")
    pairs = placed.select("topic", "theme").distinct().collect()
    assert len(pairs) == 3 and len({p["topic"] for p in pairs}) == 3


def test_lda_steps_follow_the_update_rule(spark):
    rng = np.random.default_rng(2)
    docs = [np.sort(rng.choice(9, rng.integers(0, 6), replace=False)) for _ in range(40)]
    rows = [(d.tolist(), rng.integers(1, 4, len(d)).astype(float).tolist()) for d in docs] + [([0, 1], [2.0, 1.0])] * 60
    df = spark.createDataFrame(rows, "i array<int>, v array<double>").repartition(3)
    xs = np.array([1e-3, 0.1, 1.0, 2.5, 30.0, 1e4])
    np.testing.assert_allclose(LDA.digamma(xs), [(math.lgamma(x * (1 + 1e-6)) - math.lgamma(x * (1 - 1e-6))) / (2e-6 * x) for x in xs], rtol=1e-4, atol=1e-4)
    fitted = LDA.fit_many(df, F.col("i"), F.col("v"), 9, [2, 3], passes=2, fraction=1.0)
    for k in (2, 3):
        topics = np.random.default_rng([C.SEED, k]).gamma(100.0, 0.01, (k, 9))
        for step in (1, 2):
            words, counts = LDA.expected_log(topics), np.zeros((k, 9))
            for idx, val in rows:
                gamma, b, val = np.ones(k), words[:, idx], np.array(val)
                for _ in range(100 * bool(len(idx))):
                    mix = LDA.expected_log(gamma[None])[0]
                    new = 1 / k + mix * (b @ (val / (mix @ b + 1e-100)))
                    done, gamma = np.abs(new - gamma).mean() <= 1e-3, new
                    if done:
                        break
                if len(idx):
                    mix = LDA.expected_log(gamma[None])[0]
                    counts[:, idx] += np.outer(mix, val / (mix @ b + 1e-100))
            rate = (C.LDA_OFFSET + step) ** -C.LDA_DECAY
            topics = (1 - rate) * topics + rate * (1 / k + counts * words)
        np.testing.assert_allclose(fitted[k], topics, rtol=1e-8)


def test_lda_batches_are_read_apart_and_a_broken_fit_goes_on(spark, tmp_path):
    rows = [([k % 7, 7], [1.0, 2.0]) for k in range(400)]
    df = spark.createDataFrame(rows, "i array<int>, v array<double>")
    whole = LDA.fit_lda(df, F.col("i"), F.col("v"), 8, 2, passes=4, fraction=0.25, state=str(tmp_path / "a"))
    assert LDA.steps(4, 0.25) == 16
    part = dict(passes=2, fraction=0.25, state=str(tmp_path / "b"))
    LDA.fit_lda(df, F.col("i"), F.col("v"), 8, 2, **part)
    resumed = LDA.fit_lda(df, F.col("i"), F.col("v"), 8, 2, **(part | {"passes": 4}))
    np.testing.assert_allclose(whole, resumed, rtol=1e-9)


def test_stacked_fits_equal_single_ones(planted, fitted):
    vectored = fitted.vectorizer.tfidf(planted.select("doc_id", "clean_text"), "tfidf")
    width = len(fitted.vectorizer.terms)
    together = nmf.fit_many(vectored, *V.cells("tfidf"), width, [2, 3], init="random")
    for k in (2, 3):
        alone = nmf.fit_nmf(vectored, *V.cells("tfidf"), width, k, init="random")
        np.testing.assert_allclose(together[k].topic_term, alone.topic_term, atol=1e-8)
        assert together[k].iterations == alone.iterations


def test_objective_never_rises(fitted):
    objective = fitted.models["NMF"].objective
    assert all(b <= a + 1e-9 for a, b in itertools.pairwise(objective))


def test_least_squares_meets_its_optimality_conditions():
    rng = np.random.default_rng(0)
    h = np.abs(rng.standard_normal((5, 40)))
    x = np.abs(rng.standard_normal((30, 40)))
    gram, target = h @ h.T, x @ h.T
    w = S.non_negative_least_squares(target, gram)
    gradient = w @ gram - target
    assert (w >= 0).all() and gradient.min() > -1e-5 and np.abs(w * gradient).max() < 1e-5


def test_row_blocks_cover_every_row(monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(S, "CELLS_AT_ONCE", 4)
    idx = pa.array([[0, 1], [], [2], [0, 1, 2, 3, 4, 5], [1]], pa.list_(pa.int32()))
    val = pa.array([[1.0, 2.0], [], [3.0], [1.0] * 6, [5.0]], pa.list_(pa.float64()))
    dense = np.eye(6)
    whole = np.vstack([S.times(r, dense) for r in S.row_blocks(idx, val)])
    assert whole.shape == (5, 6) and whole.sum() == 17 and whole[2, 2] == 3 and whole[4, 1] == 5


def test_fits_do_not_depend_on_the_number_of_partitions(planted, fitted):
    vectored = fitted.vectorizer.tfidf(planted.select("doc_id", "clean_text"), "tfidf")
    fits = [nmf.fit_nmf(vectored.repartition(n), *V.cells("tfidf"), len(fitted.vectorizer.terms), 3).topic_term for n in (1, 7)]
    np.testing.assert_allclose(fits[0], fits[1], atol=1e-6)


@pytest.mark.parametrize("name", ["NMF", "LDA"])
def test_new_texts_are_lemmatised_as_in_training(spark, planted, name, tmp_path):
    table = spark.createDataFrame([("mortgages", "mortgage"), ("cats", "cat")], "word string, lemma string")
    model = training.fit(planted.select("doc_id", "clean_text"), n_topics=3, models=[name], lemmas=table).models[name]
    assert model.lemmas == [("mortgages", "mortgage")]
    model.save(spark, str(tmp_path))
    upload = spark.createDataFrame([("mortgages",), ("mortgage",)], "t string")
    labels = spark.createDataFrame([], "model string, topic int, name string, style string")
    plural, singular = (tuple(r)[1:] for r in SC.score_upload(upload, "t", TopicModel.load(spark, str(tmp_path)), labels).collect())
    assert plural == singular and plural[1] > 0.5
    spoken = spark.createDataFrame([("a", 1.0, "mortgages", ""), ("b", 1.0, "mortgage", "")], SC.TRANSCRIPT_SCHEMA)
    rows = SC.score_transcripts(spoken, model, labels).orderBy("recording").collect()
    assert rows[0]["topic_number"] == rows[1]["topic_number"] is not None and rows[0]["confidence"] == rows[1]["confidence"]


def test_unknown_texts(spark, fitted):
    df = spark.createDataFrame([(1, "loan rate"), (2, "zebra"), (3, None)], "id int, text string")
    nmf_rows = {r["id"]: r for r in SC.place(SC.infer_texts(df, "text", fitted.models["NMF"])).collect()}
    lda_rows = {r["id"]: r for r in SC.place(SC.infer_texts(df, "text", fitted.models["LDA"])).collect()}
    assert nmf_rows[1]["known_terms"] > 0 and nmf_rows[2]["known_terms"] == 0
    assert (nmf_rows[2]["topic"], nmf_rows[2]["confidence"], nmf_rows[3]["confidence"]) == (0, 0.0, 0.0)
    assert lda_rows[2]["weights"] == pytest.approx([1 / 3] * 3) and sum(lda_rows[1]["weights"]) == pytest.approx(1)
    ok = {r["id"]: (r["ok"], r["topic"] is None) for r in SC.classify(SC.infer_texts(df, "text", fitted.models["NMF"])).collect()}
    assert ok == {1: (True, False), 2: (False, True), 3: (False, True)}


def test_uploads_keep_columns_of_any_name(spark, fitted):
    df = spark.createDataFrame([("loan rate bank", "mine", 7, 1)], "`my text` string, topic string, model int, length int")
    labels = spark.createDataFrame([], "model string, topic int, name string, style string")
    row = SC.score_upload(df, "my text", fitted.models["NMF"], labels).first()
    assert (row["my text"], row["topic"], row["model"], row["length"]) == ("loan rate bank", "mine", 7, 1)
    assert row["assigned_topic"].startswith("Topic ") and 0 < row["confidence"] <= 1


def test_models_survive_saving(spark, planted, fitted, tmp_path):
    fitted.save(spark, str(tmp_path))
    again = training.load(spark, str(tmp_path))
    for name in ("NMF", "LDA"):
        a = {r["doc_id"]: r["weights"] for r in fitted.models[name].doc_topic(planted).collect()}
        b = {r["doc_id"]: r["weights"] for r in again.models[name].doc_topic(planted).collect()}
        assert all(np.allclose(a[d], b[d], atol=1e-6) for d in a)
    assert isinstance(again.models["NMF"], TopicModel)


def brute_windows(docs, words, window):
    sets = []
    for doc in docs:
        tokens = doc.split()
        if not set(tokens) & words:
            continue
        last = max(1, len(tokens) - window + 1)
        sets += [set(tokens[s : s + window]) & words for s in range(last)]
    return sets


def test_window_counts_and_coherence_against_brute_force(spark):
    rng = np.random.default_rng(3)
    vocab = [f"w{i}" for i in range(12)]
    docs = [" ".join(rng.choice(vocab + ["w0"] * 6, n)) for n in (1, 3, 9, 10, 11, 25, 60, 200)] + ["other words only"]
    corpus = spark.createDataFrame(list(enumerate(docs)), "doc_id long, clean_text string").repartition(3)
    topics = {0: ["w0", "w1", "w2"], 1: ["w3 w4", "w3 w5"], 2: ["w6", "w7 w8"]}
    terms = spark.createDataFrame([("M", t, r, w) for t, ws in topics.items() for r, w in enumerate(ws)], "model string, topic int, rank int, term string")
    usable = H.usable_words(terms, corpus)
    lists = {0: ["w0", "w1", "w2"], 1: ["w3", "w4", "w3", "w5"], 2: ["w6"]}
    assert {(r["topic"], r["word"]): r["times"] for r in usable.collect()} == {(t, w): ws.count(w) for t, ws in lists.items() for w in ws}
    for segments in (H._SEGMENTS_AT_ONCE, 7):
        H._SEGMENTS_AT_ONCE = segments
        counts = {(r["model"], r["word1"], r["word2"]): r["windows"] for r in H.window_counts(usable, corpus, 10).collect()}
    sets = brute_windows(docs, {w for ws in lists.values() for w in ws}, 10)
    assert counts[("M", None, None)] == len(sets)
    for ws in lists.values():
        for a, b in itertools.combinations_with_replacement(sorted(set(ws)), 2):
            assert counts.get((None, a, b), 0) == sum(a in s and b in s for s in sets)

    def npmi(a, b):
        n, eps = len(sets), 1e-12
        p = lambda *w: sum(all(x in s for x in w) for s in sets) / n
        return math.log((p(a, b) + eps) / (p(a) * p(b))) / -math.log(p(a, b) + eps)

    per_topic = []
    for ws in lists.values():
        v = np.array([[npmi(a, b) for b in ws] for a in ws])
        s = v.sum(axis=0)
        per_topic.append(np.mean([x @ s / (np.linalg.norm(x) * np.linalg.norm(s)) for x in v]))
    assert H.coherence_cv(terms, corpus, 10).first()["coherence"] == pytest.approx(np.mean(per_topic))


def test_sweep_covers_every_number_of_topics(planted):
    rows = evaluation.sweep(planted.select("doc_id", "clean_text"), topics=[2, 3]).collect()
    assert [r["n_topics"] for r in rows] == [2, 3]
    assert all(-1 <= r[c] <= 1 for r in rows for c in ("lda_coherence", "nmf_coherence"))


def test_final_metrics(planted, fitted):
    rows = {r["Metric"]: r for r in evaluation.final_metrics(fitted, planted).collect()}
    assert set(rows) == {"Topic Coherence (c_v)", "Topic Diversity"} and 0 < rows["Topic Diversity"]["NMF"] <= 1


def test_topic_distance_against_definition(spark):
    p = np.array([[0.5, 0.5, 0.0], [0.0, 0.25, 0.75], [0.0, 0.0, 1.0]])
    rows = [("M", t, f"w{i}", float(v)) for t, row in enumerate(p) for i, v in enumerate(row)]
    shares = TM.topic_term_shares(spark.createDataFrame(rows, "model string, topic int, term string, weight double"))
    got = {(r["topic1"], r["topic2"]): r["distance"] for r in TM.topic_distances(shares).collect()}
    kl = lambda a, m: sum(x * math.log(x / y) for x, y in zip(a, m) if x > 0)
    for i, j in itertools.combinations(range(3), 2):
        m = (p[i] + p[j]) / 2
        assert got[(i, j)] == pytest.approx((kl(p[i], m) + kl(p[j], m)) / 2)


def test_scoring_a_stream(spark, fitted, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("loan mortgage rate\n\n  phone calls at work  \n")
    labels = spark.createDataFrame([], "model string, topic int, name string, style string")
    scored = streaming.score_stream(streaming.stream_lines(spark, str(tmp_path / "in")), "text", fitted.models["NMF"], labels)
    streaming.write_scores(scored, str(tmp_path / "out"), str(tmp_path / "cp"), available_now=True).awaitTermination(120)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {r["text"] for r in rows} == {"loan mortgage rate", "phone calls at work"} and all(r["assigned_topic"] for r in rows)


def test_reports_of_fitted_models(spark, planted, fitted):
    from themeloom.plans import reports
    corpus = planted.select("doc_id", "clean_text").withColumn("raw_text", F.col("clean_text"))
    weights = fitted.doc_topic(corpus).persist()
    items, key = reports.rating_sheet(fitted, weights, corpus)
    assert {r["code"] for r in items.collect()} == {f"T{i:02d}" for i in range(1, 7)} == {r["code"] for r in key.collect()}
    assert all(r["example_3"] and len(r["words"].split(", ")) <= 10 for r in items.collect())
    tables = reports.topic_map(fitted, weights, [0.0, 1.0])
    proportions = tables["prevalence"].groupBy("model").agg(F.sum("proportion").alias("p")).collect()
    assert all(r["p"] == pytest.approx(1) for r in proportions)
    assert tables["distances"].count() == 6 and tables["tokens"].count() > 0 and tables["relevant"].count() > 0
    per_topic, summary = reports.distribution(weights, spark.createDataFrame([], "model string, topic int, name string, style string"), 3)
    assert per_topic.count() == 6 and {r["documents"] for r in summary.collect()} == {180}
    with pytest.raises(ValueError):
        reports.require_alignment(corpus.where("doc_id > 5"), weights)
