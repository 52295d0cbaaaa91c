import json

import pytest
from pyspark.sql import functions as F

from themeloom.operators import compare as P
from themeloom.operators import distribution as D
from themeloom.operators import labels as L
from themeloom.operators import ratings as R
from themeloom.operators import scoring as S
from themeloom.operators import topics as TP
from themeloom.sources import files

# Published coherence of the sweep, (topics, LDA, NMF).
SWEEP = [
    (4, 0.5258249161264974, 0.6371502725574161), (5, 0.5319391560722153, 0.6005665754974044),
    (6, 0.517384849889762, 0.5875119083733319), (7, 0.5474134166069157, 0.5650935263936069),
    (8, 0.5341592955197084, 0.5498487593832063), (9, 0.534761937426671, 0.5726116486675207),
    (10, 0.5485455150724111, 0.6032038545758708), (11, 0.5322358418946657, 0.615501562384872),
    (12, 0.5067372483015443, 0.6195503601944669),
]


def test_best_number_of_topics(spark):
    sweep = spark.createDataFrame(SWEEP + [(13, 0.1, 0.6371502725574161)], "n_topics int, lda_coherence double, nmf_coherence double")
    assert {r["model"]: r["n_topics"] for r in P.best_k(sweep).collect()} == {"LDA": 10, "NMF": 4}


def test_comparison_and_leads(spark):
    metrics = spark.createDataFrame([("LDA", 0.5322, 0.6091), ("NMF", 0.6155, 0.9273)], "model string, coherence double, diversity double")
    summary = spark.createDataFrame([("LDA", 0.9, 0.3, 1), ("NMF", 0.8, 0.2, 0)], "model string, evenness double, largest_share double, topics_under_2pct long")
    compared = P.comparison(P.criteria_values(metrics, None, summary))
    assert [r["ahead"] for r in compared.orderBy("position").collect()] == ["NMF", "NMF", "", "LDA", "", ""]
    leads = {r["model"]: r["criteria"] for r in P.leads(compared).collect()}
    assert leads == {"NMF": "coherence and diversity", "LDA": "distribution evenness"}


@pytest.fixture(scope="module")
def doc_topic(spark):
    rows = [("NMF", i, w) for i, w in enumerate([[0.9, 0.1, 0.0], [0.4, 0.4, 0.2], [0.0, 0.0, 0.0], [0.1, 0.8, 0.1]])]
    return spark.createDataFrame(rows, "model string, doc_id long, weights array<double>")


def test_counts_and_summary(spark, doc_topic):
    counts = D.topic_counts(doc_topic, 3)
    assert {r["topic"]: r["documents"] for r in counts.collect()} == {0: 3, 1: 1, 2: 0}
    assert {r["topic"] for r in D.topic_counts(doc_topic).collect()} == {0, 1}
    s = D.summarize(counts).first()
    assert (s["largest_topic"], s["smallest_topic"], s["topics_under_2pct"]) == (0, 2, 1)
    assert s["evenness"] == pytest.approx(0.5118, abs=1e-4)
    labels = spark.createDataFrame([("NMF", 0, "Calls", "Narrative account"), ("LDA", 1, "Other", None)], "model string, topic int, name string, style string")
    facts = D.executive_facts(counts, labels).first()
    assert facts["sentence"].startswith('Across 4 complaints analyzed with NMF, the largest topic — "Calls" — accounts for 75% of documents (3 complaints).')
    table = {r["topic"]: (r["topic_name"], r["share_pct"]) for r in D.distribution_table(counts, labels).collect()}
    assert table == {0: ("Calls", 75.0), 1: ("Topic 1", 25.0), 2: ("Topic 2", 0.0)}
    assert [(r["documents"], r["share"]) for r in D.style_share(counts, labels).collect()] == [(3, 0.75)]


def test_single_topic_is_even(spark):
    one = spark.createDataFrame([("NMF", 0, 5)], "model string, topic int, documents long")
    assert D.summarize(one).first()["evenness"] == 1.0


def test_representatives_and_alignment(spark, doc_topic):
    best = {(r["topic"], r["example"]): (r["doc_id"], round(r["share"], 3)) for r in TP.representatives(doc_topic, 2).collect()}
    assert best[(0, 1)] == (0, 0.9) and best[(1, 1)] == (3, 0.8) and best[(2, 2)] == (3, 0.1)
    corpus = spark.createDataFrame([(0,), (1,), (9,)], "doc_id long")
    assert tuple(TP.alignment(corpus, doc_topic).first()) == (1, 2)


def test_labels_files(spark, tmp_path):
    good = tmp_path / "labels.json"
    good.write_text(json.dumps({"NMF": {"0": {"name": "A", "style": "S"}, "10": {"style": ""}}, "LDA": {}}, indent=2))
    rows = {(r["model"], r["topic"]): (r["name"], r["style"]) for r in files.read_labels(spark, str(good)).collect()}
    assert rows == {("NMF", 0): ("A", "S"), ("NMF", 10): ("Topic 10", None)}
    (tmp_path / "broken.json").write_text('{"NMF": {')
    assert files.read_labels(spark, str(tmp_path / "broken.json")).count() == 0
    assert files.read_labels(spark, str(tmp_path / "missing.json")).count() == 0
    out = L.export_labels(files.read_labels(spark, str(good)), ["NMF", "LDA"]).first()["value"]
    assert json.loads(out) == {"NMF": {"0": {"name": "A", "style": "S"}}, "LDA": {}}


def test_csv_with_line_breaks_quotes_and_missing_words(spark, tmp_path):
    (tmp_path / "c.csv").write_text('Product,Extra,Consumer complaint narrative\nLoan,1,"two\nlines ""quoted"", yes"\nCard,2,N/A\n,3,\n')
    rows = files.read_complaints(spark, str(tmp_path / "c.csv")).collect()
    assert [(r["product"], r["narrative"]) for r in rows] == [("Loan", 'two\nlines "quoted", yes'), ("Card", None), (None, None)]
    assert len({r["doc_id"] for r in rows}) == 3
    files.write_csv(files.read_csv(spark, str(tmp_path / "c.csv")), str(tmp_path / "out"), single_file=True)
    assert files.read_csv(spark, str(tmp_path / "out")).count() == 3


def test_lines(spark, tmp_path):
    (tmp_path / "t.txt").write_bytes("  one \r\n\r\n two three\n   \n".encode())
    assert sorted(r["text"] for r in files.read_lines(spark, str(tmp_path / "t.txt")).collect()) == ["one", "three", "two"]


def test_rating_sheets(spark, tmp_path):
    head = "Code,Top 10 words,Word clarity (1-5),Example fit (1-5),Suggested name\n"
    (tmp_path / "ann lee.csv").write_text(head + "T01,w,4,3.5, Late fees \nT02,w,6,3,x\nEX,w,4,4,x\nT03,w,,2,\n")
    (tmp_path / "bo.csv").write_text("Suggested name,Example fit (1-5),Code,Word clarity (1-5)\nFees,3,T01,2\n,3,T09,3\n")  # another order
    (tmp_path / "sheet_Template.csv").write_text(head + "T01,w,1,1,no\n")
    (tmp_path / "~$bo.csv").write_text(head + "T01,w,1,1,no\n")
    sheets = files.read_rating_sheets(spark, str(tmp_path / "*.csv"))
    assert {r["rater"] for r in sheets.collect()} == {"ann lee", "bo"}
    key = spark.createDataFrame([("T01", "NMF", 4), ("T02", "LDA", 0)], "code string, model string, topic int")
    topics, models, rejected = R.score_ratings(sheets, key)
    row = topics.first()
    assert (row["raters"], row["word_clarity"], row["overall"], row["spread"], row["suggested_names"]) == (2, 3.0, 3.12, 0.88, "Fees; Late fees")
    assert [tuple(r) for r in models.select("model", "raters", "ratings", "rater_spread").collect()] == [("NMF", 2, 2, 0.88)]
    assert sorted(r["problem"] for r in rejected.collect()) == ["ann lee T02", "ann lee T03"]


def test_recordings_are_transcribed_once_per_content(spark, tmp_path):
    for name, content in (("a.wav", b"hello"), ("b.wav", b"hello"), ("c.wav", b"bad")):
        (tmp_path / name).write_bytes(content)
    recordings = files.read_recordings(spark, str(tmp_path), "*.wav")
    assert {(r["recording"], r["copies"]) for r in files.unique_recordings(recordings).collect()} == {("a.wav", 2), ("c.wav", 1)}

    def fake(content):
        if content == b"bad":
            raise ValueError("unreadable")
        return content.decode(), 2.0

    rows = {r["recording"]: (r["transcript"], r["note"]) for r in S.transcribe(recordings, fake).collect()}
    assert rows == {"a.wav": ("hello", ""), "b.wav": ("hello", ""), "c.wav": ("", "Couldn't read this file (ValueError)")}


def test_staged_recordings(spark, tmp_path):
    from themeloom.sources import recordings as RC
    sound = {"a b.wav": b"hello", "c[1].wav": b"hello", "p+q%20.wav": b"bad", "zero.wav": b"", "nil.wav": b"", "other.txt": b"x", "quiet.wav": b"  "}
    for name, content in sound.items():
        (tmp_path / name).write_bytes(content)
    staged = RC.stage(spark, str(tmp_path), "*.wav")
    assert sorted((r["recording"], r["bytes"]) for r in staged.collect()) == sorted((n, len(c)) for n, c in sound.items() if n != "other.txt")
    assert sorted(bytes(r["content"]) for r in RC.contents(staged).collect()) == [b"", b"  ", b"bad", b"hello"]
    (tmp_path / "quiet.wav").unlink()

    def fake(content):
        if content == b"bad":
            raise ValueError("unreadable")
        if not content:
            raise EOFError("nothing")
        return content.decode(), 2.0

    rows = {r["recording"]: (r["transcript"], r["note"]) for r in S.transcribe_files(staged, fake).collect()}
    note = "Couldn't read this file ({})"
    assert rows == {
        "a b.wav": ("hello", ""), "c[1].wav": ("hello", ""), "p+q%20.wav": ("", note.format("ValueError")), "zero.wav": ("", note.format("EOFError")),
        "nil.wav": ("", note.format("EOFError")), "quiet.wav": ("", note.format("FileNotFoundError")),
    }
    again = S.transcribe(spark.createDataFrame([("x", b"hello"), ("x", b"hello"), ("y", None)], "recording string, content binary"), fake)
    assert sorted((r["recording"], r["transcript"]) for r in again.collect()) == [("x", "hello"), ("x", "hello"), ("y", "")]


def test_transcript_notes_in_order_of_precedence(spark):
    rows = [("a", "", "Couldn't read this file (X)", 0), ("b", "  ", "", 0), ("c", "zebra", "", 0), ("d", "loan", "", 1)]
    df = spark.createDataFrame(rows, "recording string, transcript string, note string, known_terms int").select(
        "*", F.lit(61.26).alias("seconds"), F.array(F.lit(0.2), F.lit(0.6)).alias("weights")
    )
    labels = spark.createDataFrame([("NMF", 1, "Loans", "Issue")], "model string, topic int, name string, style string")
    scored = S.place_transcripts(df, "NMF", labels, 2)
    got = {r["recording"]: (r["note"], r["topic_number"], r["topic_name"], r["confidence"]) for r in scored.collect()}
    assert got["a"][0].startswith("Couldn't") and got["b"][0] == "No speech recognised"
    assert got["c"] == ("No words the model recognises", None, "", None) and got["d"] == ("", 1, "Loans", 0.75)
    assert scored.first()["length"] == "1:01" and scored.first()["length_seconds"] == 61.3
    assert S.transcript_distribution(scored).count() == 0
