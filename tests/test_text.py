from pyspark.sql import functions as F

from themeloom.functions import constants as C
from themeloom.functions import text as T
from themeloom.functions import weights as W
from themeloom.operators import corpus as K
from themeloom.operators import lemmas as L

TRICKY = [
    "I drove past exxon; XXXX took {$500.00} on XX/XX/XXXX!", "see http://a.b/xxxx/secret now", "ends with http",
    "mail me@x.com please", "a@b@c @start end@ @@ @@x", "www.site.org next  one", "$1,200.50xx$3",
    "cannot gonna wanna gotta lemme gimme dog", "", "   ", "\x1cunit\x1dseparators\x85here", "café naïve ٥$١٢",
    "x" * 3000 + "@", "no at sign " + "y" * 3000, None,
]


# What is left of each of TRICKY, written out by hand.
CLEANED = [
    "i drove past e on took on", "see secret now", "ends with http", "mail please", "start end", "next one", "",
    "cannot gonna wanna gotta lemme gimme dog", "", "", "unit separators here", "caf na ve", "", "no at sign " + "y" * 3000, "",
]


def one_column(spark, values, *columns):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [tuple(r)[1:] for r in df.select("i", *columns).orderBy("i").collect()]


def test_cleaning_agrees_with_unicode_regexes(spark):
    got = [r[0] for r in one_column(spark, TRICKY, T.clean_text(F.col("t")))]
    assert got == CLEANED


def test_content_tokens(spark):
    texts = ["the accounts and ads of cannot gonna wanna gotta gimme lemme", "an account would"]
    got = [r[0] for r in one_column(spark, texts, T.content_tokens(F.col("t")))]
    assert got == [["accounts", "ads", "gon", "wan", "gim", "lem"], []]


def test_word_threshold_uses_unicode_whitespace(spark):
    texts = [" ".join("w" * 14), " ".join("w" * 15), " ".join("w" * 15), "", "  a  "]
    got = [r[0] for r in one_column(spark, texts, T.has_words(F.col("t"), 15))]
    assert got == [len(t.split()) >= 15 for t in texts]


def test_display_text(spark):
    long = "word " * 100
    texts = ["On XX/XX/XXXX  XXXX-XX paid {$12.00}; maXXXX", long, "z" * 400]
    readable, example = zip(*one_column(spark, texts, T.readable(F.col("t")), T.sheet_example(F.col("t"))))
    assert readable[0] == "On [redacted] [redacted] paid $12.00; maXXXX"
    assert example[0] == "On [redacted] [redacted] paid {$12.00}; maXXXX"
    assert example[1] == long.strip()[:350].rsplit(" ", 1)[0] + " ..."
    assert example[2] == "z" * 350 + " ..."


def test_duration(spark):
    got = one_column(spark, ["59.5", "60.5", None, "125"], T.duration(F.col("t").cast("double")))
    assert [g[0] for g in got] == ["1:00", "1:00", "0:00", "2:05"]


def test_weights(spark):
    df = spark.createDataFrame([([0.2, 0.5, 0.5],), ([0.0, 0.0, 0.0],)], "w array<double>")
    rows = df.select(W.assigned_topic(F.col("w")).alias("t"), W.confidence(F.col("w")).alias("c"), W.top_topics(F.col("w"), 2).alias("top")).collect()
    assert [(r["t"], round(r["c"], 3)) for r in rows] == [(1, 0.417), (0, 0.0)]
    assert [x["topic"] for x in rows[0]["top"]] == [1, 2] and [x["topic"] for x in rows[1]["top"]] == [0, 1]


def test_recognised_words_keep_first_seen_order(spark):
    got = one_column(spark, ["b a c b a"], T.recognised_words(F.split("t", " "), ["a", "b", "a b", "it's"]))
    assert got[0][0] == ["b", "a"]


def test_sample_is_exact_and_independent_of_partitioning(spark):
    df = spark.range(5000).withColumnRenamed("id", "doc_id")
    first = {r[0] for r in K.exact_sample(df.repartition(1), 137).collect()}
    second = {r[0] for r in K.exact_sample(df.repartition(13), 137).collect()}
    assert len(first) == 137 and first == second
    assert K.exact_sample(df, 5000).count() == 5000 and K.exact_sample(df, 9000).count() == 5000


def test_lemmas_take_the_shortest_known_form_on_both_paths(spark):
    texts = ["the accounts and account on my ads ad", "women woman boxes box parties party boss", "misses miss children child"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, raw_text string")
    table = L.lemma_table(df)
    got = {r["word"]: r["lemma"] for r in table.collect()}
    assert got == {"accounts": "account", "ads": "ad", "women": "woman", "boxes": "box", "parties": "party", "misses": "miss", "children": "child"}
    plain = K.preprocess(df)
    narrow = {r["doc_id"]: r["clean_text"] for r in L.apply_lemmas(plain, table).collect()}
    joined = {r["doc_id"]: r["clean_text"] for r in L.apply_lemmas(plain, table, in_task_rows=2).collect()}
    assert narrow == joined
    assert narrow[0] == "account ad"  # tested against stopwords and length before lemmatising


def test_lemmas_of_any_table_size_and_any_rows(spark):
    pairs = [("cats", "cat"), ("cat", "feline"), ("dogs", "dog"), ("xs", "cats"), ("mice", "mouse")]
    table = spark.createDataFrame(pairs, "word string, lemma string")
    texts = ["cats cat dogs", "xs mice mice zebra", "", None, "zebra zebra", "cats cat dogs"] + ["zebra cat"] * 20
    rows = [(1, t, f"n{i % 2}") for i, t in enumerate(texts)]  # one id on every row, repeated rows
    df = spark.createDataFrame(rows, "doc_id long, clean_text string, `word` string")
    lemma = dict(pairs)
    expected = [(1, f"n{i % 2}", None if t is None else " ".join(lemma.get(w, w) for w in t.split(" "))) for i, t in enumerate(texts)]
    for travelling in (100, 4, 1):
        got = L.apply_lemmas(df, table, in_task_rows=travelling).select("doc_id", "word", "clean_text").collect()
        assert sorted(map(tuple, got), key=repr) == sorted(expected, key=repr), travelling
    assert L.apply_lemmas(df.where("false"), table, in_task_rows=1).count() == 0


def test_rare_typos_and_invariant_nouns_leave_lemmas_alone(spark):
    texts = ["business address process news loss houses"] * 40 + ["house"] * 30 + ["busines addres proces new los"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, raw_text string")
    assert {r["word"]: r["lemma"] for r in L.lemma_table(df).collect()} == {"houses": "house"}


def test_single_length_histogram(spark):
    corpus = spark.createDataFrame([("a b c",), ("d e f",)], "clean_text string")
    rows = K.length_histogram(corpus).orderBy("bin").collect()
    assert len(rows) == C.LENGTH_BINS and rows[20]["documents"] == 2 and rows[0]["from_words"] == 2.5


def test_empty_texts_are_dropped_after_cleaning(spark):
    df = spark.createDataFrame([(1, "the and of"), (2, "mortgage payment")], "doc_id long, narrative string")
    assert [r["doc_id"] for r in K.prepare(df, "narrative", min_words=1).collect()] == [2]
