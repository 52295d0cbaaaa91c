"""The registered queries: each builds its result from the given tables with the library's operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from themeloom.functions import constants as C
from themeloom.functions import text as T
from themeloom.functions import weights as W
from themeloom.operators import coherence as H
from themeloom.operators import compare as P
from themeloom.operators import corpus as K
from themeloom.operators import distribution as D
from themeloom.operators import features as V
from themeloom.operators import labels as L
from themeloom.operators import lemmas as LM
from themeloom.operators import models as M
from themeloom.operators import ratings as R
from themeloom.operators import scoring as S
from themeloom.operators import topicmap as TM
from themeloom.operators import topics as TP
from themeloom.plans import evaluation, training
from themeloom.session import materialise, scratch_dir
from themeloom.sources import files
from workloads import fixtures as X

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(build: Query) -> Query:
    REGISTRY[build.__name__] = build
    return build


def r6(column: str | Column, alias: str | None = None) -> Column:
    value = F.col(column) if isinstance(column, str) else column
    return F.round(value, 6).alias(alias or column)


# ---- text and corpus ---------------------------------------------------------------------


@query
def clean_text(spark, sf_dir):
    return X.documents(spark, sf_dir).select("doc_id", T.clean_text(F.col("text")).alias("cleaned"))


@query
def corpus_prepare(spark, sf_dir):
    return X.corpus(spark, sf_dir)


@query
def corpus_product(spark, sf_dir):
    return K.prepare(X.documents(spark, sf_dir), "text", "source", "src3").select("doc_id", "clean_text")


@query
def corpus_sample(spark, sf_dir):
    return K.exact_sample(X.documents(spark, sf_dir).select("doc_id", F.col("text").alias("raw_text")), 300)


@query
def corpus_lemmatised(spark, sf_dir):
    return K.prepare(X.documents(spark, sf_dir), "text", sample_size=None, lemmatise=True).select("doc_id", "clean_text")


@query
def readable_text(spark, sf_dir):
    masked = F.regexp_replace(F.concat(F.lit("{$"), "n_chars", F.lit(".00} "), "text"), "[0-9]", "X")
    return X.documents(spark, sf_dir).select("doc_id", masked.alias("t")).select(
        "doc_id", T.readable(F.col("t")).alias("readable"), T.sheet_example(F.col("t")).alias("sheet_example"),
        T.quote(F.col("t")).alias("quote"),
    )


@query
def text_lines(spark, sf_dir):
    lines = X.documents(spark, sf_dir).select("doc_id", F.explode(files.lines_of(F.col("text"))).alias("line"))
    return lines.groupBy("doc_id", "line").agg(F.count("*").alias("n"))


@query
def recording_length(spark, sf_dir):
    seconds = F.length(F.col("content").cast("string")) / 15.0
    return X.recordings(spark, sf_dir).select("recording", T.duration(seconds).alias("length"))


@query
def recordings_unique(spark, sf_dir):
    recordings = X.table(spark, sf_dir, "conversations").select(
        F.concat_ws("_", "conv_id", "turn").alias("recording"), F.md5("text").alias("md5")
    )
    return files.unique_recordings(recordings)


@query
def csv_scan(spark, sf_dir):
    path = scratch_dir(spark, "csv")
    files.write_csv(X.documents(spark, sf_dir).select("doc_id", "source", "text"), path)
    rows = files.read_csv(spark, path, ["doc_id", "source", "text"])
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").alias("product"), F.col("text").alias("narrative"))


@query
def top_words(spark, sf_dir):
    return K.word_counts(X.corpus(spark, sf_dir), 200)


@query
def corpus_summary(spark, sf_dir):
    corpus = X.stored_corpus(spark, sf_dir)
    return K.summary(corpus).select(
        "documents", r6("mean_words"), "vocabulary", K.median_length(corpus).scalar().alias("median_words")
    )


@query
def length_histogram(spark, sf_dir):
    return K.length_histogram(X.corpus(spark, sf_dir)).select("bin", r6("from_words"), r6("to_words"), "documents")


# ---- vocabulary and vectors --------------------------------------------------------------


@query
def vocabulary(spark, sf_dir):
    return V.vocabulary(X.stored_corpus(spark, sf_dir))


@query
def count_vectors(spark, sf_dir):
    corpus = X.stored_corpus(spark, sf_dir)
    return V.long_form(V.fit_vectorizer(corpus).counts(corpus), "counts")


@query
def tfidf_vectors(spark, sf_dir):
    corpus = X.stored_corpus(spark, sf_dir)
    return V.long_form(V.fit_vectorizer(corpus).tfidf(corpus), "tfidf").select("doc_id", "term_id", r6("value"))


@query
def term_frequency(spark, sf_dir):
    corpus = X.stored_corpus(spark, sf_dir)
    return V.term_frequency(V.fit_vectorizer(corpus).tfidf(corpus), "tfidf").select("term_id", r6("frequency"))


@query
def known_terms(spark, sf_dir):
    corpus = X.stored_corpus(spark, sf_dir)
    fitted = V.fit_vectorizer(corpus)
    words = T.recognised_words(F.split("clean_text", " "), fitted.terms)
    return fitted.counts(corpus).select(
        "doc_id", V.known_terms("counts").alias("known_terms"), F.array_join(words, " ").alias("recognised")
    )


# ---- labels ------------------------------------------------------------------------------


@query
def labels_explode(spark, sf_dir):
    entry = F.struct(
        F.when(F.col("doc_id") % 3 != 0, F.col("source")).alias("name"),
        F.when(F.col("doc_id") % 4 != 0, F.col("lang")).alias("style"),
    )
    topic = F.create_map(F.col("doc_id").cast("string"), entry)
    none = F.map_filter(topic, lambda k, v: F.lit(False))
    document = F.to_json(F.create_map(F.lit("NMF"), topic, F.lit("LDA"), F.when(F.col("doc_id") % 2 == 0, none).otherwise(topic)))
    broken = F.when(F.col("doc_id") % 10 == 0, F.substring(document, 1, 20)).otherwise(document)
    return L.parse_labels(X.documents(spark, sf_dir).select(broken.alias("value")))


@query
def labels_export(spark, sf_dir):
    topic = F.substring("source", 4, 9).cast("int")
    labels = X.documents(spark, sf_dir).groupBy("source").agg(F.min("lang").alias("lang")).select(
        F.lit("NMF").alias("model"), topic.alias("topic"),
        F.when(topic % 3 == 0, L.default_name(topic)).otherwise(F.col("source")).alias("name"),
        F.when(topic % 4 != 0, F.col("lang")).alias("style"),
    )
    return L.export_labels(labels, C.MODELS)


# ---- topics ------------------------------------------------------------------------------


@query
def top_terms(spark, sf_dir):
    return TP.top_terms(X.topic_term(spark, sf_dir)).select("model", "topic", "rank", "term", "weight")


@query
def topic_word_lists(spark, sf_dir):
    return TP.top_word_lists(X.topic_term(spark, sf_dir))


@query
def diversity(spark, sf_dir):
    return TP.diversity(TP.top_terms(X.topic_term(spark, sf_dir))).select("model", r6("diversity"))


@query
def assign_topic(spark, sf_dir):
    return TP.assign(X.doc_topic(spark, sf_dir)).select("model", "doc_id", "topic")


@query
def alignment(spark, sf_dir):
    weights = X.doc_topic(spark, sf_dir).where("model = 'NMF'")
    return TP.alignment(X.documents(spark, sf_dir), weights)


@query
def representative_docs(spark, sf_dir):
    examples = TP.representatives(X.doc_topic(spark, sf_dir))
    named = TP.with_texts(examples, X.documents(spark, sf_dir).withColumnRenamed("text", "raw_text"))
    return named.select("model", "topic", "example", "doc_id", r6("weight"), r6("share"), "raw_text")


@query
def top3_topics(spark, sf_dir):
    return TP.top_topics(X.doc_topic(spark, sf_dir)).select("model", "doc_id", "rank", "topic", r6("share"))


@query
def blind_items(spark, sf_dir):
    corpus = X.documents(spark, sf_dir).withColumnRenamed("text", "raw_text")
    items, key = TP.blind_items(X.topic_term(spark, sf_dir), X.doc_topic(spark, sf_dir), corpus)
    return items.join(key, "code")


# ---- coherence ---------------------------------------------------------------------------


@query
def coherence_filter(spark, sf_dir):
    terms = TP.top_terms(X.topic_term(spark, sf_dir)).withColumn(
        "term", F.when(F.col("topic") % 5 == 0, F.concat_ws(" ", "term", F.reverse("term"))).otherwise(F.col("term"))
    )
    return H.usable_words(terms, X.stored_corpus(spark, sf_dir))


@query
def window_counts(spark, sf_dir):
    corpus = X.stored_corpus(spark, sf_dir)
    return H.window_counts(H.usable_words(TP.top_terms(X.topic_term(spark, sf_dir)), corpus), corpus)


@query
def coherence_cv(spark, sf_dir):
    terms = TP.top_terms(X.topic_term(spark, sf_dir))
    return H.coherence_cv(terms, X.stored_corpus(spark, sf_dir)).select("model", r6("coherence"))


# ---- distribution ------------------------------------------------------------------------


def _counts(spark, sf_dir):
    return D.topic_counts(X.doc_topic(spark, sf_dir), X.TOPICS)


@query
def topic_counts(spark, sf_dir):
    return _counts(spark, sf_dir)


@query
def topic_counts_present(spark, sf_dir):
    return D.topic_counts(X.doc_topic(spark, sf_dir))


@query
def topic_distribution(spark, sf_dir):
    return D.distribution_table(_counts(spark, sf_dir), X.labels(spark, sf_dir))


@query
def distribution_summary(spark, sf_dir):
    return D.summarize(_counts(spark, sf_dir)).select(
        "model", "documents", "largest_topic", r6("largest_share"), "smallest_topic", r6("smallest_share"),
        r6("evenness"), "topics_under_2pct",
    )


@query
def distribution_metrics(spark, sf_dir):
    return D.summary_table(_counts(spark, sf_dir), X.labels(spark, sf_dir))


@query
def style_share(spark, sf_dir):
    return D.style_share(_counts(spark, sf_dir), X.labels(spark, sf_dir)).select("model", "writing_style", "documents", r6("share"))


@query
def executive_facts(spark, sf_dir):
    return D.executive_facts(_counts(spark, sf_dir), X.labels(spark, sf_dir)).withColumn("top_pct", F.round("top_pct", 6))


@query
def topic_rank(spark, sf_dir):
    return TP.size_rank(_counts(spark, sf_dir)).select("model", "topic", "documents", r6("share"), "size_rank")


# ---- ratings -----------------------------------------------------------------------------


@query
def rating_rejects(spark, sf_dir):
    _, rejected = R.split_ratings(X.rating_sheets(spark, sf_dir))
    return rejected.groupBy("rater", "code", "problem").agg(F.count("*").alias("n"))


@query
def rating_sheets_read(spark, sf_dir):
    """Sheets written as files with the raters' headings and read back by name; other columns are passed over."""
    path = scratch_dir(spark, "sheets")
    named = {ours: theirs for theirs, ours in files.SHEET_COLUMNS.items()}
    sheets = X.rating_sheets(spark, sf_dir)
    files.write_csv(sheets.select(F.lit("note").alias("Remarks"), *[F.col(c).alias(named[c]) for c in sheets.columns if c in named]), path)
    read = files.read_rating_sheets(spark, f"{path}/*.csv")
    return read.groupBy("code", "word_clarity", "example_fit", F.trim("suggested_name").alias("suggested_name")).agg(F.count("*").alias("n"))


def _rated(spark, sf_dir):
    valid, _ = R.split_ratings(X.rating_sheets(spark, sf_dir))
    return R.with_key(valid, X.rating_key(spark))


@query
def rating_by_topic(spark, sf_dir):
    return R.by_topic(_rated(spark, sf_dir), digits=None).select(
        "model", "topic", "code", "raters", r6("word_clarity"), r6("example_fit"), r6("overall"), r6("spread"), "suggested_names"
    )


@query
def rating_by_model(spark, sf_dir):
    keyed = _rated(spark, sf_dir)
    return R.by_model(keyed, R.by_topic(keyed, digits=None), digits=None).select(
        "model", "raters", "ratings", r6("word_clarity"), r6("example_fit"), r6("overall"), r6("rater_spread")
    )


# ---- comparison --------------------------------------------------------------------------


@query
def best_k(spark, sf_dir):
    ids = F.col("doc_id")
    sweep = X.documents(spark, sf_dir).groupBy((F.col("n_chars") % 9 + 4).alias("n_topics")).agg(
        F.round(F.avg(ids % 97) / 97, 4).alias("lda_coherence"), F.round(F.avg(ids % 89) / 89, 4).alias("nmf_coherence")
    )
    return P.best_k(sweep)


def _compared(spark, sf_dir):
    terms = TP.top_terms(X.topic_term(spark, sf_dir))
    metrics = H.coherence_cv(terms, X.stored_corpus(spark, sf_dir)).join(TP.diversity(terms), "model")
    return P.comparison(P.criteria_values(metrics, rating_by_model(spark, sf_dir), D.summarize(_counts(spark, sf_dir))))


@query
def model_comparison(spark, sf_dir):
    return _compared(spark, sf_dir).select("position", "criterion", r6("LDA"), r6("NMF"), "ahead")


@query
def criterion_leader(spark, sf_dir):
    return P.leads(_compared(spark, sf_dir))


# ---- topic map ---------------------------------------------------------------------------


def _map_shares(spark, sf_dir):
    folded = X.topic_term(spark, sf_dir).groupBy("model", (F.col("topic") % X.TOPICS).alias("topic"), "term").agg(
        F.sum("weight").alias("weight")
    )
    return TM.topic_term_shares(materialise(folded, "topic-term"))


def _map_prevalence(spark, sf_dir):
    lengths = X.corpus(spark, sf_dir).select("doc_id", F.size(F.split("clean_text", " ")).cast("double").alias("length"))
    return TM.prevalence(TM.mapped_documents(X.doc_topic(spark, sf_dir).join(lengths, "doc_id")))


def _map_frequencies(spark, sf_dir):
    return TM.term_frequencies(_map_shares(spark, sf_dir), _map_prevalence(spark, sf_dir))


@query
def topic_map_prevalence(spark, sf_dir):
    return _map_prevalence(spark, sf_dir).select("model", "topic", r6("frequency"), r6("proportion"))


@query
def topic_map_saliency(spark, sf_dir):
    return TM.saliency(_map_frequencies(spark, sf_dir), None).select("model", "term", r6("frequency"), r6("saliency"))


@query
def topic_map_relevance(spark, sf_dir):
    return TM.relevance(_map_frequencies(spark, sf_dir)).select(
        "model", "topic", "lambda", "term", r6("relevance")
    )


@query
def topic_map_tokens(spark, sf_dir):
    frequencies = _map_frequencies(spark, sf_dir)
    return TM.token_table(frequencies, TM.saliency(frequencies)).select("model", "term", "topic", r6("share"))


@query
def topic_map_distance(spark, sf_dir):
    return TM.topic_distances(_map_shares(spark, sf_dir)).select("model", "topic1", "topic2", r6("distance"))


# ---- models and scoring ------------------------------------------------------------------


def _fitted_topics(spark, sf_dir, name):
    """What must hold of any fit: every topic has its top words, all of the vocabulary, distinct, and by falling weight.

    The words themselves depend on a random start, so they are not among the columns.
    """
    fitted = training.fit(X.stored_corpus(spark, sf_dir), models=[name]).models[name]
    top = TP.top_terms(fitted.topic_terms(spark))
    by_topic = Window.partitionBy("model", "topic")
    falling = F.coalesce(F.lag("weight").over(by_topic.orderBy("rank")) >= F.col("weight"), F.lit(True))
    known = fitted.vectorizer.table(spark).select("term", F.lit(True).alias("known"))
    return top.join(known, "term", "left").select(
        "model", "topic", "rank", F.coalesce("known", F.lit(False)).alias("known"), falling.alias("falling"),
        (F.size(F.collect_set("term").over(by_topic)) == F.count("*").over(by_topic)).alias("distinct_terms"),
        (F.col("weight") >= 0).alias("non_negative"),
    )


@query
def nmf_topics(spark, sf_dir):
    return _fitted_topics(spark, sf_dir, "NMF")


@query
def lda_topics(spark, sf_dir):
    return _fitted_topics(spark, sf_dir, "LDA")


def _scored(spark, sf_dir, name):
    corpus = X.stored_corpus(spark, sf_dir)
    fitted = training.fit(corpus, models=[name]).models[name]
    return fitted.infer(corpus.select("doc_id", "clean_text")).select(
        "doc_id", "known_terms", F.size("weights").alias("topics"),
        (F.array_min("weights") >= 0).alias("non_negative"), r6(W.total(F.col("weights")), "total"),
    )


@query
def nmf_score(spark, sf_dir):
    """Weights of NMF have no fixed total, but a text without known terms has none and no total is negative."""
    scored = _scored(spark, sf_dir, "NMF")
    return scored.withColumn("total", F.when(F.col("known_terms") == 0, F.col("total") == 0).otherwise(F.col("total") >= 0)).withColumnRenamed("total", "total_fits")


@query
def lda_score(spark, sf_dir):
    return _scored(spark, sf_dir, "LDA")


@query
def upload_assignments(spark, sf_dir):
    upload = X.documents(spark, sf_dir).select("doc_id", "lang").join(
        X.doc_topic(spark, sf_dir).where("model = 'NMF'").select("doc_id", "weights"), "doc_id"
    )
    placed = S.place(upload.withColumn("clean_text", F.lit("")).withColumn("known_terms", F.lit(1)))
    return S.name_assignments(placed, "NMF", X.labels(spark, sf_dir), X.TOPICS)


@query
def score_upload(spark, sf_dir):
    """All documents as an upload, by a lemmatised model; the id column is scored as text too and finds no words."""
    model, labels = X.scoring_model(spark, sf_dir), X.labels(spark, sf_dir)
    upload = X.documents(spark, sf_dir).select("doc_id", "source", "text")
    by_text = S.score_upload(upload, "text", model, labels).select("doc_id", F.lit("text").alias("scored"), "source", "assigned_topic", "confidence")
    by_id = S.score_upload(upload, "doc_id", model, labels).select("doc_id", F.lit("doc_id").alias("scored"), "source", "assigned_topic", "confidence")
    return by_text.unionByName(by_id)


@query
def score_saved_model(spark, sf_dir):
    """The upload again, by a model that was written as tables and read back."""
    path = scratch_dir(spark, "model")
    X.scoring_model(spark, sf_dir).save(spark, path)
    upload = X.documents(spark, sf_dir).select("doc_id", "source", "text")
    return S.score_upload(upload, "text", M.TopicModel.load(spark, path), X.labels(spark, sf_dir)).drop("text")


@query
def classify_texts(spark, sf_dir):
    """Single texts: whether the model knows a word, the best topics with their shares, and the words it knows."""
    items = X.table(spark, sf_dir, "benchmark").select("item_id", "text")
    found = S.classify_texts(items, "text", X.scoring_model(spark, sf_dir), X.labels(spark, sf_dir))
    ranked = [
        column for k in range(3) for column in (
            F.get("shares", F.lit(k))["topic"].cast("int").alias(f"topic_{k + 1}"), r6(F.get("shares", F.lit(k))["share"], f"share_{k + 1}"),
        )
    ]
    return found.select("item_id", "ok", "best", "topic_name", "writing_style", *ranked, F.array_join("recognised", " ").alias("recognised"))


def _transcribed(spark, sf_dir):
    spoken = S.transcribe(X.recordings(spark, sf_dir), X.speech)
    return S.score_transcripts(spoken, X.scoring_model(spark, sf_dir), X.labels(spark, sf_dir))


@query
def score_transcripts(spark, sf_dir):
    """Recordings to the transcript export: speech recognition once per content, then topic, style, confidence and note."""
    return _transcribed(spark, sf_dir)


@query
def transcript_topics(spark, sf_dir):
    return S.transcript_distribution(materialise(_transcribed(spark, sf_dir), "scored-transcripts"))


@query
def report_tables(spark, sf_dir):
    return S.report_table(X.doc_topic(spark, sf_dir), X.topic_term(spark, sf_dir), X.labels(spark, sf_dir), X.TOPICS)


@query
def final_metrics(spark, sf_dir):
    """The metrics' names, and that each value of each model is in its range; the values depend on random starts."""
    corpus = X.stored_corpus(spark, sf_dir)
    found = evaluation.final_metrics(training.fit(corpus), corpus)
    least = F.when(F.col("Metric") == "Topic Diversity", 1.0 / X.TOPICS).otherwise(-1.0)
    return found.select("Metric", *[F.col(m).between(F.round(least, 4), F.lit(1.0)).alias(m) for m in ("LDA", "NMF")])


@query
def topic_sweep(spark, sf_dir):
    """Every number of topics, and that both coherences are in their range."""
    found = evaluation.sweep(X.corpus(spark, sf_dir))
    return found.select("n_topics", *[F.col(c).between(-1.0, 1.0).alias(c) for c in ("lda_coherence", "nmf_coherence")])
