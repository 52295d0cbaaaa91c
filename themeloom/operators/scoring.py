"""Scoring new text with a fitted model: single texts, uploaded tables and transcripts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.functions import text as T
from themeloom.functions import weights as W
from themeloom.operators import corpus as K
from themeloom.operators.distribution import topic_counts
from themeloom.operators.labels import with_labels
from themeloom.operators.models import TopicModel
from themeloom.operators.topics import top_word_lists
from themeloom.session import materialise
from themeloom.sources import files, recordings

# Notes on transcripts, the first that applies.
NO_SPEECH, NO_WORDS = "No speech recognised", "No words the model recognises"
UNREADABLE = "Couldn't read this file ({})"
TRANSCRIPT_SCHEMA = "recording string, seconds double, transcript string, note string"


def infer_texts(df: DataFrame, text_col: str, model: TopicModel, lemmas: DataFrame | None = None) -> DataFrame:
    """Adds `clean_text`, `known_terms` and `weights`; a null text counts as empty. No shuffle.

    Words are lemmatised as in training, with the pairs the model keeps unless a table is given.
    """
    return model.infer(K.preprocess(df, text_col, model.lemmas if lemmas is None else lemmas))


def place(inferred: DataFrame) -> DataFrame:
    """Adds `topic` and `confidence`; every row gets a topic, the lowest index for an empty one."""
    return inferred.withColumn("topic", W.assigned_topic(F.col("weights"))).withColumn(
        "confidence", W.confidence(F.col("weights"))
    )


def classify_texts(df: DataFrame, text_col: str, model: TopicModel, labels: DataFrame, n: int = 3) -> DataFrame:
    """The classification of single texts: input columns, whether the model knows a word of it, its best topic with name
    and style, the shares of the n best, and the words of the text that the model recognises, in order of first use.

    A text without known words is not ok and gets no topic, shares or words.
    """
    held = df.select(F.struct("*").alias("_row"), files.upload_text(df, text_col).alias("_text"))
    judged = classify(infer_texts(held, "_text", model), n).withColumn("model", F.lit(model.name))
    named = with_labels(judged, labels, model.n_topics)
    words = T.recognised_words(F.split("clean_text", " "), model.vectorizer.terms)
    added = {
        "ok": F.col("ok"), "best": F.col("topic"), "topic_name": F.when(F.col("ok"), F.col("topic_name")),
        "writing_style": F.when(F.col("ok"), F.col("writing_style")), "shares": F.col("ranked"),
        "recognised": F.when(F.col("ok"), words),
    }
    kept = [F.col("_row")[c].alias(c) for c in df.columns if c not in added]
    return named.select(*kept, *[value.alias(c) for c, value in added.items()])


def classify(inferred: DataFrame, n: int = 3) -> DataFrame:
    """Adds `ok`, the best `topic` and the n best `ranked` shares; unknown texts get neither."""
    ok = F.col("known_terms") > 0
    ranked = W.top_topics(F.col("weights"), n)
    return inferred.withColumn("ok", ok).withColumn("ranked", F.when(ok, ranked)).withColumn(
        "topic", F.when(ok, F.get("ranked", F.lit(0))["topic"])
    )


def name_assignments(placed: DataFrame, model_name: str, labels: DataFrame, topics: int) -> DataFrame:
    """The upload result: input columns with `assigned_topic` and `confidence` to three decimals."""
    named = with_labels(placed.withColumn("model", F.lit(model_name)), labels, topics)
    return named.withColumn("assigned_topic", F.col("topic_name")).withColumn(
        "confidence", F.bround("confidence", 3)
    ).drop("model", "topic", "topic_name", "writing_style", "clean_text", "known_terms", "length", "weights")


def score_upload(df: DataFrame, text_col: str, model: TopicModel, labels: DataFrame, lemmas: DataFrame | None = None) -> DataFrame:
    """Scores a table by a column of any type and keeps its columns, whatever they are called."""
    held = df.select(F.struct("*").alias("_row"), files.upload_text(df, text_col).alias("_text"))
    named = name_assignments(place(infer_texts(held, "_text", model, lemmas)), model.name, labels, model.n_topics)
    kept = [F.col("_row")[c].alias(c) for c in df.columns if c not in ("assigned_topic", "confidence")]
    return named.select(*kept, "assigned_topic", "confidence")


def _speak(transcriber: Callable[[bytes], tuple[str, float]]):
    """The transcriber over batches of `(md5, content)`; a recording it cannot read gets a note."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for md5, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    text, seconds = transcriber(content.as_py())
                    rows.append((md5, float(seconds), text, ""))
                except Exception as error:  # one bad recording must not stop the batch
                    rows.append((md5, 0.0, "", UNREADABLE.format(type(error).__name__)))
            columns = list(zip(*rows)) if rows else [[], [], [], []]
            types = [pa.string(), pa.float64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], ["md5", "seconds", "transcript", "note"]
            )

    return run


def _transcripts(named: DataFrame, audio: DataFrame, transcriber: Callable[[bytes], tuple[str, float]]) -> DataFrame:
    # Written once: speech is the costly step, and a lost executor must not repeat all of it.
    spoken = materialise(
        audio.mapInArrow(_speak(transcriber), "md5 string, seconds double, transcript string, note string"), "transcripts"
    ).dropDuplicates(["md5"])
    gone = F.lit(UNREADABLE.format("FileNotFoundError"))
    return named.select("recording", "md5").join(spoken, "md5", "left").select(
        "recording", F.coalesce("seconds", F.lit(0.0)).alias("seconds"), F.coalesce("transcript", F.lit("")).alias("transcript"),
        F.when(F.col("note").isNull() & F.col("seconds").isNull(), gone).otherwise(F.col("note")).alias("note"),
    )


def transcribe(recorded: DataFrame, transcriber: Callable[[bytes], tuple[str, float]]) -> DataFrame:
    """Turns `(recording, content)` into `(recording, seconds, transcript, note)` with a given speech-to-text function.

    The function runs inside tasks, once per distinct content, and gets empty ones too; whatever it raises becomes a
    note. Audio is read twice and never shuffled: names and hashes are written first, and the content under the first
    name of each hash is read again. A null content counts as empty. Rows that repeat a name and content come out as often.
    """
    held = recorded.select("recording", F.coalesce("content", F.lit(b"")).alias("content"))
    named = materialise(held.select("recording", F.md5("content").alias("md5")), "recording-names")
    first = named.groupBy("md5").agg(F.min("recording").alias("recording"))
    audio = held.select("recording", F.md5("content").alias("md5"), "content").join(first, ["md5", "recording"], "left_semi").select("md5", "content")
    return _transcripts(named, audio, transcriber)


def transcribe_files(staged: DataFrame, transcriber: Callable[[bytes], tuple[str, float]]) -> DataFrame:
    """The same for recordings staged from files (`sources.recordings.stage`), one row per file, empty ones included."""
    return _transcripts(staged, recordings.contents(staged), transcriber)


def transcript_note(note: Column, transcript: Column, ok: Column) -> Column:
    """Unreadable file, then no speech, then no known words, else empty."""
    silent = T.plain_spaces(F.coalesce(transcript, F.lit("")))
    return (
        F.when(F.coalesce(note, F.lit("")) != "", note)
        .when(F.trim(silent) == "", NO_SPEECH)
        .when(~ok, NO_WORDS)
        .otherwise("")
    )


def score_transcripts(transcripts: DataFrame, model: TopicModel, labels: DataFrame, lemmas: DataFrame | None = None) -> DataFrame:
    """The transcript export: topic, style and confidence where placed, and a note where not."""
    return place_transcripts(infer_texts(transcripts, "transcript", model, lemmas), model.name, labels, model.n_topics)


def place_transcripts(inferred: DataFrame, model_name: str, labels: DataFrame, topics: int) -> DataFrame:
    spoken = F.trim(T.plain_spaces(F.coalesce("transcript", F.lit("")))) != ""
    ok = (F.col("known_terms") > 0) & spoken
    placed = inferred.select(
        F.lit(model_name).alias("model"), "recording", "seconds", "transcript",
        F.when(ok, W.assigned_topic(F.col("weights"))).alias("topic"),
        F.when(ok, W.confidence(F.col("weights"))).alias("confidence"),
        transcript_note(F.col("note"), F.col("transcript"), ok).alias("note"),
    )
    missing = F.col("topic").isNull()
    return with_labels(placed, labels, topics).select(
        "recording",
        F.bround("seconds", 1).alias("length_seconds"),
        T.duration(F.col("seconds")).alias("length"),
        "transcript",
        F.col("topic").alias("topic_number"),
        F.when(missing, "").otherwise(F.col("topic_name")).alias("topic_name"),
        F.coalesce("writing_style", F.lit("")).alias("writing_style"),
        F.bround("confidence", 3).alias("confidence"),
        "model", "note",
    )


def transcript_distribution(scored: DataFrame) -> DataFrame:
    """Recordings per topic, shown only when at least two recordings were placed."""
    counts = scored.where(F.col("topic_number").isNotNull()).groupBy(
        "model", F.col("topic_number").alias("topic")
    ).agg(F.count("*").alias("documents"))
    enough = counts.agg(F.coalesce(F.sum("documents"), F.lit(0))).scalar() >= 2
    return counts.where(enough)


def report_table(doc_topic: DataFrame, topic_term: DataFrame, labels: DataFrame, topics: int | dict[str, int]) -> DataFrame:
    """One row per topic for exported reports: name, documents (0 included) and its top words."""
    counts = with_labels(topic_counts(doc_topic, topics), labels)
    return counts.join(top_word_lists(topic_term), ["model", "topic"], "left").select(
        "model", "topic", "topic_name", "documents", "words"
    )
