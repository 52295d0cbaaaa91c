"""The analytics as jobs: `spark-submit ... -m themeloom <job> --data FOLDER [options]`, or `python -m themeloom`.

Every job reads and writes tables in one data folder, so that jobs can run one after another:
prepare -> train -> sweep, metrics, distribution, overview, maps, rating-sheet -> score-ratings, compare; score, transcripts.
"""

from __future__ import annotations

import argparse
import importlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.functions import constants as C
from themeloom.operators import compare, corpus, distribution, labels, lemmas, ratings, scoring
from themeloom.plans import evaluation, reports, training
from themeloom.session import build_session, materialise
from themeloom.sources import files, recordings


class Folder:
    """Names of the tables in a data folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def corpus(self) -> DataFrame:
        return self.spark.read.parquet(self.path("corpus"))

    def doc_topic(self) -> DataFrame:
        return self.spark.read.parquet(self.path("doc_topic"))

    def fitted(self) -> training.Fitted:
        return training.load(self.spark, self.path("models"))

    def topics(self) -> dict[str, int]:
        return {name: model.n_topics for name, model in self.fitted().models.items()}

    def labels(self) -> DataFrame:
        return files.read_labels(self.spark, self.path("topic_labels.json"))

    def table(self, name: str) -> DataFrame:
        return self.spark.read.csv(self.path(name), header=True, inferSchema=True)

    def write(self, df: DataFrame, name: str) -> None:
        files.write_csv(df, self.path(name), single_file=True)


def prepare(at: Folder, args) -> None:
    raw = files.read_complaints(at.spark, args.input)
    raw.write.mode("overwrite").parquet(at.path("raw"))  # split and keyed once
    raw = at.spark.read.parquet(at.path("raw"))
    chosen = dict(min_words=args.min_words, sample_size=args.sample_size)
    narratives = corpus.select_narratives(raw, "narrative", "product", args.product, **chosen)
    lemmas.lemma_table(narratives).write.mode("overwrite").parquet(at.path("lemmas"))  # training and scoring use it too
    clean = corpus.prepare(
        raw, "narrative", "product", args.product, lemmatise=at.spark.read.parquet(at.path("lemmas")), **chosen
    )
    clean.write.mode("overwrite").parquet(at.path("corpus"))


def train(at: Folder, args) -> None:
    clean = at.corpus()
    fitted = training.fit(clean, args.topics, lemmas=at.spark.read.parquet(at.path("lemmas")), min_df=args.min_df)
    fitted.save(at.spark, at.path("models"))
    fitted.doc_topic(clean).write.mode("overwrite").parquet(at.path("doc_topic"))


def sweep(at: Folder, args) -> None:
    found = evaluation.sweep(at.corpus(), min_df=args.min_df)
    at.write(found, "n_topics_sweep")
    compare.best_k(found).show()


def metrics(at: Folder, args) -> None:
    at.write(evaluation.final_metrics(at.fitted(), at.corpus()), "final_model_metrics")


def spread(at: Folder, args) -> None:
    per_topic, per_model = reports.distribution(at.doc_topic(), at.labels(), at.topics())
    at.write(per_topic.orderBy("model", "topic"), "topic_distribution")
    at.write(per_model, "distribution_metrics")


def maps(at: Folder, args) -> None:
    for name, table in reports.topic_map(at.fitted(), at.doc_topic()).items():
        table.write.mode("overwrite").parquet(at.path(f"topic_map/{name}"))


def rating_sheet(at: Folder, args) -> None:
    items, key = reports.rating_sheet(at.fitted(), at.doc_topic(), at.corpus())
    at.write(items.orderBy("code"), "rating_sheet_TEMPLATE")
    at.write(key.orderBy("code"), "rating_key")


def score_ratings(at: Folder, args) -> None:
    sheets = files.read_rating_sheets(at.spark, args.input)
    topics, models, rejected = ratings.score_ratings(sheets, at.table("rating_key"))
    at.write(topics, "interpretability_by_topic")
    at.write(models, "interpretability_scores")
    rejected.show(15, truncate=False)


def compare_models(at: Folder, args) -> None:
    wide = at.table("final_model_metrics")
    measured = wide.select(
        F.explode(F.create_map(F.lit("LDA"), "LDA", F.lit("NMF"), "NMF")).alias("model", "value"), "Metric"
    ).groupBy("model").pivot("Metric", ["Topic Coherence (c_v)", "Topic Diversity"]).agg(F.first("value")).toDF("model", "coherence", "diversity")
    summary = distribution.summarize(distribution.topic_counts(at.doc_topic(), at.topics()))
    rated = at.table("interpretability_scores") if files.exists(at.spark, at.path("interpretability_scores")) else None
    compared = compare.comparison(compare.criteria_values(measured, rated, summary))
    at.write(compared.orderBy("position"), "model_comparison")
    compare.leads(compared).show(truncate=False)


def score(at: Folder, args) -> None:
    upload = files.read_csv(at.spark, args.input) if args.text_col else files.read_lines(at.spark, args.input)
    fitted = at.fitted().models[args.model]
    scored = scoring.score_upload(upload, args.text_col or "text", fitted, at.labels())
    files.write_csv(scored, at.path("topic_assignments"))


def overview(at: Folder, args) -> None:
    for name, table in reports.overview(at.fitted(), at.doc_topic(), at.corpus(), at.labels()).items():
        at.write(table, f"reports/{name}")


def transcripts(at: Folder, args) -> None:
    """Recordings of a folder to the export table, and recordings per topic once two of them are placed."""
    module, _, function = args.transcriber.partition(":")
    speech = getattr(importlib.import_module(module), function)
    staged = recordings.stage(at.spark, args.input, args.pattern)
    spoken = scoring.transcribe_files(staged, speech)
    scored = materialise(scoring.score_transcripts(spoken, at.fitted().models[args.model], at.labels()), "scored-transcripts")
    files.write_csv(scored, at.path("voice_complaint_topics"))
    at.write(scoring.transcript_distribution(scored).orderBy("topic"), "voice_topic_counts")


def export_labels(at: Folder, args) -> None:
    files.write_text(labels.export_labels(at.labels(), C.MODELS), at.path("topic_labels_export"))


JOBS = {
    "prepare": prepare, "train": train, "sweep": sweep, "metrics": metrics, "distribution": spread, "maps": maps,
    "rating-sheet": rating_sheet, "score-ratings": score_ratings, "compare": compare_models, "score": score,
    "overview": overview, "transcripts": transcripts, "export-labels": export_labels,
}


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="themeloom", description=__doc__)
    parser.add_argument("job", choices=list(JOBS))
    parser.add_argument("--data", required=True, help="folder of tables, on storage every executor reaches")
    parser.add_argument("--input", help="file or folder the job reads besides the data folder")
    parser.add_argument("--product")
    parser.add_argument("--min-words", type=int, default=C.MIN_WORDS)
    parser.add_argument("--sample-size", type=int, default=0, help="narratives drawn at most; 0 keeps every one")
    parser.add_argument("--topics", type=int, default=C.N_TOPICS)
    parser.add_argument("--min-df", type=int, default=C.MIN_DF)
    parser.add_argument("--model", choices=C.MODELS, default=C.MODELS[0])
    parser.add_argument("--text-col", help="column of an uploaded CSV; without it the upload is text lines")
    parser.add_argument("--transcriber", help="module:function from a recording's bytes to (text, seconds)")
    parser.add_argument("--pattern", default="*", help="names of recordings to read, such as *.wav")
    args = parser.parse_args(argv)
    JOBS[args.job](Folder(build_session(), args.data), args)


if __name__ == "__main__":
    main()
