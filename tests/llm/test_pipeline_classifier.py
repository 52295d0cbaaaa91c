"""The pipeline's classifier learns from rows that earlier stages dropped."""

from pyspark.sql import functions as F

import corpus_pipeline
from themeloom.llm import factorisation


def test_classifier_rejects_a_bad_document_that_passes_the_rules(spark, tmp_path):
    prose = " ".join(f"the river of {k} and a house in the light of day" for k in range(8))
    spam = " ".join(f"buy{k} the offer{k} now and click{k} for a prize{k} in the shop{k}" for k in range(8))
    rows = [(k, f"{prose} w{k}", 1) for k in range(60)] + [(100 + k, f"{spam} ### w{k}", 0) for k in range(60)]
    rows += [(300, f"{spam} w7", None), (301, f"{prose} w7", None)]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t), q) for i, t, q in rows], "doc_id long, text string, lang string, source string, n_chars long, quality int")
    frame.drop("quality").write.parquet(f"{tmp_path}/documents.parquet")
    frame.where("quality is not null").select("doc_id", "quality").write.parquet(f"{tmp_path}/labels.parquet")
    docs = frame.drop("quality").where("doc_id < 100 or doc_id >= 300")  # the bad examples are gone
    assert corpus_pipeline.rules(spark, docs, str(tmp_path)).where("doc_id = 300").count() == 1
    kept = {r["doc_id"] for r in corpus_pipeline.classifier(spark, docs, str(tmp_path)).collect()}
    assert 300 not in kept and 301 in kept and len(kept) == 61


def test_training_rows_are_bounded_after_the_join_and_by_class(spark):
    docs = spark.range(1000).select(F.col("id").alias("doc_id"))
    labels = spark.range(100000).select(F.col("id").alias("doc_id"), (F.col("id") % 100 != 0).cast("int").alias("quality"))
    found = factorisation.training_rows(docs, labels, "doc_id", "quality", F.lit(False), 100).groupBy("_label").count().collect()
    assert {r["_label"]: r["count"] for r in found} == {0.0: 10, 1.0: 90}
