"""Embedding near-dedup, components and the pipeline against brute force."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from themeloom.llm import components, vector_dedup

SF = "/root/testdata/sf0.001"


def test_components(spark):
    pairs = [(k, k + 1) for k in range(30)] + [(50, 60), (60, 70), (70, 50), (80, 80)]
    found = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert found == {**{k: 0 for k in range(31)}, 50: 50, 60: 50, 70: 50}


def test_vectors_match_brute_force(spark):
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(40, 16))
    rows = np.concatenate([centres[draw.integers(0, 40, 500)] + draw.normal(scale=0.12, size=(500, 16)), np.repeat(centres[:1], 60, 0)]).astype(np.float32)
    data = [(k, [float(x) for x in v], "y") for k, v in enumerate(rows)]
    odd = [(1000, None, ""), (1001, [0.0] * 16, ""), (1002, [float("nan")] * 16, ""), (1003, [1.0, None], ""), (1004, [], ""), (None, data[0][1], ""), (1005, [1.0, 2.0], ""), (1006, [2.0, 4.0], "")]
    frame = spark.createDataFrame(data + odd, "vec_id long, embedding array<float>, n_links string")
    unit = rows.astype(float) / np.linalg.norm(rows.astype(float), axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    label = np.arange(len(rows))
    for _ in range(len(rows)):
        new = np.minimum(label, np.where(near, label[None, :], len(rows)).min(1))
        if (new == label).all():
            break
        label = new
    for leaf, block in ((512, 2048), (64, 30)):
        found = {r["vec_id"]: r for r in vector_dedup.near_vectors(frame, leaf_rows=leaf, block_rows=block).collect()}
        total = sum(found[k]["n_links"] for k in range(len(rows)))
        assert 0.98 * near.sum() <= total <= near.sum()
        if leaf == 512:
            assert all(found[k]["n_links"] == near[k].sum() and found[k]["component_id"] == label[k] for k in range(len(rows)))
        for k in (1000, 1001, 1002, 1003, 1004):
            assert (found[k]["n_links"], found[k]["component_id"], found[k]["kept"]) == (0, k, True)
        assert (found[None]["n_links"], found[None]["kept"]) == (0, False)
        assert (found[1006]["n_links"], found[1006]["component_id"]) == (1, 1005)
    assert vector_dedup.near_vectors(frame.where("false")).count() == 0


def test_pipeline_keeps_clean_documents_and_drops_the_rest(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialise(stage(spark, docs, SF), name)
        assert docs.columns == columns and 0 < docs.count() <= seen
        seen = docs.count()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert docs.join(labels, "doc_id").where("quality = 0").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == seen


def test_pipeline_stages_take_awkward_tables(spark):
    base = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(900001, None, None, None, None), (None, "", "en", "s", 0)], base.schema)
    for docs in (base.where("false"), base.limit(60).unionByName(base.limit(3)).unionByName(odd).withColumn("kept", F.lit("x"))):
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.materialise(stage(spark, docs, SF), name)
            docs.count()
