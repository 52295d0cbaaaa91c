import csv

import numpy as np

from themeloom.__main__ import main


def read_back(content: bytes) -> tuple[str, float]:
    return content.decode(), 61.0


THEMES = [["loan", "bank", "rate", "mortgages"], ["phone", "call", "calls", "stop"], ["theft", "police", "identity", "stolen"]]


def test_jobs_run_one_after_another(spark, tmp_path):
    rng = np.random.default_rng(5)
    with open(tmp_path / "raw.csv", "w", newline="") as f:
        out = csv.writer(f)
        out.writerow(["Product", "Consumer complaint narrative"])
        for i in range(90):
            out.writerow([f"P{i % 2}", "The " + " ".join(rng.choice(THEMES[i % 3], 16)) + ",\nXXXX $5.00"])
        out.writerow(["P0", ""])
        out.writerow(["P0", "too short"])
    (tmp_path / "topic_labels.json").write_text('{"NMF": {"0": {"name": "First", "style": "S"}}, "LDA": {}}')
    (tmp_path / "new.txt").write_text("the bank raised my loan rate\n\nunknownword\n")
    data = ["--data", str(tmp_path)]
    main(["prepare", *data, "--input", str(tmp_path / "raw.csv")])
    assert spark.read.parquet(str(tmp_path / "corpus")).count() == 90
    main(["train", *data, "--topics", "3"])
    for job in ("metrics", "distribution", "overview", "rating-sheet", "compare", "maps", "export-labels"):
        main([job, *data])
    main(["score", *data, "--input", str(tmp_path / "new.txt")])
    read = lambda name: spark.read.csv(str(tmp_path / name), header=True).collect()
    assert len(read("topic_distribution")) == 6 and len(read("rating_key")) == 6 and len(read("model_comparison")) == 6
    assert {r["text"]: r["confidence"] for r in read("topic_assignments")}["unknownword"] == "0.0"
    assert spark.read.text(str(tmp_path / "topic_labels_export")).first()[0] == '{"NMF":{"0":{"name":"First","style":"S"}},"LDA":{}}'
    assert {r["documents"] for r in read("reports/corpus_summary")} == {"90"} and len(read("reports/report_table")) == 6
    assert len(read("reports/representatives")) == 18 and len(read("reports/executive_facts")) == 2
    (tmp_path / "calls").mkdir()
    for name, text in (("a", "bank loans and mortgages"), ("b", "bank loans and mortgages"), ("c", ""), ("d", "qq zz"), ("e", "\udce9")):
        (tmp_path / "calls" / f"{name}.wav").write_bytes(text.encode("utf-8", "surrogateescape"))
    main(["transcripts", *data, "--input", str(tmp_path / "calls"), "--transcriber", "tests.test_jobs:read_back", "--pattern", "*.wav"])
    calls = {r["recording"]: r for r in read("voice_complaint_topics")}
    assert calls["a.wav"]["topic_number"] == calls["b.wav"]["topic_number"] is not None and calls["a.wav"]["length"] == "1:01"
    notes = {name: r["note"] for name, r in calls.items() if r["note"]}
    assert notes == {"c.wav": "No speech recognised", "d.wav": "No words the model recognises", "e.wav": "Couldn't read this file (UnicodeDecodeError)"}
    assert [r["documents"] for r in read("voice_topic_counts")] == ["2"]
