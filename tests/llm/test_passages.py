"""Runs of repeated sentences against brute force, and the pipeline's removal of near duplicates by row."""

import random
import re

import regex
from pyspark.sql import functions as F

import corpus_pipeline
from themeloom.llm import line_dedup

ENDS = regex.compile(r"(?<=[.!?][ \t])|(?<=\n)|(?<=\p{Ll} )(?=\p{Lu})", regex.V1)
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def units(text):
    places = [m.start() for m in ENDS.finditer(text) if 0 < m.start() < len(text)]
    return [(a, b) for a, b in zip([0, *places], [*places, len(text)]) if b > a]


def brute(rows, least):
    known = sorted({(i is None, i or 0, t) for i, t in rows if t is not None}, key=lambda r: r[:2])
    first = {}
    for none, i, t in known:
        for k, (a, b) in enumerate(units(t)):
            first.setdefault(" ".join(t[a:b].lower().split()), (none, i, t, k))
    out = {}
    for none, i, t in known:
        kinds = []
        for k, (a, b) in enumerate(units(t)):
            n = len(WORDS.findall(t[a:b]))
            kinds.append(("s" if n < 3 else "r" if first[" ".join(t[a:b].lower().split())] != (none, i, t, k) else "o", n, a, b))
        spans, k = [], 0
        while k < len(kinds):
            end = k
            while end < len(kinds) and kinds[end][0] != "o":
                end += 1
            run = [j for j in range(k, end) if kinds[j][0] == "r"]
            if run and sum(kinds[j][1] for j in range(run[0], run[-1] + 1)) >= least:
                spans.append((kinds[run[0]][2], kinds[run[-1]][3]))
            k = end + 1
        out[None if none else i, t] = spans
    return out


def test_passages_match_brute_force(spark):
    draw = random.Random(6)
    sentences = [" ".join(draw.choice(["la", "de", "reoi", "Éan", "of", "The"]) for _ in range(draw.randrange(1, 14))) + draw.choice(". . ! ? , ;".split()) for _ in range(60)]
    rows = [(k, draw.choice(["", "  "]).join(draw.choice(sentences) + draw.choice([" ", "\n", "  ", "\n\n"]) for _ in range(draw.randrange(0, 25)))) for k in range(90)]
    passage = " ".join(f"word{k} and some" for k in range(8)) + ". " + " ".join(f"more{k} of it" for k in range(9)) + "! Then it ends here now. "
    rows += [(200 + k, f"start {k} of a line without an end {passage}and goes on {k}") for k in range(40)]
    rows += [(300, None), (None, passage), (None, passage), (301, passage), (301, passage), (302, "x" * 200_000 + " . " * 3000), (303, "")]
    frame = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, removed string").repartition(4)
    for least in (25, 8):
        expected = brute(rows, least)
        found = line_dedup.dedup_passages(frame, run_words=least).collect()
        assert len(found) == len(rows) and line_dedup.dedup_passages(frame.where("false")).count() == 0
        left = {}
        for (i, t), spans in expected.items():
            kept = "".join(t[a:b] for a, b in zip([0, *[e for _, e in spans]], [*[s for s, _ in spans], len(t)]))
            left.setdefault(i, []).append((kept, [(s, e) for s, e in spans]))
        for r in found:
            if r["text"] is None:
                assert r["doc_id"] == 300 and r["removed"] == []
            else:
                assert (r["text"], sorted((x["start"], x["end"]) for x in r["removed"])) in left[r["doc_id"]]
    cut = {r["doc_id"]: r for r in line_dedup.dedup_passages(frame).collect() if r["doc_id"] is not None}
    assert "more3" in cut[200]["text"] and all("more3" not in cut[200 + k]["text"] and "goes on" in cut[200 + k]["text"] for k in range(1, 40))


def test_near_duplicates_go_by_row(spark, tmp_path):
    t, u = (" ".join(f"{w}{k}" for k in range(40)) for w in "tu")
    rows = [(1, t), (1, t), (2, t), (2, u), (None, t), (None, None), (5, ""), (5, ""), (6, u + " end")]
    frame = spark.createDataFrame([(i, x, "en", "s", 0) for i, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    frame.repartition(3).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    left = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    assert left.columns == docs.columns
    texts = [r["text"] for r in left.collect()]
    assert texts.count(t) == 1 and sum(x in (u, u + " end") for x in texts) == 1 and texts.count("") == 2 and texts.count(None) == 1
    assert corpus_pipeline.near_duplicates(spark, docs.where(F.lit(False)), str(tmp_path)).count() == 0
