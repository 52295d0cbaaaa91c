"""Operators on texts against brute force, and the edge cases that all of them define."""

import collections
import re
import zlib

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from themeloom.llm import factorisation, jaccard_join, licences, line_dedup, packing, piece_encoding, quality_rules, suffix_tree, token_transducer

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
LONG = "the quick brown fox and the lazy dog of that town " * 3000
TEXTS = [
    (1, "the cat sat on the mat with a hat\nshort line\nthe cat sat on the mat with a hat"),
    (2, None), (3, ""), (4, " \n\t "), (5, LONG), (5, LONG),
    (6, "The  cat sat\ton the mat with a hat\nSomething else that stays here too\nReleased under the MIT License."),
    (None, "no id at all but words enough to count here"), (7, "日本語 é́ \u0000x    y ▁z <s></s> 😀"), (8, "a b c d e f g h i j"),
    (9, "a b c d e f g h i j k"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", 3, "clash") for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, kept string, n_words int, removed string").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def test_quality_rules(docs, none):
    judged = quality_rules.judge(docs)
    for row in judged.collect():
        text = row["text"] or ""
        words = WORD.findall(text)
        windows = list(zip(words, words[1:], words[2:]))
        many = collections.Counter(windows)
        covered = {k + d for k, g in enumerate(windows) if many[g] > 1 for d in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        assert (row["n_words"], row["word_chars"]) == (len(words), sum(map(len, words)))
        assert (row["n_repeat_words"], row["n_dup_lines"]) == (len(covered), len(lines) - len(set(lines)))
        assert row["base_failed"] == (len(words) < 50 or 100 * len(covered) > 50 * len(words))
    assert judged.where("kept").count() == 0 and quality_rules.judge(none).count() == 0


def test_quality_rules_keep_prose_and_drop_symbols(spark):
    prose = " ".join(f"the w{k} of and x{k}" for k in range(30))
    frame = spark.createDataFrame([(prose,), (prose.replace(" ", "### "),)], "text string")
    assert [r["kept"] for r in quality_rules.judge(frame).collect()] == [True, False]


def test_licences(spark, docs, none):
    apache = "Licensed under the Apache License, Version 2.0. Odd words. You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    frame = spark.createDataFrame([(apache,), ("All rights reserved.\nReleased under the MIT License.",), ("License of nothing.",)], "text string")
    found = licences.scan(frame).collect()
    assert [r["licences"] for r in found] == ["Apache-2.0", "MIT,proprietary", ""]
    assert (found[0]["n_matches"], found[0]["matches"][0]["n_sentences"], found[0]["first_sentence"]) == (1, 4, 0)
    assert licences.scan(docs).count() == len(TEXTS) and licences.scan(none).count() == 0


def test_line_dedup(docs, none):
    rows = {(r["doc_id"], r["text"] is None): r for r in line_dedup.dedup_lines(docs).collect()}
    assert len(line_dedup.dedup_lines(docs).collect()) == len(TEXTS) and line_dedup.dedup_lines(none).count() == 0
    first = rows[1, False]
    assert first["text"] == "the cat sat on the mat with a hat\nshort line"
    assert [tuple(s) for s in first["removed"]] == [(45, 78, 1)]
    assert rows[6, False]["text"] == "Something else that stays here too\nReleased under the MIT License."
    assert rows[2, True]["text"] is None and rows[3, False]["text"] == "" and rows[5, False]["text"] == LONG


def test_piece_encoding_and_counts(docs, none):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    both = docs.select("doc_id", "text", piece_encoding.encode_column(PIECES)("text").alias("ids")).collect()
    for row in both:
        assert row["ids"] == library.encode(row["text"] or "", add_eos=True)
    round_trip = docs.select("text", piece_encoding.decode_column(PIECES)(piece_encoding.encode_column(PIECES)("text")).alias("back"))
    assert all(r["back"] == library.decode(library.encode(r["text"] or "")) for r in round_trip.collect())
    counts = sorted(r["n_tokens"] for r in token_transducer.count_tokens(docs, PIECES).collect())
    assert counts == sorted(len(library.encode(t or "")) for _, t in TEXTS)
    assert piece_encoding.encode_digests(docs, PIECES).count() == len(TEXTS)
    assert piece_encoding.encode_digests(none, PIECES).count() == token_transducer.count_tokens(none, PIECES).count() == 0


def test_chunk_maps_compose_in_any_grouping():
    machine = token_transducer.transducer(PIECES)
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for text in ("internationalization of   things", "   spaced  out  words  ", "x" * 70, "日本 の 😀😀 end"):
        spaced = "▁" + text.replace(" ", "▁")
        for size in (1, 3, 8):
            maps = [machine.chunk_map(spaced[k : k + size]) for k in range(0, len(spaced), size)]
            left = maps[0]
            for each in maps[1:]:
                left = left.then(machine, each)
            right = maps[-1]
            for each in reversed(maps[:-1]):
                right = each.then(machine, right)
            want = len(library.encode(text))
            assert left.apply(machine, machine.initial)[1] == right.apply(machine, machine.initial)[1] == machine.count(text, size) == want


def test_packing(docs, none):
    tokenizer = Tokenizer.from_file(WORDS)
    rows = packing.pack_documents(docs, WORDS).collect()
    lengths = collections.defaultdict(int)
    places = collections.defaultdict(list)
    for r in rows:
        lengths[r["doc_id"]] += r["length"]
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    want = collections.defaultdict(int)
    for i, t in TEXTS:
        want[i] += len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1
    assert lengths == want
    for found in places.values():
        end = 0
        for offset, length in sorted(found):
            assert offset == end
            end += length
        assert end <= 4096
    assert len(places) <= sum(want.values()) // 4096 + 2
    one = next(r for r in rows if r["doc_id"] == 3)
    assert one["ids_crc32"] == zlib.crc32((1).to_bytes(4, "little"))
    assert packing.pack_documents(none, WORDS).count() == 0


def test_best_fit_steps_match_best_fit_one_by_one():
    for seed in range(5):
        lengths = [(k * k * (seed + 3)) % 97 + 1 for k in range(400)]
        gaps = []
        for length in sorted(lengths, reverse=True):
            fit = [k for k, g in enumerate(gaps) if g >= length]
            if fit:
                gaps[min(fit, key=lambda k: gaps[k])] -= length
            else:
                gaps.append(100 - length)
        steps = packing.best_fit_steps(collections.Counter(lengths), 100)
        used = 1 + max(s[2] for s in steps)
        assert used <= len(gaps) <= used + max(lengths)  # a placement may open several sequences
        assert sum(lengths) <= 100 * len(gaps)


def test_jaccard_join_matches_brute_force(spark, docs, none):
    base = [f"w{k}" for k in range(60)]
    texts = [" ".join(base), " ".join(base), " ".join([*base[:59], "new"]), " ".join(["other", *base[1:58], "b", "c"]), " ".join(base[:40]), "one two", "ONE two"]
    rows = [(k, t) for k, t in enumerate(texts)] + [(100 + k, " ".join([*base[: k % 50], "x", *base[k % 50 :], *(["y"] * (k % 3))])) for k in range(80)]
    sets = {}
    for i, t in rows:
        w = WORD.findall(t.lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))}
    group = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                common = len(sets[a] & sets[b])
                if 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common) and group[a] != group[b]:
                    group[a] = group[b] = min(group[a], group[b])
                    changed = True
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for parts in (2000, 7):  # blocks whole and in parts
        found = jaccard_join.near_duplicates(frame, block_sets=parts, hot_from=4096 if parts == 2000 else 2).collect()
        assert {r["doc_id"]: r["component_id"] for r in found} == group
        assert {r["doc_id"]: r["n_shingles"] for r in found} == {i: len(s) for i, s in sets.items()}
    edge = {(r["doc_id"]): (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(docs).collect()}
    assert edge[2] == (0, 2) and edge[4] == (0, 4) and edge[None][0] == 6 and edge[9] == (7, 8)
    assert jaccard_join.near_duplicates(docs).count() == len(TEXTS) and jaccard_join.near_duplicates(none).count() == 0


def test_suffix_tree(spark, docs, none):
    rows = [(k, "alpha beta gamma delta " * 5 + f"rare{k} omega") for k in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    tree, _ = suffix_tree.fit(frame, symbols=4)
    assert len(tree.levels[0].states)
    known = {v: k for k, v in tree.symbols.items()}
    for context in ([0], [1], [2, 3], [3, 1]):  # every state's distribution over the symbols adds up to one
        total = sum(10 ** tree.scores(suffix_tree.np.array([*context, s]))[-1] for s in [0, *known, tree.other])
        assert abs(total - 1) < 1e-6
    scored = suffix_tree.score_documents(frame).collect()
    counts, train = collections.Counter(), 0
    for k, t in rows:
        if zlib.crc32(str(k).encode()) % 10:
            counts.update([*t.split(), ""])
    total, distinct = sum(counts.values()), len(counts)
    import math

    for r in scored:
        words = [*dict(rows)[r["doc_id"]].split(), ""]
        want = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in words)
        assert r["base_score"] == pytest.approx(want) and r["n_known"] == sum(counts[w] > 0 for w in words)
        assert r["score"] > r["base_score"] and r["train_tokens"] == total
    assert suffix_tree.score_documents(docs).count() == len(TEXTS) and suffix_tree.score_documents(none).count() == 0


def test_classifier(spark, docs, none):
    good = [(k, f"the river of {k} and a house with the light of day number {k * 7}", 1) for k in range(60)]
    bad = [(100 + k, f"BUY!! NOW!! {k}### $$$ {k * 3}%%% FREE!!", 0) for k in range(60)]
    frame = spark.createDataFrame([(i, t, len(t)) for i, t, _ in good + bad], "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(i, q) for i, _, q in good + bad] + [(1, None)], "doc_id long, quality int")
    scored = factorisation.classify(frame, labels).collect()
    truth = {i: q for i, _, q in good + bad}
    held = [r for r in scored if r["held_out"]]
    assert held and sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in scored)
    wide = docs.withColumns({"n_chars": F.lit(None).cast("long"), "score": F.lit("clash")})
    assert factorisation.classify(wide, labels).count() == len(TEXTS)
    empty = factorisation.classify(wide, labels.where("false")).collect()
    assert {r["score"] for r in empty} == {0.5}
    assert factorisation.classify(none.withColumn("n_chars", F.lit(1)), labels).count() == 0


def test_factorisation_identity():
    draw = factorisation.np.random.default_rng(1)
    size = factorisation.BUCKETS + len(factorisation.STATISTICS) + 1
    machine = factorisation.Machine(0.3, draw.normal(size=size), draw.normal(size=(size, 4)), 1)
    places, values = factorisation.np.array([3, 17, 400]), factorisation.np.array([0.5, 1.0, 2.0])
    pairs = sum(machine.factors[places[a]] @ machine.factors[places[b]] * values[a] * values[b] for a in range(3) for b in range(a))
    assert machine.margin(places, values) == pytest.approx(0.3 + machine.weights[places] @ values + pairs)
