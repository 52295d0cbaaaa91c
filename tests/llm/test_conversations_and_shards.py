"""Sharding, the prefix trie and conversation repair against brute force."""

import hashlib
import itertools
import math
import random
import zlib

from pyspark.sql import functions as F

from themeloom.llm import conversation_repair, prefix_trie, sharding
from themeloom.llm.spill import SpillingQueue, SpillingStack


def test_spilling_structures():
    draw = random.Random(1)
    queue, plain = SpillingQueue(7), []
    for _ in range(400):
        if plain and draw.random() < 0.4:
            assert queue.least() == min(plain)
            plain.remove(queue.pop())
        else:
            item = (draw.randrange(50), draw.randrange(9), draw.randrange(9))
            queue.push(item)
            plain.append(item)
    assert [queue.pop() for _ in plain] == sorted(plain) and queue.least() is None
    stack = SpillingStack(20)
    for k in range(50):
        stack.push(k, 3)
    assert list(stack.drain()) == list(range(49, -1, -1)) and list(stack.drain()) == []


def score(key, shard, weight):
    u = (int(hashlib.md5(f"{key}:{shard}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13
    return -weight / math.log(u)


def test_shards(spark):
    texts = [None, "", "é", "a b", "x" * 300_000]
    data = [(k % 400, texts[k % 5], "y") for k in range(900)] + [(None, "n", "")] * 3 + [(7, "hot", "")] * 600
    docs = spark.createDataFrame(data, "doc_id long, text string, shard string").repartition(5)
    weights, grown = {0: 1.0, 1: 2.5, 2: 1.0}, {0: 1.0, 1: 2.5, 2: 1.0, 9: 1.5}
    rows = sharding.place(docs, weights, grown).collect()
    assert len(rows) == len(data)
    for r in rows:
        key = "" if r["doc_id"] is None else r["doc_id"]
        assert r["shard"] == max(weights, key=lambda s: score(key, s, weights[s]))
        assert r["grown_shard"] in (r["shard"], 9) and r["grown_shard"] == max(grown, key=lambda s: score(key, s, grown[s]))
    expected = sorted((d is not None, d or 0, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for d, t, _ in data)
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["text_crc32"], r["size"]) for r in rows) == expected
    for shard in weights:
        own = sorted((r for r in rows if r["shard"] == shard), key=lambda r: r["slot"])
        assert [r["slot"] for r in own] == list(range(len(own)))
        order = [(r["doc_id"] is not None, r["doc_id"] or 0, r["text_crc32"]) for r in own]
        assert order == sorted(order)
    again = sharding.place(docs.repartition(2), weights, grown).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
    whole = sharding.assign(docs, weights)
    assert whole.columns == ["doc_id", "text", "shard"] and whole.count() == len(data)
    assert sharding.place(docs.where("false"), weights).count() == 0


def test_write_shards(spark, tmp_path):
    docs = spark.range(200).selectExpr("id AS doc_id", "repeat('a', cast(id AS int)) AS text")
    sharding.write_shards(docs, str(tmp_path / "s"), sharding.equal_weights(4))
    read = spark.read.parquet(str(tmp_path / "s"))
    assert sorted(tuple(r) for r in read.select("doc_id", "text").collect()) == sorted(tuple(r) for r in docs.collect())
    assert read.where(sharding.shard_of(F.col("doc_id"), sharding.equal_weights(4)) != F.col("shard")).count() == 0


def brute_trie(rows, rebuild):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [(r, t) for _, r, t in sorted(v)] for c, v in own.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        paths[c] = own.get(c - c % 100, [])[:h] + turns[h:] if rebuild else turns
    nodes = {}
    for c, p in paths.items():
        for d in range(len(p) + 1):
            nodes.setdefault(tuple(p[:d]), []).append(c)
    out = {}
    for path, members in nodes.items():
        below = [q for q in nodes if q[: len(path)] == path]
        leaves = [q for q in below if not any(len(x) == len(q) + 1 and x[: len(q)] == q for x in below)]
        ends = sorted(c for c in members if len(paths[c]) == len(path))
        out[min(members), len(path)] = (
            min(nodes[path[:-1]]) if path else None, len(members), sum(len(q) == len(path) + 1 for q in below), len(leaves),
            sum((len(nodes[q]) - 1) * len(q[-1][1]) for q in below if q), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        )
    return out


def talks(seed, n=260):
    draw = random.Random(seed)
    rows = []
    for c in range(n):
        if c in (100, 101):
            continue
        for turn in range(draw.randrange(1, 8)):
            rows.append((c, None if draw.random() < 0.05 else turn, draw.choice(["user", "assistant", None]), draw.choice(["a", "bé.", None, "c c"])))
    rows += [(300, k, "user", "hot") for k in range(60)] + [(301, k, "user", "hot") for k in range(60)]
    rows += [(k, 0, "user", "hot") for k in range(310, 395)] + [(k, 0, "system", "") for k in range(310, 350)]
    rows += [(None, 0, "user", "a"), (402, 0, "user", "x"), (402, 0, "user", "x"), (10**15 + 400, 3, "user", "🙂")]
    draw.shuffle(rows)
    return rows


def as_dict(frame):
    rows = frame.collect()
    found = {(r["conv_id"], r["depth"]): tuple(r)[2:] for r in rows}
    assert len(found) == len(rows)
    return found


def test_prefix_trie(spark):
    rows = talks(2)
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("depth", F.lit("clash")).repartition(6)
    expected = brute_trie(rows, True)
    assert as_dict(prefix_trie.graft(turns)) == expected
    plain = brute_trie(rows, False)
    assert as_dict(prefix_trie.trie(turns)) == plain
    codes = prefix_trie.turn_codes(turns)
    ids = turns.select("conv_id")
    for members, top, queue in ((1, 1000, 2), (5, 1000, 1 << 18), (1, 3, 5)):
        assert as_dict(prefix_trie.build(codes, ids, members, top, queue)) == plain
    assert prefix_trie.graft(turns.where("false")).count() == 0
    one = spark.createDataFrame([(5, 1, "user", "a"), (5, 2, "user", "b")], turns.schema.simpleString()[7:-1].replace(",depth:string", "").replace(":", " ").replace("bigint", "long"))
    assert as_dict(prefix_trie.trie(one)) == brute_trie([tuple(r) for r in one.collect()], False)


def brute_repair(rows):
    """rows of one conversation after damage, in order."""
    faults, seen = [], set()
    for _, role, text in rows:
        stripped = text.strip(" \t\n\x0b\x0c\r")
        faults.append("B" if not stripped else "D" if (role, text) in seen else "T" if stripped[-1] not in ".!?" else "")
        seen.add((role, text))
    best = None
    # States as strings of role initials are enough at this size: search by cost, then by audit.
    frontier = {("", 0): (0, "", ())}
    legal = [""] + ["ua" * k for k in range(1, 12)] + ["s" + "ua" * k for k in range(1, 12)]
    prefixes = {w[:k] for w in legal for k in range(len(w) + 1)}

    def better(table, key, value):
        if key not in table or value[:2] < table[key][:2]:
            table[key] = value

    def insert_all(table):
        for _ in range(4):
            for word, (cost, audit, lines) in list(table.items()):
                for initial, name in (("u", "user"), ("a", "assistant")):
                    if word[0] + initial in prefixes:
                        better(table, (word[0] + initial, 0), (cost + 3, audit + "I", (*lines, f"{name}:")))
        return table

    for (_, role, text), fault in zip(rows, faults):
        following = {}
        for word, (cost, audit, lines) in insert_all(frontier).items():
            better(following, word, (cost + 4, audit + "D", lines))
            if fault not in ("B", "D"):
                extra = 3 * (fault == "T")
                if word[0] + role[:1] in prefixes and role[:1]:
                    better(following, (word[0] + role[:1], 0), (cost + extra, audit + "K", (*lines, f"{role}:{text}")))
                for name in ("user", "assistant"):
                    if word[0] + name[0] in prefixes:
                        better(following, (word[0] + name[0], 0), (cost + 3 + extra, audit + "R", (*lines, f"{name}:{text}")))
        frontier = following
    best = min((v for (w, _), v in insert_all(frontier).items() if w in legal), key=lambda v: v[:2])
    turns = [t for t, _, _ in rows if t is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("B"), faults.count("D"), faults.count("T"), illegal,
        best[0], best[1], hashlib.sha256("\n".join(best[2]).encode()).hexdigest(),
    ), best[2]


def brute_damage(rows):
    found = {}
    for c, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        kept = found.setdefault(c, [])
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(x for x in text if x not in ".!?")
        if kind == 4:
            role = "user"
        kept += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, v in found.items()}


def test_repair(spark):
    draw = random.Random(4)
    rows = []
    for c in [None, *range(250)]:
        turn = 0
        for k in range(draw.randrange(1, 9)):
            turn += draw.choice([0, 1, 1, 1, 1, 3])
            role = draw.choice(["user", "assistant", "system", None, "", "umpire"]) if draw.random() < 0.3 else ("user", "assistant")[k % 2]
            rows.append((c, None if draw.random() < 0.05 else turn, role, draw.choice(["Yes.", "no", "Ok!  \n", None, "", " ", "é?", "x" * 40_000 + "."])))
    rows += [(999, k, "user", "Hello.") for k in range(9)] + [(2**60 + 1, 5, "assistant", "Ä.")]
    draw.shuffle(rows)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("fault", F.lit("clash")).repartition(5)
    damaged = conversation_repair.damage(table)
    expected = {c: brute_repair(v) for c, v in brute_damage(rows).items()}
    assert any(v[0][6] == "" for v in expected.values())
    for spill in (1 << 24, 150):
        found = conversation_repair.repair(damaged, spill).collect()
        assert {r["conv_id"]: tuple(r)[1:] for r in found} == {c: v[0] for c, v in expected.items()} and len(found) == len(expected)
    turns = {}
    for r in conversation_repair.repaired_turns(damaged).orderBy("conv_id", "turn").collect():
        turns.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    assert turns == {c: list(v[1]) for c, v in expected.items() if v[1]}
    assert conversation_repair.repair(damaged.where("false")).count() == 0


def test_every_short_conversation_is_repaired_at_least_cost(spark):
    kinds = [("user", "a."), ("assistant", "b."), ("system", "c."), ("user", ""), ("assistant", "cut")]
    cases = [case for n in range(4) for case in itertools.product(kinds, repeat=n)]
    rows = [(k, i, role, text, False) for k, case in enumerate(cases) for i, (role, text) in enumerate(case)]
    found = {r["conv_id"]: tuple(r)[1:] for r in conversation_repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, gone boolean")).collect()}
    for k, case in enumerate(cases):
        if case:
            assert found[k] == brute_repair([(i, role, text) for i, (role, text) in enumerate(case)])[0], case
