"""A trie of conversations by their turns, with subtree totals by time-forward processing.

A node is a distinct sequence of first turns. It is known by a 128-bit prefix sum of hashed (depth, turn), and named by
its smallest member conversation and its depth. Nodes are sorted by reverse level order; each pops what its children
sent from a priority queue that spills, and sends its own totals to its parent: first within shards of whole
subtrees, then, for the few heavy nodes above them, across the shards' roots.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.llm.common import materialise
from themeloom.llm.ordered_runs import running
from themeloom.llm.spill import SpillingQueue

# A node with more members than this lies above the shards, up to TOP_NODES of them: those with most members.
SHARD_MEMBERS = 4096
TOP_NODES = 65536
# Turns of one number are ordered by role and so many first characters of the text, then by hash.
TIE_CHARS = 64
_IDS_PER_CHUNK = 8192
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
_ROW = [*NODE, "n_ends", "end_id", "k1", "k2", "to_top"]


def turn_codes(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, pos (from 1), t1, t2 (hashes of role and text) and n (code points of the text), one row per turn.

    Turns are ordered by number, null first; ties by role, the first TIE_CHARS characters of the text and its hash, so
    only equal turns are left in any order. Null roles and texts are empty; rows without a conversation id belong to
    none and are left out. Whole texts are hashed in the scan; only these narrow rows move.
    """
    said, spoke = F.coalesce(turns[text], F.lit("")), F.coalesce(turns[role], F.lit(""))
    narrow = turns.where(turns[conv].isNotNull()).select(
        turns[conv].cast("long").alias("conv_id"), turns[turn].alias("_turn"), spoke.alias("_role"), F.substring(said, 1, TIE_CHARS).alias("_head"),
        F.xxhash64(spoke, said).alias("t1"), F.xxhash64(F.lit("second"), said, spoke).alias("t2"), F.length(said).cast("long").alias("n"),
        F.monotonically_increasing_id().alias("_salt"),
    )
    ranked = running(materialise(narrow, "trie-turns"), "conv_id", ["_turn", "_role", "_head", "t1", "_salt"], purpose="trie-places")
    return ranked.select("conv_id", F.col("_rank").alias("pos"), "t1", "t2", "n")


def _prefixes(codes: DataFrame) -> DataFrame:
    """conv_id, depth, the node's key (k1, k2), its parent's (p1, p2), n, and `last` where the conversation ends."""
    step = codes.select(
        "conv_id", F.col("pos").alias("depth"), F.xxhash64(F.lit(1), "pos", "t1", "t2").alias("s1"), F.xxhash64(F.lit(2), "pos", "t1", "t2").alias("s2"), "n",
    )
    run = running(materialise(step, "trie-steps"), "conv_id", ["depth"], ["s1", "s2"], "trie-prefixes")

    def parents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            before = [pa.array(b.column(f"_sum_{s}").to_numpy() - b.column(s).to_numpy(), pa.int64()) for s in ("s1", "s2")]
            yield pa.RecordBatch.from_arrays(
                [b.column("conv_id"), b.column("depth"), b.column("_sum_s1"), b.column("_sum_s2"), *before, b.column("n"), b.column("_last")],
                names=["conv_id", "depth", "k1", "k2", "p1", "p2", "n", "last"],
            )

    kind = "conv_id long, depth long, k1 long, k2 long, p1 long, p2 long, n long, last boolean"
    return materialise(run.mapInArrow(parents, kind), "trie-paths")


def _pass_up(queue_limit: int):
    """Rows by falling depth: each pops its children's messages and sends its totals to its parent in the shard."""
    kind = pa.schema([(c, pa.bool_() if c == "to_top" else pa.int64()) for c in _ROW])

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue, out = SpillingQueue(queue_limit), []
        for batch in batches:
            for r in batch.to_pylist():
                children, leaves, saved = r["m_children"], r["m_leaves"], r["m_saved"]
                key = (-r["depth"], r["conv_id"])
                while (message := queue.least()) is not None and message[:2] == key:
                    queue.pop()
                    children, leaves, saved = children + 1, leaves + message[2], saved + message[3]
                if r["n_convs"] == 1:  # the head of a tail that no other conversation shares
                    children, leaves, saved = 1 - r["n_ends"], 1, 0
                else:
                    leaves, saved = (leaves if children else 1), saved + (r["n_convs"] - 1) * r["n"]
                if not r["to_top"]:
                    queue.push((1 - r["depth"], r["parent_conv_id"], leaves, saved))
                r.update(n_children=children, n_leaves=leaves, saved_tokens=saved)
                out.append(r)
                if len(out) == 4096:
                    yield pa.RecordBatch.from_pylist(out, schema=kind)
                    out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=kind)

    return totals, ", ".join(f"{c} {'boolean' if c == 'to_top' else 'long'}" for c in _ROW)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of ids of one node, in order, as comma-joined bytes."""
    kind = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("first", pa.int64()), ("ids", pa.binary())])

    def row(key, ids):
        return {"k1": key[0], "k2": key[1], "first": ids[0], "ids": ",".join(map(str, ids)).encode()}

    key, ids = None, []
    for batch in batches:
        out = []
        for k1, k2, conv in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("k1", "k2", "conv_id"))):
            if (k1, k2) != key or len(ids) >= _IDS_PER_CHUNK:
                if ids:
                    out.append(row(key, ids))
                key, ids = (k1, k2), []
            ids.append(conv)
        yield pa.RecordBatch.from_pylist(out, schema=kind)
    if ids:
        yield pa.RecordBatch.from_pylist([row(key, ids)], schema=kind)


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("sha", pa.string())])
    key, state = None, None
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if (r["k1"], r["k2"]) != key:
                if state:
                    out.append({"k1": key[0], "k2": key[1], "sha": state.hexdigest()})
                key, state = (r["k1"], r["k2"]), hashlib.sha256(r["ids"])
            else:
                state.update(b",")
                state.update(r["ids"])
        yield pa.RecordBatch.from_pylist(out, schema=kind)
    if state:
        yield pa.RecordBatch.from_pylist([{"k1": key[0], "k2": key[1], "sha": state.hexdigest()}], schema=kind)


def _end_hashes(ends: DataFrame) -> DataFrame:
    """SHA-256 of each node's end ids in order. Ids are joined in even stretches first; one task then hashes the
    stretches of a node one after another, as the hash asks for, a row for every _IDS_PER_CHUNK ids."""
    keys = ["k1", "k2", "conv_id"]
    chunks = ends.select(*keys).repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(_chunks, "k1 long, k2 long, first long, ids binary")
    return chunks.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "first").mapInArrow(_hashes, "k1 long, k2 long, sha string")


def _sha(id_column: Column) -> Column:
    return F.sha2(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary"), 256)


def build(codes: DataFrame, conversations: DataFrame, shard_members: int = SHARD_MEMBERS, top_nodes: int = TOP_NODES, queue_limit: int = 1 << 18) -> DataFrame:
    """The nodes of the trie of `codes` (conv_id, pos from 1 without holes, t1, t2, n), one row per node.

    conv_id (smallest member), depth, parent_conv_id (root: null), n_convs, n_children, n_leaves (childless nodes in the
    subtree), saved_tokens (n of the node's last turn for each member but one, over the subtree) and ends_sha256 of the
    ids of conversations that end there. `conversations` (conv_id) lists all members, turnless ones too, which end in
    the root. Without conversations there is no root and no row.

    Nodes with one member form plain tails; only their first node takes part in the passes. A subtree stays in one
    shard once its root has at most `shard_members` members, or is not among the `top_nodes` nodes with most; so the
    top that one task passes through has at most top_nodes rows, and a turn or prefix that a third of all
    conversations share lies in the top, its parts in many shards. Memory of a pass is bounded by `queue_limit`.
    """
    paths = _prefixes(codes)
    ids = materialise(conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long")).distinct(), "trie-members")
    turnless = ids.join(paths.where("depth = 1").select("conv_id"), "conv_id", "left_anti")
    whole, bare = ids.agg(F.min("conv_id"), F.count("*")).first(), turnless.agg(F.min("conv_id"), F.count("*")).first()
    spark = codes.sparkSession

    nodes = materialise(
        paths.groupBy("k1", "k2", "depth").agg(
            F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("n").alias("n"), F.min("p1").alias("p1"), F.min("p2").alias("p2"),
            F.count_if("last").alias("n_ends"), F.min(F.when(F.col("last"), F.col("conv_id"))).alias("end_id"),
        ), "trie-nodes",
    )
    above = nodes.select(
        F.col("k1").alias("p1"), F.col("k2").alias("p2"), (F.col("depth") + 1).alias("depth"),
        F.col("conv_id").alias("parent_conv_id"), F.col("n_convs").alias("parent_n"),
    )
    first = nodes.where("depth = 1").withColumns({"parent_conv_id": F.lit(whole[0]).cast("long"), "parent_n": F.lit(whole[1])})
    linked = materialise(
        first.unionByName(nodes.where("depth > 1").join(above, ["p1", "p2", "depth"])), "trie-links",
    )
    zero, no = F.lit(0).cast("long"), F.lit(False)
    tails = linked.where("parent_n = 1 AND depth > 1").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", (1 - F.col("n_ends")).alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        zero.alias("saved_tokens"), "n_ends", "end_id", "k1", "k2", no.alias("to_top"),
    )
    shared = linked.where("parent_n > 1 OR depth = 1")

    heavy = materialise(
        nodes.where(F.col("n_convs") > shard_members).orderBy(F.desc("n_convs"), "depth", "conv_id").limit(top_nodes).select("k1", "k2"), "trie-top",
    )  # at most top_nodes rows of two longs, so they may be broadcast
    mine, parents = F.broadcast(heavy), F.broadcast(heavy.select(F.col("k1").alias("p1"), F.col("k2").alias("p2")))
    roots = paths.join(mine, ["k1", "k2"], "left_anti")
    roots = roots.where("depth = 1").unionByName(roots.where("depth > 1").join(parents, ["p1", "p2"], "left_semi").select(*roots.columns))
    labels = roots.select("conv_id", F.col("k1").alias("r1"), F.col("k2").alias("r2"))
    light = shared.join(mine, ["k1", "k2"], "left_anti").join(labels, "conv_id").withColumns({
        "to_top": (F.col("k1") == F.col("r1")) & (F.col("k2") == F.col("r2")), "m_children": zero, "m_leaves": zero, "m_saved": zero,
    })
    totals, kind = _pass_up(queue_limit)
    done = materialise(
        light.repartition("r1", "r2").sortWithinPartitions(F.desc("depth"), "conv_id").mapInArrow(totals, kind), "trie-shards",
    )

    sent = done.where("to_top").groupBy("parent_conv_id", (F.col("depth") - 1).alias("depth")).agg(
        F.count("*").alias("m_children"), F.sum("n_leaves").alias("m_leaves"), F.sum("saved_tokens").alias("m_saved"),
    ).withColumnRenamed("parent_conv_id", "conv_id")
    crown = shared.join(mine, ["k1", "k2"], "left_semi").select("conv_id", "depth", "parent_conv_id", "n_convs", "n", "n_ends", "end_id", "k1", "k2")
    if whole[1]:
        root = spark.createDataFrame(
            [(whole[0], 0, None, whole[1], 0, bare[1], bare[0], 0, 0)],
            "conv_id long, depth long, parent_conv_id long, n_convs long, n long, n_ends long, end_id long, k1 long, k2 long",
        )
        crown = crown.unionByName(root)
    top = crown.join(sent, ["conv_id", "depth"], "left").fillna(0, ["m_children", "m_leaves", "m_saved"]).withColumn("to_top", F.col("depth") == 0)
    top_done = top.repartition(1).sortWithinPartitions(F.desc("depth"), "conv_id").mapInArrow(totals, kind)

    every = tails.unionByName(done).unionByName(materialise(top_done, "trie-crown"))
    several = nodes.where("n_ends > 1").select("k1", "k2")
    ends = paths.where("last").join(several, ["k1", "k2"], "left_semi").select("k1", "k2", "conv_id")
    if bare[1] > 1:
        ends = ends.unionByName(turnless.select(zero.alias("k1"), zero.alias("k2"), "conv_id"))
    few = every.where("n_ends < 2").select(*NODE, _sha(F.col("end_id")).alias("ends_sha256"))
    many = every.where("n_ends > 1").join(_end_hashes(ends), ["k1", "k2"]).select(*NODE, F.col("sha").alias("ends_sha256"))
    return few.unionByName(many)


def trie(turns: DataFrame, **columns: str) -> DataFrame:
    """The trie of a table of turns as it stands: see `turn_codes` for columns and order, `build` for the rows."""
    conv = columns.get("conv", "conv_id")
    return build(turn_codes(turns, **columns), turns.select(turns[conv].alias("conv_id")))


def graft(turns: DataFrame, family: int = 100, most: int = 5) -> DataFrame:
    """The trie of conversations rebuilt on the first turns of their family's first conversation.

    Conversation c starts with the first h turns of conversation c - c % family, h = crc32(c) % (most + 1), or all of
    them if there are fewer, and goes on with its own turns after its first h. Only turn codes are joined.
    """
    codes = materialise(turn_codes(turns), "trie-codes")
    ids = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long")).distinct()
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)
    base = F.col("conv_id") - F.col("conv_id") % family
    heads = codes.where((F.col("conv_id") % family == 0) & (F.col("pos") <= most)).withColumnRenamed("conv_id", "base")
    lengths = heads.groupBy("base").agg(F.max("pos").alias("k"))
    own = codes.withColumns({"h": taken, "base": base}).where("pos > h").join(lengths, "base", "left").select(
        "conv_id", (F.least("h", F.coalesce("k", F.lit(0))) + F.col("pos") - F.col("h")).cast("long").alias("pos"), "t1", "t2", "n",
    )
    begun = ids.withColumns({"h": taken, "base": base}).join(heads, "base").where("pos <= h").select("conv_id", "pos", "t1", "t2", "n")
    return build(own.unionByName(begun), ids)
