"""N-gram Jaccard join by T-occurrence search.

Two documents link when their sets of word shingles overlap enough, which needs at least T common shingles. The
search of one document merges its short inverted lists with a heap, keeps the documents met often enough, and looks
these up in its long lists by binary search (DivideSkip). Around that core, Spark collapses equal sets, finds which
sets can meet at all (they share one of their first shingles in a common order), gathers those into blocks, and
unites what the links of all blocks connect.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.llm.common import materialise
from themeloom.llm.components import components
from themeloom.llm.word_hashing import word_hashes

SHINGLE_WORDS = 5
PERCENT = 80
COMMON_SHINGLES = 1 << 18  # bound of the table of frequent shingles; any bound gives the same links
COMMON_FROM = 2
BLOCK_SETS = 2000
HOT_FROM = 4096  # sets with a shingle, from which on its rows are not sent to one task
FILTER_WORDS = 1 << 20  # 64-bit words of the filter of wanted sets
_ODD = np.uint64(0xFF51AFD7ED558CCD)
_CLASS = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each text, its distinct shingles as sorted 64-bit hashes."""
    for hashes in word_hashes(texts):
        if not len(hashes):
            yield hashes
            continue
        size = min(width, len(hashes))
        n = len(hashes) - size + 1
        mixed = np.full(n, size, np.uint64)
        for k in range(size):  # every place counts: the state is multiplied and turned before the next word
            mixed = (mixed ^ hashes[k : k + n]) * _ODD
            mixed ^= mixed >> np.uint64(29)
        yield np.unique(mixed)


def set_digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def least_overlap(size: int, percent: int = PERCENT) -> int:
    """T of a set: no partner shares fewer shingles with it, whatever the partner's size."""
    return -(-percent * size // 100)


def links(a: int, b: int, common: int, percent: int = PERCENT) -> bool:
    return 100 * common >= percent * (a + b - common)


def first_shingles(shingles: np.ndarray, common: np.ndarray, counts: np.ndarray, percent: int, share: float = 1.0) -> np.ndarray:
    """The size - T + 1 first shingles in the common order, or `share` times as many.

    The order puts shingles outside the table of common ones first, by hash, then those in it by count and hash. Two
    linked sets share one of these shingles under any order that is the same for all sets.
    """
    size = len(shingles)
    many = min(size, math.ceil((size - least_overlap(size, percent) + 1) * share))
    if len(common) and many < size:
        at = np.searchsorted(common, shingles)
        at[at == len(common)] = 0
        often = np.where(common[at] == shingles, counts[at], 0)
        return shingles[np.argsort(often, kind="stable")[:many]]
    return shingles[:many]


class Block:
    """Sets that may link, added one by one; finds enough links to connect all that are connected.

    Sets already known to be connected need no further comparison, so lists are kept per group of connected sets:
    large groups have their own inverted index, small ones share one.
    """

    OWN_INDEX = 32
    PIVOTS = 8

    def __init__(self, percent: int):
        self.percent = percent
        self.sets: list[np.ndarray] = []
        self.group: list[int] = []
        self.members: dict[int, list[int]] = {}
        self.pivots: dict[int, list[int]] = {}
        self.shared: dict[int, list[int]] = defaultdict(list)
        self.own: dict[int, dict[int, list[int]]] = {}

    def common(self, a: np.ndarray, b: np.ndarray) -> int:
        small, large = (a, b) if len(a) <= len(b) else (b, a)
        at = np.searchsorted(large, small)
        at[at == len(large)] = 0
        return int((large[at] == small).sum())

    def linked(self, a: int, b: int) -> bool:
        one, two = self.sets[a], self.sets[b]
        if 100 * min(len(one), len(two)) < self.percent * max(len(one), len(two)):
            return False
        return links(len(one), len(two), self.common(one, two), self.percent)

    def search(self, query: int, index: dict[int, list[int]], skip: set[int]) -> Iterator[int]:
        """DivideSkip over one index: sets that link with the query, leaving out groups that are settled."""
        shingles = self.sets[query]
        lists = sorted((index[s] for s in shingles.tolist() if s in index), key=len)
        need = least_overlap(len(shingles), self.percent)
        if len(lists) < need:
            return
        # How many long lists to leave out of the merge: more as lists grow longer, at most T - 1.
        long_many = min(need - 1, int(need / (0.0085 * math.log2(len(lists[-1]) + 1) + 1)))
        short, long = lists[: len(lists) - long_many], lists[len(lists) - long_many :]
        least = need - len(long)
        last, met = -1, 0
        for candidate in heapq.merge(*short, [len(self.sets)]):
            if candidate == last:
                met += 1
                continue
            if last >= 0 and met >= least and self.group[last] not in skip:
                yield from self._probe(query, last, met, long)
            last, met = candidate, 1

    def _probe(self, query: int, candidate: int, met: int, long: list[list[int]]) -> Iterator[int]:
        a, b = len(self.sets[query]), len(self.sets[candidate])
        need = -(-self.percent * (a + b) // (100 + self.percent))
        for k, entries in enumerate(long):
            if met + len(long) - k < need:
                return
            at = bisect_left(entries, candidate)
            met += at < len(entries) and entries[at] == candidate
        if met >= need and links(a, b, met, self.percent):
            yield candidate

    def add(self, shingles: np.ndarray) -> list[int]:
        """Adds a set; returns earlier sets that it links with, at least one per group it is connected to."""
        me = len(self.sets)
        self.sets.append(shingles)
        self.group.append(me)
        found: list[int] = []
        joined: set[int] = set()
        for root in sorted(self.own, key=lambda r: -len(self.members[r]))[:4]:
            row = self.pivots[root]
            for k, pivot in enumerate(row):
                if self.linked(me, pivot):
                    row.insert(0, row.pop(k))
                    found.append(pivot)
                    joined.add(root)
                    break
        for root in [r for r in self.own if r not in joined]:
            for other in self.search(me, self.own[root], joined):
                self.pivots[root] = [other, *self.pivots[root][: self.PIVOTS - 1]]
                found.append(other)
                joined.add(root)
                break
        for other in self.search(me, self.shared, joined):
            found.append(other)
            joined.add(self.group[other])
        self.members[me] = [me]
        self.pivots[me] = [me]
        for s in shingles.tolist():
            self.shared[s].append(me)
        for root in joined:
            self._unite(root, self.group[me])
        return found

    def _unite(self, a: int, b: int) -> None:
        if len(self.members[a]) < len(self.members[b]):
            a, b = b, a
        moved = self.members.pop(b)
        for x in moved:
            self.group[x] = a
        self.members[a] += moved
        self.pivots[a] = (self.pivots[a] + self.pivots.pop(b))[: self.PIVOTS]
        if b in self.own:
            index = self.own.pop(b)
            if a not in self.own:
                self.own[a] = index
                self._move(self.members[a][: len(self.members[a]) - len(moved)], index)
            else:
                for s, entries in index.items():
                    self.own[a][s] = list(heapq.merge(self.own[a].get(s, []), entries))
        elif a in self.own:
            self._move(moved, self.own[a])
        elif len(self.members[a]) >= self.OWN_INDEX:
            self.own[a] = {}
            self._move(self.members[a], self.own[a])

    def _move(self, members: list[int], index: dict[int, list[int]]) -> None:
        """Takes sets out of the shared index into a group's own."""
        for x in sorted(members):
            for s in self.sets[x].tolist():
                entries = self.shared[s]
                entries.pop(bisect_left(entries, x))
                if not entries:
                    del self.shared[s]
                own = index.setdefault(s, [])
                if own and own[-1] > x:
                    own.insert(bisect_left(own, x), x)
                else:
                    own.append(x)


def _slices(batches: Iterator[pa.RecordBatch], width: int, rows: int = 1024) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            part = batch.slice(start, rows)
            yield part, list(shingle_sets(part.column(part.schema.get_field_index("text")), width))


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """id, n_shingles and the set's digest; an empty set has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _slices(batches, width):
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_digest(s) if len(s) else None for s in sets], pa.binary())],
                names=["id", "n_shingles", "sid"],
            )

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, n_shingles long, sid binary")


def _shingle_counts(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """How many documents have each shingle among their first ones by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.uint64)
        for _, sets in _slices(batches, width, 4096):
            firsts = [first_shingles(s, none, none, percent, 1.2) for s in sets if len(s) > 1]
            if firsts:
                shingle, many = np.unique(np.concatenate(firsts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(shingle.view(np.int64)), pa.array(many, pa.int64())], names=["shingle", "n"])

    return docs.select("text").mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))


def size_class(size: int, percent: int = PERCENT) -> int:
    """Linked sets are of one class or of neighbouring ones: a class spans sizes up to the ratio that links allow."""
    return math.floor(math.log(size) / -math.log(percent / 100) + 1e-9) if percent < 100 else size


def _classed(shingles: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Shingles told apart by class of size; `counts` repeats each class."""
    return (shingles ^ (np.repeat(sizes, counts).astype(np.uint64) * _CLASS)) * _ODD


def small_part(size: int, percent: int) -> int:
    """How many first shingles of a set are enough to meet its larger partners, which come with all of theirs."""
    return size - -(-2 * percent * size // (100 + percent)) + 1


def _postings(docs: DataFrame, width: int, percent: int, common: tuple[np.ndarray, np.ndarray], hot_from: int) -> DataFrame:
    """(shingle, sid, salt) for the first shingles of every set; a hot shingle's rows have salts, others 0.

    Shingles meet within a class of sizes. A set posts all its first shingles in its own class, and in the next one,
    where its partners are larger, the fewer ones that a smaller partner needs.
    """
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, counts = shared.value
        hot = shingles[counts >= hot_from]
        for _, many in _slices(batches, width):
            sets = {set_digest(s): s for s in many if len(s)}  # equal sets of a slice once
            if not sets:
                continue
            own_class = [first_shingles(s, shingles, counts, percent) for s in sets.values()]
            firsts = own_class + [f[: small_part(len(s), percent)] for f, s in zip(own_class, sets.values())]
            classes = np.array([size_class(len(s), percent) for s in sets.values()])
            lengths = np.array([len(f) for f in firsts])
            flat = np.concatenate(firsts)
            owner = np.repeat(np.tile(np.arange(len(sets)), 2), lengths)
            posted = _classed(flat, np.concatenate([classes, classes + 1]), lengths)
            salt = np.zeros(len(flat), np.int32)
            if len(hot):
                at = np.searchsorted(hot, flat)
                at[at == len(hot)] = 0
                own = np.array([1 + int.from_bytes(d[:2]) for d in sets], np.int32)
                salt = np.where(hot[at] == flat, own[owner], 0).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(posted.view(np.int64)), pa.array(list(sets), pa.binary()).take(pa.array(owner)), pa.array(salt)],
                names=["shingle", "sid", "salt"],
            )

    return docs.select("text").mapInArrow(run, "shingle long, sid binary, salt int")


def _meetings(postings: DataFrame) -> DataFrame:
    """(sid, block): the sets that share a first shingle, with the smallest set that has it.

    Postings are sorted in each partition once and read in a stream. Hot shingles pass through and meet their smallest
    set by a join that Spark can split or broadcast by its own measure.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, block, alone = None, None, True  # the run that the last row belongs to
        for batch in batches:
            of = batch.column(0).to_numpy()
            salted = batch.column(2).to_numpy() > 0
            sids = batch.column(1)
            begins = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            ends = np.append(begins[1:], len(of))
            take, blocks, hot = [], [], []
            for begin, end in zip(begins[(ends - begins > 1) | (begins == 0) | (ends == len(of)) | salted[begins]].tolist(),
                                  ends[(ends - begins > 1) | (begins == 0) | (ends == len(of)) | salted[begins]].tolist()):
                if salted[begin]:
                    take += range(begin, end)
                    blocks += [None] * (end - begin)
                    hot += [int(of[begin])] * (end - begin)
                    shingle = None
                    continue
                if shingle is None or of[begin] != shingle:
                    shingle, block, alone = of[begin], sids[begin].as_py(), True
                for k in range(begin, end):
                    sid = sids[k].as_py()
                    if sid != block:
                        if alone:
                            take.append(k)  # the row only carries the pair; its sid is replaced below
                            blocks.append(block)
                            hot.append(-1)
                            alone = False
                        take.append(k)
                        blocks.append(block)
                        hot.append(0)
            sid = [b if h == -1 else s for s, b, h in zip(sids.take(pa.array(take, pa.int64())).to_pylist(), blocks, hot)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(sid, pa.binary()), pa.array(blocks, pa.binary()), pa.array([None if b is not None else h for h, b in zip(hot, blocks)], pa.int64())],
                names=["sid", "block", "shingle"],
            )

    sent = postings.repartition("shingle", "salt").sortWithinPartitions("shingle", "sid")
    met = materialise(sent.mapInArrow(run, "sid binary, block binary, shingle long").distinct(), "meetings")
    hot = met.where("block is null").select("sid", "shingle")
    least = hot.groupBy("shingle").agg(F.min("sid").alias("block"))
    return met.where("block is not null").select("sid", "block").unionByName(hot.join(least, "shingle").select("sid", "block")).distinct()


def _block_links(percent: int):
    """Links of a block's sets, or between two of its parts, as (u, v) of digests."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["shingles"].to_pylist(), table["sid"].to_pylist()), key=lambda r: (len(r[0]), r[1]))
        block, u, v = Block(percent), [], []
        for shingles, sid in rows:
            for other in block.add(np.frombuffer(shingles, np.uint64)):
                u.append(sid)
                v.append(rows[other][1])
        return pa.table({"u": pa.array(u, pa.binary()), "v": pa.array(v, pa.binary())})

    return run


def _filter_places(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and bits of the filter for digests given as rows of two 64-bit numbers; two places each."""
    return digests % np.uint64(FILTER_WORDS), (digests >> np.uint64(40)) & np.uint64(63)


def _wanted_filter(wanted: DataFrame) -> np.ndarray:
    """A filter of fixed size that holds all digests of `wanted`: words of bits, or-ed in Spark by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint64)
            word, bit = _filter_places(digests)
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array((np.uint64(1) << bit).view(np.int64))], names=["word", "bits"])

    table = wanted.select("sid").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(FILTER_WORDS, np.uint64)
    bits[table["word"].to_numpy()] = table["bits"].to_numpy().view(np.uint64)
    return bits


def _full_sets(docs: DataFrame, width: int, wanted: DataFrame) -> DataFrame:
    """(sid, shingles as sorted bytes), one row per set; the filter lets all wanted sets pass and few others."""
    shared = docs.sparkSession.sparkContext.broadcast(_wanted_filter(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for _, many in _slices(batches, width):
            sets = {set_digest(s): s for s in many if len(s)}
            if not sets:
                continue
            word, bit = _filter_places(np.frombuffer(b"".join(sets), np.uint64))
            passed = ((bits[word] >> bit) & np.uint64(1)).reshape(-1, 2).all(1)
            chosen = [(d, s.tobytes()) for (d, s), ok in zip(sets.items(), passed) if ok]
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in chosen], pa.binary()), pa.array([b for _, b in chosen], pa.binary())], names=["sid", "shingles"])

    return docs.select("text").mapInArrow(run, "sid binary, shingles binary").groupBy("sid").agg(F.first("shingles").alias("shingles"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = SHINGLE_WORDS, percent: int = PERCENT,
                    common_shingles: int = COMMON_SHINGLES, hot_from: int = HOT_FROM, block_sets: int = BLOCK_SETS) -> DataFrame:
    """One row per document: the id column, n_shingles and component_id, the smallest id that links reach.

    Texts are lower-cased (A-Z); a text of fewer words than `width` has its whole sequence as its one shingle. Null,
    empty and blank texts have an empty set, link with nothing and are their own component. Equal sets link at once
    and are one class, so copies are never expanded. Rows that repeat an id are each linked by their own text; a row
    without an id belongs to its component but never names it. Other columns are not read. Shingles are compared
    by 64-bit hashes and whole sets by 128 bits.
    """
    source = docs.select(docs[id_col].alias("id"), docs[text].alias("text"))
    rows = materialise(_sets(source, width), "shingle-sets")
    # Written first: the rows behind the counts are shuffled shingles of all sets, whose files a written table frees.
    frequent = _shingle_counts(source, width, percent).where(F.col("n") >= COMMON_FROM).orderBy(F.desc("n"), "shingle").limit(common_shingles)
    often = materialise(frequent, "common-shingles").toArrow()
    shingle, count = often["shingle"].to_numpy().view(np.uint64), often["n"].to_numpy()
    order = np.argsort(shingle)
    common = (shingle[order], count[order])
    # A block is the smallest set of some shingle with all sets that share such a shingle with it. Any two sets that
    # share a first shingle lie together in the block of its smallest set, so blocks need not be united.
    blocks = _meetings(_postings(source, width, percent, common, hot_from))
    sized = blocks.groupBy("block").agg(F.ceil(F.count("*") / block_sets).cast("int").alias("parts"))
    placed = materialise(
        blocks.join(sized, "block").withColumn("part", F.pmod(F.xxhash64("sid"), F.col("parts")).cast("int")), "shingle-blocks"
    )
    full = _full_sets(source, width, placed.select("sid").distinct())
    dealt = full.join(placed, "sid").select(
        "sid", "shingles", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"), "part"
    ).select("sid", "shingles", "block", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"))
    found = dealt.groupBy("block", "a", "b").applyInArrow(_block_links(percent), "u binary, v binary")
    united = components(found, "shingle-components")
    labelled = rows.join(united.withColumnRenamed("node", "sid"), "sid", "left").withColumn("_label", F.coalesce("component", "sid"))
    names = labelled.where("_label is not null").groupBy("_label").agg(F.min("id").alias("component_id"))
    named = labelled.join(names, "_label", "left")
    return named.select(F.col("id").alias(id_col), "n_shingles", F.when(F.col("_label").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
