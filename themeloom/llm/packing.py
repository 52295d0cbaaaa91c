"""Best-fit packing of tokenized texts into sequences of a fixed length, in bulk steps.

Pieces and gaps are both whole numbers up to the sequence length, so their range-sorted orders are runs: all pieces
of one length, all sequences with one gap. A superstep takes the next length, longest first, and sweeps its run over
the gaps from its successor upwards: the smallest gap that holds a piece is filled with as many as fit, then the
next sequence of that gap, then the next gap; what is left opens sequences. Which piece goes where is settled by
rank alone: the r-th piece of a length takes the r-th place of that length. Gaps are updated and the next step
follows. The steps see counts per length only, at most one number per possible length; Spark tokenizes, counts,
ranks and places the pieces.
"""

from __future__ import annotations

import bisect
import json
import os
import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from themeloom.llm.common import materialise

MAX_TOKENS = 4096
END_ID = 1
MEMO_WORDS = 300_000  # of each of the two generations
PARTS_AT_ONCE = 512
SLICE_ROWS = 256
# What a file must say for its words to be cut into parts here, and the same in Python. Words of printable ASCII and
# composed Latin-1 letters alone, which NFC leaves as they are; none with "<", so none that holds a special string.
FOLDING = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"},
]}
SPLITTING = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]}
PLAIN = re.compile("[!-;=-~À-ÖØ-öø-ÿ]+").fullmatch
PART = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+").findall
PIECES = "id {id}, piece int, start long, length long, ids_crc32 long"


class Generations:
    """A memo that is filled for many keys at once, in two generations of at most MEMO_WORDS entries and one filling.

    A full generation becomes the older one and keys met again come back from it, so keys that occur once
    push out no frequent ones.
    """

    def __init__(self, compute: Callable[[list], list[bytes]]):
        self.compute = compute
        self.recent: dict = {}
        self.before: dict = {}

    def learn(self, keys: Iterable) -> dict:
        """A memo that holds all of `keys`, which are distinct; unknown ones are computed in one call."""
        if len(self.recent) >= MEMO_WORDS:
            self.recent, self.before = {}, self.recent
        recent, before = self.recent, self.before
        unmet = [k for k in keys if k not in recent]
        recent.update((k, before[k]) for k in unmet if k in before)
        new = [k for k in unmet if k not in before]
        if new:
            recent.update(zip(new, self.compute(new)))
        return recent


class WordEncoder:
    """Encodes white-space separated words with a tokenizer that drops white space, remembering met words.

    The tokenizer's normalisation and pre-tokenization never reach across ASCII white space, which
    a probe tests when the file is opened, so a text's ids are those of its words in a row.

    If the file lower-cases and splits words as FOLDING and SPLITTING say, words of plain letters, digits and marks are
    cut into the same parts here: a word in another case, or with other marks around it, is mostly known by its parts,
    and unknown parts of many words are one call, taken apart by the suffix that ends each.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        probe = ["a", "b́", "'s", "1", "é"]
        apart = [i for w in probe for i in self.tokenizer.encode(w, add_special_tokens=False).ids]
        if self.tokenizer.encode(" \t".join(probe), add_special_tokens=False).ids != apart:
            raise ValueError("the tokenizer does not drop white space between words")
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        suffix = spec["model"].get("end_of_word_suffix")
        self.in_parts = bool(suffix) and spec["normalizer"] == FOLDING and spec["pre_tokenizer"] == SPLITTING and all(
            "<" in token["content"] for token in spec["added_tokens"]
        )
        if self.in_parts:
            size = self.tokenizer.get_vocab_size()
            self.ends = np.array([(self.tokenizer.id_to_token(k) or "").endswith(suffix) for k in range(size)])
        self.words = Generations(self._words)
        self.parts = Generations(self._parts)

    def _apart(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [struct.pack(f"<{len(ids)}I", *ids) for ids in (e.ids for e in found)]

    def _parts(self, parts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(parts), PARTS_AT_ONCE):
            some = parts[at : at + PARTS_AT_ONCE]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            stops = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
            if len(stops) == len(some) and stops[-1] == 4 * len(ids):
                raw = ids.tobytes()
                out += map(raw.__getitem__, map(slice, [0, *stops], stops))
            else:
                out += self._apart(some)
        return out

    def _words(self, words: list[bytes]) -> list[bytes]:
        texts = [w.decode("utf-8", "replace") for w in words]
        if not self.in_parts:
            return self._apart(texts)
        cut = [PART(t.lower()) if PLAIN(t) else None for t in texts]
        ids_of = self.parts.learn(dict.fromkeys(chain.from_iterable(filter(None, cut))))
        others = iter(self._apart([t for t, parts in zip(texts, cut) if parts is None]))
        return [next(others) if parts is None else b"".join(map(ids_of.__getitem__, parts)) for parts in cut]

    def learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        """The ids of a slice's words, as little-endian unsigned 32-bit numbers."""
        return self.words.learn(words)


@lru_cache(maxsize=1)
def word_encoder(path: str) -> WordEncoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already fill the cores
    return WordEncoder(path)


def tokenized_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", max_tokens: int = MAX_TOKENS,
                     end_id: int = END_ID) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32. A null or empty text is the end id alone."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = word_encoder(path)
        slices = (batch.slice(at, SLICE_ROWS) for batch in batches for at in range(0, batch.num_rows, SLICE_ROWS))
        for part in slices:
            # Bytes split at ASCII white space alone, which is what separates words.
            split = [t.split() if t else [] for t in part.column(1).cast(pa.large_binary()).to_pylist()]
            ids_of = own.learn(set(chain.from_iterable(split)))
            row, piece, start, length, crc = [], [], [], [], []
            for k, words in enumerate(split):
                ids = b"".join(map(ids_of.__getitem__, words)) + end
                for n, at in enumerate(range(0, len(ids), 4 * max_tokens)):
                    own_ids = ids[at : at + 4 * max_tokens]
                    row.append(k)
                    piece.append(n)
                    start.append(at // 4)
                    length.append(len(own_ids) // 4)
                    crc.append(zlib.crc32(own_ids))
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["id", "piece", "start", "length", "ids_crc32"],
            )

    source = docs.select(docs[id_col].alias("id"), docs[text].alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, PIECES.format(id=kind))


def best_fit_steps(counts: dict[int, int], max_tokens: int = MAX_TOKENS) -> list[tuple[int, int, int, int, int]]:
    """The placements of all supersteps: (length, first rank, first sequence, pieces per sequence, offset).

    A placement holds the ranks up to the next one's first rank of the same length. `counts` has at most
    max_tokens entries, so neither the time nor the memory depends on the number of pieces, only on how many
    different gaps the lengths meet.
    """
    runs: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> [(first sequence, sequences)]
    sizes: list[int] = []  # gaps with runs, ascending
    placements, opened = [], 0

    def give(gap: int, first: int, many: int) -> None:
        if gap and many:
            if not runs[gap]:
                bisect.insort(sizes, gap)
            runs[gap].append((first, many))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(sizes, length)
            if at < len(sizes):
                gap = sizes[at]
                first, many = runs[gap].pop()
                if not runs[gap]:
                    sizes.pop(at)
            else:
                gap, first, many = max_tokens, opened, -(-left // (max_tokens // length))
                opened += many
            each = gap // length
            used = min(many, -(-left // each))
            placed = min(left, used * each)
            placements.append((length, rank, first, each, max_tokens - gap))
            full, over = divmod(placed, each)
            give(gap - each * length, first, full)
            if over:
                give(gap - over * length, first + full, 1)
            give(gap, first + used, many - used)
            rank += placed
            left -= placed
    return placements


def pack(pieces: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Adds sequence_id and offset (long) to rows with id, piece and length; sequences have no gaps inside.

    The ranks of a length are counted per hash bucket and then within buckets, so a length that a third of all
    pieces share is not one group. Repeated rows are packed as often as they occur. An empty table stays empty.
    """
    buckets = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = pieces.withColumn("_bucket", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    cells = keyed.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    counts = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    placements = sorted(best_fit_steps(counts, max_tokens))
    starts = np.array([(p[0] << 44) + p[1] for p in placements], np.int64)
    detail = np.array([p[1:] for p in placements], np.int64).reshape(-1, 4)
    shared = pieces.sparkSession.sparkContext.broadcast((starts, detail))

    def place(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        begins, rows = shared.value
        for length, rank in columns:
            size, r = length.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False)
            found = rows[np.searchsorted(begins, (size << 44) + r, side="right") - 1]
            sequence, nth = np.divmod(r - found[:, 0], found[:, 2])
            yield pa.StructArray.from_arrays(
                [pa.array(found[:, 1] + sequence), pa.array(found[:, 3] + nth * size)], names=["sequence_id", "offset"]
            )

    placed = F.arrow_udf(place, "struct<sequence_id:bigint,offset:bigint>", F.ArrowUDFType.SCALAR_ITER)
    before = cells.select(
        "length", "_bucket", (F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("_n")).alias("_before")
    )
    ranked = keyed.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("id", "piece", "ids_crc32")))
    located = ranked.join(before, ["length", "_bucket"]).withColumn(
        "_at", placed(F.col("length"), F.col("_before") + F.col("_rank") - 1)
    )
    return located.select(*[F.col(c) for c in pieces.columns], F.col("_at.sequence_id").alias("sequence_id"), F.col("_at.offset").alias("offset"))


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", max_tokens: int = MAX_TOKENS,
                   end_id: int = END_ID) -> DataFrame:
    """Tokenizes every whole text, ends it with end_id, cuts longer ones and packs all pieces.

    Returns the id column, piece, start, length, ids_crc32, sequence_id and offset. Texts of any size and null or
    repeated ids are packed row by row; other columns of docs are not read.
    """
    pieces = materialise(tokenized_pieces(docs, path, id_col, text, max_tokens, end_id), "pieces")
    return pack(pieces, max_tokens).withColumnRenamed("id", id_col)
