"""Token counts by a finite-state transducer compiled from a merge-type vocabulary.

A state says which pieces may still be under way: for each place where an unfinished piece can have started, its
node in the trie of pieces, the token before that place and the difference of token counts. Reading a character
leads to one next state and changes the count by a number written on the transition. States and transitions are
compiled when first needed and kept up to a fixed number. A text is cut into chunks; each chunk's map from entry
state to exit state and count is built apart from the others, and the maps are composed by a prefix scan.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.llm.common import BoundedCache, text_batches
from themeloom.llm.piece_encoding import PART
from themeloom.llm.piece_model import SPACE, Compatibility, load, reachable

CHUNK = 1 << 16
MAX_TRANSITIONS = 400_000
PART_LIMIT = 150_000
LONGEST_KEPT = 64
_START = None


class Transducer:
    """step(state, character) gives the next state and the count emitted; `initial` is the state at a cut."""

    def __init__(self, path: str):
        self.vocabulary = load(path)
        self.compatible = Compatibility(self.vocabulary)
        self.children: list[dict[str, int]] = [{}]
        self.accepts: list[str | None] = [None]
        for piece in sorted(reachable(path)):
            node = 0
            for char in piece:
                if char not in self.children[node]:
                    self.children[node][char] = len(self.children)
                    self.children.append({})
                    self.accepts.append(None)
                node = self.children[node][char]
            self.accepts[node] = piece
        self.initial = (((0, _START, 0),), False)
        self.transitions: dict[tuple, tuple] = BoundedCache(self._compile, MAX_TRANSITIONS)
        self.parts = BoundedCache(lambda part: self.run(self.initial, part)[1], PART_LIMIT)

    def _compile(self, key: tuple) -> tuple:
        """Next state and emitted count. A state is (places, after a character that is no space)."""
        (places, after_text), char = key
        if char == SPACE and after_text:
            places = self.initial[0]  # no piece spans this cut
        if char not in self.vocabulary.ids:
            # Bytes join no merge, so what follows starts afresh.
            return (self.initial[0], True), len(char.encode())
        live, last, emitted = [], None, 0
        for node, before, count in places:
            child = self.children[node].get(char)
            if child is None:
                continue
            piece = self.accepts[child]
            if last is None and piece is not None and (before is _START or self.compatible(before, piece)):
                last, emitted = piece, count + 1  # exactly one piece can end the text here
            if self.children[child]:
                live.append((child, before, count))
        state = (*((node, before, count - emitted) for node, before, count in live), (0, last, 0))
        return (state, char != SPACE), emitted

    def run(self, state: tuple, text: str) -> tuple[tuple, int]:
        """Exit state and count of a text read from a state."""
        total, transitions = 0, self.transitions
        for char in text:
            state, emitted = transitions[state, char]
            total += emitted
        return state, total

    def chunk_map(self, chunk: str) -> ChunkMap:
        """The map of a chunk, valid for every entry state: what comes before its first cut is left open."""
        cut = _first_cut(chunk)
        if cut < 0:
            return ChunkMap(chunk, None, 0)
        total, tail = 0, ""
        for part in PART.findall(chunk, cut):
            total += self._count(tail)
            tail = part
        state, emitted = self.run(self.initial, tail)
        return ChunkMap(chunk[:cut], state, total + emitted)

    def _count(self, part: str) -> int:
        return self.parts[part] if len(part) <= LONGEST_KEPT else self.run(self.initial, part)[1]

    def count(self, text: str, chunk: int = CHUNK) -> int:
        """Tokens of a whole text, without begin or end, by composing the maps of its chunks in order."""
        if not text:
            return 0
        spaced = SPACE + text.replace(" ", SPACE)
        maps = [self.chunk_map(spaced[k : k + chunk]) for k in range(0, len(spaced), chunk)]
        state, total = self.initial, 0
        for each in maps:  # the scan; a map with no cut in it needs the state before it
            state, emitted = each.apply(self, state)
            total += emitted
        return total


class ChunkMap:
    """head: characters whose count depends on the entry state; after them the exit state and count are fixed."""

    __slots__ = ("head", "state", "rest")

    def __init__(self, head: str, state: tuple | None, rest: int):
        self.head, self.state, self.rest = head, state, rest

    def apply(self, machine: Transducer, state: tuple) -> tuple[tuple, int]:
        state, emitted = machine.run(state, self.head)
        return (state, emitted) if self.state is None else (self.state, emitted + self.rest)

    def then(self, machine: Transducer, other: ChunkMap) -> ChunkMap:
        """The map of two chunks in a row; composing is associative."""
        if self.state is None:
            return ChunkMap(self.head + other.head, other.state, other.rest)
        if other.head[:1] == SPACE and self.state[1]:
            state, emitted = machine.run(machine.initial, other.head)
        else:
            state, emitted = machine.run(self.state, other.head)
        if other.state is None:
            return ChunkMap(self.head, state, self.rest + emitted)
        return ChunkMap(self.head, other.state, self.rest + emitted + other.rest)


def _first_cut(chunk: str) -> int:
    """The first space after another character, both inside the chunk; -1 if there is none."""
    place = chunk.find(SPACE, 1)
    while place > 0 and chunk[place - 1] == SPACE:
        place = chunk.find(SPACE, place + 1)
    return place


@lru_cache(maxsize=1)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", limit: int = 4096) -> DataFrame:
    """Per row: the id column, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    A null or empty text has 0 bytes and 0 tokens. Repeated rows give equal rows; other columns of docs are not
    read. One narrow pass in bounded memory; a long text costs a task time in proportion to its length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = transducer(path)
        for part, texts in text_batches(batches):
            counts = [own.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())],
                names=["id", "n_bytes", "n_tokens", "over_limit"],
            )

    source = docs.select(
        docs[id_col].alias("id"), F.octet_length(F.coalesce(docs[text], F.lit(""))).cast("long").alias("n_bytes"), docs[text].alias("text")
    )
    kind = source.schema["id"].dataType.simpleString()
    found = source.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return found.withColumnRenamed("id", id_col)
