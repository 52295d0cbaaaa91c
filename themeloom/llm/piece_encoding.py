"""SentencePiece encoding and decoding, exact for merge-type vocabularies, by backtracking.

At each place the longest piece is tried first. A piece may follow another only if re-merging the two gives the
same two; when no piece fits, the last one is taken back and its end is marked in a bitfield, so that no place is
left twice. No piece has a space after another character, and none holds characters of the two classes that `joined_letters`
finds in the vocabulary, so no merge crosses from one to the other: texts are cut there and the parts encoded alone,
which lets a task remember the parts it has met, such as a word without the comma after it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.llm.common import BoundedCache, text_batches
from themeloom.llm.piece_model import SPACE, Compatibility, load, reachable

PART = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")  # cut before spaces alone
PART_LIMIT = 150_000
LONGEST_KEPT = 64


def joined_letters(pieces: Iterable[str]) -> set[str]:
    """The letters of the pieces and all characters that a chain of neighbours in pieces links to one, spaces aside.

    So no piece holds one of these next to a character that is none of them, except the space.
    """
    linked: dict[str, set[str]] = {}
    for piece in pieces:
        text = piece.lstrip(SPACE)
        for left, right in zip(text, text[1:] or text):
            linked.setdefault(left, set()).add(right)
            linked.setdefault(right, set()).add(left)
    found = {c for c in linked if c.isalpha()}
    fresh = list(found)
    while fresh:
        for char in linked[fresh.pop()] - found:
            found.add(char)
            fresh.append(char)
    return found


class PartCache(BoundedCache):
    """The memo of parts; long ones, which hardly come again, are encoded each time."""

    def __missing__(self, part: str):
        return super().__missing__(part) if len(part) <= LONGEST_KEPT else self.compute(part)


class Encoder:
    """Encodes and decodes single texts; holds the automaton and the memo of a task."""

    def __init__(self, path: str):
        self.vocabulary = load(path)
        self.compatible = Compatibility(self.vocabulary)
        self.automaton = ahocorasick.Automaton()
        self.tokens = reachable(path)
        for piece in self.tokens:
            if len(piece) > 1:
                self.automaton.add_word(piece, (len(piece) - 1, piece))
        self.automaton.make_automaton()
        self.characters = frozenset(p for p in self.vocabulary.ids if len(p) == 1)
        letters = "".join(map(re.escape, sorted(joined_letters(self.vocabulary.ids)))) or SPACE
        self.split = re.compile(f"{SPACE}*[{letters}]+|{SPACE}*[^{letters}{SPACE}]+|{SPACE}+").findall
        self.shorter: dict[str, str | None] = BoundedCache(self._shorter, len(self.tokens) + 1)
        self.parts = PartCache(self._part, PART_LIMIT)
        # The text of each id, if it has one that does not depend on its neighbours: all but bytes from 128 on.
        known = self.vocabulary
        self.texts = ["" if k in known.control else " ⁇ " if k == known.unknown else p.replace(SPACE, " ") for k, p in enumerate(known.pieces)]
        for byte, k in enumerate(known.byte_ids):
            self.texts[k] = chr(byte) if byte < 128 else ""
        self.numbers = [str(k) for k in range(len(known.pieces))]
        self.high_bytes = frozenset(known.byte_ids[128:])

    def _shorter(self, piece: str) -> str | None:
        """The longest other piece that starts this one."""
        return next((piece[:n] for n in range(len(piece) - 1, 0, -1) if piece[:n] in self.tokens), None)

    def _run(self, text: str) -> list[int]:
        """Encodes characters that are all in the vocabulary."""
        longest: list[str | None] = list(text)
        for end, (back, piece) in self.automaton.iter(text):
            longest[end - back] = piece  # ends ascend, so the last one found at a place is the longest
        longest.append(None)
        size, shorter, fits = len(text), self.shorter, self.compatible.memo
        failed = None  # a bit for each place, once there is one to set
        chosen: list[str] = []
        place, piece, before = 0, longest[0], None
        while place < size:
            while piece is not None:
                end = place + len(piece)
                if (before is None or fits[before, piece]) and (failed is None or not failed[end >> 3] >> (end & 7) & 1):
                    break
                piece = shorter[piece]
            if piece is not None:
                chosen.append(piece)
                before, place = piece, end
                piece = longest[place]
            else:
                if failed is None:
                    failed = bytearray((size >> 3) + 1)
                failed[place >> 3] |= 1 << (place & 7)
                piece = chosen.pop()
                place -= len(piece)
                before = chosen[-1] if chosen else None
                # Its end is marked now, so the search goes on with the next shorter piece.
        return [*map(self.vocabulary.ids.__getitem__, chosen)]

    def _part(self, text: str) -> tuple[int, ...]:
        if self.characters.issuperset(text):
            return tuple(self._run(text))
        found: list[int] = []
        start = 0
        for k, char in enumerate(text):
            if char not in self.characters:  # never part of a merge, written as its bytes
                if k > start:
                    found += self._run(text[start:k])
                found += [self.vocabulary.byte_ids[b] for b in char.encode()]
                start = k + 1
        if start < len(text):
            found += self._run(text[start:])
        return tuple(found)

    def encode(self, text: str, end: bool = True) -> list[int]:
        """The ids of a whole text, with the end id if asked for. An empty text has the end id alone."""
        found: list[int] = []
        if text:
            found += chain.from_iterable(map(self.parts.__getitem__, self.split(SPACE + text.replace(" ", SPACE))))
        if end:
            found.append(self.vocabulary.end)
        return found

    def decode(self, ids: list[int]) -> str:
        """The text of ids: control ids have none, bytes that are no UTF-8 give U+FFFD each, and the space that
        encoding puts in front goes."""
        if self.high_bytes.isdisjoint(ids):
            text = "".join(map(self.texts.__getitem__, ids))
            first = next((k for k in ids if k not in self.vocabulary.control), self.vocabulary.unknown)
            return text[1:] if first != self.vocabulary.unknown and self.vocabulary.pieces[first][:1] == SPACE else text
        pieces, control, out, run = self.vocabulary.pieces, self.vocabulary.control, [], bytearray()
        first, last = self.vocabulary.byte_ids[0], self.vocabulary.byte_ids[255]
        started = False
        for k in ids:
            if first <= k <= last and pieces[k][:3] == "<0x":
                run.append(k - first)
                started = True
                continue
            if run:
                out.append(_utf8(bytes(run)))
                run.clear()
            if k in control:
                continue
            piece = pieces[k] if k != self.vocabulary.unknown else " ⁇ "
            if not started and piece[:1] == SPACE:
                piece = piece[1:]
            started = True
            out.append(piece)
        if run:
            out.append(_utf8(bytes(run)))
        return "".join(out).replace(SPACE, " ")


def _utf8(run: bytes) -> str:
    """Decodes bytes, one U+FFFD for each byte that starts no whole character."""
    out = []
    while run:
        try:
            out.append(run.decode())
            break
        except UnicodeDecodeError as error:
            out.append(run[: error.start].decode())
            out.append("�")
            run = run[error.start + 1 :]
    return "".join(out)


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _texts_udf(fn: Callable[[Encoder, list], list], path: str, kind: pa.DataType, ddl: str):
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = encoder(path)
        for column in columns:
            yield pa.array(fn(own, column.to_pylist()), type=kind)

    return F.arrow_udf(run, ddl, F.ArrowUDFType.SCALAR_ITER)


def encode_column(path: str, end: bool = True):
    """A column function from text to array<int>; null counts as empty."""
    return _texts_udf(lambda own, texts: [own.encode(t or "", end) for t in texts], path, pa.list_(pa.int32()), "array<int>")


def decode_column(path: str):
    """A column function from array<int> to text; null gives null."""
    return _texts_udf(lambda own, rows: [None if r is None else own.decode(r) for r in rows], path, pa.string(), "string")


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the id column, n_tokens (with the end id), ids_sha256 and decoded_sha256.

    Encodes each whole text, then decodes those ids. A null or empty text has the end id alone and decodes to ''.
    Repeated rows give equal rows; other columns of docs are not read. One narrow pass; a task holds one small
    slice of texts and memos of fixed size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for part, texts in text_batches(batches, 128):
            counts, ids_digests, text_digests = [], [], []
            for text_value in texts:
                ids = own.encode(text_value)
                counts.append(len(ids))
                ids_digests.append(hashlib.sha256(" ".join(map(own.numbers.__getitem__, ids)).encode()).hexdigest())
                text_digests.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(counts, pa.int64()), pa.array(ids_digests), pa.array(text_digests)],
                names=["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    source = docs.select(docs[id_col].alias("id"), docs[text].alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    found = source.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return found.withColumnRenamed("id", id_col)
