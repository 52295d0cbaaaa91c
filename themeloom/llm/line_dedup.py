"""Substring dedup by line or paragraph hashing.

Units of every text are normalised and hashed to 128 bits, digests are grouped over the whole corpus, the earliest
ranked occurrence of each stays and all others are cut out of their texts, with the original offsets retained.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.llm.common import WORD

MIN_WORDS = 5
UNITS = {"line": "\n", "paragraph": "\n\n"}
# Sentences inside lines: a unit ends after `.`, `!` or `?` with a blank, after a line break, and before a capital that
# follows a small letter, where a passage set into other text often starts. The places are empty, so no character is lost.
SENTENCE_ENDS = r"(?<=[.!?][\x20\x09])|(?<=\n)|(?=\p{Lu})(?<=\p{Ll}\x20)"
SENTENCE_WORDS = 3  # shorter units are not compared: they belong to the run around them
# A repeated passage of more than 50 words is found by the units that lie wholly in it, without those at its ends.
RUN_WORDS = 25
SPANS = "array<struct<start:bigint,end:bigint,kept_doc_id:bigint>>"


def _normalised(unit: Column) -> Column:
    # Most units hold single spaces only, and a search is much cheaper than a replacement.
    even = F.when(unit.rlike(r"  |[\x09-\x0D]"), F.regexp_replace(unit, r"[\x20\x09-\x0D]+", " ")).otherwise(unit)
    return F.lower(F.btrim(even))


def repeated_units(docs: DataFrame, id_col: str, text: str, unit: str, min_words: int) -> DataFrame:
    """_id, _hash (of the text) and _unit of each unit that is not the earliest with its digest, and kept_doc_id.

    Only digests move: one row per unit of min_words words or more. The group is a combined minimum, so a digest that
    a third of all units share costs each task one row; the join back reads the repeated digests only.
    """
    one = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")).where(F.col("_text").isNotNull())
    # Normalising inside the array keeps it to one evaluation per unit, below the explode.
    pieces = one.select(
        "_id", F.xxhash64("_text").alias("_hash"),
        F.posexplode(F.transform(F.split("_text", UNITS[unit]), _normalised)).alias("_unit", "_norm"),
    )
    # min_words words are separated by min_words - 1 single spaces.
    hashed = pieces.where(
        (F.length("_norm") - F.length(F.replace("_norm", F.lit(" "), F.lit(""))) >= min_words - 1) & (F.col("_norm") != "")
    ).select("_id", "_hash", "_unit", F.unhex(F.md5("_norm")).alias("_digest"))
    rank = F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("id"), F.col("_hash").alias("h"), F.col("_unit").alias("u"))
    first = (
        hashed.groupBy("_digest")
        .agg(F.min(rank).alias("_first"), F.count("*").alias("_n"))
        .where("_n > 1")
        .select("_digest", "_first")
    )
    same = (F.col("_id").eqNullSafe(F.col("_first.id"))) & (F.col("_hash") == F.col("_first.h")) & (F.col("_unit") == F.col("_first.u"))
    return hashed.join(first, "_digest").where(~same).select("_id", "_hash", "_unit", F.col("_first.id").alias("kept_doc_id"))


def _cutter(separator: str):
    kind = pa.struct([("text", pa.string()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kept_doc_id", pa.int64())])))])

    def cut(texts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for text, dropped in texts:
            out = []
            for t, units in zip(text.to_pylist(), dropped.to_pylist()):
                if t is None or not units:
                    out.append(None)
                    continue
                gone = {u["_unit"]: u["kept_doc_id"] for u in units}
                start, stay, spans = 0, [], []
                for k, piece in enumerate(t.split(separator)):
                    if k in gone:
                        spans.append({"start": start, "end": start + len(piece), "kept_doc_id": gone[k]})
                    else:
                        stay.append(piece)
                    start += len(piece) + len(separator)
                out.append({"text": separator.join(stay), "removed": spans})
            yield pa.array(out, type=kind)

    return F.arrow_udf(cut, f"struct<text:string,removed:{SPANS}>", F.ArrowUDFType.SCALAR_ITER)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", unit: str = "line", min_words: int = MIN_WORDS) -> DataFrame:
    """Every row of docs with its text less the units that occur earlier, and `removed`: the cut spans.

    Spans hold start and end in code points of the original text and the id of the document that keeps the unit.
    Units are equal when they agree after folding case and white space; those under min_words words are never
    removed. Rank is by id (nulls last), then by a hash of the text, then by place. Rows that repeat id and text
    count as one document and come out alike. A null text stays null, an empty one empty, both with no spans; a
    text all of whose units are repeats becomes ''. An input column named `removed` is replaced.
    """
    drops = (
        repeated_units(docs, id_col, text, unit, min_words)
        .groupBy("_id", "_hash")
        .agg(F.collect_set(F.struct("_unit", "kept_doc_id")).alias("_drops"))
        .select(F.col("_id").alias("_drop_id"), F.col("_hash").alias("_drop_hash"), "_drops")
    )
    names = [c for c in docs.columns if c != "removed"]
    whole = docs.select(F.struct(*[docs[c] for c in names]).alias("_row")).withColumns(
        {"_id": F.col(f"_row.`{id_col}`"), "_hash": F.xxhash64(f"_row.`{text}`")}
    )
    met = whole.join(drops, F.col("_id").eqNullSafe(F.col("_drop_id")) & (F.col("_hash") == F.col("_drop_hash")), "left")
    cut = met.select("_row", _cutter(UNITS[unit])(F.when(F.col("_drops").isNotNull(), F.col(f"_row.`{text}`")), F.col("_drops")).alias("_cut"))
    return cut.select(
        *[F.coalesce("_cut.text", f"_row.`{c}`").alias(c) if c == text else F.col(f"_row.`{c}`").alias(c) for c in names],
        F.coalesce("_cut.removed", F.array().cast(SPANS)).alias("removed"),
    )


def _repeated_sentences(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """_id, _hash (of the text), _unit and kept_doc_id of each sentence that is not the earliest of its kind.

    Sentences are compared by 64 bits: only runs of many words are cut, which chance matches do not make.
    """
    one = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")).where(F.col("_text").isNotNull())
    pieces = one.select(
        "_id", F.xxhash64("_text").alias("_hash"),
        F.posexplode(F.transform(F.split("_text", SENTENCE_ENDS), _normalised)).alias("_unit", "_norm"),
    )
    hashed = pieces.where(
        F.length("_norm") - F.length(F.replace("_norm", F.lit(" "), F.lit(""))) >= SENTENCE_WORDS - 1
    ).select("_id", "_hash", "_unit", F.xxhash64("_norm").alias("_digest"))
    rank = F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("id"), F.col("_hash").alias("h"), F.col("_unit").alias("u"))
    first = hashed.groupBy("_digest").agg(F.min(rank).alias("_first"), F.count("*").alias("_n")).where("_n > 1").select("_digest", "_first")
    same = (F.col("_id").eqNullSafe(F.col("_first.id"))) & (F.col("_hash") == F.col("_first.h")) & (F.col("_unit") == F.col("_first.u"))
    return hashed.join(first, "_digest").where(~same).select("_id", "_hash", "_unit", F.col("_first.id").alias("kept_doc_id"))


def _run_cutter(run_words: int):
    kind = pa.struct([("text", pa.string()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kept_doc_id", pa.int64())])))])

    def runs(text: str, lengths: list[int], gone: dict[int, int | None]) -> list[dict]:
        spans, start, words, place = [], None, 0, 0
        open_words = 0  # of short units since the last repeated one: they count if another follows
        end = kept = None

        def close() -> None:
            if start is not None and words >= run_words:
                spans.append({"start": start, "end": end, "kept_doc_id": kept})

        for k, length in enumerate(lengths):
            n = len(WORD.findall(text, place, place + length))
            if k in gone:
                if start is None:
                    start, words, open_words, kept = place, 0, 0, gone[k]
                words += open_words + n
                open_words, end = 0, place + length
            elif n < SENTENCE_WORDS:
                open_words += n
            else:
                close()
                start = None
            place += length
        close()
        return spans

    def cut(columns: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, sizes, dropped in columns:
            out = []
            for text, lengths, units in zip(texts.to_pylist(), sizes.to_pylist(), dropped.to_pylist()):
                spans = runs(text, lengths, {u["_unit"]: u["kept_doc_id"] for u in units}) if text is not None and units else []
                if not spans:
                    out.append(None)
                    continue
                stay, at = [], 0
                for span in spans:
                    stay.append(text[at : span["start"]])
                    at = span["end"]
                out.append({"text": "".join([*stay, text[at:]]), "removed": spans})
            yield pa.array(out, type=kind)

    return F.arrow_udf(cut, f"struct<text:string,removed:{SPANS}>", F.ArrowUDFType.SCALAR_ITER)


def dedup_passages(docs: DataFrame, id_col: str = "doc_id", text: str = "text", run_words: int = RUN_WORDS) -> DataFrame:
    """Every row of docs with its text less the passages that occur earlier, and `removed`: the cut spans.

    Units are the sentences inside lines. The earliest occurrence of each stays; of the others, those are cut that lie
    in a run of neighbouring repeated units of `run_words` words or more together, so a short line or sentence that
    many texts share stays everywhere. Units under SENTENCE_WORDS words are never compared; between repeated ones they
    go with the run. The blank or line break that ends a unit belongs to it. Units are equal when they agree after
    folding case and white space. Spans hold start and end in code points of the original text and the document that
    keeps the run's first unit. Rank is by id (nulls last), then by a hash of the text, then by place. Rows that repeat
    id and text count as one document and come out alike. A null text stays null, an empty one empty, both with no
    spans; a text that is one repeated passage becomes ''. An input column named `removed` is replaced.
    """
    drops = (
        _repeated_sentences(docs, id_col, text).groupBy("_id", "_hash")
        .agg(F.collect_set(F.struct("_unit", "kept_doc_id")).alias("_drops"))
        .select(F.col("_id").alias("_drop_id"), F.col("_hash").alias("_drop_hash"), "_drops")
    )
    names = [c for c in docs.columns if c != "removed"]
    whole = docs.select(F.struct(*[docs[c] for c in names]).alias("_row")).withColumns(
        {"_id": F.col(f"_row.`{id_col}`"), "_hash": F.xxhash64(f"_row.`{text}`")}
    )
    met = whole.join(drops, F.col("_id").eqNullSafe(F.col("_drop_id")) & (F.col("_hash") == F.col("_drop_hash")), "left")
    own = F.when(F.col("_drops").isNotNull(), F.col(f"_row.`{text}`"))
    cut = met.select("_row", _run_cutter(run_words)(own, F.transform(F.split(own, SENTENCE_ENDS), F.length), F.col("_drops")).alias("_cut"))
    return cut.select(
        *[F.coalesce("_cut.text", f"_row.`{c}`").alias(c) if c == text else F.col(f"_row.`{c}`").alias(c) for c in names],
        F.coalesce("_cut.removed", F.array().cast(SPANS)).alias("removed"),
    )
