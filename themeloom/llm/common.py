"""What several operators share: the word pattern, hashed row splits, batches of texts, scratch tables."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.session import scratch_dir

SEPARATORS = r"\x20\x09-\x0D"
SEPARATOR_CHARS = " \t\n\x0b\x0c\r"
WORD = re.compile(rf"[^{SEPARATORS}]+")
UPPER_TO_LOWER = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
BATCH_ROWS = 512


def lower_ascii(text: str) -> str:
    """Lower-cases A-Z and nothing else."""
    return text.lower() if text.isascii() else text.translate(UPPER_TO_LOWER)


def words_of(column: Column) -> Column:
    """The words of a text as an array; null and blank texts have none. Native."""
    trimmed = F.btrim(F.coalesce(column, F.lit("")), F.lit(SEPARATOR_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{SEPARATORS}]+"))


def remainder(id_column: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null ids count as 0's complement and give -1."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % modulus, F.lit(-1))


def text_batches(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Small slices of Arrow batches with the texts of their column `text`, null as empty."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            part = batch.slice(start, rows)
            column = part.column(part.schema.get_field_index("text"))
            yield part, [t or "" for t in column.to_pylist()]


class BoundedCache(dict):
    """A memo of two generations of at most `limit` entries each: it bounds memory and never changes a result.

    A full generation becomes the older one. Entries met again come back from there, so keys that occur once push
    out no frequent ones.
    """

    def __init__(self, compute: Callable, limit: int):
        super().__init__()
        self.compute, self.limit, self.older = compute, limit, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write(df: DataFrame, path: str) -> None:
    """Writes a table. Once it is written the shuffles behind it serve nothing, so their files are freed at once."""
    conf = df.sparkSession.conf
    before = conf.get(FREE_SHUFFLES)
    conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(FREE_SHUFFLES, before)


def materialise(df: DataFrame, purpose: str) -> DataFrame:
    """Writes a table to the shared folder that spark.checkpoint.dir names and reads it back."""
    path = scratch_dir(df.sparkSession, purpose)
    write(df, path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._scratch = path
    return table


def discard(table: DataFrame) -> None:
    """Deletes a table that `materialise` wrote and that nothing reads any more."""
    session = table.sparkSession
    path = session.sparkContext._jvm.org.apache.hadoop.fs.Path(table._scratch)
    path.getFileSystem(session._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
