"""Recordings as content-addressed staging: names and hashes are written once, audio is read again once per content."""

from __future__ import annotations

import re
from urllib.parse import unquote

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.session import materialise

EMPTY_MD5 = "d41d8cd98f00b204e9800998ecf8427e"


def _audio(spark: SparkSession, path: str | list[str], extensions: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", extensions).option("ignoreMissingFiles", "true").load(path)


def stage(spark: SparkSession, path: str, extensions: str = "*") -> DataFrame:
    """`(recording, path, md5, bytes)` of every file under a path, empty ones included, written to the shared folder.

    This is the first of two reads of the audio, and nothing of it is moved: each task hashes its files. The reader
    passes over files without a byte, so they are added from the session's list of files, which holds every name in
    any case. Files of one name in several folders are several recordings.
    """
    files = _audio(spark, path, extensions)
    read = files.select(F.col("path"), F.md5("content").alias("md5"), F.col("length").alias("bytes"), F.col("_metadata.file_path").alias("_uri"))
    found = materialise(read, "recordings-read")
    listed = pa.table({"_uri": pa.array(files.inputFiles(), pa.string())})
    # An empty host is spelled `file:///` in the list and `file:/` in the rows.
    uris = spark.createDataFrame(listed, "_uri string").withColumn("_uri", F.replace("_uri", F.lit(":///"), F.lit(":/")))
    plain = F.url_decode(F.replace("_uri", F.lit("+"), F.lit("%2B")))
    empty = uris.join(found, "_uri", "left_anti").select(plain.alias("path"), F.lit(EMPTY_MD5).alias("md5"), F.lit(0).cast("long").alias("bytes"))
    named = found.drop("_uri").unionByName(empty).select(F.element_at(F.split("path", "/"), -1).alias("recording"), "path", "md5", "bytes")
    return materialise(named, "recordings")


def _plain(uri: str) -> str:
    """A listed name as rows spell it: no escapes, and `file:/` for an empty host."""
    return unquote(uri).replace(":///", ":/", 1)


def _literal(path: str) -> str:
    """A path whose own characters are no pattern."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


def contents(staged: DataFrame) -> DataFrame:
    """`(md5, content)`, one row per distinct content of a staged table: the first path of each is read once more.

    The paths, one per content, pass through the driver, as every list of files to read does. A file that has gone
    since gives no row, one that has changed gives its present hash.
    """
    spark = staged.sparkSession
    first = staged.where("bytes > 0").groupBy("md5").agg(F.min("path").alias("path"))
    paths = [r["path"] for r in first.select("path").toLocalIterator()]
    nothing = staged.where("bytes = 0").select("md5", F.lit(b"").alias("content")).limit(1)
    try:
        audio = _audio(spark, [_literal(p) for p in paths]) if paths else None
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        folders = sorted({_literal(p.rpartition("/")[0]) for p in paths})
        present = {_plain(uri) for uri in _audio(spark, folders).inputFiles()}
        paths = [p for p in paths if p in present]
        audio = _audio(spark, [_literal(p) for p in paths]) if paths else None
    return nothing if audio is None else audio.select(F.md5("content").alias("md5"), "content").unionByName(nothing)
