"""Readers and writers for the files the analytics starts from and ends in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.functions import constants as C
from themeloom.functions import text as T
from themeloom.operators.labels import parse_labels

# The columns raters' sheets are read by, and our names for them.
SHEET_COLUMNS = {
    "Code": "code", "Word clarity (1-5)": "word_clarity", "Example fit (1-5)": "example_fit",
    "Suggested name": "suggested_name",
}


def or_missing(value: Column) -> Column:
    """Null where a delimited file spells a missing value."""
    return F.when(~value.isin(C.MISSING_WORDS), value)


def read_csv(spark: SparkSession, path: str | list[str], columns: list[str] | None = None) -> DataFrame:
    """Quoted CSV with a header and line breaks inside fields, every column a string.

    Such files cannot be split, so they should be converted to Parquet once.
    """
    raw = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    return raw.select(*[or_missing(F.col(f"`{c}`")).alias(c) for c in (columns or raw.columns)])


def read_complaints(
    spark: SparkSession, path: str | list[str], text_col: str = "Consumer complaint narrative", product_col: str = "Product"
) -> DataFrame:
    """Raw complaints as `(doc_id, product, narrative)`; other columns are pruned in the scan.

    A quoted file is one task, so ids number rows by file and position. Write the result to Parquet
    before anything joins on the id.
    """
    return spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"').select(
        F.monotonically_increasing_id().alias("doc_id"),
        or_missing(F.col(f"`{product_col}`")).alias("product"),
        or_missing(F.col(f"`{text_col}`")).alias("narrative"),
    )


def lines_of(text: Column) -> Column:
    """Non-blank lines of a text without surrounding whitespace."""
    spaces = "[" + "".join(f"\\x{{{ord(c):X}}}" for c in C.WHITESPACE) + "]"
    ends = "[" + "".join(f"\\x{{{ord(c):X}}}" for c in C.LINE_ENDS) + "]"
    trimmed = F.transform(
        F.split(text, ends), lambda line: F.regexp_replace(line, rf"^{spaces}+|{spaces}+$", "")
    )
    return F.filter(trimmed, lambda line: line != "")


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One text per line, blank lines dropped."""
    return spark.read.text(path).select(F.explode(lines_of(F.col("value"))).alias("text"))


def upload_text(df: DataFrame, text_col: str) -> Column:
    """The chosen column of an uploaded table as text, whatever its type and name."""
    return df[f"`{text_col}`"].cast("string")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Topic labels from a JSON file; a missing or broken file gives an empty table."""
    found = exists(spark, path)
    return parse_labels(spark.read.text(path, wholetext=True) if found else spark.createDataFrame([], "value string"))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path holds anything that Spark can read."""
    try:
        spark.read.text(path)
        return True
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return False
        raise


def read_rating_sheets(spark: SparkSession, path: str) -> DataFrame:
    """Raters' sheets saved as CSV, one file per rater; templates and lock files are left out.

    Columns are found by name: files are grouped by their header line, and each group is read with its own.
    """
    header = F.regexp_extract(F.decode("content", "UTF-8"), r"^\x{FEFF}?([^\r\n]*)", 1)
    groups = (
        spark.read.format("binaryFile").load(path).where("length > 0")
        .groupBy(header.alias("header")).agg(F.collect_list("path").alias("paths")).orderBy("header").collect()
    )
    name = F.element_at(F.split("_metadata.file_path", "/"), -1)
    rated = None
    for group in groups:
        sheet = spark.read.csv(group["paths"], header=True, multiLine=True, quote='"', escape='"')
        part = sheet.select(
            F.regexp_replace(F.url_decode(name), r"\.[^.]*$", "").alias("rater"),
            *[or_missing(F.col(f"`{c}`")).alias(n) for c, n in SHEET_COLUMNS.items()],
        )
        rated = part if rated is None else rated.unionByName(part)
    if rated is None:
        raise ValueError(f"no rating sheet in {path}")
    return rated.where(~F.upper("rater").contains("TEMPLATE") & ~F.col("rater").startswith("~$"))


def read_recordings(spark: SparkSession, path: str, extensions: str = "*") -> DataFrame:
    """`(recording, content, md5)` of audio files; `recordings.stage` also lists files without a byte."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", extensions).load(path)
    return files.select(
        F.element_at(F.split("path", "/"), -1).alias("recording"), "content", F.md5("content").alias("md5")
    )


def unique_recordings(recordings: DataFrame) -> DataFrame:
    """One row per distinct content, under its first name."""
    return recordings.groupBy("md5").agg(F.min("recording").alias("recording"), F.count("*").alias("copies"))


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """A result table as CSV with a header; one file only for tables known to be small."""
    (df.coalesce(1) if single_file else df).write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def write_text(df: DataFrame, path: str) -> None:
    """A one-column table, such as an exported label document, as text."""
    df.write.mode("overwrite").text(path)
