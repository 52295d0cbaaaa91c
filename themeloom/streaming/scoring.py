"""Upload scoring over a growing folder: the batch transform is stateless, so it runs on streams as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from themeloom.operators import scoring as S
from themeloom.operators.models import TopicModel
from themeloom.sources.files import lines_of
from pyspark.sql import functions as F


def stream_lines(spark: SparkSession, path: str) -> DataFrame:
    """One text per non-blank line of every text file that arrives in a folder."""
    return spark.readStream.text(path).select(F.explode(lines_of(F.col("value"))).alias("text"))


def score_stream(stream: DataFrame, text_col: str, model: TopicModel, labels: DataFrame) -> DataFrame:
    """Adds `assigned_topic` and `confidence` to streaming rows."""
    return S.score_upload(stream, text_col, model, labels)


def write_scores(scored: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Appends scored rows to Parquet, exactly once per input row."""
    writer = scored.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).outputMode("append").start()
