"""Operators on streams. They are stateless and never act, so a stream takes them as a table does."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def watched(spark: SparkSession, folder: str) -> DataFrame:
    """New text files of a folder, each one row: path, text."""
    return spark.readStream.text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def run(stream: DataFrame, plan: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, **options) -> StreamingQuery:
    """Apply a plan and write what is there to parquet, exactly once, then stop (``availableNow``)."""
    return plan(stream).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).options(**options).trigger(availableNow=True).start()
