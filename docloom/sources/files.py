"""Scans: files and folders become rows. Decoding is left to ``decode``; column pruning keeps content unread where unused."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import dsl, matchers


def binary(spark: SparkSession, paths: str | list[str], recursive: bool = False, glob: str | None = None) -> DataFrame:
    """path, length, modificationTime, content: one row per file."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(paths)


def text_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, text (UTF-8, else Latin-1), kind."""
    content = F.col("content")
    as_text = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))
    return binary(spark, paths).select("path", as_text.alias("text"), F.lit("text").alias("kind"))


def html_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, html and what the loader tells of it."""
    return text_files(spark, paths).select("path", F.col("text").alias("html"), F.lit("html").alias("kind"), F.create_map(F.lit("content_type"), F.lit("text/html"), F.lit("file_size"), F.length("text").cast("string")).alias("metadata"))


def csv_table(spark: SparkSession, path: str, schema: str | None = None, ordinal: str | None = None, multi_line: bool = True) -> DataFrame:
    """A CSV file as a table; types are inferred where no schema is given (one more pass over the file).

    With ``ordinal``, rows are numbered in file order (parts are numbered in path order). Cells may hold line breaks, so
    a file is read by one task; ``multi_line=False`` lets large files without such cells be split."""
    reader = spark.read.options(header=True, multiLine=multi_line, escape='"')
    df = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    return df.withColumn(ordinal, F.monotonically_increasing_id()) if ordinal else df


def detected(files: DataFrame) -> DataFrame:
    """Add kind and processor from path, content type (if there) and content."""
    f = matchers.File(F.col("path"), F.col("content_type") if "content_type" in files.columns else None, F.col("content") if "content" in files.columns else None)
    return files.withColumns({"kind": matchers.kind(f), "processor": matchers.processor(f)})


def attached(spark: SparkSession, references: list[str]) -> DataFrame:
    """References in the bracket notation, in order: ord, attachy, path, commands."""
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(references)], "ord long, attachy string")
    return dsl.parsed(rows)
