"""Ordered folds of many rows into one: one shuffle on the group, never an unordered collection.

A fold's result is one value by definition; groups are what a message or a document holds, so their size is the
caller's. Texts are gathered as (order, text) and sorted before they are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import basename, strip
from docloom.operators.refine import HEADERS


def ordered_join(order: Column, text: Column, separator: str) -> Column:
    """Aggregate: texts joined in order, empty ones left out."""
    rows = F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("t"))))
    return F.array_join(F.filter(F.transform(rows, lambda r: r["t"]), lambda t: F.length(t) > 0), separator)


def ordered_array(order: Column, values: Column) -> Column:
    """Aggregate: arrays concatenated in order."""
    return F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), values.alias("v")))), lambda r: r["v"]))


def collection(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """One attachment per group: text, images and audio in order; metadata says how many and which."""
    o = F.struct(*order)
    out = {"text": ordered_join(o, F.col("text"), "\n\n")}
    for c in ("images", "audio"):
        if c in df.columns:
            out[c] = ordered_array(o, F.col(c))
    if "path" in df.columns:
        out["combined_from"] = F.transform(F.array_sort(F.collect_list(F.struct(o.alias("o"), F.col("path").alias("p")))), lambda r: r["p"])
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("collection_size"), *[v.alias(k) for k, v in out.items()])


def rendered(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """One prompt text per group: sections under headers, with a summary line where there are several files."""
    text, path = F.col("text"), F.col("path")
    begins = F.lit(False)
    for pattern in (*HEADERS, "Data from {}", "PDF Document: {}"):
        for name in (path, basename(path)):
            begins = begins | F.startswith(strip(text), F.concat(F.lit(pattern.replace("{}", "")), name))
    section = F.when(begins, text).otherwise(F.concat(F.lit("## "), path, F.lit("\n\n"), text))
    images = F.size("images") if "images" in df.columns else F.lit(0)
    o = F.struct(*order)
    g = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("files"), F.sum(images).alias("images"),
        ordered_join(o, text, "\n\n---\n\n").alias("plain"), ordered_join(o, F.when(F.length(text) > 0, section), "\n\n---\n\n").alias("headed"),
    )
    said = F.concat(F.lit("📄 Processing Summary: "), F.col("files").cast("string"), F.lit(" files processed"), F.when(F.col("images") > 0, F.concat(F.lit(", "), F.col("images").cast("string"), F.lit(" images extracted"))).otherwise(F.lit("")))
    return g.select(*by, F.when(F.col("files") > 1, F.concat(said, F.lit("\n\n"), F.col("headed"))).otherwise(F.col("plain")).alias("text"))
