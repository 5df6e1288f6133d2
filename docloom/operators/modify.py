"""Modifiers: selections that the notation asks for, and the geometry of image changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import dsl, matchers
from docloom.operators import html as html_ops


def limit(df: DataFrame, n: str | int, keys: list) -> DataFrame:
    """The first n rows in the order of keys; a negative n leaves out the last ones; nonsense changes nothing."""
    try:
        n = int(n)
    except (TypeError, ValueError):
        return df
    if n >= 0:
        return df.orderBy(*keys).limit(n)
    from docloom.functions.ordinal import with_ordinal

    numbered = with_ordinal(df, keys, "_row")
    return numbered.filter(F.col("_row") < max(0, numbered.count() + n)).drop("_row")


def select_columns(df: DataFrame, names: str) -> DataFrame:
    """A comma list of columns; an unknown one leaves the table as it is."""
    wanted = [n.strip() for n in names.split(",")]
    return df.select(*wanted) if wanted and set(wanted) <= set(df.columns) else df


def select_html(df: DataFrame, css: str, html: str = "html") -> DataFrame:
    return html_ops.select(df, css, html)


def pages(df: DataFrame, spec: str, number: str = "page_number", total: str = "total_pages", path: str = "path") -> DataFrame:
    """Rows of the pages asked for, in the order asked for (``page_order``); pages that do not exist are left out."""
    wanted = dsl.page_list(F.lit(spec), F.col(total))
    hits = F.filter(F.transform(F.coalesce(wanted, F.expr("cast(array() as array<int>)")), lambda p, i: F.struct(i.alias("i"), p.alias("p"))), lambda e: e["p"] == F.col(number))
    return df.withColumn("_h", F.explode(hits)).withColumn("page_order", F.col("_h.i")).drop("_h")


def slides(df: DataFrame, spec: str) -> DataFrame:
    return pages(df, spec, "slide_number", "total_slides")


def crop(df: DataFrame, spec: Column, width: str = "width", height: str = "height") -> DataFrame:
    """The box's size where the spec is good; ``crop_error`` where it is not."""
    size = dsl.cropped(spec, F.col(width), F.col(height))
    return df.withColumn("_c", size).withColumns({width: F.coalesce("_c.width", width), height: F.coalesce("_c.height", height), "crop_error": F.when(F.col("_c").isNull(), F.concat(F.lit("invalid crop: "), spec))}).drop("_c")


def rotate(df: DataFrame, degrees: Column, width: str = "width", height: str = "height") -> DataFrame:
    return df.withColumn("_r", dsl.rotated(degrees, F.col(width), F.col(height))).withColumns({width: F.col("_r.width"), height: F.col("_r.height")}).drop("_r")


def resize(df: DataFrame, spec: Column, width: str = "width", height: str = "height") -> DataFrame:
    """New size, the original one beside it; a bad spec keeps the image and sets ``resize_error``."""
    return df.withColumn("_s", dsl.resized(spec, F.col(width), F.col(height))).withColumns({
        "original_width": F.col(width), "original_height": F.col(height), width: F.coalesce("_s.width", width), height: F.coalesce("_s.height", height),
        "resize_applied": F.col("_s").isNotNull(), "resize_error": F.when(F.col("_s").isNull(), F.concat(F.lit("invalid resize: "), spec)),
    }).drop("_s")


def watermark(df: DataFrame, spec: Column, path: str = "path") -> DataFrame:
    return df.withColumn("watermark", dsl.watermark(spec, F.col(path)))


def morph_to_detected_type(df: DataFrame) -> DataFrame:
    """Decide ``kind`` anew from content type and content, as for a file that a URL gave."""
    f = matchers.File(F.col("path"), F.col("content_type") if "content_type" in df.columns else None, F.col("content"))
    return df.withColumns({"kind": matchers.kind(f), "is_binary": matchers.binary(F.col("content"))})
