"""Refiners: what is done to a text after it was presented, and folds of many rows into one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import dsl
from docloom.functions.text import basename, extension, file_size, language

#: Headers that presenters write, with {} for the full path or the base name.
HEADERS = ("# {}", "# PDF Document: {}", "# Image: {}", "# Presentation: {}", "## Data from {}")
PATH_ONLY = ("Data from {}", "PDF Document: {}")


def no_op(df: DataFrame) -> DataFrame:
    return df


def truncate(df: DataFrame, limit: int = 1000) -> DataFrame:
    return df.withColumn("text", F.when(F.length("text") > limit, F.concat(F.left("text", F.lit(limit)), F.lit("..."))).otherwise(F.col("text")))


def _any_header(text: Column, path: Column, test) -> Column:
    out = F.lit(False)
    for pattern in HEADERS + PATH_ONLY:
        out = out | test(text, F.concat(F.lit(pattern.replace("{}", "")), path))
    return out


def has_header(text: Column, path: Column) -> Column:
    out = _any_header(text, path, lambda t, h: F.contains(t, h))
    name = basename(path)
    for pattern in HEADERS:
        out = out | ((name != path) & F.contains(text, F.concat(F.lit(pattern.replace("{}", "")), name)))
    return out


def add_headers(df: DataFrame, keep_empty: bool = False) -> DataFrame:
    """A header where the text has none; an empty text stays empty, with ``keep_empty`` it gets its header too."""
    text, path = F.col("text"), F.col("path")
    return df.withColumn("text", F.when((F.length(text) >= (0 if keep_empty else 1)) & ~has_header(text, path), F.concat(F.lit("# "), path, F.lit("\n\n"), text)).otherwise(text))


def format_tables(df: DataFrame) -> DataFrame:
    return df.withColumn("text", F.replace(F.col("text"), F.lit("\t"), F.lit(" | ")))


def add_repo_headers(df: DataFrame, rel_path: str = "relative_path", size: str = "length", keep_empty: bool = False) -> DataFrame:
    """Header and fence for files of a repository (rel_path not null), the plain header for the rest; an empty text stays
    empty, with ``keep_empty`` it gets them too."""
    rel, lang = F.col(rel_path), language(extension(F.col(rel_path)))
    size_text = F.coalesce(file_size(F.col(size)), F.lit("unknown"))
    framed = F.concat(
        F.lit("## File: `"), rel, F.lit("`\n\n"), F.when(lang != "", F.concat(F.lit("**Language**: "), lang, F.lit("  \n"))).otherwise(F.lit("")),
        F.lit("**Size**: "), size_text, F.lit("  \n**Path**: `"), rel, F.lit("`\n\n```"), F.lower(lang), F.lit("\n"), F.col("text"), F.lit("\n```\n\n"),
    )
    return _repo(df, rel, framed, keep_empty)


def _repo(df: DataFrame, rel: Column, framed: Column, keep_empty: bool = False) -> DataFrame:
    text, path = F.col("text"), F.col("path")
    plain = F.when(has_header(text, path), text).otherwise(F.concat(F.lit("# "), path, F.lit("\n\n"), text))
    return df.withColumn("text", F.when((F.length(text) == 0) & F.lit(not keep_empty), text).when(rel.isNotNull(), framed).otherwise(plain))


def report_unused_commands(df: DataFrame, used: list[str]) -> DataFrame:
    """Add ``unused_commands``: what the notation asked for and nothing read, with the nearest valid names."""
    return df.withColumn("unused_commands", dsl.unused_report(F.col("commands"), used))


def tile_layout(df: DataFrame, doc: str, width: str, height: str, spec: str = "2x2", order: str = "ord") -> DataFrame:
    """Layout of the tiled sheets of each document's images: one row per sheet with its grid, cell and canvas.

    A partial sheet is as wide as it has images, at most the grid; cells take the smallest image, 100 pixels at least.
    Documents with fewer than two images are not tiled. Images are placed by a window per document."""
    from pyspark.sql import Window

    grid = dsl.tile_grid(F.lit(spec))
    w = Window.partitionBy(doc)
    numbered = df.withColumns({"_n": F.count(F.lit(1)).over(w), "_k": F.row_number().over(w.orderBy(order)) - 1, "_g": grid}).filter("_n > 1 AND _g IS NOT NULL")
    per = F.col("_g.cols") * F.col("_g.rows")
    sheets = numbered.withColumn("sheet", F.floor(F.col("_k") / per).cast("int")).groupBy(doc, "sheet", "_g").agg(
        F.count(F.lit(1)).alias("images"), F.greatest(F.min(width), F.lit(100)).alias("cell_width"), F.greatest(F.min(height), F.lit(100)).alias("cell_height")
    )
    cols = F.when(F.col("images") < per, F.least(F.col("_g.cols"), F.col("images"))).otherwise(F.col("_g.cols")).cast("int")
    rows = F.when(F.col("images") < per, F.ceil(F.col("images") / F.least(F.col("_g.cols"), F.col("images")))).otherwise(F.col("_g.rows")).cast("int")
    return sheets.select(doc, "sheet", "images", cols.alias("cols"), rows.alias("rows"), "cell_width", "cell_height", (F.col("cell_width") * cols).alias("tile_width"), (F.col("cell_height") * rows).alias("tile_height"))


def resize_images(df: DataFrame, spec: str = "800", width: str = "width", height: str = "height") -> DataFrame:
    """New sizes of images; rows whose size cannot be told are dropped."""
    return df.withColumn("_s", dsl.resized(F.lit(spec), F.col(width), F.col(height))).filter("_s IS NOT NULL").withColumns({"new_width": F.col("_s.width"), "new_height": F.col("_s.height")}).drop("_s")
