"""Splitters: one attachment becomes its chunks. A row whose text gives none stays as it is.

Text splitters are native expressions over ``text``; only ``tokens``, whose cuts depend on one another, runs in
Arrow batches. Nothing shuffles, so they also run on streams.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import accumulate
from typing import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import W, in_slices, strip
from docloom.functions.ordinal import with_ordinal

#: Fixed value: where a token window may be cut.
BREAKS = " \n\t.,!?;:"


def _spread(df: DataFrame, pieces: Column, label: Callable[[Column, Column], Column], kind: str, fields: dict[str, Callable[[Column, Column], Column]], total: bool) -> DataFrame:
    """Explode an array of text or of struct(text, ...); fields and label see (piece, 0-based index)."""
    columns = set(df.columns)
    df = df.withColumn("_all", pieces).select("*", F.posexplode_outer("_all").alias("_i", "_piece"))
    piece, i, some = F.col("_piece"), F.col("_i"), F.col("_i").isNotNull()
    struct = "struct" in dict(df.dtypes)["_piece"]
    out = {
        "chunk_type": F.when(some, F.lit(kind)),
        "chunk_index": i.cast("int"),
        "original_path": F.when(some, F.col("path")),
        "text": F.when(some, piece["text"] if struct else piece).otherwise(F.col("text")),
        "path": F.when(some, F.concat(F.col("path"), F.lit("#"), label(piece, i))).otherwise(F.col("path")),
    }
    if total:
        out["total_chunks"] = F.when(some, F.size("_all"))
    out |= {k: F.when(some, f(piece, i)) for k, f in fields.items()}
    if "chunk_ord" in columns:
        out["chunk_ord"] = F.coalesce(i.cast("int"), F.col("chunk_ord"))
    return df.withColumns(out).drop("_all", "_i", "_piece")


def _numbered(name: str):
    return lambda piece, i: F.concat(F.lit(f"{name}-"), (i + 1).cast("string"))


def _parts(text: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(strip(text), pattern, -1), lambda p: strip(p)), lambda p: p != "")


def paragraphs(df: DataFrame, text: str = "text") -> DataFrame:
    return _spread(df, _parts(F.col(text), rf"\n{W}*\n"), _numbered("paragraph"), "paragraph", {}, True)


def sentences(df: DataFrame, text: str = "text") -> DataFrame:
    return _spread(df, _parts(F.col(text), rf"[.!?]+{W}+"), _numbered("sentence"), "sentence", {}, True)


def _given(value) -> Column:
    """An option as a column: a value for all rows, or each row's own."""
    return value if isinstance(value, Column) else F.lit(value)


def custom(df: DataFrame, separator: str | Column = "\n---\n", text: str = "text") -> DataFrame:
    separator = _given(separator)
    quoted = F.concat(F.lit(r"\Q"), F.replace(separator, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    pieces = F.filter(F.transform(F.split(F.col(text), quoted, -1), lambda p: strip(p)), lambda p: p != "")
    return _spread(df, pieces, _numbered("custom"), "custom", {"separator": lambda p, i: separator}, True)


def characters(df: DataFrame, limit: int | Column = 1000, text: str = "text") -> DataFrame:
    c, n, limit = F.col(text), F.length(text), _given(limit)
    pieces = F.when((n > 0) & (limit > 0), F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.greatest(limit, F.lit(1))), lambda s: F.struct(
        F.substring(c, s + 1, limit).alias("text"), s.alias("start"), F.least(s + limit, n).alias("end"))))
    fields = {"char_start": lambda p, i: p["start"], "char_end": lambda p, i: p["end"], "char_limit": lambda p, i: limit}
    label = lambda p, i: F.concat(F.lit("chars-"), (p["start"] + 1).cast("string"), F.lit("-"), p["end"].cast("string"))
    return _spread(df, pieces, label, "characters", fields, False)


def lines(df: DataFrame, per_chunk: int | Column = 50, text: str = "text", keep_empty: bool = False) -> DataFrame:
    """With ``keep_empty`` an empty text is one chunk of one empty line."""
    every, per_chunk = F.split(F.col(text), "\n", -1), _given(per_chunk)
    n = F.size(every)
    pieces = F.when((F.length(text) >= (0 if keep_empty else 1)) & (per_chunk > 0), F.transform(F.sequence(F.lit(0), n - 1, F.greatest(per_chunk, F.lit(1))), lambda s: F.struct(
        F.array_join(F.slice(every, s + 1, F.greatest(per_chunk, F.lit(1))), "\n").alias("text"), (s + 1).alias("first"), F.least(s + per_chunk, n).alias("last"))))
    fields = {"line_start": lambda p, i: p["first"], "line_end": lambda p, i: p["last"], "lines_per_chunk": lambda p, i: per_chunk}
    label = lambda p, i: F.concat(F.lit("lines-"), p["first"].cast("string"), F.lit("-"), p["last"].cast("string"))
    return _spread(df, pieces, label, "lines", fields, False)


def token_windows(text: str, limit: int) -> list[tuple[str, int, int]]:
    """(text, start, end) of windows of about ``limit`` tokens of four characters, cut back to the last break."""
    out, at, width = [], 0, 4 * limit
    while at < len(text):
        end = min(at + width, len(text))
        if end < len(text):
            back = max(text.rfind(b, at + 1, end + 1) for b in BREAKS)
            end = back if back > at else end
        chunk = text[at:end].strip()
        if chunk:
            out.append((chunk, at, end))
        at = end
    return out


def _window_array(rows: list[list[tuple[str, int, int]]]) -> pa.Array:
    flat = [w for found in rows for w in found]
    columns = [pa.array([w[k] for w in flat], kind) for k, kind in enumerate((pa.string(), pa.int32(), pa.int32()))]
    ends = pa.array([0, *accumulate(map(len, rows))], pa.int32())
    return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(columns, ["text", "start", "end"]))


def tokens(df: DataFrame, limit: int | Column = 500, text: str = "text") -> DataFrame:
    limit = _given(limit)

    @F.arrow_udf("array<struct<text:string,start:int,end:int>>")
    def windows(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, limits in batches:
            given = ((t.as_py(), n.as_py()) for t, n in zip(texts, limits))
            yield from in_slices(([] if t is None or not (n or 0) > 0 else token_windows(t, n) for t, n in given), _window_array, lambda found: sum(len(c) for c, _, _ in found))

    fields = {
        "token_limit": lambda p, i: limit, "estimated_tokens": lambda p, i: (F.length(p["text"]) / 4).cast("int"),
        "char_start": lambda p, i: p["start"], "char_end": lambda p, i: p["end"],
    }
    return _spread(df, windows(F.col(text), limit.cast("int")), _numbered("tokens"), "tokens", fields, False)


def rows(df: DataFrame, keys: list, per_chunk: int = 100) -> DataFrame:
    """Tag each row of a table with its chunk: rows are numbered by keys, ``per_chunk`` to a chunk."""
    numbered = with_ordinal(df, keys, "row_index")
    start = F.col("row_index") - F.col("row_index") % per_chunk
    return numbered.withColumns({
        "chunk_index": F.floor(F.col("row_index") / per_chunk).cast("int"), "chunk_type": F.lit("rows"), "row_start": start, "rows_per_chunk": F.lit(per_chunk),
    })


def row_chunks(df: DataFrame, keys: list, per_chunk: int = 100, path: str = "") -> DataFrame:
    """One row per chunk of a table: its range of rows and shape."""
    columns = len(df.columns)
    return rows(df, keys, per_chunk).groupBy("chunk_index").agg(F.min("row_start").alias("row_start"), (F.max("row_index") + 1).alias("row_end"), F.count(F.lit(1)).alias("n_rows")).select(
        F.concat(F.lit(f"{path}#rows-"), (F.col("row_start") + 1).cast("string"), F.lit("-"), F.col("row_end").cast("string")).alias("path"),
        F.lit("rows").alias("chunk_type"), "chunk_index", "row_start", "row_end", F.lit(per_chunk).alias("rows_per_chunk"),
        F.concat(F.lit("("), F.col("n_rows").cast("string"), F.lit(f", {columns})")).alias("chunk_shape"),
    )


def columns(df: DataFrame, per_chunk: int = 10) -> list[DataFrame]:
    """The table cut by columns; each part reads its own columns only."""
    return [df.select(*df.columns[i : i + per_chunk]) for i in range(0, len(df.columns), per_chunk)]


def column_chunks(df: DataFrame, per_chunk: int = 10, path: str = "") -> DataFrame:
    """One row per chunk of columns: names and range; the row count is the table's."""
    total, rows_out = len(df.columns), []
    for k, i in enumerate(range(0, total, per_chunk)):
        end = min(i + per_chunk, total)
        rows_out.append(F.struct(F.lit(f"{path}#columns-{i + 1}-{end}").alias("path"), F.lit("columns").alias("chunk_type"), F.lit(k).alias("chunk_index"), F.lit(i).alias("column_start"), F.lit(end).alias("column_end"), F.lit(per_chunk).alias("cols_per_chunk"), F.lit(", ".join(df.columns[i:end])).alias("chunk_columns")))
    return df.agg(F.count(F.lit(1)).alias("n")).select("n", F.explode(F.array(*rows_out)).alias("c")).select(
        "c.*", F.concat(F.lit("("), F.col("n").cast("string"), F.lit(", "), (F.col("c.column_end") - F.col("c.column_start")).cast("string"), F.lit(")")).alias("chunk_shape")
    )


def pages(df: DataFrame) -> DataFrame:
    """Rows of decoded pages (path, page_number, total_pages, text), each a chunk of its own."""
    return df.withColumns({
        "original_path": F.col("path"), "path": F.concat(F.col("path"), F.lit("#page-"), F.col("page_number").cast("string")), "chunk_type": F.lit("page"),
        "chunk_index": (F.col("page_number") - 1).cast("int"), "selected_pages": F.array(F.col("page_number")),
    })


def slides(df: DataFrame) -> DataFrame:
    """Rows of decoded slides (path, slide_number, total_slides, text), each a chunk of its own."""
    return df.withColumns({
        "original_path": F.col("path"), "path": F.concat(F.col("path"), F.lit("#slide-"), F.col("slide_number").cast("string")), "chunk_type": F.lit("slide"),
        "chunk_index": (F.col("slide_number") - 1).cast("int"), "selected_slides": F.array(F.col("slide_number") - 1),
    })


def sections(df: DataFrame, html: str = "html") -> DataFrame:
    """A chunk per heading: the heading and the siblings up to the next."""
    from docloom.operators.html import section_udf

    found = section_udf()(F.col(html))
    fields = {"section_index": lambda p, i: i, "section_heading": lambda p, i: p["heading"], "heading_level": lambda p, i: p["level"], "section_html": lambda p, i: p["html"]}
    out = _spread(df, found, _numbered("section"), "section", fields, True)
    return out.withColumnRenamed("total_chunks", "total_sections")


TEXT_SPLITTERS = {"paragraphs": paragraphs, "sentences": sentences, "characters": characters, "tokens": tokens, "lines": lines, "custom": custom}
SPLITTERS = (*TEXT_SPLITTERS, "pages", "slides", "rows", "columns", "sections")
