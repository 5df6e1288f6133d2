"""Presenters: renderings that append to ``text``. Tables render to one text by an ordered fold; widths come first,
from one aggregate row. Decoded documents (rows of pages, slides, paragraphs, cells) render by a fold per path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions import dsl
from docloom.functions.text import is_blank, strip
from docloom.operators import html as html_ops
from docloom.operators.fold import ordered_join

#: Metadata that readers want to see.
SHOWN = ("format", "size", "mode", "content_type", "status_code", "file_size", "pdf_pages_rendered", "pdf_total_pages", "collection_size", "from_zip", "zip_filename", "docx_pages_rendered", "docx_total_pages", "pptx_slides_rendered", "pptx_total_slides", "excel_sheets_rendered", "excel_total_sheets")

#: The report on a document that looks scanned, by style; figures go between the pieces.
REPORT = {
    "markdown": {
        "opening": "\n📄 **Document Analysis**: This appears to be a scanned PDF with little to no extractable text.\n\n",
        "pages": "- **Pages processed**: ", "with_text": "\n- **Pages with text**: ", "mean": "\n- **Average text per page**: ",
        "closing": " characters\n\n💡 **Suggestions**:\n"
        "- Use the extracted images for vision-capable LLMs (Claude, GPT-4V)\n"
        "- Consider OCR tools like `pytesseract` for text extraction\n"
        "- The images are available in the `images` property for multimodal analysis\n\n",
    },
    "text": {
        "opening": "\nDOCUMENT ANALYSIS: This appears to be a scanned PDF with little to no extractable text.\n\n",
        "pages": "- Pages processed: ", "with_text": "\n- Pages with text: ", "mean": "\n- Average text per page: ",
        "closing": " characters\n\nSUGGESTIONS:\n"
        "- Use the extracted images for vision-capable LLMs (Claude, GPT-4V)\n"
        "- Consider OCR tools like pytesseract for text extraction\n"
        "- The images are available in the images property for multimodal analysis\n\n",
    },
}


def _numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def _strings(df: DataFrame, null: str) -> DataFrame:
    return df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(null)).alias(f"c{i}") for i, c in enumerate(df.columns)])


def _ordered(df: DataFrame, keys: list[str], null: str) -> DataFrame:
    return df.select(F.struct(*keys).alias("o"), *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(null)).alias(f"c{i}") for i, c in enumerate(df.columns)])


def _widths(df: DataFrame, null: str) -> list[int]:
    """Longest value of each column: one aggregate row."""
    cells = _strings(df, null)
    row = cells.agg(*[F.max(F.length(c)).alias(c) for c in cells.columns]).first()
    return [w or 0 for w in row]


def _fold(rows: DataFrame, line: Column) -> DataFrame:
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", line.alias("l")))), lambda r: r["l"]), "\n")
    return rows.agg(joined.alias("body"), F.count(F.lit(1)).alias("n"))


def table_text(df: DataFrame, keys: list[str], path: str) -> DataFrame:
    """Right-aligned columns under their names, with title and shape; names of numbers are led by a space."""
    numeric, order = set(_numeric(df)), _ordered(df, keys, "None")
    names = [" " + c if c in numeric else c for c in df.columns]
    pad = [max(len(n), w) for n, w in zip(names, _widths(df, "None"))]
    line = F.concat_ws(" ", *[F.lpad(f"c{i}", p, " ") for i, p in enumerate(pad)])
    title = f"Data from {path}"
    top = F.lit(f"{title}\n{'=' * len(title)}\n\n{' '.join(n.rjust(p) for n, p in zip(names, pad))}")
    return _fold(order, line).select(F.concat(top, F.when(F.col("n") > 0, F.concat(F.lit("\n"), "body")).otherwise(F.lit("")), F.lit("\n\nShape: ("), F.col("n").cast("string"), F.lit(f", {len(df.columns)})\n\n")).alias("text"))


def _pipe_table(df: DataFrame, keys: list[str]) -> DataFrame:
    """Markdown pipe table: numbers to the right; columns two wider than their names at least."""
    numeric = set(_numeric(df))
    sizes = [max(len(c) + 2, w) for c, w in zip(df.columns, _widths(df, ""))]
    cell = lambda i, c: F.lpad(f"c{i}", sizes[i], " ") if c in numeric else F.rpad(f"c{i}", sizes[i], " ")
    rows = _ordered(df, keys, "")
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(i, c) for i, c in enumerate(df.columns)]), F.lit(" |"))
    head = "| " + " | ".join(c.rjust(s) if c in numeric else c.ljust(s) for c, s in zip(df.columns, sizes)) + " |"
    rule = "|" + "|".join("-" * (s + 1) + ":" if c in numeric else ":" + "-" * (s + 1) for c, s in zip(df.columns, sizes)) + "|"
    return _fold(rows, line).select(F.concat(F.lit(f"{head}\n{rule}"), F.when(F.col("n") > 0, F.concat(F.lit("\n"), "body")).otherwise(F.lit(""))).alias("text"), "n")


def table_markdown(df: DataFrame, keys: list[str], path: str) -> DataFrame:
    return _pipe_table(df, keys).select(F.concat(F.lit(f"## Data from {path}\n\n"), "text", F.lit("\n\n*Shape: ("), F.col("n").cast("string"), F.lit(f", {len(df.columns)})*\n\n")).alias("text"))


def table_head(df: DataFrame, keys: list[str], n: int = 5) -> DataFrame:
    return _pipe_table(df.orderBy(*keys).limit(n), keys).select(F.concat(F.lit("\n## Data Preview\n\n"), "text", F.lit("\n\n")).alias("text"))


def csv_line(df: DataFrame) -> Column:
    """One row as CSV, quoted where needed; null is empty."""
    def cell(c: str) -> Column:
        s = F.col(f"`{c}`").cast("string")
        return F.coalesce(F.when(s.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s), F.lit(""))

    return F.concat_ws(",", *[cell(c) for c in df.columns])


def table_csv(df: DataFrame, keys: list[str]) -> DataFrame:
    rows = df.select(F.struct(*keys).alias("o"), csv_line(df).alias("l"))
    return _fold(rows, F.col("l")).select(F.concat(F.lit(",".join(df.columns) + "\n"), F.when(F.col("n") > 0, F.concat("body", F.lit("\n"))).otherwise(F.lit(""))).alias("text"))


def xml_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def table_xml(df: DataFrame, keys: list[str]) -> DataFrame:
    def cell(c: str) -> Column:
        s = F.col(f"`{c}`").cast("string")
        return F.when(s.isNull(), F.lit(f"    <{c}/>\n")).otherwise(F.concat(F.lit(f"    <{c}>"), xml_escape(s), F.lit(f"</{c}>\n")))

    rows = df.select(F.struct(*keys).alias("o"), F.concat(F.lit("  <row>\n"), *[cell(c) for c in df.columns], F.lit("  </row>")).alias("l"))
    return _fold(rows, F.col("l")).select(F.concat(F.lit("<?xml version='1.0' encoding='utf-8'?>\n<data>\n"), "body", F.lit("\n</data>")).alias("text"))


def table_summary(df: DataFrame) -> DataFrame:
    names = "[" + ", ".join(f"'{c}'" for c in _numeric(df)) + "]"
    return df.agg(F.count(F.lit(1)).alias("n")).select(F.concat(
        F.lit("\n## Summary Statistics\n\n- **Rows**: "), F.col("n").cast("string"), F.lit(f"\n- **Columns**: {len(df.columns)}\n- **Memory Usage**: Not available\n- **Numeric Columns**: {names}\n\n")).alias("text"))


def metadata(df: DataFrame) -> DataFrame:
    """Append what readers want to know of the metadata map, and every ``*_error``."""
    shown = F.map_filter("metadata", lambda k, v: k.isin(*SHOWN) | k.endswith("_error"))
    names = {"pdf_pages_rendered": "Pages Rendered", "docx_pages_rendered": "Pages Rendered", "pptx_slides_rendered": "Slides Rendered", "excel_sheets_rendered": "Sheets Rendered", "pdf_total_pages": "Total Pages", "docx_total_pages": "Total Pages", "pptx_total_slides": "Total Slides", "excel_total_sheets": "Total Sheets"}

    def line(e: Column) -> Column:
        label = F.initcap(F.replace(e["key"], F.lit("_"), F.lit(" ")))
        for key, name in names.items():
            label = F.when(e["key"] == key, F.lit(name)).otherwise(label)
        value = F.when((e["key"] == "size") & e["value"].rlike(r"\A\([0-9]+, [0-9]+\)\z"), F.regexp_replace(e["value"], r"\A\(([0-9]+), ([0-9]+)\)\z", "$1 × $2 pixels")).otherwise(e["value"])
        return F.concat(F.lit("- **"), label, F.lit("**: "), value, F.lit("\n"))

    said = F.concat(F.lit("\n## File Info\n\n"), F.array_join(F.transform(F.map_entries(shown), line), ""), F.lit("\n"))
    return df.withColumn("text", F.when(F.size(shown) > 0, F.concat("text", said)).otherwise(F.col("text")))


def fallback_text(df: DataFrame, obj: str = "content_text") -> DataFrame:
    return df.withColumn("text", F.concat("text", "path", F.lit(": "), F.coalesce(F.col(obj), F.lit("None")), F.lit("\n\n")))


def fallback_markdown(df: DataFrame, obj: str = "content_text") -> DataFrame:
    kind = F.when(F.col(obj).isNull(), F.lit("<class 'NoneType'>")).otherwise(F.lit("<class 'str'>"))
    return df.withColumn("text", F.concat("text", F.lit("# "), "path", F.lit("\n\n*Object type: "), kind, F.lit("*\n\n```\n"), F.coalesce(F.col(obj), F.lit("None")), F.lit("\n```\n\n")))


def page_text(df: DataFrame, html: str = "html") -> DataFrame:
    return df.withColumn("text", F.concat("text", html_ops.html_text(F.col(html))))


def page_html(df: DataFrame, html: str = "html") -> DataFrame:
    return df.withColumn("text", F.concat("text", html_ops.prettified(F.col(html))))


def page_markdown(df: DataFrame, html: str = "html") -> DataFrame:
    return df.withColumn("text", F.concat("text", html_ops.markdown(F.col(html))))


def _by(parts: DataFrame) -> list[str]:
    """What a document is known by: its path, and its place where one file is attached twice."""
    return [c for c in ("ord", "path") if c in parts.columns]


def _measures() -> list[Column]:
    n = F.length(strip(F.coalesce("text", F.lit(""))))
    return [F.count(F.lit(1)).alias("total_pages"), F.count_if(n > 0).alias("pages_with_text"), F.sum(n).alias("_n")]


def _judged(measured: DataFrame, keep: list[str]) -> DataFrame:
    mean = F.col("_n") / F.col("total_pages")
    bad = (F.col("pages_with_text") == 0) | (mean < 50) | (F.col("pages_with_text") / F.col("total_pages") < 0.3)
    return measured.select(*keep, "total_pages", "pages_with_text", mean.alias("avg_text_per_page"), bad.alias("is_likely_scanned"),
                           F.when(~bad, "good").when(mean < 20, "poor").otherwise("limited").alias("text_extraction_quality"))


def scanned(pages: DataFrame, order: str = "page_number") -> DataFrame:
    """Per path: pages, pages with text, mean length, whether it looks scanned and the quality of the text."""
    by = _by(pages)
    return _judged(pages.groupBy(*by).agg(*_measures()), by)


def pdf(pages: DataFrame, style: str = "markdown") -> DataFrame:
    """Rows of pages (path, page_number, page_order, text) -> one text per path, with the analysis of scanned ones."""
    md = style == "markdown"
    order = "page_order" if "page_order" in pages.columns else "page_number"
    no = F.col("page_number").cast("string")
    body, blank = F.coalesce("text", F.lit("")), F.coalesce(is_blank(F.col("text")), F.lit(True))
    title, page, missing = ("# PDF Document: ", ("## Page ", "\n\n"), "*[No extractable text - likely scanned image]*") if md else ("PDF Document: ", ("[Page ", "]\n"), "[No extractable text - likely scanned image]")
    part = F.concat(F.lit(page[0]), no, F.lit(page[1]), F.when(blank, F.lit(missing)).otherwise(body), F.lit("\n\n"))
    by = _by(pages)
    texts = _judged(pages.groupBy(*by).agg(ordered_join(F.struct(order), part, "").alias("body"), *_measures()), [*by, "body"])
    say = REPORT[style if md else "text"]
    report = F.concat(
        F.lit(say["opening"]), F.lit(say["pages"]), F.col("total_pages").cast("string"), F.lit(say["with_text"]), F.col("pages_with_text").cast("string"),
        F.lit(say["mean"]), F.format_string("%.0f", F.rint("avg_text_per_page")), F.lit(say["closing"]),
    )
    done = F.concat(F.lit("*Total pages processed: "), F.col("total_pages").cast("string"), F.lit("*\n\n")) if md else F.lit("")
    heading = F.concat(F.lit(title), "path")
    top = F.concat(heading, F.lit("\n\n")) if md else F.concat(heading, F.lit("\n"), F.repeat(F.lit("="), F.length(heading)), F.lit("\n\n"))
    return texts.withColumn("text", F.concat(top, "body", F.when(F.col("is_likely_scanned"), report).otherwise(done))).drop("body")


def slides(rows: DataFrame, style: str = "markdown") -> DataFrame:
    """Rows of shapes (path, slide_number, shape, text) -> one text per path."""
    md = style == "markdown"
    has = ~F.coalesce(is_blank(F.col("text")), F.lit(True))
    o = F.struct("shape")
    per = rows.groupBy(*_by(rows), "slide_number").agg(ordered_join(o, F.when(has, F.concat("text", F.lit("\n\n" if md else "\n"))), "").alias("body"))
    no = F.col("slide_number").cast("string")
    part = F.concat(F.lit("## Slide "), no, F.lit("\n\n"), "body") if md else F.concat(F.lit("[Slide "), no, F.lit("]\n"), F.when(is_blank(F.col("body")), F.lit("[No text content]\n\n")).otherwise(F.concat("body", F.lit("\n"))))
    g = per.groupBy(*_by(rows)).agg(ordered_join(F.struct("slide_number"), part, "").alias("body"), F.count(F.lit(1)).cast("string").alias("n"))
    top = _title("Presentation: ", md)
    return g.select(*_by(rows), F.concat(top, "body", F.lit("*Slides processed: " if md else "Slides processed: "), "n", F.lit("*\n\n" if md else "\n\n")).alias("text"))


def _title(kind: str, md: bool) -> Column:
    heading = F.concat(F.lit(("# " if md else "") + kind), "path")
    return F.concat(heading, F.lit("\n\n")) if md else F.concat(heading, F.lit("\n"), F.repeat(F.lit("="), F.length(heading)), F.lit("\n\n"))


def document(paragraphs: DataFrame, style: str = "markdown") -> DataFrame:
    """Rows of paragraphs (path, number, style, text) -> one text per path; headings by their style's level."""
    md = style == "markdown"
    level = F.regexp_extract("style", r"(\S+)\s*\z", 1).try_cast("int")
    mark = F.when(F.col("style").startswith("Heading"), F.concat(F.repeat(F.lit("#"), F.coalesce(F.least(level + 1, F.lit(6)), F.lit(2))), F.lit(" "))).otherwise(F.lit("")) if md else F.lit("")
    has = ~F.coalesce(is_blank(F.col("text")), F.lit(True))
    g = paragraphs.groupBy(*_by(paragraphs)).agg(ordered_join(F.struct("number"), F.when(has, F.concat(mark, "text", F.lit("\n\n"))), "").alias("body"), F.count(F.lit(1)).cast("string").alias("n"))
    return g.select(*_by(paragraphs), F.concat(_title("Document: ", md), "body", F.lit("*Document processed: "), "n", F.lit(" paragraphs*\n\n")).alias("text"))


def workbook(rows: DataFrame, style: str = "markdown") -> DataFrame:
    """Rows of sheets (path, sheet_number, title, row_number, cells array<string>, columns) -> one text per path."""
    md = style == "markdown"
    clean = F.transform("cells", lambda v: F.replace(F.replace(F.coalesce(v, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")) if md else F.coalesce(v, F.lit("")))
    joined = F.array_join(clean, " | ")
    rule = F.when(F.col("row_number") == 1, F.concat(F.lit("|"), F.repeat(F.lit("---|"), F.col("columns")), F.lit("\n"))).otherwise(F.lit(""))
    line = F.concat(F.lit("| "), joined, F.lit(" |\n"), rule) if md else F.concat(F.lit("Row "), F.col("row_number").cast("string"), F.lit(": "), joined, F.lit("\n"))
    per = rows.groupBy(*_by(rows), "sheet_number", "title", "columns").agg(ordered_join(F.struct("row_number"), F.when(F.col("row_number").isNotNull(), line), "").alias("body"), F.count("row_number").cast("string").alias("n"))
    no, size = F.col("sheet_number").cast("string"), F.concat(F.col("n"), F.lit(" rows × "), F.col("columns").cast("string"), F.lit(" columns\n"))
    part = F.concat(F.lit("## Sheet "), no, F.lit(": "), "title", F.lit("\n\n**Dimensions**: "), size, F.lit("\n"), F.when(F.col("n") > 0, F.concat(F.lit("**Data**:\n\n"), "body", F.lit("\n"))).otherwise(F.lit("*Empty sheet*\n\n"))) if md else F.concat(F.lit("[Sheet "), no, F.lit(": "), "title", F.lit("]\nDimensions: "), size, "body", F.lit("\n"))
    g = per.groupBy(*_by(rows)).agg(ordered_join(F.struct("sheet_number"), part, "").alias("body"), F.count(F.lit(1)).cast("string").alias("n"))
    return g.select(*_by(rows), F.concat(_title("Workbook: ", md), "body", F.lit("*Workbook processed: "), "n", F.lit(" sheets*\n\n")).alias("text"))


def image_markdown(df: DataFrame) -> DataFrame:
    """Rows of images (path, format, width, height, mode)."""
    size = F.concat(F.lit("("), F.col("width").cast("string"), F.lit(", "), F.col("height").cast("string"), F.lit(")"))
    said = F.concat(F.lit("# Image: "), "path", F.lit("\n\n- **Format**: "), F.coalesce("format", F.lit("Unknown")), F.lit("\n- **Size**: "), F.coalesce(size, F.lit("Unknown")), F.lit("\n- **Mode**: "), F.coalesce("mode", F.lit("Unknown")), F.lit("\n\n*Image converted to base64 and available in images list*\n\n"))
    return df.withColumn("text", F.concat(F.coalesce("text", F.lit("")), said) if "text" in df.columns else said)


def images(df: DataFrame) -> DataFrame:
    """Content as data URLs of its own type, told by its first bytes; formats that no data URL can carry need a renderer
    that is not here and set ``images_error``."""
    head = F.hex(F.substring("content", 1, 12))
    brand = F.substring("content", 9, 4).cast("string")
    kind = (
        F.when(head.startswith("89504E47"), "png").when(head.startswith("FFD8FF"), "jpeg").when(head.startswith("47494638"), "gif").when(head.startswith("424D"), "bmp")
        .when(head.rlike("^52494646.{8}57454250"), "webp").when(head.rlike("^.{8}66747970") & brand.isin("heic", "heix", "heif", "mif1", "msf1", "hevc"), "heic")
        .when(F.decode(F.substring("content", 1, 1024), "ISO-8859-1").rlike(r"(?i)\A\s*<[\s\S]*?svg[\s>]"), "svg+xml")
    )
    return df.withColumns({
        "images": F.when(kind.isNotNull(), F.array(F.concat(F.lit("data:image/"), kind, F.lit(";base64,"), F.base64("content")))).otherwise(F.expr("cast(array() as array<string>)")),
        "images_error": F.when(kind.isNull(), F.lit("no renderer for this format is registered")),
    })


def unrendered(df: DataFrame, kind: str) -> DataFrame:
    """Documents whose pages need a renderer that is not here: no images, and ``<kind>_images_error`` in the metadata."""
    said = F.create_map(F.lit(f"{kind}_images_error"), F.lit("no renderer for this format is registered"))
    return df.withColumns({"images": F.expr("cast(array() as array<string>)"), "metadata": F.map_concat("metadata", said)})


def office_xml(parts: DataFrame, kind: str = "PPTX") -> DataFrame:
    """Rows of pretty-printed members (path, part, member, members, text) -> one text per path."""
    part = F.concat(F.lit("<!-- "), "member", F.lit(" -->\n"), "text", F.lit("\n\n"))
    g = parts.groupBy("path").agg(ordered_join(F.struct("part"), part, "").alias("body"), F.max("members").alias("members"))
    return g.select("path", F.concat(F.lit(f"# {kind} XML Content: "), "path", F.lit(f"\n\n```xml\n<!-- {kind} Structure Overview -->\n<!-- XML Files: "), "members", F.lit(" -->\n\n"), "body", F.lit("```\n\n")).alias("text"))


def pdf_metadata(info: DataFrame) -> DataFrame:
    """Rows of (path, key, value) -> one text per path."""
    line = F.when(F.col("key").isNotNull(), F.concat(F.lit("- **"), "key", F.lit("**: "), "value", F.lit("\n")))
    g = info.groupBy("path").agg(ordered_join(F.struct("key"), line, "").alias("body"))
    return g.select("path", F.concat(F.lit("\n## Document Metadata\n\n"), F.when(F.col("body") == "", F.lit("*No metadata available*\n")).otherwise(F.col("body")), F.lit("\n")).alias("text"))


def object_summary(df: DataFrame, obj: str = "content_text") -> DataFrame:
    said = F.concat(F.lit("\n## Object Summary\n\n- **Type**: str\n- **Length**: "), F.length(obj).cast("string"), F.lit("\n- **String representation**: "), F.left(obj, F.lit(100)), F.lit("...\n\n"))
    none = F.lit("\n## Object Summary\n\n- **Type**: NoneType\n- **String representation**: None...\n\n")
    return df.withColumn("text", F.concat("text", F.coalesce(said, none)))


def object_preview(df: DataFrame, obj: str = "content_text") -> DataFrame:
    return df.withColumn("text", F.concat("text", F.lit("\n## Preview\n\n"), F.left(F.coalesce(F.col(obj), F.lit("None")), F.lit(200)), F.lit("\n\n")))


def filtered(df: DataFrame) -> DataFrame:
    """What the notation switches off: ``[text:off|false|no|0]`` leaves no text, ``[images:false]`` no images."""
    out = {"text": F.when(F.lower(dsl.command("text")).isin("off", "false", "no", "0"), F.lit("")).otherwise(F.col("text"))}
    if "images" in df.columns:
        out["images"] = F.when(F.lower(dsl.command("images")) == "false", F.expr("cast(array() as array<string>)")).otherwise(F.col("images"))
    return df.withColumns(out)


def thumbnails(df: DataFrame, total: str = "total_pages", most: int = 3) -> DataFrame:
    n = F.least(F.col(total), F.lit(most))
    made = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.lit("thumbnail_page_"), i.cast("string"), F.lit("_placeholder")))
    return df.withColumn("images", F.when(n > 0, made).otherwise(F.expr("cast(array() as array<string>)")))


def contact_sheet(df: DataFrame) -> DataFrame:
    return df.withColumn("images", F.array(F.lit("contact_sheet_placeholder")))


def ocr(df: DataFrame) -> DataFrame:
    """Text recognition needs an engine that is not here: the rows say so."""
    return df.withColumn("text", F.concat("text", F.lit("\n## OCR Text Extraction\n\n*OCR not available: no recognition engine is registered.*\n\n")))


PRESENTERS_BY_FORMAT = {"text": page_text, "html": page_html, "markdown": page_markdown}


def page(df: DataFrame, fmt: str = "markdown", html: str = "html") -> DataFrame:
    """Render pages in the format asked for, by the routing rules of the notation."""
    routed = df.sparkSession.range(1).select(dsl.format_presenter(F.lit(fmt)).alias("f")).first()["f"]
    return PRESENTERS_BY_FORMAT.get(routed, page_markdown)(df, html)
