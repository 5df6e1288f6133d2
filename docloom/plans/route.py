"""Processors: which plan a file takes, and the plans. Routing is one CASE column; each kind is a branch of a union."""

from __future__ import annotations

import csv
import io

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import dsl, matchers
from docloom.operators import present, refine, split
from docloom.plans import verbs
from docloom.schema import canonical
from docloom.sources import decode, files

RENDERED = ("ord", "attachy", "path", "commands", "kind", "processor", "text", "images", "metadata", "error")


def _back(df: DataFrame, texts: DataFrame) -> DataFrame:
    """Rendered texts onto the rows they belong to."""
    return df.drop("text").join(texts.select("ord", "path", "text"), ["ord", "path"], "left").withColumn("text", F.coalesce("text", F.concat(F.lit("# "), "path", F.lit("\n\n*Could not be read*\n\n"))))


def _style(df: DataFrame) -> DataFrame:
    return df.withColumn("_style", F.when(dsl.format_presenter(dsl.command("format")) == "text", "text").otherwise("markdown"))


def _by_style(df: DataFrame, render) -> DataFrame:
    """Render both styles lazily, each over the rows that ask for it."""
    styled, out = _style(df), None
    for s in ("markdown", "text"):
        mine = styled.filter(F.col("_style") == s).drop("_style")
        part = _back(mine, render(mine, s))
        out = part if out is None else out.unionByName(part)
    return out


def _paged(df: DataFrame, decode_parts, number: str, total: str) -> DataFrame:
    """Parts that the attachment's ``pages`` asks for (all without it), in its order."""
    asked = decode_parts(df.withColumn("_spec", dsl.command("pages"))).filter("error IS NULL")
    wanted = F.when(F.col("_spec").isNull(), F.array(F.col(number))).otherwise(F.coalesce(dsl.page_list(F.col("_spec"), F.col(total)), F.array(F.col(number))))
    hit = F.transform(F.filter(F.transform(wanted, lambda p, i: F.struct(i.alias("i"), p.alias("p"))), lambda e: e["p"] == F.col(number)), lambda e: e["i"])
    return asked.withColumn("_i", F.explode(hit)).withColumn("page_order", F.when(F.col("_spec").isNull(), F.col(number)).otherwise(F.col("_i"))).drop("_i", "_spec")


@verbs.processor
def pdf_to_llm(df: DataFrame) -> DataFrame:
    return _by_style(df, lambda mine, s: present.pdf(_paged(mine, decode.pdf, "page_number", "total_pages"), s))


@verbs.processor
def pptx_to_llm(df: DataFrame) -> DataFrame:
    return _by_style(df, lambda mine, s: present.slides(_paged(mine, decode.pptx, "slide_number", "total_slides"), s))


@verbs.processor
def docx_to_llm(df: DataFrame) -> DataFrame:
    return _by_style(df, lambda mine, s: present.document(decode.docx(mine).filter("error IS NULL"), s))


@verbs.processor
def excel_to_llm(df: DataFrame) -> DataFrame:
    return refine.add_headers(_by_style(df, lambda mine, s: present.workbook(decode.xlsx(mine).filter("error IS NULL"), s)))


@verbs.processor
def image_to_llm(df: DataFrame) -> DataFrame:
    rendered = present.images(_back(df, present.image_markdown(decode.images(df).filter("error IS NULL"))))
    return rendered.withColumn("images", F.when(F.lower(dsl.command("images")) == "true", F.col("images")).otherwise(F.expr("cast(array() as array<string>)"))).drop("images_error")


@verbs.processor
def webpage_to_llm(df: DataFrame) -> DataFrame:
    """Pages with their html at hand (fetched or stored)."""
    page = df if "html" in df.columns else df.withColumn("html", F.make_valid_utf8(F.col("content").cast("string")))
    fmt = dsl.format_presenter(dsl.command("format"))
    out = None
    for name, render in (("text", present.page_text), ("html", present.page_html), ("markdown", present.page_markdown)):
        mine = page.filter((fmt == name) if name != "markdown" else ~fmt.isin("text", "html"))
        part = render(mine.withColumn("text", F.lit("")))
        out = part if out is None else out.unionByName(part)
    return refine.add_headers(present.metadata(out)).drop("html")


def _csv_rows():
    @F.pandas_udf("array<array<string>>")
    def rows(contents: pd.Series) -> pd.Series:
        return contents.map(lambda c: None if c is None else list(csv.reader(io.StringIO(bytes(c).decode("utf-8", "replace")))))

    return rows


def _quoted(cells: Column) -> Column:
    one = lambda c: F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    return F.array_join(F.transform(cells, one), ",")


def _barred(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda c: F.replace(F.replace(c, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))), " | "), F.lit(" |"))


@verbs.processor
def csv_to_llm(df: DataFrame) -> DataFrame:
    """Each file is one text: its rows up to ``limit``, as CSV or a pipe table, and on request the summary and preview."""
    most = dsl.command("limit").try_cast("int")
    d = df.withColumn("_t", F.coalesce(_csv_rows()(F.col("content")), F.expr("cast(array() as array<array<string>>)")))
    d = d.withColumns({"_head": F.coalesce(F.get("_t", F.lit(0)), F.expr("cast(array() as array<string>)")), "_rows": F.slice("_t", F.lit(2), F.when(most >= 0, most).otherwise(F.size("_t")))})
    shape = F.concat(F.lit("("), F.size("_rows").cast("string"), F.lit(", "), F.size("_head").cast("string"), F.lit(")"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit("---|"), F.size("_head")))
    table = lambda rows: F.array_join(F.concat(F.array(_barred(F.col("_head")), rule), F.transform(rows, _barred)), "\n")
    plain = F.array_join(F.concat(F.array(_quoted(F.col("_head"))), F.transform("_rows", _quoted)), "\n")
    fmt = dsl.format_presenter(dsl.command("format"))
    text = F.when(fmt == "csv", F.concat(plain, F.lit("\n"))).when(
        fmt == "text", F.concat(F.lit("Data from "), "path", F.lit("\n"), F.repeat(F.lit("="), F.length("path") + 10), F.lit("\n\n"), plain, F.lit("\n\nShape: "), shape, F.lit("\n\n"))
    ).otherwise(F.concat(F.lit("## Data from "), "path", F.lit("\n\n"), table(F.col("_rows")), F.lit("\n\n*Shape: "), shape, F.lit("*\n\n")))
    asked = lambda name, said: F.when(F.lower(dsl.command(name)) == "true", said).otherwise(F.lit(""))
    summary = asked("summary", F.concat(F.lit("\n## Summary Statistics\n\n- **Rows**: "), F.size("_rows").cast("string"), F.lit("\n- **Columns**: "), F.size("_head").cast("string"), F.lit("\n\n")))
    head = asked("head", F.concat(F.lit("\n## Data Preview\n\n"), table(F.slice("_rows", 1, 5)), F.lit("\n\n")))
    return refine.add_headers(d.withColumn("text", F.concat(text, summary, head))).drop("_t", "_head", "_rows")


def _vector(df: DataFrame, decoded: DataFrame) -> DataFrame:
    """The source as text; vector graphics that browsers know as an image too, others with an error in the metadata."""
    shown = present.images(_back(df, decoded.select("ord", "path", F.concat("path", F.lit(": "), "text", F.lit("\n\n")).alias("text"))))
    said = F.when(F.col("images_error").isNotNull(), F.create_map(F.concat("kind", F.lit("_images_error")), F.col("images_error"))).otherwise(F.expr("cast(map() as map<string,string>)"))
    return shown.withColumn("metadata", F.map_concat("metadata", said)).drop("images_error")


@verbs.processor
def svg_to_llm(df: DataFrame) -> DataFrame:
    return _vector(df, decode.svg(df).filter("error IS NULL"))


@verbs.processor
def eps_to_llm(df: DataFrame) -> DataFrame:
    return _vector(df, decode.eps(df))


@verbs.processor
def universal(df: DataFrame) -> DataFrame:
    """Text as it is, once, under a header; a missing file is a row that says so."""
    read = F.col("content").isNotNull()
    known = F.when(read & matchers.text(matchers.File(F.col("path"), None, F.col("content"))), F.coalesce(F.col("content").cast("string"), F.lit("")))
    text = F.when(known.isNotNull(), known).otherwise(F.concat(F.lit("# "), "path", F.lit("\n\n*Object type: <class 'NoneType'>*\n\n```\nNone\n```\n\n")))
    return refine.add_headers(df.withColumn("text", text))


@verbs.processor
def academic_pdf(df: DataFrame) -> DataFrame:
    return pdf_to_llm(df)


@verbs.processor
def legal_pdf(df: DataFrame) -> DataFrame:
    return refine.add_headers(pdf_to_llm(df))


@verbs.processor
def financial_pdf(df: DataFrame) -> DataFrame:
    return refine.format_tables(pdf_to_llm(df))


@verbs.processor
def medical_pdf(df: DataFrame) -> DataFrame:
    return refine.add_headers(pdf_to_llm(df))


@verbs.processor
def legal_docx(df: DataFrame) -> DataFrame:
    return refine.add_headers(docx_to_llm(df))


PLANS = {"pdf": pdf_to_llm, "image": image_to_llm, "docx": docx_to_llm, "pptx": pptx_to_llm, "excel": excel_to_llm, "webpage": webpage_to_llm, "csv": csv_to_llm, "svg": svg_to_llm, "eps": eps_to_llm, "universal": universal}


def available_processors(spark) -> DataFrame:
    rows = [(name, "primary" if name.endswith("_to_llm") else "named") for name in dir(verbs.processors) if name != "universal"]
    return spark.createDataFrame(rows, "name string, role string")


def processed(df: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """Rows with content -> their texts, by the plan each one's kind chooses; only the plans in use are built."""
    df = files.detected(canonical(df))
    use = kinds if kinds is not None else [r["processor"] for r in df.select("processor").distinct().toLocalIterator()]
    out = None
    for kind in use:
        part = present.filtered(PLANS[kind](df.filter(F.col("processor") == kind))).select(*RENDERED)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else df.select(*RENDERED)


def unsplit(df: DataFrame) -> DataFrame:
    """The columns of chunks, empty: where nothing is to be split."""
    return df.withColumns({"chunk_type": F.lit(None).cast("string"), "chunk_index": F.lit(None).cast("int"), "original_path": F.lit(None).cast("string")})


def split_as_asked(df: DataFrame) -> DataFrame:
    """Apply each attachment's own ``[split:...]``; an unknown splitter changes nothing."""
    asked = dsl.command("split")
    names = list(split.TEXT_SPLITTERS)
    chunk = unsplit(df)
    columns = chunk.columns
    out = chunk.filter(F.coalesce(~asked.isin(*names), F.lit(True))).select(*columns)
    for name in names:
        mine, value = df.filter(asked == name), dsl.command(name)
        if name == "custom":
            done = split.custom(mine, value)
        elif name in ("characters", "tokens", "lines"):  # each row's own limit; one that is no number changes nothing
            done = split.TEXT_SPLITTERS[name](mine, value.try_cast("int"))
        else:
            done = split.TEXT_SPLITTERS[name](mine)
        out = out.unionByName(done.select(*columns))
    return out


def _as_format(name: str):
    """A presenter of mixed rows: each by the plan of its kind, in one format."""

    def run(df: DataFrame) -> DataFrame:
        other = F.map_filter("commands", lambda k, v: k != "format")
        return processed(canonical(df).withColumn("commands", F.map_concat(other, F.create_map(F.lit("format"), F.lit(name)))))

    return run


for _verb, _format in {"text": "plain", "markdown": "markdown", "html": "html", "csv": "csv"}.items():
    verbs.present.register(_verb, _as_format(_format))
