"""The verb algebra: ``flow | verb | (a + b)``, lazily, over DataFrames.

A verb is a named DataFrame -> DataFrame function. ``|`` composes, ``+`` appends in turn, ``fallback`` keeps a second
plan for rows that the first marks with ``error``. Nothing runs until the result is used; Catalyst sees one plan.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators import adapt as adapt_ops
from docloom.operators import modify as modify_ops
from docloom.operators import present as present_ops
from docloom.operators import refine as refine_ops
from docloom.operators import split as split_ops
from docloom.schema import canonical
from docloom.sources import decode, directories, files, urls


class Verb:
    def __init__(self, name: str, apply: Callable[..., DataFrame], *args, **kwargs):
        self.name, self.apply, self.args, self.kwargs = name, apply, args, kwargs

    def __call__(self, *args, **kwargs):
        """With a DataFrame: run. Otherwise: the verb with these arguments bound."""
        if args and isinstance(args[0], DataFrame):
            return self.apply(args[0], *self.args, *args[1:], **{**self.kwargs, **kwargs})
        return Verb(self.name, self.apply, *self.args, *args, **{**self.kwargs, **kwargs})

    def __or__(self, other: Verb) -> Verb:
        return Verb(f"{self.name} | {other.name}", lambda df: other(self(df)))

    def __add__(self, other: Verb) -> Verb:
        return Verb(f"{self.name} + {other.name}", lambda df: other(self(df)))

    def __repr__(self) -> str:
        return f"<verb {self.name}>"


class Flow:
    """A table of files or texts with verbs applied to it."""

    def __init__(self, df: DataFrame):
        self.df = df

    def __or__(self, verb: Verb) -> Flow:
        return Flow(verb(self.df))


class Namespace:
    def __init__(self, name: str):
        self._name, self._verbs = name, {}

    def register(self, name: str, apply: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        self._verbs[name] = Verb(f"{self._name}.{name}", apply)
        return apply

    def __getattr__(self, name: str) -> Verb:
        try:
            return self.__dict__["_verbs"][name]
        except KeyError:
            raise AttributeError(f"{self.__dict__['_name']} has no verb {name!r}; it has {', '.join(sorted(self.__dict__['_verbs']))}") from None

    def __dir__(self):
        return sorted(self._verbs)


load, modify, split, present, refine, adapt, processors = map(Namespace, ("load", "modify", "split", "present", "refine", "adapt", "processors"))
NAMESPACES = {"load": load, "modify": modify, "split": split, "present": present, "refine": refine, "adapt": adapt, "processors": processors}


def _decorator(space: Namespace):
    def register(function: Callable[..., DataFrame] | None = None, *, name: str | None = None):
        if function is None:
            return lambda f: register(f, name=name)
        return space.register(name or function.__name__, function)

    return register


#: Users add verbs with these; a function takes a DataFrame (and options) and returns one.
loader, modifier, splitter, presenter, refiner, adapter, processor = map(_decorator, (load, modify, split, present, refine, adapt, processors))


def fallback(main: Verb, *others: Verb) -> Verb:
    """Rows that end with ``error`` set are taken, as they came in, through the next plan. Plans keep ``ord``."""

    def run(df: DataFrame) -> DataFrame:
        done = main(df)
        for other in others:
            failed = done.filter(F.col("error").isNotNull()).select("ord")
            again = other(df.join(failed, "ord", "left_semi"))
            done = done.filter(F.col("error").isNull()).unionByName(again, allowMissingColumns=True)
        return done

    return Verb("fallback", run)


def attach(spark, *references: str) -> Flow:
    return Flow(canonical(files.attached(spark, list(references))))


A = attach


def _existing(spark, paths: list[str]) -> list[tuple[str, str]]:
    """(path, its full name) of those that are files, in whatever file system they name. A scan's files are listed by
    the driver in any case; only names pass through it, no content."""
    jvm, conf, out = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf(), []
    for p in paths:
        if not p or p.startswith(("http://", "https://")):
            continue
        try:
            at = jvm.org.apache.hadoop.fs.Path(p)
            system = at.getFileSystem(conf)
            if system.getFileStatus(at).isFile():
                out.append((p, system.makeQualified(at).toString()))
        except Exception:  # noqa: BLE001  not there, or no name of a file: the row says so
            continue
    return out


def _content(df: DataFrame) -> DataFrame:
    """Bring in each file's content by path; a file that is not there leaves it null and sets ``error``."""
    spark = df.sparkSession
    there = _existing(spark, [r["path"] for r in df.select("path").distinct().toLocalIterator()])
    if not there:
        return df.withColumn("error", F.lit("file not found"))
    literal = [re.sub(r"([\[\]{}*?\\])", r"\\\1", at) for _, at in there]  # names, not patterns
    read = files.binary(spark, sorted(set(literal))).select(F.col("path").alias("_at"), F.col("content").alias("_c"))
    known = spark.createDataFrame(there, "path string, _at string")
    joined = df.join(known, "path", "left").join(read, "_at", "left")
    return joined.withColumns({"content": F.col("_c"), "error": F.when(F.col("_c").isNull(), "file not found")}).drop("_at", "_c")


def _text(df: DataFrame) -> DataFrame:
    c = F.col("content")
    decoded = F.when(F.is_valid_utf8(c.cast("string")), c.cast("string")).otherwise(F.decode(c, "ISO-8859-1"))
    return df.withColumns({"text": F.coalesce(decoded, F.col("text")), "content_text": decoded, "kind": F.lit("text")})


load.register("content", _content)
load.register("text_to_string", _text)
load.register("html_to_bs4", lambda df: _text(df).withColumns({"html": F.col("content_text"), "text": F.lit(""), "kind": F.lit("html")}))
for _name, _f in {"pdf_to_pdfplumber": decode.pdf, "pptx_to_python_pptx": decode.pptx, "docx_to_python_docx": decode.docx, "excel_to_openpyxl": decode.xlsx, "image_to_pil": decode.images, "zip_to_images": decode.zip_images, "svg_to_svgdocument": decode.svg, "eps_to_epsdocument": decode.eps, "office_xml": decode.office_xml, "pdf_info": decode.pdf_info, "url_to_response": urls.responses, "url_to_bs4": urls.pages, "url_to_file": urls.responses}.items():
    load.register(_name, _f)
for _name in ("limit", "select_columns", "select_html", "pages", "slides", "crop", "rotate", "resize", "watermark", "morph_to_detected_type"):
    modify.register(_name, getattr(modify_ops, _name))
for _name in split_ops.SPLITTERS:
    split.register(_name, getattr(split_ops, _name))
for _name in ("page_text", "page_html", "page_markdown", "table_text", "table_markdown", "table_csv", "table_xml", "table_summary", "table_head", "metadata", "images", "thumbnails", "contact_sheet", "ocr", "pdf", "document", "workbook", "image_markdown", "fallback_text", "fallback_markdown", "unrendered", "office_xml", "pdf_metadata", "object_summary", "object_preview", "filtered"):
    present.register(_name, getattr(present_ops, _name))
present.register("shapes", present_ops.slides)
present.register("files", directories.directory_map)
for _name in ("no_op", "truncate", "add_headers", "format_tables", "add_repo_headers", "report_unused_commands", "tile_layout", "resize_images"):
    refine.register(_name, getattr(refine_ops, _name))
for _name, _f in adapt_ops.ADAPTERS.items():
    adapt.register(_name, _f)
