"""The bracket notation on paths: ``report.pdf[pages:1-3][format:plain]``, as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import basename, strip

#: Command -> default (empty where a command has none).
COMMANDS = {
    "characters": "1000", "tokens": "500", "lines": "50", "rows": "100", "columns": "10", "custom": "\n---\n", "split": "",
    "pages": "", "limit": "", "select": "", "crop": "", "rotate": "", "resize": "", "watermark": "auto", "truncate": "1000",
    "tile": "2x2", "resize_images": "800", "format": "markdown", "images": "true", "text": "true", "ocr": "auto", "lang": "eng",
    "summary": "false", "head": "false", "prompt": "", "viewport": "1280x720", "fullpage": "true", "wait": "200",
    "ignore": "standard", "max_files": "1000", "glob": "", "recursive": "true", "files": "false",
    "dirs_only_with_files": "true", "force": "false", "mode": "",
}
#: Text formats, in the order in which suggestions prefer them.
FORMATS = ("plain", "text", "txt", "markdown", "md", "html", "code", "xml", "csv", "structured")

_ONE = r"\[[a-zA-Z0-9_-]+:[^\[\]]*\]|\[[0-9,-]+\]"
_SPACE = r"[\s\u001c-\u001f\u0085\p{Z}]*"
_TAIL = rf"((?:(?:{_ONE}){_SPACE})*(?:{_ONE}))\z"


def _tail(attachy: Column) -> Column:
    return F.regexp_extract(attachy, _TAIL, 1)


def commands(attachy: Column) -> Column:
    """map<string,string> of the commands at the end; of equal keys the rightmost counts."""
    parts = F.regexp_extract_all(_tail(attachy), F.lit(rf"({_ONE})"), F.lit(1))
    entry = F.transform(parts, lambda p: F.when(
        p.rlike(r"\A\[[a-zA-Z0-9_-]+:"),
        F.struct(F.regexp_extract(p, r"\A\[([a-zA-Z0-9_-]+):", 1).alias("key"), strip(F.regexp_extract(p, r"(?s)\A\[[^:]*:(.*)\]\z", 1)).alias("value")),
    ).otherwise(F.struct(F.lit("pages").alias("key"), F.regexp_extract(p, r"\A\[(.*)\]\z", 1).alias("value"))))
    last = F.filter(entry, lambda e, i: ~F.exists(F.slice(entry, i + 2, F.size(entry)), lambda later: later["key"] == e["key"]))
    return F.when(_only_commands(attachy), F.expr("cast(map() as map<string,string>)")).otherwise(F.map_from_entries(last))


def _only_commands(attachy: Column) -> Column:
    bare = strip(F.regexp_replace(attachy, _TAIL, ""))
    return attachy.startswith('"[') & attachy.endswith(']"') & (bare == "")


def path(attachy: Column) -> Column:
    return F.when(_only_commands(attachy), attachy).otherwise(strip(F.regexp_replace(attachy, _TAIL, "")))


def parsed(df: DataFrame, attachy_col: str = "attachy") -> DataFrame:
    """Add path and commands."""
    return df.withColumns({"commands": commands(F.col(attachy_col)), "path": path(F.col(attachy_col))})


def command(name: str, default: str | None = None, commands_col: str = "commands") -> Column:
    value = F.try_element_at(F.col(commands_col), F.lit(name))
    given = COMMANDS.get(name) if default is None else default
    return F.coalesce(value, F.lit(given)) if given not in (None, "") else value


def page_list(spec: Column, total: Column) -> Column:
    """array<int> of 1-based pages in the order given: ``1,3-5,-1``; -1 is the last, 5-3 is empty, nonsense is null."""
    parts = F.transform(F.split(spec, ","), lambda p: strip(p))
    good = F.forall(parts, lambda p: p.rlike(r"\A(-?[0-9]+|[0-9]+\s*-\s*[0-9]+)\z"))

    def one(p: Column) -> Column:
        a, b = F.regexp_extract(p, r"\A([0-9]+)\s*-", 1).try_cast("int"), F.regexp_extract(p, r"-\s*([0-9]+)\z", 1).try_cast("int")
        spread = F.when(a <= b, F.sequence(a, F.greatest(a, b))).otherwise(F.expr("cast(array() as array<int>)"))
        return F.when(p == "-1", F.array(total.cast("int"))).when(p.rlike(r"\A[0-9]+\s*-"), spread).otherwise(F.array(p.try_cast("int")))

    return F.when(good, F.flatten(F.transform(parts, one)))


def existing_pages(pages: Column, total: Column) -> Column:
    return F.filter(pages, lambda p: (p >= 1) & (p <= total))


def slide_list(spec: Column, total: Column) -> Column:
    """array<int>, 0-based."""
    return F.transform(page_list(spec, total), lambda p: p - 1)


def resized(spec: Column, width: Column, height: Column) -> Column:
    """struct(width, height) after ``50%``, ``800x600`` or ``800``; whole pixels, at least 1; null where the spec is bad."""
    percent = F.regexp_extract(spec, r"\A(.*)%\z", 1).try_cast("double") / 100.0
    both = r"\A\s*([+-]?[0-9]+)\s*x\s*([+-]?[0-9]+)\s*\z"
    w, h = F.regexp_extract(spec, both, 1).try_cast("int"), F.regexp_extract(spec, both, 2).try_cast("int")
    alone = strip(spec).try_cast("int")
    whole = lambda c: F.when(c < 0, F.ceil(c)).otherwise(F.floor(c)).cast("int")
    size = F.when(spec.endswith("%"), F.struct(whole(width * percent).alias("width"), whole(height * percent).alias("height"))).when(
        spec.contains("x"), F.struct(w.alias("width"), h.alias("height"))
    ).otherwise(F.struct(alone.alias("width"), F.when(width != 0, whole(alone * (height / width))).alias("height")))
    return F.when(size["width"].isNotNull() & size["height"].isNotNull(), F.struct(F.greatest(F.lit(1), size["width"]).alias("width"), F.greatest(F.lit(1), size["height"]).alias("height")))


def crop_box(spec: Column) -> Column:
    """struct(x1, y1, x2, y2) of ``x1,y1,x2,y2``; null unless x2 > x1 and y2 > y1."""
    n = F.transform(F.split(spec, ","), lambda p: strip(p).try_cast("int"))
    ok = (F.size(n) == 4) & F.forall(n, lambda v: v.isNotNull()) & (n[2] > n[0]) & (n[3] > n[1])
    return F.when(ok, F.struct(*[n[i].alias(k) for i, k in enumerate(("x1", "y1", "x2", "y2"))]))


def cropped(spec: Column, width: Column, height: Column) -> Column:
    box = crop_box(spec)
    return F.when(box.isNotNull(), F.struct((box["x2"] - box["x1"]).alias("width"), (box["y2"] - box["y1"]).alias("height")))


def rotated(degrees: Column, width: Column, height: Column) -> Column:
    """struct(width, height) of the canvas that holds a turned image."""
    a = F.radians(F.pmod(degrees.cast("double"), F.lit(360.0)))
    s, c = F.abs(F.round(F.sin(a), 15)), F.abs(F.round(F.cos(a), 15))
    return F.struct(F.ceil(F.round(width * c + height * s, 6)).cast("int").alias("width"), F.ceil(F.round(width * s + height * c, 6)).cast("int").alias("height"))


def tile_grid(spec: Column) -> Column:
    """struct(cols, rows) of ``3x2`` or ``2``; null where tiling is switched off or the spec is bad."""
    off = F.lower(strip(spec)).isin("false", "no", "off", "disable", "disabled")
    cols = F.when(spec.contains("x"), F.regexp_extract(spec, r"\A\s*([0-9]+)\s*x", 1).try_cast("int")).otherwise(strip(spec).try_cast("int"))
    rows = F.when(spec.contains("x"), F.regexp_extract(spec, r"x\s*([0-9]+)\s*\z", 1).try_cast("int")).otherwise(strip(spec).try_cast("int"))
    return F.when(~off & (cols > 0) & (rows > 0), F.struct(cols.alias("cols"), rows.alias("rows")))


def watermark(spec: Column, file_path: Column) -> Column:
    """struct(text, position, style) of ``text|position|style``; ``auto`` is the file's name, cut to 25 characters."""
    name = basename(file_path)
    auto = F.concat(F.lit("📄 "), F.when(F.length(name) > 25, F.concat(F.left(name, F.lit(22)), F.lit("..."))).otherwise(name))
    part = F.split(spec, r"\|")
    get = lambda i, default: F.coalesce(F.when(F.size(part) > i, strip(F.get(part, F.lit(i)))), F.lit(default))
    text = F.when(strip(get(0, "auto")).isin("auto", ""), auto).otherwise(get(0, ""))
    return F.struct(text.alias("text"), get(1, "bottom-right").alias("position"), get(2, "medium").alias("style"))


def suggestion(word: Column, valid: tuple[str, ...] | list[str], most: int = 2) -> Column:
    """The nearest valid word within ``most`` edits, the first of equals; null if none."""
    scored = F.array(*[F.struct(F.levenshtein(word, F.lit(v)).alias("d"), F.lit(i).alias("i"), F.lit(v).alias("v")) for i, v in enumerate(valid)])
    best = F.array_min(scored)
    return F.when(best["d"] <= most, best["v"])


def format_suggestion(word: Column) -> Column:
    return F.when(~word.isin(*FORMATS), suggestion(word, FORMATS))


def format_presenter(fmt: Column) -> Column:
    """text, html, markdown, xml or csv; a near miss and anything unknown is markdown."""
    fmt = F.when(format_suggestion(fmt).isNotNull(), F.lit("markdown")).otherwise(fmt)
    return (
        F.when(fmt.isin("plain", "text", "txt"), "text").when(fmt.isin("code", "html", "structured"), "html")
        .when(fmt == "xml", "xml").when(fmt == "csv", "csv").otherwise("markdown")
    )


def unused(commands_col: Column, used: list[str]) -> Column:
    """Sorted command names that nothing has read."""
    return F.array_sort(F.array_except(F.map_keys(commands_col), F.array(*[F.lit(u) for u in used]) if used else F.expr("cast(array() as array<string>)")))


def unused_report(commands_col: Column, used: list[str]) -> Column:
    """``'pagse' (did you mean 'pages'?), 'x'``; null if all were used."""
    names = unused(commands_col, used)
    said = F.transform(names, lambda n: F.concat(F.lit("'"), n, F.lit("'"), F.coalesce(F.concat(F.lit(" (did you mean '"), suggestion(n, list(COMMANDS)), F.lit("'?)")), F.lit(""))))
    return F.when(F.size(names) > 0, F.array_join(said, ", "))
