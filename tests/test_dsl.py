import random
import re

import pytest
from pyspark.sql import functions as F

from docloom.functions import dsl
from docloom.functions import text as text_fn


def one(spark, column, *values):
    names = [f"c{i}" for i in range(len(values[0]))] if isinstance(values[0], tuple) else ["c0"]
    rows = [(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)]
    schema = "i int, " + ", ".join(f"{n} {'string' if isinstance(x, str) or x is None else 'int'}" for n, x in zip(names, rows[0][1:]))
    return [r.out for r in spark.createDataFrame(rows, schema).select("i", column.alias("out")).orderBy("i").collect()]


def plain_parse(s):
    rest, found = s, []
    while True:
        if m := re.search(r"\[([a-zA-Z0-9_-]+):([^\[\]]*)\]\Z", rest):
            found.append((m[1].strip(), m[2].strip()))
        elif m := re.search(r"\[([0-9,-]+)\]\Z", rest):
            found.append(("pages", m[1].strip()))
        else:
            break
        rest = rest[: m.start()].strip()
    commands = dict(reversed(found))
    if not rest.strip() and s.startswith('"[') and s.endswith(']"') and commands:
        return s, {}
    return rest.strip(), commands


def test_notation(spark):
    rng = random.Random(0)
    parts = ["a.pdf", "dir/b c.csv", "[pages:1-3]", "[1,3-5,-1]", "[limit: 5 ]", " ", "[x]", "[a:b[c]", "]", "[format:plain]", "[pages:9]", "[prompt:two words]", " ", "é"]
    samples = ["", "[pages:1]", '"[a:b]"', "f[a:1][a:2]", "u?x=[1]&y[select:p > a]"] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 6))) for _ in range(300)]
    df = dsl.parsed(spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, attachy string"))
    for r in df.collect():
        assert (r.path, r.commands) == plain_parse(samples[r.i]), repr(samples[r.i])


@pytest.mark.parametrize("spec,want", [("1,3-5,-1", [1, 3, 4, 5, 10]), ("5-3", []), ("-2", [-2]), ("2,2,1", [2, 2, 1]), (" 1 , 2-3 ", [1, 2, 3]), ("x", None), ("1-2-3", None), ("7", [7])])
def test_pages(spark, spec, want):
    assert one(spark, dsl.page_list(F.col("c0"), F.lit(10)), spec) == [want]
    if want is not None:
        assert one(spark, dsl.slide_list(F.col("c0"), F.lit(10)), spec) == [[p - 1 for p in want]]


def test_sizes(spark):
    specs = ["50%", "33%", "640x480", "300", "0", "-5", "x", "10x", "", "120.5%", "abc%", "800x600x2"]
    got = one(spark, dsl.resized(F.col("c0"), F.lit(1001), F.lit(333)), *specs)
    want = []
    for s in specs:
        try:
            if s.endswith("%"):
                w, h = (int(x * (float(s[:-1]) / 100.0)) for x in (1001, 333))
            elif "x" in s:
                a, b = s.split("x", 1)
                w, h = int(a), int(b)
            else:
                w = int(s)
                h = int(w * (333 / 1001))
            want.append((max(1, w), max(1, h)))
        except ValueError:
            want.append(None)
    assert [tuple(g) if g else None for g in got] == want
    assert [bool(g) for g in one(spark, dsl.crop_box(F.col("c0")), "1,2,3,4", "3,2,1,4", "1,2,3", "a,b,c,d")] == [True, False, False, False]
    assert [tuple(g) if g else None for g in one(spark, dsl.tile_grid(F.col("c0")), "3x2", "2", "off", "0x2", "q")] == [(3, 2), (2, 2), None, None, None]
    assert [tuple(g) for g in one(spark, dsl.rotated(F.col("c0"), F.lit(40), F.lit(20)), 0, 90, 180, 270, 45)][:4] == [(40, 20), (20, 40), (40, 20), (20, 40)]


def test_watermark(spark):
    got = one(spark, dsl.watermark(F.col("c0"), F.lit("dir/a_very_long_file_name_indeed.png")), "auto", "Draft", "Draft|center|large", "")
    assert [tuple(g) for g in got] == [("📄 a_very_long_file_name_...", "bottom-right", "medium"), ("Draft", "bottom-right", "medium"), ("Draft", "center", "large"), ("📄 a_very_long_file_name_...", "bottom-right", "medium")]


def test_suggestions(spark):
    assert one(spark, dsl.suggestion(F.col("c0"), ["pages", "images", "page"]), "pagse", "pag", "imags", "nothing") == ["page", "page", "images", None]
    assert one(spark, dsl.format_presenter(F.col("c0")), "md", "txt", "code", "plan", "zzzzzz", "csv", "xml") == ["markdown", "text", "html", "markdown", "markdown", "csv", "xml"]
    commands = dsl.commands(F.col("c0"))
    assert one(spark, dsl.unused_report(commands, ["limit"]), "f[pagse:1][limit:2][zzz:3]", "f[limit:1]") == ["'pagse' (did you mean 'pages'?), 'zzz'", None]


def test_strings(spark):
    def size(n):
        for unit in ("B", "KB", "MB", "GB"):
            if n < 1024:
                return f"{n:.1f}{unit}"
            n /= 1024
        return f"{n:.1f}TB"

    rng = random.Random(1)
    values = [0, 1, 1023, 1024, 10496, 1 << 20, (1 << 30) - 1] + [rng.randint(0, 1 << 31 - 1) for _ in range(300)]
    assert one(spark, text_fn.file_size(F.col("c0")), *values) == [size(v) for v in values]
    paths = ["a/b.PY", "x.tar.gz", ".gitignore", "Makefile", "a.b/c", "..x", "d/.e.md"]
    import os

    assert one(spark, text_fn.extension(F.col("c0")), *paths) == [os.path.splitext(p)[1].lower() for p in paths]
    texts = ["  a 　", "\x1c\x1da\x1f", "a\n", "", " \x85"]
    assert one(spark, text_fn.strip(F.col("c0")), *texts) == [t.strip() for t in texts]
