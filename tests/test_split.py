"""Each splitter against a plain restatement of its rule, on random strings."""

import random
import re

import pytest
from pyspark.sql import functions as F

from docloom.operators import split

STRINGS = ["", " ", "...", "a\n \t\nb\n\n\nc", "x" * 50, "one. two!  three?! four", " a　\n\u0085\nb", "e😀" * 9, "\n---\nq\n---\n", "a\\Eb\\E", "\x1c a.\x1fb", "a. b"]


def strings():
    rng = random.Random(11)
    for alphabet in ("ab \n\t.,!?;:", "aé😀 \n 　\u0085.!", "a \x1c\x1d\x1e\x1f\n."):
        yield from ("".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(120))
    yield from STRINGS


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, f"p{i}", s) for i, s in enumerate(strings())] + [(9999, "null", None)]
    return data, spark.createDataFrame(data, "id long, path string, text string").repartition(3).cache()


def chunks(df, *extra):
    out = {}
    for r in df.orderBy("id", "chunk_index").collect():
        out.setdefault(r.id, []).append((r.path, r.text, r.chunk_type, *[r[c] for c in extra]))
    return out


def whole(path, text):
    return [(path, text, None)]


def named(path, kind, label, parts):
    return [(f"{path}#{label}-{i + 1}", p, kind) for i, p in enumerate(parts)]


@pytest.mark.parametrize("name,pattern", [("paragraphs", r"\n\s*\n"), ("sentences", r"[.!?]+\s+")])
def test_patterns(rows, name, pattern):
    data, df = rows
    got = chunks(split.TEXT_SPLITTERS[name](df))
    for i, path, text in data:
        parts = [p.strip() for p in re.split(pattern, (text or "").strip()) if p.strip()]
        assert got[i] == (named(path, name[:-1], name[:-1], parts) if parts else whole(path, text)), repr(text)


@pytest.mark.parametrize("separator", ["\n---\n", " ", "\\E", "."])
def test_custom(rows, separator):
    data, df = rows
    got = chunks(split.custom(df, separator))
    for i, path, text in data:
        parts = [p.strip() for p in (text or "").split(separator) if p.strip()]
        assert got[i] == (named(path, "custom", "custom", parts) if parts else whole(path, text)), repr(text)


@pytest.mark.parametrize("n", [1, 7, 1000])
def test_characters(rows, n):
    data, df = rows
    got = chunks(split.characters(df, n), "char_start", "char_end")
    for i, path, text in data:
        want = [(f"{path}#chars-{s + 1}-{min(s + n, len(text))}", text[s : s + n], "characters", s, min(s + n, len(text))) for s in range(0, len(text or ""), n)]
        assert got[i] == (want or [(path, text, None, None, None)]), repr(text)


@pytest.mark.parametrize("n", [1, 3])
def test_lines(rows, n):
    data, df = rows
    got = chunks(split.lines(df, n), "line_start", "line_end")
    for i, path, text in data:
        all_lines = (text or "").split("\n")
        want = [(f"{path}#lines-{s + 1}-{min(s + n, len(all_lines))}", "\n".join(all_lines[s : s + n]), "lines", s + 1, min(s + n, len(all_lines))) for s in range(0, len(all_lines), n)] if text else None
        assert got[i] == (want or [(path, text, None, None, None)]), repr(text)


def slow_windows(text, limit):
    out, at = [], 0
    while at < len(text):
        end = min(at + 4 * limit, len(text))
        if end < len(text):
            cut = end
            while cut > at and text[cut] not in " \n\t.,!?;:":
                cut -= 1
            end = cut if cut > at else end
        if text[at:end].strip():
            out.append((text[at:end].strip(), at, end))
        at = end
    return out


@pytest.mark.parametrize("limit", [1, 2, 5])
def test_tokens(rows, limit):
    data, df = rows
    got = chunks(split.tokens(df, limit), "char_start", "char_end", "estimated_tokens")
    for i, path, text in data:
        want = [(f"{path}#tokens-{k + 1}", c, "tokens", a, b, len(c) // 4) for k, (c, a, b) in enumerate(slow_windows(text or "", limit))]
        assert got[i] == (want or [(path, text, None, None, None, None)]), repr(text)


def test_rows_and_columns(spark):
    df = spark.range(0, 1003).select((F.col("id") * 7 % 1003).alias("k"), F.lit("x").alias("a"), F.lit(1).alias("b"))
    got = split.row_chunks(df, ["k"], 100, "t").orderBy("chunk_index").collect()
    assert [(r.row_start, r.row_end) for r in got] == [(s, min(s + 100, 1003)) for s in range(0, 1003, 100)]
    assert got[-1].path == "t#rows-1001-1003" and got[-1].chunk_shape == "(3, 3)"
    tagged = split.rows(df, ["k"], 100)
    assert tagged.filter(F.col("row_index") != F.col("k")).count() == 0
    assert [c.columns for c in split.columns(df, 2)] == [["k", "a"], ["b"]]
    assert [r.chunk_columns for r in split.column_chunks(df, 2).orderBy("chunk_index").collect()] == ["k, a", "b"]
    assert split.row_chunks(df.limit(0), ["k"]).count() == 0


def test_pages_slides_sections(spark):
    pages = spark.createDataFrame([("d.pdf", 1, 2, "a"), ("d.pdf", 2, 2, "b")], "path string, page_number int, total_pages int, text string")
    assert {(r.path, r.chunk_index, tuple(r.selected_pages)) for r in split.pages(pages).collect()} == {("d.pdf#page-1", 0, (1,)), ("d.pdf#page-2", 1, (2,))}
    slides = pages.withColumnRenamed("page_number", "slide_number")
    assert {tuple(r.selected_slides) for r in split.slides(slides).collect()} == {(0,), (1,)}
    html = spark.createDataFrame([("p", "", "<h1>A</h1><p>x</p>y<h2>B <b>c</b></h2><div><h3>in</h3></div>"), ("q", "t", "<p>no heading</p>"), ("r", "", None)], "path string, text string, html string")
    got = [(r.path, r.section_heading, r.heading_level, r.text, r.total_sections) for r in split.sections(html).orderBy("path").collect()]
    assert got == [("p#section-1", "A", "h1", "A x y", 3), ("p#section-2", "B c", "h2", "B c in", 3), ("p#section-3", "in", "h3", "in", 3), ("q", None, None, "t", None), ("r", None, None, "", None)]
