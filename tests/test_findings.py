"""What a review found, each with the number of its finding: odd rows against the SQL, and work that grows with the rows."""

import gc
import time

import duckdb
import pytest

from docloom.functions import text
from docloom.operators import html, split
from docloom.plans import queries
from docloom.sources import decode


def differences(spark, tables, name, table, schema, rows):
    """(rows too many, rows missing) of a query against its SQL, over one table."""
    at = tables(**{table: (schema, rows)})
    df = queries.QUERIES[name](spark, at)
    df.write.parquet(f"{at}/out")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{at}/{table}.parquet/*.parquet')")
    want, got = f"SELECT {', '.join(df.columns)} FROM ({queries.ORACLES[name]})", f"SELECT * FROM read_parquet('{at}/out/*.parquet')"
    return tuple(con.execute(f"{a} EXCEPT ALL ({b})").fetchall() for a, b in ((got, want), (want, got)))


def test_f1_rows_are_gathered():
    """load_image: a batch for each image made the time of the query."""
    import pyarrow as pa

    schema = pa.schema([("path", pa.string()), ("text", pa.string()), ("error", pa.string())])
    small = list(decode.gathered(({"path": str(i), "text": "x"} for i in range(10_000)), schema))
    assert [b.num_rows for b in small] == [4096, 4096, 1808] and [r["path"] for b in small for r in b.to_pylist()] == [str(i) for i in range(10_000)]
    large = list(decode.gathered(({"path": "p", "text": "x" * (5 << 20)} for _ in range(4)), schema))
    assert [b.num_rows for b in large] == [2, 2] and large[0].column("error").null_count == 2
    assert list(decode.gathered(iter([]), schema)) == []


def seconds(spark, name, at, out):
    began = time.time()
    queries.QUERIES[name](spark, at).write.parquet(out)
    return time.time() - began


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """20,000 images and 10,000 documents."""
    at = str(tmp_path_factory.mktemp("many"))
    spark.range(20_000).selectExpr("id AS p_partkey", "cast(1 + id % 50 AS int) AS p_size").coalesce(1).write.parquet(f"{at}/part.parquet")
    spark.range(10_000).selectExpr("id AS doc_id", "concat('text ', id) AS text").coalesce(1).write.parquet(f"{at}/documents.parquet")
    return at


#: Query -> seconds that are far above what it takes now and far below what it took with a batch for each file.
@pytest.mark.parametrize("name,most", [
    pytest.param("present_image_markdown", 20, id="F2"),
    pytest.param("processor_image", 35, id="F3"),
    pytest.param("processor_svg", 20, id="F22"),
    pytest.param("load_svg", 12, id="F24"),
])
def test_many_files(spark, many, tmp_path, name, most):
    queries.QUERIES[name](spark, many).schema
    assert seconds(spark, name, many, str(tmp_path / "out")) < most


#: An empty text, none, and plain ones.
ODD = [(1, ""), (2, None), (3, "One. Two the three"), (4, ""), (6, "a\nb\nc\n\nd" * 90)]


@pytest.mark.parametrize("name", [
    pytest.param("adapt_agno", id="F4"),
    pytest.param("adapt_claude", id="F5"),
    pytest.param("adapt_openai_chat", id="F6"),
    pytest.param("adapt_openai_responses", id="F7"),
    pytest.param("message_agno", id="F9"),
    pytest.param("message_dspy", id="F9-message_dspy"),
    pytest.param("message_claude", id="F10"),
    pytest.param("message_openai", id="F11"),
    pytest.param("message_openai_responses", id="F12"),
    pytest.param("split_characters", id="F13"),
    pytest.param("split_tokens", id="F13-split_tokens"),
    pytest.param("split_lines", id="F14"),
    pytest.param("verb_pipeline", id="F16"),
    pytest.param("refine_add_headers", id="F17"),
    pytest.param("repo_headers", id="F17-repo_headers"),
])
def test_rows_without_text(spark, tables, name):
    rows = [(i, x, "en", "src", len(x or "")) for i, x in ODD]
    assert differences(spark, tables, name, "documents", "doc_id long, text string, lang string, source string, n_chars long", rows) == ([], [])


def test_f8_open_references(spark, tables):
    """html_select_text: a reference without its semicolon is text, as in the SQL; those of scripts and attributes stay."""
    rows = [(1, "u", "<h1>a &amp;&amp</h1>"), (2, "u", "<h1 title='&amp;x&lt;'>&quo &quot;q&quot; R&D a&ampb; &lt</h1>"), (3, "u", "<h1>\ue000 &middot; &am</h1>")]
    assert differences(spark, tables, "html_select_text", "pages", "page_id long, url string, html string", rows) == ([], [])
    page = '<a href="/?a=1&b=2&copy=3&amp;d">x &amp</a><script>a&&b&amp</script>'
    assert [c.html() for c in html.parse(page, closed=True).children] == ['<a href="/?a=1&amp;b=2&amp;copy=3&amp;d">x &amp;amp</a>', "<script>a&&b&amp</script>"]


def test_f15_upper_case(spark, tables):
    """user_functions: upper case letter for letter; groups without a source or a text are groups too."""
    rows = [(i, x, "de", s, 1) for i, (x, s) in enumerate([("ßa", "s"), ("ŉx", "t"), ("straße", "u"), ("ﬁx", "v"), ("ᾳb", "w"), (None, "x"), ("a", None), (None, None), ("", "y")])]
    assert differences(spark, tables, "user_functions", "documents", "doc_id long, text string, lang string, source string, n_chars long", rows) == ([], [])
    known = duckdb.sql("SELECT chr(i::INT), upper(chr(i::INT)) FROM range(1, 1114112) t(i) WHERE i < 55296 OR i > 57343").fetchall()
    assert [c for c, u in known if text.upper(c) != u] == []


#: Query -> how often its plan decodes: once, and once for each named plan.
@pytest.mark.parametrize("name,times", [
    pytest.param("present_pdf_markdown", 1, id="F18"),
    pytest.param("present_pdf_text", 1, id="F19"),
    pytest.param("processor_named", 4, id="F21"),
    pytest.param("processor_pdf", 1, id="F25"),
])
def test_decoded_once(spark, many, name, times):
    plan = queries.QUERIES[name](spark, many)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") + plan.count("MapInPandas") == times


def test_f20_results_in_slices():
    """split_tokens: the windows of a batch leave the worker a few texts at a time."""
    found = [split.token_windows("word " * 60_000, 100) for _ in range(9)] + [[], [("a", 0, 1)]]
    arrays = list(text.in_slices(iter(found), split._window_array, lambda f: sum(len(c) for c, _, _ in f)))
    assert [len(a) for a in arrays] == [4, 4, 3]
    assert [[tuple(w.values()) for w in row] for a in arrays for row in a.to_pylist()] == found


def test_f23_trees_go_at_once():
    """html_pretty, html_markdown: a page's tree holds no circles that only the collector finds."""
    page = "<html><body><div><p>a<p>b</div></body></html>"
    html.pretty(page), html.to_markdown(page), gc.collect()
    gc.disable()
    try:
        html.pretty(page), html.to_markdown(page)
        assert gc.collect() == 0
    finally:
        gc.enable()
