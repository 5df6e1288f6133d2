import json
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from docloom.functions import matchers
from docloom.operators import adapt, fold, html, modify, present, refine

DOC = "ord int, path string, text string, images array<string>"


def frame(spark, rows, schema=DOC):
    return spark.createDataFrame(rows, schema)


def test_truncate_headers_tables(spark):
    df = frame(spark, [(0, "d/a.txt", "x" * 12, []), (1, "d/a.txt", "see # a.txt", []), (2, "b", "", []), (3, "c\td", "p\tq", []), (4, "e", None, [])])
    assert [r.text for r in refine.truncate(df, 10).orderBy("ord").collect()][:2] == ["x" * 10 + "...", "see # a.tx..."]
    assert [r.text for r in refine.add_headers(df).orderBy("ord").collect()] == ["# d/a.txt\n\n" + "x" * 12, "see # a.txt", "", "# c\td\n\np\tq", None]
    assert [r.text for r in refine.format_tables(df).orderBy("ord").collect()][3] == "p | q"


def test_repo_headers(spark):
    df = spark.createDataFrame([("p", "hi", "src/x.PY", 2048), ("p", "hi", "LICENSE", None), ("p", "hi", None, 1), ("p", "", "a.c", 1)], "path string, text string, relative_path string, length long")
    got = [r.text for r in refine.add_repo_headers(df).collect()]
    assert got[0] == "## File: `src/x.PY`\n\n**Language**: Python  \n**Size**: 2.0KB  \n**Path**: `src/x.PY`\n\n```python\nhi\n```\n\n"
    assert "**Size**: unknown" in got[1] and "Language" not in got[1] and got[2] == "# p\n\nhi" and got[3] == ""


def test_folds(spark):
    df = frame(spark, [(2, "c", "third", ["i3"]), (0, "a", "first", ["i1", "x_placeholder"]), (1, "b", "", []), (3, "z/d", "## Data from d\nq", [])]).withColumn("g", F.lit(1))
    one = fold.collection(df, ["g"], ["ord"]).first()
    assert one.text == "first\n\nthird\n\n## Data from d\nq" and one.images == ["i1", "x_placeholder", "i3"] and one.combined_from == ["a", "b", "c", "z/d"] and one.collection_size == 4
    text = fold.rendered(df, ["g"], ["ord"]).first().text
    assert text == "📄 Processing Summary: 4 files processed, 3 images extracted\n\n## a\n\nfirst\n\n---\n\n## c\n\nthird\n\n---\n\n## Data from d\nq"
    assert fold.rendered(df.filter("ord = 0"), ["g"], ["ord"]).first().text == "first"


def test_adapters(spark):
    images = ["data:image/png;base64,AAAABBBB", "data:image/bad-no-comma", "QUFBQUFBQUFBQQ==", "x_page_placeholder", "tiny", "data:image/x_placeholder"]
    df = frame(spark, [(0, "a", 'say "hi"\n', images), (1, "b", "", [])]).withColumn("commands", F.create_map(F.lit("prompt"), F.lit("from the path")))
    message = lambda d: [json.loads(r.message) for r in d.orderBy("ord").collect()]
    chat, empty = message(adapt.openai_chat(df, "p"))
    assert chat[0]["role"] == "user" and [c.get("text") for c in chat[0]["content"][:2]] == ["p", 'say "hi"\n']
    assert [c["image_url"]["url"] for c in chat[0]["content"][2:]] == [images[0], images[1], "data:image/png;base64," + images[2], images[5]]
    assert empty == [{"role": "user", "content": [{"type": "text", "text": "p"}]}]
    responses = message(adapt.openai_responses(df))
    assert [c["type"] for c in responses[0][0]["content"]] == ["input_text"] + ["input_image"] * 4 and responses[0][0]["content"][1]["image_url"] == images[0] and responses[1][0]["content"] == []
    claude = message(adapt.claude(df))
    assert claude[0][0]["content"][0]["text"] == 'from the path\n\nsay "hi"\n' and [c["source"]["data"] for c in claude[0][0]["content"][1:]] == ["AAAABBBB", images[2]]
    assert message(adapt.claude(df, "mine"))[1][0]["content"] == [{"type": "text", "text": "mine"}]
    agno = message(adapt.agno(df))
    assert agno[0]["message"] == 'from the path say "hi"\n' and [i["url"] for i in agno[0]["images"]] == [images[0], images[1], images[2], images[4]] and agno[1]["message"] == "from the path"
    assert message(adapt.dspy(df))[0]["images"] == [images[0], images[1], images[2], images[5]]


TABLE = [("Alice", 25, "a|b"), ("B, ob", -3, None), ('q"x', 1000, "<&>")]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(TABLE)], "k int, name string, n int, s string")


def test_table_renderings(spark, table):
    pdf = pd.DataFrame([(i, *r) for i, r in enumerate(TABLE)], columns=["k", "name", "n", "s"])
    text = present.table_text(table, ["k"], "t").first().text
    assert text == "Data from t\n===========\n\n" + pdf.to_string(index=False) + "\n\nShape: (3, 4)\n\n"
    assert present.table_csv(table, ["k"]).first().text == pdf.to_csv(index=False)
    assert present.table_markdown(table.select("k", "name"), ["k"], "t").first().text == "## Data from t\n\n|   k | name   |\n|----:|:-------|\n|   0 | Alice  |\n|   1 | B, ob  |\n|   2 | q\"x    |\n\n*Shape: (3, 2)*\n\n"
    assert present.table_xml(table.select("k", "s"), ["k"]).first().text == "<?xml version='1.0' encoding='utf-8'?>\n<data>\n  <row>\n    <k>0</k>\n    <s>a|b</s>\n  </row>\n  <row>\n    <k>1</k>\n    <s/>\n  </row>\n  <row>\n    <k>2</k>\n    <s>&lt;&amp;&gt;</s>\n  </row>\n</data>"
    assert "- **Rows**: 3\n- **Columns**: 4\n" in present.table_summary(table).first().text and "['k', 'n']" in present.table_summary(table).first().text
    assert present.table_head(table, ["k"], 1).first().text.count("\n") == 7
    assert present.table_csv(table.limit(0), ["k"]).first().text == "k,name,n,s\n"


def test_metadata(spark):
    df = spark.sql("""SELECT 'x' AS text, map('size', '(3, 4)', 'secret', 'no', 'ocr_error', 'bad', 'pptx_total_slides', '9') AS metadata UNION ALL SELECT 'y', map()""")
    assert [r.text for r in df.transform(present.metadata).collect()] == ["x\n## File Info\n\n- **Size**: 3 × 4 pixels\n- **Ocr Error**: bad\n- **Total Slides**: 9\n\n", "y"]


def test_pdf_rendering(spark):
    good = "word " * 30
    df = spark.createDataFrame([("a", 1, good), ("a", 2, good), ("b", 1, " "), ("b", 2, "few"), ("c", 1, None)], "path string, page_number int, text string")
    texts = {r.path: r for r in present.pdf(df).collect()}
    assert texts["a"].text == f"# PDF Document: a\n\n## Page 1\n\n{good}\n\n## Page 2\n\n{good}\n\n*Total pages processed: 2*\n\n"
    assert texts["b"].text_extraction_quality == "poor" and "likely scanned image" in texts["b"].text and "**Pages with text**: 1" in texts["b"].text and texts["c"].is_likely_scanned
    assert present.pdf(df.filter("path = 'a'"), "text").first().text.startswith("PDF Document: a\n===============\n\n[Page 1]\n")


def test_modifiers(spark, table):
    assert [r.k for r in modify.limit(table, "2", ["k"]).collect()] == [0, 1] and modify.limit(table, "x", ["k"]).count() == 3 and [r.k for r in modify.limit(table, -1, ["k"]).orderBy("k").collect()] == [0, 1]
    assert modify.select_columns(table, "n, k").columns == ["n", "k"] and modify.select_columns(table, "n,zz").columns == table.columns
    pages = spark.createDataFrame([("d", i, 5, str(i)) for i in range(1, 6)], "path string, page_number int, total_pages int, text string")
    assert [r.page_number for r in modify.pages(pages, "4,1-2,4,9,-1").orderBy("page_order").collect()] == [4, 1, 2, 4, 5]
    sizes = spark.createDataFrame([(100, 50)], "width int, height int")
    assert modify.crop(sizes, F.lit("0,0,10,5")).first().asDict() == {"width": 10, "height": 5, "crop_error": None}
    assert modify.crop(sizes, F.lit("9,9,1,1")).first().crop_error == "invalid crop: 9,9,1,1"
    assert modify.rotate(sizes, F.lit(90)).first().asDict() == {"width": 50, "height": 100}
    bad = modify.resize(sizes, F.lit("huge")).first()
    assert bad.width == 100 and bad.resize_error == "invalid resize: huge"


def test_tiles(spark):
    df = spark.createDataFrame([("a", i, 200 + i, 50) for i in range(5)] + [("b", 0, 9, 9)], "doc string, ord int, width int, height int")
    got = [(r.sheet, r.images, r.cols, r.rows, r.tile_width, r.tile_height) for r in refine.tile_layout(df, "doc", "width", "height").orderBy("sheet").collect()]
    assert got == [(0, 4, 2, 2, 400, 200), (1, 1, 1, 1, 204, 100)]
    assert refine.tile_layout(df, "doc", "width", "height", "off").count() == 0
    assert refine.resize_images(df, "50%").filter("doc = 'b'").first().new_width == 4


PAGE = '<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style></head><body id="b"><!-- c --><nav><ul><li><a href="/x">X</a></li><li class="on two"><a href="/y">Y</a></li></ul></nav><h1>Head</h1><p class=lead>One<p>Two &lt;b&gt;<br/>three<script>var a="</p>";</script><blockquote>Q</blockquote></body></html>'


@pytest.mark.parametrize("css,n", [("li", 2), (".two", 1), ("#b > nav a[href]", 2), ("a[href='/y']", 1), ("nav, h1", 2), ("li + li a", 1), ("h1 ~ p", 1), ("li:first-child", 1), ("p", 2), ("table", 0), ("*[class^=le]", 1), ("a[href$=x], li.on.two", 2)])
def test_select(spark, css, n):
    df = spark.createDataFrame([(PAGE,), (None,)], "html string")
    got = modify.select_html(df, css).collect()
    assert [r.selected_count for r in got] == [n, 0]
    assert got[0].html.startswith("<div>") if n > 1 else (got[0].html == "") == (n == 0)


def test_html(spark):
    df = spark.createDataFrame([(PAGE,)], "html string")
    assert df.select(html.html_text(F.col("html"))).first()[0] == "T & t X Y Head One Two <b> three Q"
    assert html.to_markdown(PAGE).startswith("# T & t\n\n- X\n- Y\n# Head\n\n") and "> Q\n\n" in html.to_markdown(PAGE) and "- [Y](/y)\n" in html.to_markdown(PAGE)
    assert html.parse(html.parse(PAGE).html()).html() == html.parse(PAGE).html()
    assert html.pretty("<p>a<b>c</b></p>") == "<p>\n a\n <b>\n  c\n </b>\n</p>\n"
    assert df.select(html.tag_texts(F.col("html"), "li")).first()[0] == ["X", "Y"] and df.select(html.links(F.col("html"))).first()[0] == ["/x", "/y"]
    deep = "<div>" * 5000 + "x" + "</div>" * 5000
    assert html.parse(deep).text() == "x" and len(html.parse(deep).html()) == len(deep)


FILES = [
    ("a.pdf", None, b"", "pdf"), ("b", None, b"%PDF-1.4", "pdf"), ("c.PNG", None, b"", "image"), ("d", None, b"\xff\xd8\xff\x00", "image"), ("e", None, b"RIFF1234WEBP", "image"),
    ("f.docx", None, b"", "docx"), ("g", None, b"PK\x03\x04word/document.xml", "docx"), ("h", None, b"PK\x03\x04ppt/", "pptx"), ("i", None, b"PK\x03\x04xl/", "excel"), ("j", None, b"PK\x03\x04other", "zip"),
    ("https://x.y/z", None, None, "webpage"), ("https://x.y/z.csv", None, None, "csv"), ("k", "text/csv", b"x", "csv"), ("l", None, b"a,b\n1,2", "csv"), ("m", None, b"<svg xmlns='q'>", "svg"), ("n", None, b"%!PS-Adobe-3.0", "eps"),
    ("o.txt", None, b"", "text"), ("p", None, "é".encode(), "text"), ("q", None, b"\xff\x41", None), ("r.CSV", None, b"\x00\xff", None),
]


def test_matchers(spark):
    df = spark.createDataFrame([(i, p, c, b) for i, (p, c, b, _) in enumerate(FILES)], "i int, path string, ct string, content binary")
    got = [r.kind for r in df.select("i", matchers.kind(matchers.File(F.col("path"), F.col("ct"), F.col("content"))).alias("kind")).orderBy("i").collect()]
    assert got == [k for *_, k in FILES]
    assert [r[0] for r in df.filter("path in ('o.txt', 'q')").select(matchers.binary(F.coalesce("content", F.lit(b"")))).collect()] == [False, True]


def test_user_functions(spark):
    from docloom.functions import register

    shout = register.scalar("string")(lambda v: v.upper())
    longest = register.reducer("int")(lambda v: int(v.str.len().max()))
    spread = register.table("piece: string")(lambda v: ((c,) for c in v))
    df = spark.createDataFrame([("ab",), (None,)], "t string")
    assert [r[0] for r in df.select(shout("t")).collect()] == ["AB", None] and df.dropna().agg(longest("t")).first()[0] == 2
    assert [r.piece for r in spread(F.lit("xyz")).collect()] == ["x", "y", "z"]
    assert os.path.basename(__file__) == "test_operators.py"
