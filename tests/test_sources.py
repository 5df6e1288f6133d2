import io
import os
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from docloom.operators import present
from docloom.plans import api, route, verbs
from docloom.sources import decode, directories, files
from docloom.streaming import apply


def zipped(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
SLIDE = "<p:sld {0}><p:sp><p:txBody><a:p><a:r><a:t>{1}</a:t></a:r></a:p></p:txBody></p:sp></p:sld>"
W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
PPTX = zipped({f"ppt/slides/slide{n}.xml": SLIDE.format(A, f"S{n}") for n in (10, 2, 1)})
DOCX = zipped({
    "word/document.xml": f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="H1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>Body</w:t><w:tab/><w:t>x</w:t></w:r></w:p><w:p/></w:body></w:document>',
    "word/styles.xml": f'<w:styles {W}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>',
})
XLSX = zipped({
    "xl/workbook.xml": f'<workbook {S}><sheets><sheet name="One" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<R><Relationship Id="r1" Target="worksheets/sheet1.xml"/></R>',
    "xl/sharedStrings.xml": f"<sst {S}><si><t>na|me</t></si></sst>",
    "xl/worksheets/sheet1.xml": f'<worksheet {S}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><v>3</v></c></row><row r="3"><c r="B3" t="inlineStr"><is><t>in</t></is></c></row></sheetData></worksheet>',
})
PNG = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sIIBBBBB", 13, b"IHDR", 7, 5, 8, 6, 0, 0, 0)
SHOW = b"BT (Hello \\(PDF\\)!) Tj 0 -12 Td [(two) -20 ( parts)] TJ ET"
PDF = b"%PDF-1.4\n1 0 obj\n<</Type /Pages /Kids [2 0 R]>>\nendobj\n2 0 obj\n<</Type /Page /Contents 3 0 R>>\nendobj\n3 0 obj\n<</Filter /FlateDecode>>\nstream\n" + zlib.compress(SHOW) + b"\nendstream\nendobj\n"


def contents(spark, *items):
    return spark.createDataFrame(list(items), "path string, content binary")


def test_office(spark):
    slides = decode.pptx(contents(spark, ("p", PPTX), ("bad", b"nope")))
    assert [(r.slide_number, r.text) for r in slides.filter("error IS NULL").orderBy("slide_number").collect()] == [(1, "S1"), (2, "S2"), (3, "S10")]
    assert slides.filter("error IS NOT NULL").first().path == "bad"
    assert present.slides(slides.filter("error IS NULL")).first().text == "# Presentation: p\n\n## Slide 1\n\nS1\n\n## Slide 2\n\nS2\n\n## Slide 3\n\nS10\n\n*Slides processed: 3*\n\n"
    doc = decode.docx(contents(spark, ("d", DOCX)))
    assert present.document(doc).first().text == "# Document: d\n\n## Title\n\nBody\tx\n\n*Document processed: 3 paragraphs*\n\n"
    assert present.document(doc, "text").first().text.startswith("Document: d\n===========\n\nTitle\n\n")
    sheet = decode.xlsx(contents(spark, ("w", XLSX)))
    assert present.workbook(sheet).first().text == "# Workbook: w\n\n## Sheet 1: One\n\n**Dimensions**: 3 rows × 3 columns\n\n**Data**:\n\n| na\\|me |  | 3 |\n|---|---|---|\n|  |  |  |\n|  | in |  |\n\n*Workbook processed: 1 sheets*\n\n"
    assert "Row 3:  | in | \n" in present.workbook(sheet, "text").first().text


def test_pdf_images_vectors(spark):
    assert decode.pdf(contents(spark, ("f", PDF))).first().text == "Hello (PDF)!\ntwo parts"
    heads = {r.path: r for r in decode.images(contents(spark, ("png", PNG), ("gif", b"GIF89a" + struct.pack("<HH", 3, 4) + b"\0" * 9), ("bmp", b"BM" + b"\0" * 16 + struct.pack("<ii", 6, -2)), ("jpg", b"\xff\xd8\xff\xe0\0\x04ab\xff\xc0\0\x11\x08\0\x09\0\x08\x03" + b"\0" * 9), ("no", b"text"))).collect()}
    assert {k: (r.format, r.width, r.height, r.mode) for k, r in heads.items()} == {"png": ("PNG", 7, 5, "RGBA"), "gif": ("GIF", 3, 4, "P"), "bmp": ("BMP", 6, 2, "RGB"), "jpg": ("JPEG", 8, 9, "RGB"), "no": (None, None, None, None)}
    assert heads["no"].error and present.image_markdown(spark.createDataFrame([("i", "PNG", 1, 2, "L")], "path string, format string, width int, height int, mode string")).first().text.startswith("# Image: i\n\n- **Format**: PNG\n- **Size**: (1, 2)\n")
    archive = decode.zip_images(contents(spark, ("z.zip", zipped({"a.PNG": PNG, "b.txt": b"x", "d/c.jpg": b"j"}))))
    assert [(r.member, r.metadata["from_zip"]) for r in archive.orderBy("member").collect()] == [("a.PNG", "z.zip"), ("d/c.jpg", "z.zip")]
    svg = decode.svg(contents(spark, ("s", b'<svg xmlns="http://www.w3.org/2000/svg" width="9"><text>t</text></svg>'), ("x", b"<svg"))).collect()
    assert (svg[0].svg_width, svg[0].svg_height, svg[0].element_count, svg[0].has_text_elements, svg[0].has_images) == ("9", "auto", 2, True, False) and svg[1].error
    eps = decode.eps(contents(spark, ("e", b"%!PS-Adobe-3.0\r\n%%BoundingBox: 0 0 1 2\r\n%%Title: a: b\n" + b"\n" * 30 + b"%%Creator: late"))).first()
    assert (eps.bounding_box, eps.title, eps.creator) == ("0 0 1 2", "a: b", None)


@pytest.fixture
def tree(tmp_path):
    for name, data in {"a.py": b"print(1)", "b.log": b"x", "docs/c.md": b"# c", "docs/deep/d.txt": b"d", "node_modules/e.js": b"e", "bin.dat": b"\x00\x01", ".hidden": b"h", "n.csv": b"name,age\nA,1\n\"B, b\",2\n"}.items():
        at = tmp_path / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(data)
    return str(tmp_path)


def test_directories(spark, tree):
    names = lambda **kw: [r.rel for r in directories.listing(spark, tree, **kw).collect()]
    assert names() == ["a.py", "docs/c.md", "docs/deep/d.txt", "n.csv"]
    assert names(ignore="", include_binary=True) == [".hidden", "a.py", "b.log", "bin.dat", "docs/c.md", "docs/deep/d.txt", "n.csv", "node_modules/e.js"] or names(ignore="", include_binary=True) == ["a.py", "b.log", "bin.dat", "docs/c.md", "docs/deep/d.txt", "n.csv", "node_modules/e.js"]
    assert names(ignore="docs/, *.csv") == ["a.py", "b.log", "node_modules/e.js"] and names(glob="*.md,d*.txt") == ["docs/c.md", "docs/deep/d.txt"]
    assert names(recursive=False) == ["a.py", "n.csv"] and names(max_files=2) == ["a.py", "docs/c.md"]
    listed = directories.listing(spark, tree)
    assert "├── docs/\n│   ├── deep/\n│   │   └── d.txt\n│   └── c.md\n├── a.py\n└── n.csv" in directories.structure(listed, tree)
    assert "**Files Found**: 4" in directories.directory_map(listed, tree).first().text
    small = directories.size_guard(listed, 10).first()
    assert small.too_large and "(4 files)" in small.text and not directories.size_guard(listed).first().too_large
    with open(os.path.join(tree, ".gitignore"), "w") as f:
        f.write("# c\n*.md\n\n")
    assert directories.ignore_patterns(tree, "auto") == ["*.md"] and directories.ignore_patterns(tree, "none,x") == ["none", "x"] and directories.git_metadata(tree) == {}


def test_scans(spark, tree):
    assert files.text_files(spark, f"{tree}/a.py").first().text == "print(1)" and files.html_files(spark, f"{tree}/a.py").first().metadata["file_size"] == "8"
    table = files.csv_table(spark, f"{tree}/n.csv", ordinal="ord")
    assert [(r.name, r.age) for r in table.orderBy("ord").collect()] == [("A", 1), ("B, b", 2)]


def test_facade(spark, tree, tmp_path):
    (tmp_path / "x.pdf").write_bytes(PDF)
    (tmp_path / "p.png").write_bytes(PNG)
    a = api.Context(spark, f"{tree}/docs/c.md", [f"{tree}/n.csv[limit:1]", f"{tree}/x.pdf[pages:1][format:plain]"], f"{tree}/p.png", "missing.txt")
    text = str(a)
    assert len(a) == 5 and text.startswith("📄 Processing Summary: 5 files processed, 1 images extracted\n\n") and "missing.txt" in text
    assert "| A | 1 |" in text and "B, b" not in text and "[Page 1]\nHello (PDF)!" in text and a.images[0].startswith("data:image/png;base64,")
    assert [r.path for r in a][0].endswith("c.md") and a[0].text == a.df.orderBy("ord").first().text and "openai" not in a.metadata
    meta = a.metadata
    assert (meta["file_count"], meta["image_count"]) == (5, 1) and [f["path"] for f in meta["files"]][3] == f"{tree}/p.png" and meta["files"][0]["text_length"] == len(a[0].text)
    assert a[-1].path == "missing.txt"
    with pytest.raises(IndexError):
        a[5]
    assert a.openai_chat("hi").startswith('[{"role":"user"') and a.claude("x") != a.openai_responses("x")
    twice = api.Context(spark, f"{tree}/x.pdf[1]", f"{tree}/x.pdf[format:plain]", f"{tree}/x.pdf[pages:2]")
    assert [r.text[:14] for r in twice] == ["# PDF Document", "PDF Document: ", f"# {tree}"[:14]] and "could not be read" in twice[2].text.lower()
    parts = api.Context(spark, f"{tree}/a.py[split:characters][characters:3]", f"{tree}/docs/c.md[split:nonsense]")
    assert [r.chunk_index for r in parts][0] == 0 and len(parts) > 3
    with pytest.raises(AttributeError):
        a.unknown_adapter
    assert str(api.Context(spark)) == ""


def test_auto_attach(spark, tree):
    a = api.auto_attach(spark, "look at n.csv and `docs/c.md`, not none.txt ", [tree, "/nowhere"])
    assert str(a).startswith("look at n.csv and `docs/c.md`, not none.txt\n\n📄 Processing Summary: 2 files") and len(a) == 2
    only = api.auto_attach(spark, "nothing here", tree)
    assert str(only) == "nothing here" and only.images == [] and only.metadata["prompt_only"]
    df = spark.createDataFrame([('see a.txt, "b c.pdf[pages:1]" https://x.y/z[select:h1]',)], "text string")
    got = api.references_in(df).first().references
    assert {"a.txt", "b c.pdf[pages:1]", "https://x.y/z[select:h1]"} <= set(got) and set(api.referenced(df.first().text)) == set(got)


def test_verbs(spark, tree):
    flow = verbs.attach(spark, f"{tree}/a.py", "gone") | verbs.load.content | verbs.load.text_to_string | verbs.refine.truncate(5) + verbs.refine.add_headers | verbs.adapt.claude("q")
    assert [r.error for r in flow.df.orderBy("ord").collect()] == [None, "file not found"] and "print..." in flow.df.orderBy("ord").first().message

    @verbs.refiner
    def shout(df):
        return df.withColumn("text", F.upper("text"))

    assert (verbs.Flow(spark.createDataFrame([("a",)], "text string")) | verbs.refine.shout).df.first().text == "A" and "shout" in dir(verbs.refine)
    with pytest.raises(AttributeError):
        verbs.refine.nothing
    bad = verbs.Verb("bad", lambda df: df.withColumn("error", F.when(F.col("ord") == 1, "x")))
    good = verbs.Verb("good", lambda df: df.withColumns({"error": F.lit(None).cast("string"), "text": F.lit("second")}))
    df = spark.createDataFrame([(0, "first"), (1, "first")], "ord int, text string")
    assert [r.text for r in verbs.fallback(bad, good)(df).orderBy("ord").collect()] == ["first", "second"]
    assert route.available_processors(spark).filter("role = 'primary'").count() == 9 and api.dsl_info(spark).filter("command = 'tokens'").first().default == "500"


def test_pages_plan(spark):
    rows = [(0, "https://a/x", "https://a/x", {"format": "plain"}, "<h1>T</h1><p>b"), (1, "https://a/y", "https://a/y", {}, "<h1>T</h1>")]
    df = spark.createDataFrame(rows, "ord long, attachy string, path string, commands map<string,string>, html string")
    assert [r.text for r in route.processed(df).orderBy("ord").collect()] == ["# https://a/x\n\nT b", "# https://a/y\n\n# T\n\n"]


def test_stream_equals_batch(spark, tmp_path):
    from docloom.operators import split

    source = tmp_path / "in"
    source.mkdir()
    (source / "a.txt").write_text("One. Two! Three")
    (source / "b.txt").write_text("Only one")
    plan = lambda df: split.sentences(df).select("chunk_index", "text")
    apply.run(apply.watched(spark, str(source)), plan, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert sorted(r.text for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["One", "Only one", "Three", "Two"]


def test_directories_and_patterns_in_the_facade(spark, tree):
    told = api.Context(spark, tree)
    assert len(told) == 1 and "## Directory Structure" in str(told)
    every = api.Context(spark, f"{tree}[files:true][glob:*.md,*.py]")
    assert [os.path.basename(r.path) for r in every] == [os.path.basename(tree), "a.py", "c.md"]
    assert [os.path.basename(r.path) for r in api.Context(spark, f"{tree}/docs/*")] == ["c.md"]
    assert [os.path.basename(r.path) for r in api.Context(spark, f"{tree}/**/*.txt")] == ["d.txt"]
    assert directories.glob_base("/a/b/*.x") == "/a/b" and not directories.is_repository(tree)


def test_responses_and_errors(spark):
    from docloom.sources import urls

    df = spark.createDataFrame([(1, "https://a/x"), (2, "ftp://b")], "i int, path string")
    got = urls.pages(df, get=lambda u, t: {"status_code": 200, "content_type": "text/html", "content": b"<p>\xff", "error": None} if u.startswith("https") else urls.fetch(u)).orderBy("i").collect()
    assert got[0].html == "<p>\ufffd" and got[0].status_code == 200 and got[1].content is None and "not a web address" in got[1].error


def test_office_xml_and_pdf_info(spark):
    parts = decode.office_xml(contents(spark, ("p", PPTX), ("bad", b"")))
    assert [r.member for r in parts.filter("error IS NULL").orderBy("part").collect()] == ["ppt/slides/slide1.xml", "ppt/slides/slide2.xml", "ppt/slides/slide10.xml"]
    assert present.office_xml(parts.filter("error IS NULL")).first().text.startswith("# PPTX XML Content: p\n\n```xml\n")
    info = decode.pdf_info(contents(spark, ("f", PDF + b"9 0 obj\n<</Title (A \\(b\\)) /Author (me)>>\nendobj\ntrailer <</Info 9 0 R>>")))
    assert present.pdf_metadata(info).first().text == "\n## Document Metadata\n\n- **Author**: me\n- **Title**: A (b)\n\n"


def test_switched_off(spark):
    df = spark.sql("""SELECT 'x' AS text, array('i') AS images, map('text', 'off') AS commands UNION ALL SELECT 'y', array('i'), map('images', 'false')""")
    assert [(r.text, r.images) for r in present.filtered(df).collect()] == [("", ["i"]), ("y", [])]
    one = spark.sql("SELECT 'a' AS text, 'abc' AS content_text, map() AS metadata")
    assert "**Length**: 3" in present.object_summary(one).first().text and present.object_preview(one).first().text == "a\n## Preview\n\nabc\n\n"
    assert present.unrendered(one.withColumn("metadata", F.expr("cast(map() as map<string,string>)")), "pdf").first().metadata["pdf_images_error"]


def test_images_of_every_kind_in_the_facade(spark, tmp_path):
    heic = b"\0\0\0\x18ftypheic" + b"\0" * 20 + b"\0\0\0\x14ispe\0\0\0\0" + struct.pack(">II", 40, 30)
    jpeg = b"\xff\xd8\xff\xe0\0\x04ab\xff\xc0\0\x11\x08\0\x09\0\x08\x03" + b"\0" * 9
    webp = b"RIFF\0\0\0\0WEBPVP8X" + b"\0" * 8 + b"\x04\0\0\x05\0\0"
    svg = b'<?xml version="1.0"?>\n<svg xmlns="http://www.w3.org/2000/svg" width="9"><text>t</text></svg>'
    given = {"png": ("a.png", PNG), "gif": ("a.gif", b"GIF89a" + struct.pack("<HH", 3, 4) + b"\0" * 9), "jpeg": ("a.jpg", jpeg), "webp": ("a.webp", webp), "heic": ("a.HEIC", heic), "svg+xml": ("a.svg", svg)}
    for name, data in given.values():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "b.eps").write_bytes(b"%!PS-Adobe-3.0\n%%Title: t\n")
    paths = [str(tmp_path / name) for name, _ in given.values()] + [str(tmp_path / "b.eps")]
    ctx = api.Context(spark, *paths)
    rows, meta = list(ctx), ctx.metadata
    for row, path, kind, told in zip(rows, paths, given, meta["files"]):
        assert len(row.images) == 1 and row.images[0].startswith(f"data:image/{kind};base64,") and row.text, kind
        assert told["path"] == path and told["image_count"] == 1
    assert (meta["file_count"], meta["image_count"]) == (7, 6) and "svg" in rows[5].text
    assert rows[6].images == [] and "eps_images_error" in meta["files"][6]["metadata"]
    message = ctx.claude("x")
    assert all(f'"media_type":"image/{kind}"' in message for kind in given)


def test_pages_follow_the_page_tree(spark):
    page = lambda no, text: b"%d 0 obj\n<</Type /Page /Contents %d 0 R>>\nendobj\n%d 0 obj\n<<>>\nstream\nBT (%s) Tj ET\nendstream\nendobj\n" % (no, no + 1, no + 1, text)
    nodes = b"20 0 obj\n<</Type /Catalog /Pages 21 0 R>>\nendobj\n21 0 obj\n<</Type /Pages /Kids [7 0 R 22 0 R 3 0 R]>>\nendobj\n22 0 obj\n<</Type /Pages /Kids [5 0 R 21 0 R]>>\nendobj\n"
    whole = b"%PDF-1.4\n" + page(3, b"third") + page(5, b"second") + page(7, b"first") + page(9, b"in no tree") + nodes + b"trailer <</Root 20 0 R>>"
    assert [(r.page_number, r.text) for r in decode.pdf(contents(spark, ("f", whole))).orderBy("page_number").collect()] == [(1, "first"), (2, "second"), (3, "third")]


def test_one_verb_for_mixed_rows_and_names_that_look_like_patterns(spark, tmp_path):
    (tmp_path / "a[1].txt").write_text("plain")
    (tmp_path / "n.csv").write_text("k,v\n1,2\n")
    flow = verbs.attach(spark, f"{tmp_path}/n.csv") | verbs.load.content | verbs.present.csv
    assert flow.df.first().text.endswith("k,v\n1,2\n")
    rows = spark.createDataFrame([(0, f"{tmp_path}/a[1].txt"), (1, f"{tmp_path}/n.csv")], "ord long, path string")
    mixed = (verbs.Flow(rows) | verbs.load.content | verbs.present.markdown).df.orderBy("ord").collect()
    assert mixed[0].text.endswith("plain") and "| 1 | 2 |" in mixed[1].text


def test_each_row_has_its_own_limit(spark):
    df = spark.sql("""SELECT 'p' AS path, 'abcdef' AS text, map('split', 'characters', 'characters', '2') AS commands UNION ALL SELECT 'q', 'abcdef', map('split', 'characters', 'characters', '4')
      UNION ALL SELECT 'r', 'a|b', map('split', 'custom', 'custom', '|') UNION ALL SELECT 's', 'abc', map('split', 'characters', 'characters', 'many') UNION ALL SELECT 't', 'abc', map('split', 'lines', 'lines', '0')""")
    got = sorted((r.path, r.text) for r in route.split_as_asked(df).collect())
    assert got == [("p#chars-1-2", "ab"), ("p#chars-3-4", "cd"), ("p#chars-5-6", "ef"), ("q#chars-1-4", "abcd"), ("q#chars-5-6", "ef"), ("r#custom-1", "a"), ("r#custom-2", "b"), ("s", "abc"), ("t", "abc")]


def test_samples(spark, tmp_path):
    from docloom.sources import samples

    paths = [samples.sample_path(name, str(tmp_path)) for name in samples.sample_names()]
    assert all(r.text and "could not be read" not in r.text.lower() for r in api.Context(spark, *paths))
    with pytest.raises(KeyError):
        samples.sample_path("none", str(tmp_path))
