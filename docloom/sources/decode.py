"""Decoders of formats that Spark does not read: one Arrow-batched pass per format, error as data.

Each takes rows of (path, content) and yields rows of the document's parts; a damaged file gives one row with
``error`` set. The rows of many small files are handed on together, those of large ones a few at a time.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Members of an archive that count as images.
IMAGE_ENDINGS = (".jpg", ".jpeg", ".png", ".gif", ".bmp", ".heic", ".heif", ".webp")
#: Brands of image files in the ISO container.
HEIF_BRANDS = (b"heic", b"heix", b"heif", b"mif1", b"msf1", b"hevc")


#: Rows, and bytes of their values, that a decoder gathers before it hands them on.
BATCH_ROWS, BATCH_BYTES = 4096, 8 << 20


def _weight(value) -> int:
    """Bytes of a value, roughly."""
    return len(value) if isinstance(value, (str, bytes)) else 8 + sum(map(_weight, value)) if isinstance(value, list) else 8


def gathered(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows in batches of bounded rows and bytes; what a row lacks is null."""
    held, n, weight = {c: [] for c in schema.names}, 0, 0
    made = lambda: pa.RecordBatch.from_arrays([pa.array(held[f.name], f.type) for f in schema], schema=schema)
    for r in rows:
        for c, values in held.items():
            values.append(r.get(c))
        n, weight = n + 1, weight + sum(map(_weight, r.values()))
        if n >= BATCH_ROWS or weight >= BATCH_BYTES:
            yield made()
            held, n, weight = {c: [] for c in schema.names}, 0, 0
    if n:
        yield made()


def parts(files: DataFrame, decode: Callable[[bytes], list[dict]], schema: str) -> DataFrame:
    """1 file -> N rows: path (and the attachment's place ``ord`` and the pages asked for, if there), the decoder's columns, error."""
    carried = [c for c in ("ord", "_spec") if c in files.columns]
    kinds = "".join(f", {c} {files.schema[c].dataType.simpleString()}" for c in carried)
    out = f"path string{kinds}, {schema}, error string"
    arrow = to_arrow_schema(StructType.fromDDL(out))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for path, content, *place in zip(*(batch.column(c) for c in ("path", "content", *carried))):
                same = {"path": path.as_py(), **{c: v.as_py() for c, v in zip(carried, place)}}
                try:
                    found = [{**same, **r} for r in decode(bytes(content.as_py()))]
                except Exception as e:  # noqa: BLE001  a bad file is a row that says so
                    found = [{**same, "error": f"{type(e).__name__}: {e}"}]
                yield from found

    return files.select("path", "content", *carried).mapInArrow(lambda batches: gathered(rows(batches), arrow), out)


def _natural(names: list[str], pattern: str) -> list[str]:
    found = [(int(m[1]), n) for n in names if (m := re.fullmatch(pattern, n))]
    return [n for _, n in sorted(found)]


def _slides(content: bytes) -> list[dict]:
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = _natural(z.namelist(), r"ppt/slides/slide(\d+)\.xml")
        for no, name in enumerate(names, 1):
            shapes = [s for s in ET.fromstring(z.read(name)).iter() if s.tag in (f"{P}sp",)]
            texts = ["\n".join("".join(t.text or "" for t in p.iter(f"{A}t")) for p in s.iter(f"{A}p")) for s in shapes]
            out += [{"slide_number": no, "total_slides": len(names), "shape": k, "text": t} for k, t in enumerate(texts or [""])]
    return out


def pptx(files: DataFrame) -> DataFrame:
    return parts(files, _slides, "slide_number int, total_slides int, shape int, text string")


def _paragraphs(content: bytes) -> list[dict]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{WORD}body")
        names = {}
        if "word/styles.xml" in z.namelist():
            for s in ET.fromstring(z.read("word/styles.xml")).iter(f"{WORD}style"):
                name = s.find(f"{WORD}name")
                names[s.get(f"{WORD}styleId")] = (name.get(f"{WORD}val") or "") if name is not None else ""
    out = []
    for no, p in enumerate(body.findall(f"{WORD}p")):
        style = p.find(f"{WORD}pPr/{WORD}pStyle")
        key = style.get(f"{WORD}val") if style is not None else None
        name = names.get(key, re.sub(r"(\d+)$", r" \1", key)) if key else "Normal"
        name = re.sub(r"^heading\b", "Heading", name)
        text = "".join("\t" if e.tag == f"{WORD}tab" else "\n" if e.tag in (f"{WORD}br", f"{WORD}cr") else e.text or "" for e in p.iter() if e.tag in (f"{WORD}t", f"{WORD}tab", f"{WORD}br", f"{WORD}cr") and not (e.tag == f"{WORD}tab" and e.attrib))
        out.append({"number": no, "style": name, "text": text})
    return out


def docx(files: DataFrame) -> DataFrame:
    return parts(files, _paragraphs, "number int, style string, text string")


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = 26 * n + ord(c) - 64
    return n


def _sheets(content: bytes) -> list[dict]:
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{SHEET}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml"))]
        rels = {r.get("Id"): r.get("Target").lstrip("/") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for no, s in enumerate(ET.fromstring(z.read("xl/workbook.xml")).iter(f"{SHEET}sheet"), 1):
            target = rels[s.get(REL)]
            root = ET.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
            grid: dict[int, dict[int, str]] = {}
            for c in root.iter(f"{SHEET}c"):
                kind, v = c.get("t"), c.find(f"{SHEET}v")
                value = "".join(t.text or "" for t in c.iter(f"{SHEET}t")) if kind == "inlineStr" else None if v is None else shared[int(v.text)] if kind == "s" else {"1": "True", "0": "False"}.get(v.text, v.text) if kind == "b" else v.text
                if value is not None:
                    grid.setdefault(int(re.search(r"\d+", c.get("r"))[0]), {})[_column(c.get("r"))] = value
            width, height = max((max(r) for r in grid.values()), default=0), max(grid, default=0)
            rows = [{"row_number": r, "cells": [grid.get(r, {}).get(k) for k in range(1, width + 1)]} for r in range(1, height + 1)] or [{"row_number": None, "cells": []}]
            out += [{"sheet_number": no, "title": s.get("name"), "columns": width, **r} for r in rows]
    return out


def xlsx(files: DataFrame) -> DataFrame:
    return parts(files, _sheets, "sheet_number int, title string, columns int, row_number int, cells array<string>")


_PDF_STRING = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|\[(?:\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|[^\]])*\]|\b(?:Tj|TJ|Td|TD|Tm|T\*|ET)|['\"]", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _pdf_bytes(token: bytes) -> bytes:
    if token[:1] == b"<":
        raw = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((raw + b"0" * (len(raw) % 2)).decode())
    body = re.sub(rb"\\([0-7]{1,3})", lambda m: bytes([int(m[1], 8) & 255]), token[1:-1])
    return re.sub(rb"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), body, flags=re.S)


def _pdf_text(stream: bytes) -> str:
    out, held = [], b""
    for m in _PDF_STRING.finditer(stream):
        t = m[0]
        if t[:1] in (b"(", b"<"):
            held = _pdf_bytes(t)
        elif t[:1] == b"[":
            held = b"".join(_pdf_bytes(x) for x in re.findall(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>", t, re.S))
        elif t in (b"Tj", b"TJ", b"'", b'"'):
            out.append(held.decode("latin-1"))
            held = b""
        elif out and not out[-1].endswith("\n"):
            out.append("\n")
    return "".join(out).strip()


_IS_PAGE = re.compile(rb"/Type\s*/Page\b(?!s)")


def _page_tree(objects: dict[int, bytes], content: bytes) -> list[bytes]:
    """Pages from the root down, as their parents list them; empty where no tree can be told. The last root counts."""
    roots = [m for body in (*objects.values(), content) for m in re.findall(rb"/Root\s+(\d+)\s+\d+\s+R", body)]
    top = re.search(rb"/Pages\s+(\d+)\s+\d+\s+R", objects.get(int(roots[-1]), b"")) if roots else None
    out, seen, stack = [], set(), [int(top[1])] if top else []
    while stack:
        no = stack.pop()
        body = objects.get(no, b"")
        if no in seen:
            continue
        seen.add(no)
        kids = re.search(rb"/Kids\s*\[([^\]]*)\]", body)
        if _IS_PAGE.search(body):
            out.append(body)
        elif kids:
            stack += [int(r) for r in re.findall(rb"(\d+)\s+\d+\s+R", kids[1])][::-1]
    return out


def _pdf_pages(content: bytes) -> list[dict]:
    """Text that pages show by simple fonts, in the order of the page tree. What it cannot read counts as without text."""
    if not content.startswith(b"%PDF"):
        raise ValueError("not a PDF")
    objects = {int(m[1]): m[2] for m in re.finditer(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", content, re.S)}

    def stream(body: bytes) -> bytes:
        m = re.search(rb"stream\r?\n(.*?)\r?\n?endstream", body, re.S)
        data = m[1] if m else b""
        return zlib.decompressobj().decompress(data) if b"FlateDecode" in body[: m.start() if m else 0] else data

    for body in list(objects.values()):
        if b"/ObjStm" in body:
            data, n = stream(body), int(re.search(rb"/N\s+(\d+)", body)[1])
            first = int(re.search(rb"/First\s+(\d+)", body)[1])
            heads = list(map(int, data[:first].split()[: 2 * n]))
            ends = [*heads[3::2], len(data) - first]
            for no, a, b in zip(heads[::2], heads[1::2], ends):
                objects.setdefault(no, data[first + a : first + b])
    pages = _page_tree(objects, content) or [b for _, b in sorted(objects.items()) if _IS_PAGE.search(b)]
    out = []
    for no, body in enumerate(pages, 1):
        m = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)
        refs = [int(r) for r in re.findall(rb"(\d+)\s+\d+\s+R", m[1])] if m else []
        out.append({"page_number": no, "total_pages": len(pages), "text": "\n".join(t for r in refs if (t := _pdf_text(stream(objects.get(r, b"")))))})
    return out


def pdf(files: DataFrame) -> DataFrame:
    return parts(files, _pdf_pages, "page_number int, total_pages int, text string")


def image_header(content: bytes) -> dict:
    """format, width, height and mode from the first bytes."""
    if content[:8] == b"\x89PNG\r\n\x1a\n":
        w, h, _, color = struct.unpack(">IIBB", content[16:26])
        return {"format": "PNG", "width": w, "height": h, "mode": {0: "L", 2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}.get(color)}
    if content[:4] == b"GIF8":
        return {"format": "GIF", **dict(zip(("width", "height"), struct.unpack("<HH", content[6:10]))), "mode": "P"}
    if content[:2] == b"BM":
        w, h = struct.unpack("<ii", content[18:26])
        return {"format": "BMP", "width": w, "height": abs(h), "mode": "RGB"}
    if content[:4] == b"RIFF" and content[8:12] == b"WEBP":
        if content[12:16] == b"VP8X":
            return {"format": "WEBP", "width": 1 + int.from_bytes(content[24:27], "little"), "height": 1 + int.from_bytes(content[27:30], "little"), "mode": "RGBA"}
        if content[12:16] == b"VP8L":
            bits = int.from_bytes(content[21:25], "little")
            return {"format": "WEBP", "width": 1 + (bits & 0x3FFF), "height": 1 + (bits >> 14 & 0x3FFF), "mode": "RGBA"}
        return {"format": "WEBP", "width": int.from_bytes(content[26:28], "little") & 0x3FFF, "height": int.from_bytes(content[28:30], "little") & 0x3FFF, "mode": "RGB"}
    if content[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(content):
            marker, size = content[at + 1], int.from_bytes(content[at + 2 : at + 4], "big")
            if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                return {"format": "JPEG", "height": int.from_bytes(content[at + 5 : at + 7], "big"), "width": int.from_bytes(content[at + 7 : at + 9], "big"), "mode": {1: "L", 3: "RGB", 4: "CMYK"}.get(content[at + 9])}
            at += 2 + size
    if content[4:8] == b"ftyp" and content[8:12] in HEIF_BRANDS:
        at = content.find(b"ispe")
        w, h = struct.unpack(">II", content[at + 8 : at + 16]) if at >= 0 else (None, None)
        return {"format": "HEIF", "width": w, "height": h, "mode": "RGB"}
    raise ValueError("image format not known")


def images(files: DataFrame) -> DataFrame:
    return parts(files, lambda c: [image_header(c)], "format string, width int, height int, mode string")


def _members(content: bytes) -> list[dict]:
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for name in z.namelist():
            if name.lower().endswith(IMAGE_ENDINGS) and not name.startswith("__MACOSX"):
                out.append({"member": name, "content": z.read(name)})
    return out


def zip_images(files: DataFrame) -> DataFrame:
    """One row per image of an archive: path (of the archive), member, content, metadata."""
    rows = parts(files, _members, "member string, content binary")
    return rows.withColumn("metadata", F.create_map(F.lit("from_zip"), F.col("path"), F.lit("zip_filename"), F.col("member")))


def _svg(content: bytes) -> list[dict]:
    text = content.decode("utf-8", "replace")
    if "<!DOCTYPE" in text and "<!ENTITY" in text:
        raise ValueError("entity declarations are not read")
    root = ET.fromstring(text)
    tags = [e.tag for e in root.iter()]
    space = "{http://www.w3.org/2000/svg}"
    return [{"svg_width": root.get("width", "auto"), "svg_height": root.get("height", "auto"), "element_count": len(tags), "has_text_elements": f"{space}text" in tags, "has_images": f"{space}image" in tags, "text": text}]


def svg(files: DataFrame) -> DataFrame:
    return parts(files, _svg, "svg_width string, svg_height string, element_count int, has_text_elements boolean, has_images boolean, text string")


def eps(files: DataFrame) -> DataFrame:
    """Comments of the first twenty lines, by expressions alone; the last of equal ones counts."""
    text = F.decode("content", "ISO-8859-1")
    head = F.slice(F.split(text, "\n"), 1, 20)

    def comment(name: str):
        hits = F.filter(head, lambda line: line.startswith(f"%%{name}:"))
        return F.when(F.size(hits) > 0, F.trim(F.regexp_replace(F.substring(F.element_at(hits, -1), len(name) + 4, 1 << 20), "\r", "")))

    return files.select("path", *[c for c in ("ord",) if c in files.columns], comment("BoundingBox").alias("bounding_box"), comment("Creator").alias("creator"), comment("Title").alias("title"), comment("CreationDate").alias("creation_date"), F.length(text).alias("file_size"), text.alias("text"))


def _xml_parts(content: bytes, slides: int = 3) -> list[dict]:
    """The members that say what an office file holds, pretty-printed: the first slides, or document, styles and core."""
    from xml.dom import minidom

    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        wanted = _natural(names, r"ppt/slides/slide(\d+)\.xml")[:slides] or [n for n in ("word/document.xml", "word/styles.xml", "docProps/core.xml") if n in names]
        for k, name in enumerate(wanted):
            raw = z.read(name)
            if b"<!DOCTYPE" in raw:
                raise ValueError("document types are not read")
            lines = [x for x in minidom.parseString(raw).toprettyxml(indent="  ").split("\n") if x.strip()]
            out.append({"part": k, "member": name, "members": ", ".join(n for n in names if n.endswith(".xml")), "text": "\n".join(lines[1:])})
    return out


def office_xml(files: DataFrame) -> DataFrame:
    return parts(files, _xml_parts, "part int, member string, members string, text string")


def _pdf_info(content: bytes) -> list[dict]:
    """The information dictionary, as far as its strings are plain."""
    ref = re.search(rb"/Info\s+(\d+)\s+\d+\s+R", content)
    body = re.search(rb"\b" + ref[1] + rb"\s+\d+\s+obj\b(.*?)endobj", content, re.S) if ref else None
    if not body:
        return []
    return [{"key": m[1].decode(), "value": _pdf_bytes(m[2]).decode("latin-1")} for m in re.finditer(rb"/(\w+)\s*(\((?:\\.|[^\\()])*\))", body[1], re.S)]


def pdf_info(files: DataFrame) -> DataFrame:
    return parts(files, _pdf_info, "key string, value string")
