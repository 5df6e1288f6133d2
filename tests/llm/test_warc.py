import base64
import gzip
import hashlib
from pathlib import Path

import pytest

from docloom.llm import warc
from docloom.llm.warc import chunked, op3_warc, page_urn, parse, read_archives, record, records_of, unchunked, write_archives

SCHEMA = "page_id long, url string, html string, payload_bytes string, sha string"


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_chunked_framing():
    for n in (0, 1, 4095, 4096, 4097, 100_000):
        assert unchunked(chunked(b"\r\n" * n)) == b"\r\n" * n
    assert unchunked(b"3;x=y\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    for bad in (b"", b"5\r\nabc\r\n0\r\n\r\n", b"zz\r\n", b"3\r\nabc\r\n"):
        with pytest.raises(ValueError):
            unchunked(bad)


def pages():
    big = "é<p>\r\n\r\nWARC/1.1 " * 9000
    return [(1, "http://a/", "x"), (2, None, big), (3, "http://b/\n", "x"), (4, "u", None), (5, "u", ""), (6, "u", big), (6, "u", "other"), (7, "u", "x"), (7, "u", "x"), (None, "u", "nobody"), (8, "u", "\u0000 z")]


@pytest.mark.parametrize("segment", [100, 16 << 10])
def test_write_and_read(spark, tables, tmp_path, segment):
    d = tables(pages=(SCHEMA, [(*r, "x", "y") for r in pages()]))
    out = f"{tmp_path}/warc"
    write_archives(spark.read.parquet(f"{d}/pages.parquet"), out, segment=segment)
    got = sorted(map(tuple, read_archives(spark, out).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error").collect()), key=repr)
    first, want = {}, []
    for i, _, html in pages():
        first[html or ""] = min(first.get(html or "", 10**9), 10**9 if i is None else i)
    for i, _, html in pages():
        again = i is not None and i != first[html or ""]
        want.append((i, len((html or "").encode()), digest(html), "revisit" if again else "response", first[html or ""] if again else None, None))
    assert got == sorted(want, key=repr)
    for f in Path(out).glob("part-*"):
        text = gzip.decompress(f.read_bytes()) if f.stat().st_size else b""
        assert not text or text.startswith(b"WARC/1.1\r\n")
        assert len(list(parse(text))) == len(list(parse(f.read_bytes())))
    heads = [h for f in Path(out).glob("part-*") for _, h, _, wrong in parse(f.read_bytes()) if not wrong]
    ids = [h["warc-record-id"] for h in heads]
    assert len(ids) == len(set(ids)) and {h["warc-refers-to"] for h in heads if "warc-refers-to" in h} <= set(ids)
    assert {h["warc-segment-origin-id"] for h in heads if "warc-segment-origin-id" in h} <= set(ids)


def test_query_and_empty_table(spark, tables):
    assert op3_warc(spark, tables(pages=(SCHEMA, [(*r, "x", "y") for r in pages()]))).count() == len(pages())
    assert op3_warc(spark, tables(pages=(SCHEMA, []))).count() == 0


def test_small_payloads_can_be_left_out(spark, tables, tmp_path):
    d = tables(pages=(SCHEMA, [(1, "u", "x", "", ""), (2, "u", "x", "", "")]))
    write_archives(spark.read.parquet(f"{d}/pages.parquet"), f"{tmp_path}/w", least=2)
    assert [r.record_type for r in read_archives(spark, f"{tmp_path}/w").collect()] == ["response", "response"]


def test_damage_is_reported(spark, tmp_path):
    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(b"y" * 5000)
    head = [("WARC-Type", "response"), ("WARC-Payload-Digest", "sha1:WRONG")]
    parts = list(records_of(head, block, page_urn(1) + ":a", 1000))
    other = list(records_of(head, block, page_urn(2) + ":a", 1000))
    (tmp_path / "a").write_bytes(b"".join(parts[::-1]))
    (tmp_path / "b").write_bytes(b"".join(other[:2] + other[3:]) + record([("WARC-Type", "response"), ("WARC-Record-ID", f"<{page_urn(3)}>")], b"no head") + record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<x>")], b""))
    got = {r.page_id: r for r in read_archives(spark, str(tmp_path)).collect()}
    assert sorted(got) == [1, 2, 3] and "digest" in got[1].error and got[1].payload_bytes == 5000
    assert got[2].error == "segments missing" and "head" in got[3].error
    assert warc.EMPTY_MEMBER and gzip.decompress(warc.EMPTY_MEMBER) == b""


def test_damaged_files_give_rows_and_spare_their_neighbours(spark, tmp_path):
    block = b"HTTP/1.1 200 OK\r\n\r\n" + bytes(range(256)) * 8
    whole = [record([("WARC-Type", "response"), ("WARC-Record-ID", f"<{page_urn(i)}:a>")], block) for i in range(4)]
    flipped, checksum = bytearray(whole[1]), bytearray(whole[1])
    flipped[len(flipped) // 2] ^= 0x55
    checksum[-6] ^= 1
    (tmp_path / "flipped").write_bytes(whole[0] + bytes(flipped) + whole[2])
    (tmp_path / "checksum").write_bytes(whole[0] + bytes(checksum) + whole[2])
    (tmp_path / "cut").write_bytes(whole[0] + whole[1][:-30])
    raw = lambda headers, body: ("WARC/1.1\r\nWARC-Type: response\r\n" + headers + "\r\n\r\n").encode() + body
    for name, length in (("negative", "Content-Length: -5"), ("absent", "X: y"), ("words", "Content-Length: ten"), ("long", "Content-Length: 900"), ("nameless", "Content-Length: 1")):
        more = "" if name == "nameless" else f"WARC-Record-ID: <{page_urn(7)}:a>\r\n"
        (tmp_path / name).write_bytes(gzip.compress(raw(more + length, b"z")) + whole[3])
    (tmp_path / "number").write_bytes(gzip.compress(raw(f"WARC-Record-ID: <{page_urn(7)}:a>\r\nWARC-Segment-Number: x\r\nContent-Length: 1", b"z")))
    (tmp_path / "noise").write_bytes(b"nothing of the kind")
    (tmp_path / "empty").write_bytes(b"")
    for path in sorted(tmp_path.iterdir()):
        rows = [r.asDict() for r in read_archives(spark, str(path)).collect()]
        good, bad = [r for r in rows if r["error"] is None], [r for r in rows if r["error"]]
        assert (len(bad) > 0) == (path.name != "empty"), path.name
        want = {"flipped": {0, 2}, "checksum": {0, 2}, "cut": {0}, "noise": set(), "empty": set(), "number": set()}.get(path.name, {3})
        assert {r["page_id"] for r in good} == want and all(r["payload_bytes"] == 2048 for r in good), path.name
        if path.name == "checksum":
            assert bad[0]["page_id"] == 1
