"""Operator 3, WARC archives: writing, and reading with segment reassembly.

Writing. Each page becomes a ``response`` record whose HTTP body is sent chunked; of equal payloads the smallest
page_id is the response and the others are ``revisit`` records that refer to it. A block beyond ``SEGMENT`` bytes
is cut: the first record carries segment number 1, ``continuation`` records name their origin, and the last gives
the total length. Each record is a gzip member; the text writer's line separator is an empty gzip member, which
readers skip, so the files are ordinary .warc.gz content of at most ``FILE_RECORDS`` records, each with a block of at
most ``SEGMENT`` bytes: some 17 MB a file, whatever the pages' lengths. A revisit names the response's record id.

Reading. Files are parsed member by member where they lie. Whole records are decoded at once; only segments are
shuffled, grouped by their origin, ordered by number, checked against the total length, and joined; then the
chunked framing is undone and the payload's digest verified. A group is one payload, never more.

Defined results: null html is the empty payload, which takes part like any other unless ``least`` excludes it;
rows that repeat both page_id and payload of a response are responses too; null ids are written as empty and read
as null. A record that is damaged, cut short or incomplete (gzip data or checksum, lengths, ids, numbers, chunks,
digest, segments) gives a row with ``error`` set and what else could be told; the records around it are read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import shared_dir, small_batches, table, written

SEGMENT, CHUNK, FILE_RECORDS, LEVEL = 16 << 10, 4096, 1024, 5
DATE = "2024-01-01T00:00:00Z"
#: Fixed: an empty gzip member (RFC 1952), as ISO-8859-1 text for the writer's separator.
EMPTY_MEMBER = bytes.fromhex("1f8b08000000000000ff03000000000000000000")


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """Undo chunked framing; extensions and trailers are allowed, anything short or malformed raises ValueError."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk size line missing")
        n = int(body[at:end].split(b";")[0].strip(), 16)
        if n < 0:
            raise ValueError("chunk size below zero")
        at = end + 2
        if n == 0:
            return b"".join(out)
        if body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("chunk cut short")
        out.append(body[at : at + n])
        at += n + 2


def record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", len(block))])
    raw = b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return pack.compress(raw) + pack.flush()


def records_of(headers: list[tuple[str, object]], block: bytes, name: str, segment: int = SEGMENT) -> Iterator[bytes]:
    """The record, or its segments."""
    if len(block) <= segment:
        yield record([*headers, ("WARC-Record-ID", f"<{name}>")], block)
        return
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    for i, part in enumerate(parts, 1):
        if i == 1:
            more = [*headers, ("WARC-Record-ID", f"<{name}>"), ("WARC-Segment-Number", 1)]
        else:
            more = [("WARC-Type", "continuation"), ("WARC-Date", DATE), ("WARC-Record-ID", f"<{name}+{i}>"), ("WARC-Segment-Origin-ID", f"<{name}>"), ("WARC-Segment-Number", i)]
            if i == len(parts):
                more.append(("WARC-Segment-Total-Length", len(block)))
        yield record(more, part)


def _inflated(view: memoryview) -> tuple[bytes, int, str | None]:
    """(what a gzip member holds, as far as it can be read; its bytes; what is wrong with it)."""
    unpack, out, at = zlib.decompressobj(31), [], 0
    try:
        while not unpack.eof and at < len(view):
            piece = view[at : at + (32 << 10)]
            out.append(unpack.decompress(piece))
            at += len(piece) - len(unpack.unused_data)
        return b"".join(out), at, None if unpack.eof else "gzip member cut short"
    except zlib.error as e:
        unpack, out = zlib.decompressobj(31), []
        try:  # again in small steps, for what comes before the damage
            for i in range(0, len(view), 64):
                out.append(unpack.decompress(view[i : i + 64]))
        except zlib.error:
            pass
        return b"".join(out), at, f"gzip member damaged: {e}"


def members(data: bytes) -> Iterator[tuple[int, bytes, str | None]]:
    """(place, content, error) of each gzip member of a file; plain bytes are one member. After a damaged member,
    reading goes on at the next place that looks like one."""
    view, at = memoryview(data), 0
    while at < len(view):
        if data[at : at + 2] != b"\x1f\x8b":
            then = data.find(b"\x1f\x8b\x08", at) if at else -1
            yield at, bytes(view[at : then if then >= 0 else len(view)]), None
            if then < 0:
                return
            at = then
            continue
        text, size, error = _inflated(view[at:])
        if error is None:
            yield at, text, None
            at += size
            continue
        then = data.find(b"\x1f\x8b\x08", at + 3)
        yield at, text, error
        at = then if then >= 0 else len(view)


def parse(data: bytes) -> Iterator[tuple[str, dict[str, str], bytes, str | None]]:
    """(place, headers, block, error) of the records of a file of gzip members (or of plain records). What cannot be
    read as a record is one with an error and the headers that could be told."""
    for place, text, error in members(data):
        at = 0
        while at < len(text) or error:
            end = text.find(b"\r\n\r\n", at)
            head = text[at : end if end >= 0 else len(text)]
            lines = head.decode("utf-8", "replace").split("\r\n")[1:]
            headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
            wrong = error
            if not wrong and (end < 0 or not head.startswith(b"WARC/")):
                wrong = "not a WARC record"
            length = headers.get("content-length", "")
            if not wrong and not (length.isascii() and length.isdigit()):
                wrong = f"content length is {length or 'missing'}"
            if not wrong and end + 4 + int(length) > len(text):
                wrong = f"record holds {len(text) - end - 4} bytes of {length}"
            if not wrong and "warc-record-id" not in headers:
                wrong = "record id missing"
            for name in ("warc-segment-number", "warc-segment-total-length"):
                if not wrong and not headers.get(name, "0").isdigit():
                    wrong = f"{name} is {headers[name]}"
            if wrong:
                yield f"{place}+{at}", headers, b"", wrong
                break  # where the next record of this member begins is not known
            n = int(length)
            yield f"{place}+{at}", headers, text[end + 4 : end + 4 + n], None
            at = end + 4 + n + 4


def page_urn(page_id) -> str:
    return f"urn:docloom:page:{'' if page_id is None else page_id}"


def page_of(urn: str) -> int | None:
    found = re.match(r"<?urn:docloom:page:(-?\d+)", urn or "")
    return int(found[1]) if found else None


def write_archives(pages: DataFrame, path: str, least: int = 0, segment: int = SEGMENT) -> None:
    """pages(page_id, url, html) -> archives under ``path``; payloads of fewer than ``least`` bytes are never revisits."""
    spark = pages.sparkSession
    small_batches(spark)
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("payload"))
    base = base.withColumn("sha", F.unhex(F.sha1("payload"))).withColumn("place", F.monotonically_increasing_id())
    # By page first, so that rows which repeat a response's page and payload are known: ``place`` tells them apart.
    by_page = base.filter(F.octet_length("payload") >= least).groupBy("sha", "page_id").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("place"))
    groups = by_page.groupBy("sha").agg(F.min(F.struct(F.col("page_id").isNull().alias("no_id"), F.col("page_id").alias("first"), F.col("n").alias("same"), F.col("place").alias("at"))).alias("f"), F.sum("n").alias("n"))
    # Only payloads that occur again; written first, so that Spark knows its size when it chooses the join.
    again = written(groups.filter("n > 1").select("sha", "f.first", "f.same", "f.at"), "warc-again")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count = TaskContext.get().partitionId(), 0
        for batch in batches:
            out, size = [], 0
            for page, url, payload, sha, place, first, same, at in zip(*(c.to_pylist() for c in batch.columns)):
                count += 1
                letters = base64.b32encode(sha).decode()
                # The record others refer to has a name they can tell; all other names are told apart by their place.
                named = page is not None and page == first and (same == 1 or place == at)
                name = f"{page_urn(page)}:{letters}" if named else f"{page_urn(page)}:{part}-{count}"
                digest = "sha1:" + letters
                target = [("WARC-Target-URI", re.sub(r"[\r\n]", " ", url))] if url else []
                common = [("WARC-Date", DATE), *target, ("WARC-Payload-Digest", digest), ("Content-Type", "application/http; msgtype=response")]
                status = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
                if first is not None and page != first:
                    headers = [("WARC-Type", "revisit"), *common, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{page_urn(first)}:{letters}>")]
                    block = status + b"Content-Length: %d\r\n\r\n" % len(payload)
                else:
                    headers = [("WARC-Type", "response"), *common]
                    block = status + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
                for r in records_of(headers, block, name, segment):
                    out.append(r)
                    size += len(r)
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
                        out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    rows = base.join(again, "sha", "left").select("page_id", "url", "payload", "sha", "place", "first", "same", "at").mapInArrow(run, "value binary")
    rows.select(F.col("value").cast("string")).write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("maxRecordsPerFile", FILE_RECORDS).text(path)


_PARSED = "origin string, page_id long, record_type string, refers_to long, digest string, number int, total long, part binary, payload_bytes long, payload_digest string, error string"


def decoded(kind: str, digest: str, block: bytes, total: int | None) -> tuple[int | None, str | None, str | None, bytes]:
    """(payload bytes, payload digest, error, payload) of a whole block."""
    try:
        if total is not None and total != len(block):
            raise ValueError(f"segments hold {len(block)} bytes of {total}")
        head, found, body = block.partition(b"\r\n\r\n")
        if not found:
            raise ValueError("HTTP head missing")
        if kind == "revisit":
            length = re.search(rb"(?im)^Content-Length:\s*(\d+)", head)
            return int(length[1]) if length else None, digest, None, b""
        payload = unchunked(body) if re.search(rb"(?im)^Transfer-Encoding:\s*chunked", head) else body
        own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        return len(payload), own, None if not digest or own == digest else f"digest differs from {digest}", payload
    except ValueError as e:
        return None, None, str(e), b""


def read_archives(spark, path: str) -> DataFrame:
    """One row per page: page_id, payload_bytes, payload_digest, record_type, refers_to, error, payload (null where whole)."""
    small_batches(spark)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _PARSED.split(", ")]
        schema = pa.schema([pa.field(n, t) for n, t in zip(names, [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.string()])])
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                out = []
                for place, h, block, wrong in parse(content.as_py()):
                    kind = h.get("warc-type")
                    name = h.get("warc-segment-origin-id") or h.get("warc-record-id")
                    if wrong:
                        out.append(dict.fromkeys(names) | {"origin": f"{path}@{place}", "page_id": page_of(name), "record_type": kind, "error": wrong})
                        continue
                    if kind not in ("response", "revisit", "continuation"):
                        continue
                    number = int(h.get("warc-segment-number", 0))
                    digest = h.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    total = h.get("warc-segment-total-length")
                    origin = name if number else f"{path}@{place}"  # whole records meet no other
                    row = dict.fromkeys(names) | {"origin": origin, "page_id": page_of(name), "number": number, "total": int(total) if total else None}
                    if kind != "continuation":
                        row |= {"record_type": kind, "refers_to": page_of(h.get("warc-refers-to")), "digest": digest}
                    if number:
                        row["part"] = block
                    else:
                        row["payload_bytes"], row["payload_digest"], row["error"], _ = decoded(kind, digest, block, None)
                    out.append(row)
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                parts = sorted(row.pop("parts"), key=lambda p: p["number"])
                total, digest = row.pop("total"), row.pop("digest")
                if parts:
                    if [p["number"] for p in parts] != list(range(1, len(parts) + 1)) or total is None or row["record_type"] is None:
                        row["error"] = "segments missing"
                    else:
                        row["payload_bytes"], row["payload_digest"], row["error"], _ = decoded(row["record_type"], digest, b"".join(p["part"] for p in parts), total)
                out.append(row)
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("error", pa.string())]))

    first = lambda c: F.max(c).alias(c)  # noqa: E731  one record of a group at most has it
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    whole = files.mapInArrow(take, _PARSED).groupBy("origin").agg(
        *map(first, ("page_id", "record_type", "refers_to", "digest", "total", "payload_bytes", "payload_digest", "error")),
        F.collect_list(F.when(F.col("part").isNotNull(), F.struct("number", "part"))).alias("parts"),
    )
    return whole.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error", "digest", "total", "parts").mapInArrow(
        join, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, error string"
    )


def op3_warc(spark, sf_dir):
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path)


def _base32(hexes: str) -> str:
    """SQL: the base32 text of 40 hexadecimal digits, five digits (four letters) at a time."""
    letters = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
    part = lambda k: f"('0x' || substr({hexes}, {5 * k + 1}, 5))::INT"
    return " || ".join(f"substr({letters}, (({part(k)} >> {shift}) & 31) + 1, 1)" for k in range(8) for shift in (15, 10, 5, 0))


OP3_SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, n AS payload_bytes, {_base32('h')} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to, NULL::VARCHAR AS error FROM f
"""
