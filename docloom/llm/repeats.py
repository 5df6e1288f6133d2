"""Windows of a fixed number of tokens that occur again, exactly, in memory-sized groups: what operators 4 and 6 share.

A full suffix array or tree of every position would move many times the corpus. Only some suffixes can matter: the
k-gram with the smallest hash in a window, its anchor, is the same in equal windows, at the same offset. So

1. ``candidates``: every document's anchors meet by the hash of their k-gram. Anchors whose k-gram is alone (in words:
   in no other document) are done, nothing else is decided here. K-grams that a bounded sample of documents shows to
   be common are candidates without meeting, so that no task receives all their anchors;
2. ``compare``: a candidate becomes a suffix: the tokens from the anchor on, and backwards before it, as far as the
   windows it owns reach. Suffixes go to groups that fit in memory, by their leading tokens (how is the operator's
   choice: ``Place``). A group first puts equal suffixes together, token by token, then sorts the others by multikey
   quicksort; the common prefixes of neighbours, right and left of the anchor, are the inner nodes of the suffix trees
   and tell which windows are equal;
3. ``across``: where a k-gram is so common that a group's border runs through it, windows whose part right of the
   anchor is shorter than what the group shares can have an equal on the other side. They are compared across borders,
   one row a window;
4. the ranges of repeated windows return to their documents.

A row is known by its id and a hash of its text, so rows that repeat an id are kept apart unless they are equal.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import parts_for, small_batches, written
from docloom.llm.words import _powers, buffers, mixed, slices, word_hashes, word_spans

#: Tokens handled at once of a long document; below 2^24.
SEGMENT = 1 << 21
#: Bytes of the suffixes of a group; bytes of a suffix that may serve to place it; suffixes put together at once.
GROUP_BYTES, KEY, TOGETHER = 16 << 20, 64, 1 << 15
#: Samples that only balance the load: documents looked at for common k-grams, how often such a one occurs there and
#: how many are kept; documents and suffixes of each that tell where suffixes are dense.
LOOK_DOCS, COMMON, MOST_COMMON = 2048, 8, 1 << 16
SAMPLE_DOCS, SAMPLE_SUFFIXES = 1024, 32
NO_ID = -(1 << 63)
ENTRY = np.dtype([("h", "<u8"), ("pos", "<u4"), ("doc", "<u2"), ("o1", "u1"), ("o2", "u1")])
REP = np.dtype([("pos", "<u4"), ("o1", "u1"), ("o2", "u1"), ("flags", "u1")])
SPAN = np.dtype([("x1", "<u4"), ("x2", "<u4")])
#: Flags of a suffix: its windows await a decision; it stands for several equal ones.
ASKS, MANY = 1, 2


@dataclass(frozen=True)
class Kind:
    """Bytes (any second occurrence repeats) or words (an occurrence in a smaller document repeats)."""

    words: bool
    window: int
    gram: int

    @property
    def unit(self) -> int:
        """Bytes of a token."""
        return 8 if self.words else 1

    @property
    def reach(self) -> int:
        return self.window - self.gram + 1

    def tokens(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of all documents in data, first token of each document and the end)."""
        if not self.words:
            return data, cuts - cuts[0]
        starts, ends = word_spans(data, cuts)
        return word_hashes(data, starts, ends), np.searchsorted(starts, cuts - cuts[0])


def _anchors(kind: Kind, tokens: np.ndarray, first: np.ndarray):
    """(k-gram hash, anchor, first and last window it owns, document), positions in tokens."""
    n, w = len(tokens), kind.reach
    if n < kind.window:
        return None
    up, down = _powers(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((tokens.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    grams = mixed((total[kind.gram :] - total[: -kind.gram]) * down[: n - kind.gram + 1])
    low = (grams >> np.uint64(24) << np.uint64(24)) | np.arange(len(grams), dtype=np.uint64)
    span = 1
    while 2 * span <= w:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < w:
        low = np.minimum(low[: len(low) - (w - span)], low[w - span :])
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    x = np.flatnonzero(owner[: n - kind.window + 1] == owner[kind.window - 1 :])
    if not len(x):
        return None
    p = (low[x] & np.uint64((1 << 24) - 1)).astype(np.int64)
    new = np.concatenate([[True], (np.diff(x) != 1) | (np.diff(p) != 0)])
    s = np.flatnonzero(new)
    e = np.concatenate([s[1:], [len(x)]]) - 1
    p, x1, x2 = p[s], x[s], x[e]
    return grams[p] >> np.uint64(16), p, x1, x2, owner[x1]


def document_anchors(kind: Kind, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """ENTRY rows of a batch of documents; pos counts from the document's start."""
    out = []
    for i, j in slices(at):
        tokens, first = kind.tokens(data[at[i] : at[j]], at[i : j + 1])
        step = SEGMENT if j == i + 1 else len(tokens) or 1
        for s in range(0, max(1, len(tokens) - kind.window + 1), step):
            part = tokens[s : s + step + kind.window - 1]
            got = _anchors(kind, part, first if step >= len(tokens) else np.array([0, len(part)]))
            if got is not None:
                h, p, x1, x2, owner = got
                rows = np.zeros(len(h), dtype=ENTRY)
                rows["h"], rows["pos"], rows["doc"] = h, p + s - first[owner], owner + i
                rows["o1"], rows["o2"] = p - x2, p - x1
                out.append(rows)
    return np.concatenate(out) if out else np.zeros(0, dtype=ENTRY)


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where a new value begins in sorted keys."""
    new = np.ones(len(keys[0]), dtype=bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _spans(rows: np.ndarray) -> np.ndarray:
    out = np.empty(len(rows), dtype=SPAN)
    out["x1"], out["x2"] = rows["pos"] - rows["o2"].astype(np.uint32), rows["pos"] - rows["o1"].astype(np.uint32)
    return out


def _by_document(ids: np.ndarray, hashes: np.ndarray, data: np.ndarray) -> pa.RecordBatch:
    """One row per document: rid1, rid2, its records as bytes."""
    order = np.lexsort((hashes, ids))
    ids, hashes, data = ids[order], hashes[order], data[order]
    s = _starts(ids, hashes)
    e = np.append(s[1:], len(ids))
    return pa.RecordBatch.from_arrays([pa.array(ids[s]), pa.array(hashes[s]), pa.array([data[a:b].tobytes() for a, b in zip(s, e)], pa.binary())], names=["rid1", "rid2", "data"])


_RECORDS = "rid1 long, rid2 long, data binary"


def keyed(docs: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """rid1, rid2, text and, as a struct, the columns that go along. All joins use these rows, so they shuffle once."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    extra = [F.struct(*keep).alias("extra")] if keep else []
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("rid1"), F.xxhash64(text).alias("rid2"), text.alias("text"), *extra)


def _share(wanted: int, of: int):
    """A test of (rid1, rid2) that about ``wanted`` of so many rows pass, the same ones each time."""
    return F.pmod(F.xxhash64("rid2", "rid1"), F.lit(1_000_003)) <= int(1_000_003 * min(1.0, wanted / max(1, of)))


def common_grams(kind: Kind, docs: DataFrame, rows: int) -> np.ndarray:
    """Hashes of k-grams that a sample of documents shows to be common: a bounded, sorted array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = buffers(batch.column(0))
            found = document_anchors(kind, data, at)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(found[["h", "doc"]])["h"].astype(np.int64))], names=["h"])

    some = docs.filter(_share(LOOK_DOCS, rows)).select("text").mapInArrow(run, "h long")
    often = some.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= COMMON).orderBy(F.desc("n"), "h").limit(MOST_COMMON)
    return np.array(sorted(r["h"] for r in often.collect()), dtype=np.int64).view(np.uint64)


def candidates(kind: Kind, docs: DataFrame, parts: int, common: np.ndarray) -> DataFrame:
    """Step 1: the suffixes whose k-gram occurs elsewhere, REP records per document."""

    def records(rows: np.ndarray, flags: np.ndarray) -> np.ndarray:
        out = np.empty(len(rows), dtype=REP)
        for f in ("pos", "o1", "o2"):
            out[f] = rows[f]
        out["flags"] = flags
        return out

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            data, at = buffers(batch.column(2))
            rows = document_anchors(kind, data, at)
            if not len(rows):
                continue
            known = np.searchsorted(common, rows["h"])
            known = common[np.minimum(known, len(common) - 1)] == rows["h"] if len(common) else np.zeros(len(rows), dtype=bool)
            to = ((rows["h"] >> np.uint64(8)) % np.uint64(parts)).astype(np.int32)
            to[known] = parts  # these need no meeting: any one bucket takes them, see below
            order = np.argsort(to, kind="stable")
            s = _starts(to[order])
            dest, blob, docs_of, final = [], [], [], []
            for a, b in zip(s, np.append(s[1:], len(order))):
                bucket, part = int(to[order][a]), rows[order[a:b]].copy()
                used = np.unique(part["doc"])
                part["doc"] = np.searchsorted(used, part["doc"])
                final.append(bucket == parts)
                dest.append(int(hashes[used[0]] % parts) if bucket == parts else bucket)
                blob.append(part.view(np.uint8).reshape(len(part), ENTRY.itemsize).T.tobytes())  # by byte: the upper ones compress
                docs_of.append(np.stack([ids[used], hashes[used]]).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(dest, pa.int32()), pa.array(blob, pa.binary()), pa.array(docs_of, pa.binary()), pa.array(final, pa.bool_())], names=["bucket", "entries", "docs", "final"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids, hashes = [], [], []
        for batch in batches:
            for blob, table, final in zip(batch.column(1), batch.column(2), batch.column(3).to_pylist()):
                rows = np.ascontiguousarray(np.frombuffer(blob.as_py(), dtype=np.uint8).reshape(ENTRY.itemsize, -1).T).view(ENTRY)[:, 0]
                names = np.frombuffer(table.as_py(), dtype=np.int64).reshape(2, -1)
                if final:
                    yield _by_document(names[0][rows["doc"]], names[1][rows["doc"]], records(rows, np.uint8(ASKS)))
                else:
                    held.append(rows)
                    ids.append(names[0][rows["doc"]])
                    hashes.append(names[1][rows["doc"]])
        if not held:
            return
        rows, ids, hashes = np.concatenate(held), np.concatenate(ids), np.concatenate(hashes)
        order = np.lexsort((ids, rows["h"]))
        h, doc = rows["h"][order], ids[order]
        s = _starts(h)
        size = np.diff(np.append(s, len(h)))
        if kind.words:  # a smaller document must have it; the smallest one's own windows stay
            asks = doc > np.repeat(doc[s], size)
            stays = np.repeat(np.logical_or.reduceat(asks, s), size)
        else:
            asks = stays = np.repeat(size > 1, size)
        at = order[stays]
        if len(at):
            yield _by_document(ids[at], hashes[at], records(rows[at], np.where(asks[stays], ASKS, 0).astype(np.uint8)))

    sent = docs.mapInArrow(send, "bucket int, entries binary, docs binary, final boolean")
    return sent.repartitionById(parts, "bucket").mapInArrow(meet, _RECORDS)


@dataclass
class Place:
    """Groups of suffixes by their leading tokens. ``cuts`` are border strings (ranges), or ``longer`` holds the
    prefixes that are lengthened by a token (prefixes, by hash). Called with a suffix, it gives its group and the
    smallest offset at which a window of it might have an equal in another group."""

    kind: Kind
    groups: int
    cuts: list[bytes] | None = None
    longer: set[bytes] = field(default_factory=set)

    @property
    def divides(self) -> bool:
        """Whether any border runs through a k-gram."""
        short = self.kind.gram * self.kind.unit
        return bool(self.longer) or any(len(c) > short for c in self.cuts or ())

    def __call__(self, right: bytes) -> tuple[int, int]:
        kind, short = self.kind, self.kind.gram * self.kind.unit
        if self.cuts is None:
            n = short
            while n <= len(right) and right[:n] in self.longer:
                n += kind.unit
            return crc32(right[:n]) % self.groups, kind.window + 1 if n == short else kind.window - n // kind.unit + 1
        at, shared = bisect_right(self.cuts, right[:KEY]), 0
        for cut in self.cuts[max(0, at - 1) : at + 1]:
            if len(cut) > short and right.startswith(cut[:short]):
                n = short
                while n < KEY - 1 and right[n : n + 1] == cut[n : n + 1] != b"":
                    n += 1
                shared = max(shared, n)
        return at, kind.window - shared // kind.unit if shared else kind.window + 1


def ranges_of(kind: Kind, sample: list[bytes], groups: int) -> Place:
    """Borders at the quantiles of a sample: at its k-gram, so that none is divided, unless one k-gram fills several
    groups; then as many more tokens as tell its quantiles apart (``KEY`` bytes at most)."""
    keys, short, cuts = sorted(r[:KEY] for r in sample), kind.gram * kind.unit, set()
    for i in range(1, groups) if keys else ():
        key = keys[len(keys) * i // groups]
        cuts.add(key if key[:short] in cuts else key[:short])
    return Place(kind, len(cuts) + 1, sorted(cuts))


def prefixes_of(kind: Kind, sample: list[bytes], groups: int) -> Place:
    """Prefixes of variable length: a k-gram, lengthened token by token while a sample shows more than a group's share."""
    longer, most = set(), max(8, len(sample) / groups)
    n, left = kind.gram * kind.unit, sample
    while left and n < KEY:
        found = {p for p, c in Counter(r[:n] for r in left if len(r) >= n).items() if c > most}
        longer |= found
        left, n = [r for r in left if r[:n] in found], n + kind.unit
    return Place(kind, groups, None, longer)


def contexts_of(kind: Kind, tokens: np.ndarray, reps: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """Tokens from each anchor on, and backwards before it, as far as the windows it owns reach."""
    p = reps["pos"].astype(np.int64)
    right = [tokens[a : a + kind.window - o].tobytes() for a, o in zip(p, reps["o1"].tolist())]
    left = [tokens[a - o : a][::-1].tobytes() for a, o in zip(p, reps["o2"].tolist())]
    return right, left


def _asked(docs: DataFrame, found: DataFrame) -> DataFrame:
    reps = found.groupBy("rid1", "rid2").agg(F.collect_list("data").alias("data"))
    return docs.select("rid1", "rid2", "text").join(reps, ["rid1", "rid2"])


def _each_document(kind: Kind, batch: pa.RecordBatch):
    for rid1, rid2, text, data in zip(*(batch.column(c) for c in ("rid1", "rid2", "text", "data"))):
        raw = np.frombuffer((text.as_py() or "").encode(), dtype=np.uint8)
        tokens, _ = kind.tokens(raw, np.array([0, len(raw)]))
        yield rid1.as_py(), rid2.as_py(), tokens, np.unique(np.frombuffer(b"".join(data.as_py()), dtype=REP))


def sampled_suffixes(kind: Kind, docs: DataFrame, found: DataFrame, rows: int) -> list[bytes]:
    """Leading bytes of some suffixes of a bounded sample of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, tokens, reps in _each_document(kind, batch):
                reps = reps[:: -(-len(reps) // SAMPLE_SUFFIXES)]
                yield pa.RecordBatch.from_arrays([pa.array([r[:KEY] for r in contexts_of(kind, tokens, reps)[0]], pa.binary())], names=["lead"])

    # Bounded: SAMPLE_DOCS rows of at most 512 records.
    some = found.filter(_share(SAMPLE_DOCS, rows)).select("rid1", "rid2", F.array(F.substring("data", 1, 512 * REP.itemsize)).alias("data")).limit(SAMPLE_DOCS)
    joined = docs.select("rid1", "rid2", "text").join(F.broadcast(some), ["rid1", "rid2"])
    return [r["lead"] for r in joined.mapInArrow(run, "lead binary").collect()]


def together(kind: Kind, right: list[bytes], left: list[bytes], ids: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which suffixes go on, which repeat for certain, flags): equal ones, token by token, are put together."""
    first: dict[tuple[bytes, bytes], int] = {}
    slot = np.array([first.setdefault(key, i) for i, key in enumerate(zip(right, left))], dtype=np.int64)
    lead = slot == np.arange(len(slot))
    if kind.words:
        least = np.full(len(slot), np.iinfo(np.int64).max)
        np.minimum.at(least, slot, ids)
        certain = ids > least[slot]
        # The smallest document's suffixes stay, one of them at least; so does each that awaits a decision.
        rest = np.flatnonzero(~certain)
        keep = np.zeros(len(slot), dtype=bool)
        keep[rest[np.unique(slot[rest], return_index=True)[1]]] = True
        keep |= ~certain & (flags & ASKS > 0)
        return keep, certain & (flags & ASKS > 0), flags
    many = np.bincount(slot, minlength=len(slot))
    several = np.maximum.reduceat((flags & MANY)[np.argsort(slot, kind="stable")], np.flatnonzero(np.diff(np.sort(slot), prepend=-1)))
    standing = np.zeros(len(slot), dtype=bool)
    standing[np.flatnonzero(lead)] = (several > 0) | (many[lead] > 1)
    again = standing[slot]
    return lead, again & (flags & ASKS > 0), np.where(again, MANY, flags).astype(np.uint8)


def matrix(rows: list[bytes], width: int) -> np.ndarray:
    """Byte strings as rows of big-endian 64-bit words, zero-padded."""
    flat = b"".join(r.ljust(width, b"\0") for r in rows)
    return np.frombuffer(flat, dtype=">u8").reshape(len(rows), width // 8).astype(np.uint64)


def multikey_sort(m: np.ndarray) -> np.ndarray:
    """Order of the rows by multikey quicksort, all runs of a round at once: a run is split by a pivot of its current
    word into smaller, equal and larger; the equal ones go on to the next word."""
    n, width = m.shape
    order, depth = np.arange(n), np.zeros(n, dtype=np.int64)
    start, active = np.zeros(n, dtype=np.int64), np.arange(n if n > 1 else 0)
    while len(active):
        word = m[order[active], depth[active]]
        heads = _starts(start[active])
        size = np.diff(np.append(heads, len(active)))
        pivot = np.sort([word[heads], word[heads + size // 2], word[heads + size - 1]], axis=0)[1]
        pivot, run = np.repeat(pivot, size), np.repeat(np.arange(len(heads)) * 3, size)
        side = (word >= pivot).astype(np.int64) + (word > pivot)
        by = np.argsort(run + side, kind="stable")
        order[active] = order[active][by]
        heads = _starts((run + side)[by])
        size = np.diff(np.append(heads, len(active)))
        start[active] = np.repeat(active[heads], size)
        depth[active] += side[by] == 1
        active = active[(np.repeat(size, size) > 1) & (depth[active] < width)]
    return order


def common_prefix(m: np.ndarray, order: np.ndarray, unit: int) -> np.ndarray:
    """Tokens (of unit bytes) that each sorted row shares with the one before it; -1 for the first."""
    out = np.full(len(order), -1, dtype=np.int64)
    for at in range(1, len(order), 8192):
        a, b = m[order[at - 1 : at + 8191]], m[order[at : at + 8192]]
        diff = a[: len(b)] ^ b
        has = diff.any(axis=1)
        word = np.where(has, (diff != 0).argmax(axis=1), m.shape[1])
        value = diff[np.arange(len(b)), np.minimum(word, m.shape[1] - 1)]
        zero = np.zeros(len(b), dtype=np.int64)
        for shift in (56, 48, 40, 32, 24, 16, 8):
            zero += (value >> np.uint64(shift)) == 0
        out[at : at + len(b)] = (word * 8 + np.where(has, zero, 0)) // unit
    return out


def equal_windows(kind: Kind, right: np.ndarray, left: np.ndarray, ids: np.ndarray, o1: np.ndarray, o2: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix, offset) of the windows that repeat, of those that await a decision.

    Windows at offset o are equal where the suffixes share window - o tokens to the right and o to the left: the
    intervals of the sorted orders at those depths, that is, the nodes of the suffix trees."""
    unit = kind.unit
    by_right, by_left = multikey_sort(right), multikey_sort(left)
    prefix, back = common_prefix(right, by_right, unit), common_prefix(left, by_left, unit)
    found_s, found_o = [], []
    for o in range(int(o1.min()), int(o2.max()) + 1):
        own = np.flatnonzero((o1 <= o) & (o <= o2))
        if len(own) < 2:
            continue
        node_r, node_l = np.empty(len(ids), np.int64), np.empty(len(ids), np.int64)
        node_r[by_right] = np.cumsum(prefix < kind.window - o)
        node_l[by_left] = np.cumsum(back < o)
        key = node_r[own] * (len(ids) + 1) + node_l[own]
        order = np.lexsort((ids[own], key))
        key = key[order]
        s = _starts(key)
        counts = np.diff(np.append(s, len(key)))
        mine = own[order]
        again = ids[mine] > np.repeat(ids[mine][s], counts) if kind.words else np.repeat(counts > 1, counts)
        hit = mine[again & (flags[mine] & ASKS > 0)]
        found_s.append(hit)
        found_o.append(np.full(len(hit), o))
    if not found_s:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_s), np.concatenate(found_o)


_SUFFIX = "bucket int, rid1 long, rid2 long, pos int, o int, right binary, left binary"


def compare(kind: Kind, docs: DataFrame, found: DataFrame, place: Place) -> DataFrame:
    """Step 2: ranges of repeated windows within the groups."""
    names = [f.split()[0] for f in _SUFFIX.split(", ")]

    def settled(ids, hashes, spans, at) -> pa.RecordBatch:
        """Ranges that are certain travel along as rows without a suffix."""
        r = _by_document(ids, hashes, spans)
        n = len(r)
        none = pa.nulls(n, pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, at, dtype=np.int32)), r.column(0), r.column(1), pa.array(np.zeros(n, np.int32)), pa.array(np.zeros(n, np.int32)), none, r.column(2)], names=names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush():
            right, left = [x for r, _, _, _, _ in held for x in r], [x for _, l, _, _, _ in held for x in l]
            reps = np.concatenate([r for _, _, r, _, _ in held])
            ids, hashes = (np.concatenate([np.full(len(x[2]), x[k]) for x in held]) for k in (3, 4))
            keep, certain, flags = together(kind, right, left, ids, reps["flags"])
            if certain.any():
                yield settled(ids[certain], hashes[certain], _spans(reps[certain]), int(hashes[0] % place.groups))
            at = np.flatnonzero(keep)
            o = reps["o1"].astype(np.int32) | reps["o2"].astype(np.int32) << 8 | flags.astype(np.int32) << 16
            for a in range(0, len(at), 4096):
                some = at[a : a + 4096]
                columns = [pa.array([place(right[i])[0] for i in some], pa.int32()), pa.array(ids[some]), pa.array(hashes[some]), pa.array(reps["pos"][some].astype(np.int32)), pa.array(o[some])]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([right[i] for i in some], pa.binary()), pa.array([left[i] for i in some], pa.binary())], names=names)

        for batch in batches:
            for rid1, rid2, tokens, reps in _each_document(kind, batch):
                for at in range(0, len(reps), TOGETHER):
                    part = reps[at : at + TOGETHER]
                    held.append((*contexts_of(kind, tokens, part), part, rid1, rid2))
                    n += len(part)
                    if n >= TOGETHER:
                        yield from flush()
                        held, n = [], 0
        if held:
            yield from flush()

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            has = batch.column("right").is_valid()
            done = batch.filter(pa.compute.invert(has))
            if len(done):
                yield pa.RecordBatch.from_arrays([done.column("rid1"), done.column("rid2"), done.column("left")], names=["rid1", "rid2", "data"])
            held.append(batch.filter(has))
        t = pa.Table.from_batches(held) if held else None
        if t is None or not len(t):
            return
        get = lambda c: t[c].to_numpy()
        rows = np.zeros(len(t), dtype=REP)
        rows["pos"], rows["o1"], rows["o2"] = get("pos"), get("o") & 255, get("o") >> 8 & 255
        right, left = t["right"].to_pylist(), t["left"].to_pylist()
        keep, certain, flags = together(kind, right, left, get("rid1"), (get("o") >> 16).astype(np.uint8))
        if certain.any():
            yield _by_document(get("rid1")[certain], get("rid2")[certain], _spans(rows[certain]))
        at = np.flatnonzero(keep)
        wide = lambda n: max(8, -(-n * kind.unit // 8) * 8)
        first = matrix([right[i] for i in at], wide(kind.window))
        order = multikey_sort(first)
        shared = common_prefix(first, order, kind.unit)
        # Alone in its k-gram: nothing to compare.
        near = np.zeros(len(at), dtype=bool)
        near[order] = np.maximum(shared, np.append(shared[1:], -1)) >= kind.gram
        at, first = at[near], first[near]
        if not len(at) or not (flags[at] & ASKS).any():
            return
        back = matrix([left[i] for i in at], wide(max(1, kind.reach - 1)))
        s, o = equal_windows(kind, first, back, get("rid1")[at], rows["o1"][at].astype(np.int64), rows["o2"][at].astype(np.int64), flags[at])
        if len(s):
            out = np.empty(len(s), dtype=SPAN)
            out["x1"] = out["x2"] = rows["pos"][at][s] - o
            yield _by_document(get("rid1")[at][s], get("rid2")[at][s], out)

    return _asked(docs, found).mapInArrow(cut, _SUFFIX).repartitionById(place.groups, "bucket").mapInArrow(group, _RECORDS)


def across(kind: Kind, docs: DataFrame, found: DataFrame, place: Place) -> DataFrame:
    """Step 3: windows that may have an equal beyond their group's border, one row each, met by a 128-bit digest; equal
    ones that come together are one row."""

    names = ["w", "rid1", "rid2", "x", "flags", "n", "sure"]

    def reduced(w: list[bytes], rid1: np.ndarray, rid2: np.ndarray, x: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
        """One row of equal windows goes to the meeting; the others that await a decision have it."""
        slot = np.unique(np.frombuffer(b"".join(w), dtype="V16"), return_inverse=True)[1]
        count = np.bincount(slot)[slot]
        if kind.words:
            least = np.full(slot.max() + 1, np.iinfo(np.int64).max)
            np.minimum.at(least, slot, rid1)
            sure = (rid1 > least[slot]) & (f & ASKS > 0)
            stays = rid1 == least[slot]
            one = np.zeros(len(w), dtype=bool)
            one[np.flatnonzero(stays)[np.unique(slot[stays], return_index=True)[1]]] = True
            goes = one | stays & (f & ASKS > 0)
        else:
            sure = (count > 1) & (f & ASKS > 0)
            goes = np.zeros(len(w), dtype=bool)
            goes[np.unique(slot, return_index=True)[1]] = True
        f = np.where(sure, 0, f)
        at = np.flatnonzero(goes | sure)
        n = np.where(goes, 1 if kind.words else count, 0)
        columns = [pa.array([w[i] for i in at], pa.binary()), pa.array(rid1[at]), pa.array(rid2[at]), pa.array(x[at]), pa.array(f[at].astype(np.int32)), pa.array(n[at].astype(np.int64)), pa.array(sure[at])]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, rows = [], []
        for batch in batches:
            for rid1, rid2, tokens, reps in _each_document(kind, batch):
                for rep in reps:
                    p, f = int(rep["pos"]), int(rep["flags"])
                    right = tokens[p : p + kind.window - int(rep["o1"])].tobytes()
                    for o in range(max(int(rep["o1"]), place(right)[1]), int(rep["o2"]) + 1):
                        w.append(hashlib.blake2b(tokens[p - o : p - o + kind.window].tobytes(), digest_size=16).digest())
                        rows.append((rid1, rid2, p - o, f))
                if len(w) >= 1 << 17:
                    yield reduced(w, *np.array(rows, dtype=np.int64).T)
                    w, rows = [], []
        if w:
            yield reduced(w, *np.array(rows, dtype=np.int64).T)

    # Used twice, from one shuffle of the documents: the same as that of step 2.
    rows = _asked(docs, found).mapInArrow(windows, "w binary, rid1 long, rid2 long, x long, flags int, n long, sure boolean")
    met = rows.filter("n > 0").groupBy("w").agg(F.sum("n").alias("times"), F.min("rid1").alias("least")).filter("times > 1")
    again = F.col("rid1") > F.col("least") if kind.words else F.col("times") > 1
    told = (F.col("flags").bitwiseAND(ASKS) > 0) & F.coalesce(again, F.lit(False))
    hits = rows.join(met, "w", "left").filter(F.col("sure") | told).select("rid1", "rid2", "x")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(2).to_numpy()
            out = np.empty(len(x), dtype=SPAN)
            out["x1"] = out["x2"] = x
            if len(x):
                yield _by_document(batch.column(0).to_numpy(), batch.column(1).to_numpy(), out)

    return hits.mapInArrow(pack, _RECORDS)


def repeated_windows(kind: Kind, docs: DataFrame, id_col: str, text_col: str, placed, keep: tuple[str, ...] = (), group_bytes: int = GROUP_BYTES) -> tuple[DataFrame, DataFrame]:
    """(keyed documents, their repeated windows: rid1, rid2, data as an array of SPAN bytes). ``placed`` makes the
    ``Place`` of a sample of suffixes and a number of groups."""
    spark = docs.sparkSession
    small_batches(spark)
    base = keyed(docs, id_col, text_col, keep)
    size = base.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("text")).alias("bytes")).first()
    parts = parts_for(spark, size["bytes"] or 0)
    found = written(candidates(kind, base.select("rid1", "rid2", "text"), parts, common_grams(kind, base, size["rows"])), "suffixes")
    size = found.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("data")).alias("bytes")).first()
    groups = parts_for(spark, (size["bytes"] or 0) // REP.itemsize * (kind.window * 2 * kind.unit), group_bytes)
    place = placed(kind, sampled_suffixes(kind, base, found, size["rows"]), groups)
    ranges = compare(kind, base, found, place)
    if place.divides:
        ranges = ranges.unionByName(across(kind, base, found, place))
    return base, ranges.groupBy("rid1", "rid2").agg(F.collect_list("data").alias("data"))


def covered(data: list[bytes] | None, n: int, window: int) -> np.ndarray:
    """Which of n tokens the windows cover."""
    if not data:
        return np.zeros(n, dtype=bool)
    spans = np.frombuffer(b"".join(data), dtype=SPAN)
    step = np.zeros(n + 1, dtype=np.int64)
    np.add.at(step, spans["x1"].astype(np.int64), 1)
    np.add.at(step, np.minimum(spans["x2"].astype(np.int64) + window, n), -1)
    return np.cumsum(step[:-1]) > 0
