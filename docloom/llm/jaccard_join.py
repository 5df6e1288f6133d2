"""Operator 7, n-gram Jaccard join: a MinHash LSH forest with exact verification.

A document is the set of its five-word shingles (a shorter one is the single shingle of all its words). Equal sets
are one node. Each of ``TREES`` trees gives a node a string of ``DEPTH`` MinHash values; the sorted strings of a tree are
its prefix trie, whose inner nodes are runs of neighbours with a common prefix. A prefix of ``LEAST`` values is so short
that a pair at the similarity threshold misses the common prefix in all trees with a chance far below
1 - ``RECALL``. Where such a prefix is common (more than ``CROWD`` nodes share it), its nodes use longer ones: each node
starts from whole strings in its crowded trees and shortens the one where that adds the fewest candidates for the
chance it gains, until its recall, over all trees, reaches ``RECALL``. The trie is cut above what any of the nodes
below needs, so that the parts are disjoint and every node gets at least its recall. Nodes of one part are candidates,
and every candidate pair is verified on the shingle sets.

Distribution. Strings are shuffled once: range-partitioned and sorted, the node being part of the order, so a common
prefix spreads over partitions; runs that touch a border are added up, and only the strings of runs go on. Parts met once
are dropped; parts with the same members are handled
once (order-free member checksums); large ones are dealt into tiles of at most ``TILE`` nodes or ``TILE_SHINGLES``
shingles a side, so no task holds a whole part, and a pair counts only in the first tree where it meets. A tile
returns one row per linked node (number of links, a spanning edge), never pairs. Classes are the connected components,
by alternating large and small stars with every round written to the shared folder.

Defined results: null, empty and blank texts have no shingles: their class is their own id, without links. Copies
(equal sets) share a class. Rows that repeat an id are separate documents. The class id is its smallest doc_id.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import parts_for, small_batches, table, written
from docloom.llm.words import buffers, gram_hashes, mixed, slices, word_hashes, word_spans

SHINGLE, SIMILARITY = 5, (4, 5)
TREES, DEPTH, LEAST, RECALL = 24, 8, 3, 0.99999
#: Nodes that share a shortest prefix before longer ones are used; sides of a tile at most.
CROWD = 512
TILE, TILE_SHINGLES = 512, 1 << 20
#: Words of 64 bits that mark the identifiers whose texts are read again (``likely``), at most.
MARKS = 1 << 18
SEED = 77


def misses(length: int, similarity: float = SIMILARITY[0] / SIMILARITY[1]) -> float:
    """Logarithm of the chance that two sets of this similarity differ within the first values of one tree."""
    return math.log1p(-(similarity**length))


def shingle_sets(column: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted distinct shingles of each row), in runs of rows."""
    data, at = buffers(column)
    for i, j in slices(at):
        part, cuts = data[at[i] : at[j]], at[i : j + 1]
        starts, ends = word_spans(part, cuts)
        words = word_hashes(part, starts, ends)
        grams = gram_hashes(words, SHINGLE)
        first = np.searchsorted(starts, cuts - cuts[0])
        sets = []
        for a, b in zip(first[:-1], first[1:]):
            if b - a >= SHINGLE:
                sets.append(np.unique(grams[a : b - SHINGLE + 1]))
            else:
                sets.append(gram_hashes(words[a:b], int(b - a)) + np.uint64(b - a) if b > a else np.zeros(0, np.uint64))
        yield i, sets


def signature_strings(sets: list[np.ndarray], trees: int) -> list[bytes]:
    """Per set, the strings of its trees one after the other: DEPTH MinHash values of 16 bits each. No set is empty."""
    rng = np.random.default_rng(SEED)
    factors = (rng.integers(0, 1 << 31, (trees, DEPTH), dtype=np.uint32) << np.uint32(1)) + np.uint32(1)
    masks = rng.integers(0, 1 << 32, (trees, DEPTH), dtype=np.uint32)
    flat = np.concatenate(sets)
    flat = (flat ^ flat >> np.uint64(32)).astype(np.uint32)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.zeros((len(sets), trees, DEPTH), dtype=np.uint32)
    for t in range(trees):
        for d in range(DEPTH):
            out[:, t, d] = np.minimum.reduceat((flat ^ masks[t, d]) * factors[t, d], at)
    out = (mixed(out.astype(np.uint64)) >> np.uint64(48)).astype(">u2")
    return [row.tobytes() for row in out]


def fingerprint(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, id_col: str, text_col: str, trees: int, more: tuple[str, ...] = ()) -> DataFrame:
    """id, node (null without words), n shingles, strings, and the struct ``more`` of columns that go along."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, sets in shingle_sets(batch.column(1)):
                has = [k for k, s in enumerate(sets) if len(s)]
                keys: list = [None] * len(sets)
                if has:
                    for k, row in zip(has, signature_strings([sets[k] for k in has], trees)):
                        keys[k] = row
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, len(sets)), batch.column(2).slice(i, len(sets)), pa.array([fingerprint(s) if len(s) else None for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary())],
                    names=["id", "more", "node", "n", "strings"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.struct(F.lit(0).alias("_"), *more).alias("more"))
    schema = T.StructType([rows.schema["id"], rows.schema["more"]]).add("node", T.BinaryType()).add("n", T.LongType()).add("strings", T.BinaryType())
    return rows.mapInArrow(run, schema)


def runs_of(strings: DataFrame, parts: int, crowd: int) -> tuple[DataFrame, DataFrame]:
    """The inner nodes of the tries that matter: tree, level, prefix, members, weight and two checksums of the members.
    And node, tree, string of the members of the shortest prefixes.

    Sorted neighbours with a common prefix are a run; levels below the shortest are given where a run may be crowded.
    A string alone in its run is a member of nothing; only at a border, where its run may go on, it is given too."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        t = pa.Table.from_batches(held)
        tree, n = t["tree"].to_numpy(), t["n"].to_numpy()
        text = np.frombuffer(b"".join(t["string"].to_pylist()), dtype=">u2").reshape(len(tree), DEPTH)
        node = np.frombuffer(b"".join(t["node"].to_pylist()), dtype=np.int64).reshape(len(tree), 2)
        same = np.where(tree[1:] == tree[:-1], np.cumprod(text[1:] == text[:-1], axis=1).sum(axis=1), -1)
        wide = np.zeros(len(tree), dtype=bool)
        for level in range(LEAST, DEPTH + 1):
            s = np.flatnonzero(np.concatenate([[True], same < level]))
            size = np.diff(np.append(s, len(tree)))
            border = (s == 0) | (s + size == len(tree))
            if level == LEAST:
                take = border | (size > 1)
                wide = np.repeat(border | (size > crowd), size)
                inside = t.select(["tree", "string", "node"]).filter(pa.array(np.repeat(take, size)))
                for batch in inside.to_batches(max_chunksize=1 << 16):
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).cast(pa.int32()), pa.nulls(len(batch), pa.int32()), *batch.columns[1:], *[pa.nulls(len(batch), pa.int64())] * 4],
                        names=["tree", "level", "key", "node", "members", "weight", "x", "y"],
                    )
            else:
                take = wide[s] & (border | (size > 1))
            if take.any():
                at = s[take]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tree[at].astype(np.int32)), pa.array(np.full(len(at), level, np.int32)), pa.array([text[k, :level].tobytes() for k in at], pa.binary()), pa.nulls(len(at), pa.binary()), pa.array(size[take].astype(np.int64))]
                    + [pa.array(v) for v in (np.add.reduceat(n, s)[take], np.bitwise_xor.reduceat(node[:, 0], s)[take], np.bitwise_xor.reduceat(node[:, 1], s)[take])],
                    names=["tree", "level", "key", "node", "members", "weight", "x", "y"],
                )

    order = ("tree", "string", "node")
    schema = "tree int, level int, key binary, node binary, members long, weight long, x long, y long"
    found = written(strings.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(scan, schema), "strings")
    runs = found.filter("level IS NOT NULL").groupBy("tree", "level", "key").agg(F.sum("members").alias("members"), F.sum("weight").alias("weight"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y")).filter("members > 1")
    return written(runs, "runs"), found.filter("level IS NULL").select("node", "tree", F.col("key").alias("string"))


def lengths_needed(sizes: np.ndarray, crowded: np.ndarray, recall: float) -> np.ndarray:
    """Prefix lengths, nodes x trees, from the members at each length (nodes x trees x levels): crowded trees start from
    whole strings and are shortened where a gained chance costs the fewest members, until the recall is reached."""
    chance = np.array([misses(k) for k in range(LEAST, DEPTH + 1)])
    at = np.where(crowded, DEPTH - LEAST, 0)
    target, rows = math.log1p(-recall), np.arange(len(at))
    for _ in range(at.shape[1] * (DEPTH - LEAST)):
        short = chance[at].sum(axis=1) > target
        if not (short & (at > 0).any(axis=1)).any():
            break
        below = np.maximum(at - 1, 0)
        gain = chance[at] - chance[below]
        cost = 1 + np.take_along_axis(sizes, below[:, :, None], 2)[:, :, 0] - np.take_along_axis(sizes, at[:, :, None], 2)[:, :, 0]
        pick = np.where(at > 0, gain / cost, -1).argmax(axis=1)
        at[rows, pick] -= short & (at[rows, pick] > 0)
    return at + LEAST


def _needs(trees: int, recall: float):
    """Crowded strings of a node, with members by level -> the length that each needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column(0).to_pylist()
            sizes = np.ones((len(nodes), trees, DEPTH - LEAST + 1), dtype=np.int64)
            crowded, strings = np.zeros((len(nodes), trees), dtype=bool), {}
            for i, found in enumerate(batch.column(1).to_pylist()):
                for e in found:
                    sizes[i, e["tree"], e["level"] - LEAST] = e["members"]
                    crowded[i, e["tree"]] = True
                    strings[i, e["tree"]] = e["string"]
            need = lengths_needed(sizes, crowded, recall)
            keys = list(strings)
            yield pa.RecordBatch.from_arrays(
                [pa.array([nodes[i] for i, _ in keys], pa.binary()), pa.array([t for _, t in keys], pa.int32()), pa.array([strings[k] for k in keys], pa.binary()), pa.array([int(need[k]) for k in keys], pa.int32())],
                names=["node", "tree", "string", "need"],
            )

    return run


def crowded_parts(strings: DataFrame, runs: DataFrame, trees: int, recall: float, crowd: int) -> DataFrame:
    """node, tree, key: the part of the trie that each node of a crowded prefix belongs to."""
    crowds = runs.filter((F.col("level") == LEAST) & (F.col("members") > crowd)).select("tree", F.col("key").alias("short"))
    inside = strings.select("node", "tree", "string", F.substring("string", 1, 2 * LEAST).alias("short")).join(crowds, ["tree", "short"])
    at = lambda length: F.expr(f"substring(string, 1, 2 * {length})")
    levels = inside.withColumn("level", F.explode(F.sequence(F.lit(LEAST), F.lit(DEPTH)))).withColumn("key", at("level"))
    sized = levels.join(runs.select("tree", "level", "key", "members"), ["tree", "level", "key"])
    needs = written(
        sized.groupBy("node").agg(F.collect_list(F.struct("tree", "level", "string", "members")).alias("found")).mapInArrow(_needs(trees, recall), "node binary, tree int, string binary, need int"), "needs"
    )
    # Cut the trie above whatever any string below a prefix needs.
    cuts = needs.select("tree", F.col("need").alias("level"), at("need").alias("key")).distinct()
    above = needs.withColumn("level", F.explode(F.sequence(F.lit(LEAST), F.col("need")))).withColumn("key", at("level"))
    return above.join(cuts, ["tree", "level", "key"]).groupBy("node", "tree").agg(F.min(F.struct("level", "key"))["key"].alias("key"))


def likely(rows: DataFrame, wanted: DataFrame, key: str, words: int = MARKS) -> DataFrame:
    """The rows whose ``key`` is in ``wanted``, and a few more, without a shuffle of the rows: every key sets one of
    64 x ``words`` bits. The words are broadcast: at most ``words`` rows of 12 bytes, however many keys there are."""
    word, bit = F.pmod(F.shiftrightunsigned(F.xxhash64(key), 6), F.lit(words)).cast("int"), F.expr(f"shiftleft(1L, cast(xxhash64({key}) & 63 AS int))")
    marks = wanted.groupBy(word.alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    return rows.withColumn("_word", word).join(F.broadcast(marks), "_word").filter(F.col("_bits").bitwiseAND(bit) != 0).drop("_word", "_bits")


def _sets_of(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, sets in shingle_sets(batch.column(0)):
                sets = [s for s in sets if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([fingerprint(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "shingles"])

    return docs.mapInArrow(run, "node binary, shingles binary")


def intersections(left: list[np.ndarray], right: list[np.ndarray], wanted: np.ndarray) -> np.ndarray:
    """Sizes of the intersections, where wanted; blocks of an incidence matrix, or pair by pair where few are wanted."""
    out = np.zeros(wanted.shape, dtype=np.int64)
    if wanted.sum() <= 4 * (len(left) + len(right)):
        for a, b in zip(*np.nonzero(wanted)):
            x, y = (left[a], right[b]) if len(left[a]) <= len(right[b]) else (right[b], left[a])
            at = np.searchsorted(y, x)
            at[at == len(y)] = 0
            out[a, b] = (y[at] == x).sum()
        return out
    both = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)), assume_unique=True)
    place = [[np.searchsorted(both, s[np.isin(s, both, assume_unique=True)]) for s in side] for side in (left, right)]
    dense, step = np.zeros(wanted.shape, dtype=np.float32), 4096
    for at in range(0, len(both), step):
        blocks = []
        for side in place:
            m = np.zeros((len(side), step), dtype=np.float32)
            for r, p in enumerate(side):
                lo, hi = np.searchsorted(p, [at, at + step])
                m[r, p[lo:hi] - at] = 1
            blocks.append(m)
        dense += blocks[0] @ blocks[1].T
    return np.where(wanted, dense.astype(np.int64), 0)


def _verify(tile: pa.Table, num: int, den: int) -> pa.Table:
    """Links of a tile: per linked node its linked texts and documents and the root of its local component."""
    nodes, n, copies, tree, side, same = (tile[c].to_pylist() for c in ("node", "n", "copies", "tree", "side", "same"))
    sets = [np.frombuffer(s, dtype=np.uint64) for s in tile["shingles"].to_pylist()]
    keys = np.array(tile["keys"].to_pylist(), dtype=np.int64)
    left = np.array([k for k in range(len(nodes)) if same[k] or side[k] == 0], dtype=np.int64)
    right = left if same[0] else np.array([k for k in range(len(nodes)) if side[k] == 1], dtype=np.int64)
    n, copies = np.array(n), np.array(copies)
    total = n[left][:, None] + n[right][None, :]
    small = np.minimum(n[left][:, None], n[right][None, :])
    wanted = (den + num) * small >= num * total
    for t in range(tree[0]):
        wanted &= keys[left, t][:, None] != keys[right, t][None, :]
    if same[0]:
        wanted &= np.triu(np.ones(wanted.shape, dtype=bool), 1)
    if not wanted.any():
        return pa.table({"node": pa.array([], pa.binary()), "texts": pa.array([], pa.int64()), "documents": pa.array([], pa.int64()), "root": pa.array([], pa.binary())})
    shared = intersections([sets[k] for k in left], [sets[k] for k in right], wanted)
    linked = wanted & ((den + num) * shared >= num * total)
    texts, documents, root = np.zeros(len(nodes), np.int64), np.zeros(len(nodes), np.int64), list(range(len(nodes)))
    np.add.at(texts, left, linked.sum(axis=1))
    np.add.at(texts, right, linked.sum(axis=0))
    np.add.at(documents, left, linked @ copies[right])
    np.add.at(documents, right, copies[left] @ linked)

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for a, b in zip(*np.nonzero(linked)):
        x, y = find(left[a]), find(right[b])
        if x != y:
            x, y = (x, y) if nodes[x] < nodes[y] else (y, x)
            root[y] = x
    on = np.flatnonzero(texts)
    return pa.table({"node": pa.array([nodes[k] for k in on], pa.binary()), "texts": pa.array(texts[on]), "documents": pa.array(documents[on]), "root": pa.array([nodes[find(k)] for k in on], pa.binary())})


def components(edges: DataFrame) -> DataFrame:
    """edges(u, v) -> (node, root): the smallest node of each component, for every node that has an edge."""
    state = lambda e: tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.shiftright(F.xxhash64("v", "u"), 24))).first())
    e = edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e, before = written(e, "components"), None
    now = state(e)
    while now != before and now[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        e = written(small.filter("u != v").distinct(), "components")
        before, now = now, state(e)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", trees: int = TREES, recall: float = RECALL, tile: int = TILE, crowd: int = CROWD, more: tuple[str, ...] = (), choose: bool = False) -> DataFrame:
    """One row per document: id, class_id, n_links (other documents of similarity 0.8 or more), n_texts (different sets among them); with ``more``, those columns too.

    With ``choose`` also chosen: true for one id and ``more`` of a class (the class id, by the smallest node and ``more``) and where there are no shingles."""
    num, den = SIMILARITY
    signed = written(signatures(docs, id_col, text_col, trees, more), "signatures")
    nodes = signed.filter("node IS NOT NULL").groupBy("node").agg(
        F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"), F.max("n").alias("n"), F.max("strings").alias("strings"),
        *([F.min(F.struct(F.col("id").isNull().alias("null"), "id", "more"))["more"].alias("first")] if choose else []),
    )
    nodes = written(nodes, "nodes")
    string = lambda t: F.substring("strings", 2 * DEPTH * t + 1, 2 * DEPTH)
    strings = nodes.select("node", "n", F.posexplode(F.array(*[string(t) for t in range(trees)])).alias("tree", "string"))
    parts = parts_for(docs.sparkSession, nodes.count() * trees * 64)
    runs, inside = runs_of(strings, parts, crowd)
    key = F.substring("string", 1, 2 * LEAST)
    met = runs.filter((F.col("level") == LEAST) & (F.col("members") <= crowd)).drop("level")
    places, longer = inside.select("node", "tree", key.alias("key")), None
    if runs.filter((F.col("level") == LEAST) & (F.col("members") > crowd)).limit(1).count():
        longer = written(crowded_parts(inside, runs, trees, recall, crowd), "parts")
        half = lambda k: F.conv(F.hex(F.substring("node", 8 * k + 1, 8)), 16, -10).cast("long")
        sized = longer.join(nodes.select("node", "n"), "node").groupBy("tree", "key").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("weight"), F.bit_xor(half(0)).alias("x"), F.bit_xor(half(1)).alias("y"))
        met = met.unionByName(sized.filter("members > 1"))
        places = places.unionByName(longer.filter(F.octet_length("key") > 2 * LEAST).select("node", "tree", "key"))  # the shortest are there
    kept = met.groupBy("members", "weight", "x", "y").agg(F.min(F.struct("tree", "key")).alias("k")).select(
        "k.tree", "k.key", F.greatest(F.ceil(F.col("members") / tile), F.ceil(F.col("weight") / TILE_SHINGLES)).cast("int").alias("sides")
    )
    members = written(places.join(kept, ["tree", "key"]), "members")
    own = F.pmod(F.xxhash64("node"), F.col("sides")).cast("int")
    placed = (
        members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
        .select("node", "tree", "key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), (F.col("own") > F.col("other")).cast("int").alias("side"), (F.col("own") == F.col("other")).alias("same"))
    )
    short = F.concat(*[F.substring("strings", 2 * DEPTH * t + 1, 2 * LEAST) for t in range(trees)])
    asked = members.select("node").distinct().join(nodes.select("node", "least", "n", "copies", short.alias("short")), "node")
    own_key = lambda t: F.substring("short", 2 * LEAST * t + 1, 2 * LEAST)
    if longer is not None:
        asked = asked.join(longer.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("tree", "key"))).alias("longer")), "node", "left")
        own_key = lambda t: F.coalesce(F.try_element_at("longer", F.lit(t)), F.substring("short", 2 * LEAST * t + 1, 2 * LEAST))
    asked = written(asked.select("node", "least", "n", "copies", F.array(*[F.xxhash64(own_key(t)) for t in range(trees)]).alias("keys")), "asked")
    texts = docs.select(F.col(id_col).cast("long").alias("least"), F.col(text_col).alias("text"))
    named = asked.filter("least IS NOT NULL").select("least").distinct()
    # An inner join with distinct ids: a semi join would be moved below the marks, where it shuffles every text.
    sets = _sets_of(likely(texts, named, "least").join(named, "least").select("text"))
    nameless = _sets_of(texts.filter("least IS NULL").select("text"))
    sets = sets.unionByName(nameless).groupBy("node").agg(F.max("shingles").alias("shingles"))
    asked = asked.drop("least").join(sets, "node")  # not written: both lie by node, as the join with the tiles needs them
    schema = "node binary, texts long, documents long, root binary"
    found = written(placed.join(asked, "node").groupBy("tree", "key", "a", "b").applyInArrow(lambda t: _verify(t, num, den), schema), "links")
    links = found.groupBy("node").agg(F.sum("texts").alias("texts"), F.sum("documents").alias("documents"))
    roots = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    classes = nodes.select("node", "least", "copies", *(["first"] if choose else [])).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    only = [F.min(F.struct(F.col("least").isNull().alias("null"), "least", "node"))["node"].alias("only")] if choose else []
    least = classes.groupBy("root").agg(F.min("least").alias("class_id"), *only)
    classes = classes.join(least, "root").join(links, "node", "left").select(
        "node", *(["first", "only"] if choose else []), "class_id", (F.col("copies") - 1 + F.coalesce("documents", F.lit(0))).alias("n_links"), F.coalesce("texts", F.lit(0)).alias("n_texts")
    )
    chosen = F.col("node").isNull() | (F.col("node") == F.col("only")) & F.col("id").eqNullSafe(F.col("class_id")) & F.col("more").eqNullSafe(F.col("first")) if choose else None
    return signed.select("id", "node", "more").join(classes, "node", "left").select(
        F.col("id").alias(id_col), F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("n_texts", F.lit(0)).cast("long").alias("n_texts"),
        *[F.col(f"more.{c}") for c in more], *([chosen.alias("chosen")] if choose else []),
    )


def op7_jaccard_join(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+') AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s FROM w),
n AS MATERIALIZED (SELECT s, md5(array_to_string(s, chr(10))) AS node, min(doc_id) AS least, count(*) AS copies, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY s),
g AS MATERIALIZED (SELECT node, n, unnest(s) AS g FROM n),
p AS (SELECT a.node AS a, b.node AS b, count(*) AS c, any_value(a.n) + any_value(b.n) AS t FROM g a JOIN g b ON a.g = b.g AND a.node < b.node GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM p WHERE 9 * c >= 4 * t),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT node, node AS root FROM n UNION SELECT e.b, r.root FROM r JOIN e ON r.node = e.a),
c AS (SELECT r.node, min(n.least) AS class_id FROM r JOIN n ON r.root = n.node GROUP BY 1),
k AS (SELECT e.a AS node, count(*) AS texts, sum(n.copies) AS documents FROM e JOIN n ON n.node = e.b GROUP BY 1)
SELECT s.doc_id, coalesce(c.class_id, s.doc_id) AS class_id, coalesce(n.copies - 1 + coalesce(k.documents, 0), 0)::BIGINT AS n_links, coalesce(k.texts, 0)::BIGINT AS n_texts
FROM s LEFT JOIN n USING (s) LEFT JOIN c ON c.node = n.node LEFT JOIN k ON k.node = n.node
"""
