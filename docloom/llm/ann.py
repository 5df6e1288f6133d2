"""Operator 2, approximate nearest neighbours: a hash-prefix forest.

``TREES`` trees each give every vector a string of ``BITS`` bits (signs of random projections) and keep the entries
sorted by it. A query descends in all trees to its longest matching prefix and ascends in all of them at the same
pace, one bit at a time, until the entries that share that many bits with it, summed over the trees, reach
``ASCENT`` times the entries of the forest (and hold k + 1 different ones for certain). An entry counts once for
every bit level at which it was met in a tree; the ``SHARE`` of the entries met most deeply and most often are
scored exactly, in double precision.

Distribution. Equal vectors are one entry with their smallest ids, so copies cost nothing. Entries are stored once
and dealt by a hash of their vector into blocks of at most ``BLOCK``, each with its own forest, built where it lies:
neither strings nor candidates are ever shuffled, only the entries, once, and the queries, which are sent to every
block and stream through it in batches. A block returns k + 1 entries a query. A task holds one block and one batch.

Defined results: vectors null, empty, zero or with null or non-finite components take no part, nor do null ids;
vectors of different lengths never meet; rows repeating an id count as other rows' candidates once per id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import table, written

TREES, BITS, ASCENT, SHARE = 192, 20, 3.0, 0.09
#: Entries of a block at most, and at least where blocks are fewer than tasks; entries scored at least; queries at once.
BLOCK, LEAST_BLOCK, LEAST, STEP = 1 << 16, 8192, 512, 64
SEED = 20240229
_PLANES: dict[tuple[int, int, int], np.ndarray] = {}


def planes(dim: int, trees: int, bits: int = BITS) -> np.ndarray:
    key = (dim, trees, bits)
    if key not in _PLANES:
        _PLANES[key] = np.random.default_rng([SEED, dim]).standard_normal((dim, trees * bits)).astype(np.float32)
    return _PLANES[key]


def hash_strings(vectors: np.ndarray, trees: int = TREES) -> np.ndarray:
    """rows x trees, BITS bits in an int32."""
    out = np.empty((len(vectors), trees), dtype=np.int32)
    weights = (1 << np.arange(BITS - 1, -1, -1)).astype(np.float32)
    for at in range(0, len(vectors), 256):
        unit = vectors[at : at + 256] / np.abs(vectors[at : at + 256]).max(axis=1, keepdims=True)
        bits = (unit.astype(np.float32) @ planes(vectors.shape[1], trees) > 0).reshape(len(unit), trees, BITS)
        out[at : at + 256] = bits.astype(np.float32) @ weights
    return out


def element(vectors: DataFrame, vec_col: str):
    """How components travel: as float where they are float, else as double; scores are double either way."""
    small = vectors.schema[vec_col].dataType.elementType.simpleString() == "float"
    return ("float", np.float32, pa.float32()) if small else ("double", np.float64, pa.float64())


def distinct_vectors(vectors: DataFrame, id_col: str, vec_col: str, keep: int, is_query) -> DataFrame:
    """One entry per distinct usable vector: vec, its ``keep`` smallest ids, and whether a query has it.

    Input partitions first reduce their own copies, so a hot vector is a few entries, not its rows."""
    c = F.col(vec_col)
    usable = F.col(id_col).isNotNull() & (F.size(c) > 0) & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(c, lambda x: x != 0)
    kind, dtype, arrow = element(vectors, vec_col)
    rows = vectors.filter(usable).select(F.col(id_col).cast("long").alias("id"), c.cast(f"array<{kind}>").alias("vec"), is_query.alias("q"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, list] = {}

        def flush():
            vecs = [np.frombuffer(v, dtype=dtype) for v in seen]
            yield pa.RecordBatch.from_arrays(
                [pa.array(vecs, pa.list_(arrow)), pa.array([sorted(e[0]) for e in seen.values()], pa.list_(pa.int64())), pa.array([e[1] for e in seen.values()], pa.bool_())],
                names=["vec", "ids", "q"],
            )
            seen.clear()

        for batch in batches:
            vec = batch.column(1)
            flat, ends = vec.flatten().to_numpy(zero_copy_only=False) + 0.0, np.cumsum(vec.value_lengths().to_numpy())
            for i, q, end, n in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), ends, vec.value_lengths().to_pylist()):
                entry = seen.setdefault(flat[end - n : end].tobytes(), [set(), False])
                entry[0].add(i)
                if len(entry[0]) > keep:
                    entry[0].discard(max(entry[0]))
                entry[1] = entry[1] or bool(q)
            if len(seen) > 65_536:
                yield from flush()
        yield from flush()

    return (
        rows.mapInArrow(run, f"vec array<{kind}>, ids array<long>, q boolean")
        .groupBy("vec")
        .agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep).alias("ids"), F.max("q").alias("q"))
    )


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Doubles times the power of two that brings each row's largest component below one; cosines stay the same."""
    v = vectors.astype(np.float64)
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1))[1][:, None])


class Forest:
    """Sorted strings of a block's vectors of one length, and the ascent of queries in them."""

    def __init__(self, vectors: np.ndarray, ids: list[list[int]], trees: int, ascent: float, share: float):
        self.trees, self.ids, self.n = trees, ids, len(vectors)
        self.v = scaled(vectors)
        self.norm = np.sqrt((self.v * self.v).sum(axis=1))
        self.least = np.array([i[0] for i in ids], dtype=np.int64)
        strings = hash_strings(self.v, trees).T
        order = np.argsort(strings, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(strings, order, axis=1)
        self.places = order.ravel()
        self.ascent, self.take = ascent, min(self.n, max(LEAST, math.ceil(share * self.n)))

    def intervals(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first, end) of the entries that share 0, 1, ... BITS bits: trees x queries x levels."""
        shift = np.arange(BITS, -1, -1)
        first = hash_strings(vectors, self.trees).T[:, :, None] >> shift << shift
        ask = np.concatenate([first, first + (np.int32(1) << shift)], axis=2).reshape(self.trees, -1)
        at = np.stack([np.searchsorted(s, a) for s, a in zip(self.sorted, ask)]).reshape(self.trees, len(vectors), 2, BITS + 1)
        return at[:, :, 0], at[:, :, 1]

    def candidates(self, first: np.ndarray, end: np.ndarray, k: int) -> np.ndarray:
        """Entries to score for one query, from its intervals (trees x levels)."""
        size = end - first
        wanted = max(self.ascent * self.n, self.trees * min(self.n, k))
        level = int(np.flatnonzero(size.sum(axis=0) >= wanted).max())
        lengths, start = size[:, level:].ravel(), (first[:, level:] + np.arange(self.trees)[:, None] * self.n).ravel()
        ends = np.cumsum(lengths)
        met = np.bincount(self.places[np.repeat(start - ends + lengths, lengths) + np.arange(ends[-1])], minlength=self.n)
        pick = np.argpartition(-met, self.take - 1)[: self.take]
        return pick[met[pick] > 0]

    def nearest(self, vectors: np.ndarray, k: int) -> Iterator[tuple[int, list[int], float]]:
        """(query, ids, score) of the k best entries found, for each query of a batch."""
        q = scaled(vectors)
        norm = np.sqrt((q * q).sum(axis=1))
        for at in range(0, len(q), STEP):
            first, end = self.intervals(q[at : at + STEP])
            for i in range(first.shape[1]):
                pick = self.candidates(first[:, i], end[:, i], k)
                score = (self.v[pick] * q[at + i]).sum(axis=1) / (self.norm[pick] * norm[at + i])
                best = np.lexsort((self.least[pick], -score))[:k]
                for e in best:
                    yield at + i, self.ids[pick[e]], float(score[e])


def _matrices(vec: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors) of each vector length in a column."""
    lengths = vec.value_lengths().to_numpy()
    flat, ends = vec.flatten().to_numpy(zero_copy_only=False), np.cumsum(lengths)
    for dim in np.unique(lengths):
        rows = np.flatnonzero(lengths == dim)
        yield rows, flat[(ends[rows] - dim)[:, None] + np.arange(dim)]


def _search(k: int, trees: int, ascent: float, share: float):
    """Blocks in order, entries before queries: forests are built when a block's first query arrives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, forests = None, {}, {}
        for batch in batches:
            numbers, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.concatenate([[True], (numbers[1:] != numbers[:-1]) | (asks[1:] != asks[:-1])]))
            for a, b in zip(cuts, np.append(cuts[1:], len(numbers))):
                part = batch.slice(a, b - a)
                if numbers[a] != block:
                    block, held, forests = numbers[a], {}, {}
                if not asks[a]:
                    names = part.column(4).to_pylist()
                    for rows, vectors in _matrices(part.column(3)):
                        mine = held.setdefault(vectors.shape[1], ([], []))
                        mine[0].append(vectors)
                        mine[1].extend(names[r] for r in rows)
                    continue
                if held:
                    forests = {dim: Forest(np.concatenate(v), ids, trees, ascent, share) for dim, (v, ids) in held.items()}
                    held = {}
                out_q, out_ids, out_s = [], [], []
                for rows, vectors in _matrices(part.column(3)):
                    if vectors.shape[1] in forests:
                        for i, ids, score in forests[vectors.shape[1]].nearest(vectors, k):
                            out_q.append(part.column(2)[int(rows[i])].as_py())
                            out_ids.append(ids)
                            out_s.append(score)
                yield pa.RecordBatch.from_arrays([pa.array(out_q, pa.binary()), pa.array(out_ids, pa.list_(pa.int64())), pa.array(out_s, pa.float64())], names=["query", "ids", "score"])

    return run


def nearest(vectors: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", is_query=None, trees: int = TREES, ascent: float = ASCENT, share: float = SHARE, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest other rows found for every query row."""
    spark = vectors.sparkSession
    asks = is_query if is_query is not None else F.lit(True)
    entries = written(distinct_vectors(vectors, id_col, vec_col, k + 1, asks).withColumn("id", F.unhex(F.sha2(F.to_json("vec"), 256))), "ann-entries")
    n = entries.count()
    # Smaller blocks only where there would be fewer than tasks.
    blocks = max(1, -(-n // block), min(int(spark.conf.get("spark.sql.shuffle.partitions")), n // LEAST_BLOCK))
    rows = entries.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.lit(False).alias("q"), "id", "vec", "ids")
    asked = entries.filter("q").select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("q"), "id", "vec", F.lit(None).cast("array<long>").alias("ids"))
    found = (
        rows.unionByName(asked).repartitionById(blocks, "block").sortWithinPartitions("block", "q")
        .mapInArrow(_search(k + 1, trees, ascent, share), "query binary, ids array<long>, score double")
    )
    best = (
        found.groupBy("query").agg(F.collect_list(F.struct((-F.col("score")).alias("s"), "ids")).alias("c"))
        .select("query", F.slice(F.array_sort(F.array_distinct(F.flatten(F.transform("c", lambda e: F.transform(e["ids"], lambda i: F.struct(e["s"].alias("s"), i.alias("id"))))))), 1, k + 1).alias("c"))
    )
    own = vectors.filter(asks & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("query_id"), F.unhex(F.sha2(F.to_json(F.transform(F.col(vec_col), lambda x: x + F.lit(0.0)).cast(f"array<{element(vectors, vec_col)[0]}>")), 256)).alias("query"))
    return (
        own.join(best, "query")
        .select("query_id", F.posexplode(F.slice(F.filter("c", lambda e: e["id"] != F.col("query_id")), 1, k)).alias("i", "e"))
        .select("query_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("e.id").alias("vec_id"), (-F.col("e.s")).alias("score"))
    )


def op2_nearest(spark, sf_dir):
    return nearest(table(spark, sf_dir, "embeddings"), is_query=F.col("vec_id") % 50 == 0)
