import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import ann
from docloom.llm.ann import nearest, op2_nearest

SCHEMA = "vec_id long, embedding array<float>, label int, hash string, id int"


def brute(rows, k, every):
    good = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in good:
        if i % every == 0:
            s = sorted((-(v * w).sum() / (np.sqrt((v * v).sum()) * np.sqrt((w * w).sum())), j) for j, w in good if j != i and len(w) == len(v))
            out[i] = s[:k]
    return out


def rows_of(n, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    return [(i, rng.standard_normal(dim).astype(np.float32).tolist()) for i in range(n)]


def frame(spark, tables, rows):
    d = tables(embeddings=(SCHEMA, [(i, v, 0, "x", 1) for i, v in rows]))
    return d, spark.read.parquet(f"{d}/embeddings.parquet")


@pytest.mark.parametrize("block", [8192, 300])
def test_recall_and_exact_scores(spark, tables, block):
    rows = rows_of(1500)
    _, df = frame(spark, tables, rows)
    want = brute(rows, 5, 50)
    got = {}
    for r in nearest(df, is_query=F.col("vec_id") % 50 == 0, block=block).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert set(got) == set(want) and all(sorted(g) == [1, 2, 3, 4, 5] for g in got.values())
    hits = sum(len({j for _, j in want[q]} & {v for v, _ in got[q].values()}) for q in want)
    assert hits >= 0.95 * 5 * len(want)
    by_id = dict(rows)
    for q, found in got.items():
        for j, s in found.values():
            a, b = np.array(by_id[q]), np.array(by_id[j])
            assert s == pytest.approx((a * b).sum() / np.sqrt((a * a).sum()) / np.sqrt((b * b).sum()), abs=1e-12)
        assert [s for _, s in (found[i] for i in range(1, 6))] == sorted((s for _, s in found.values()), reverse=True)


def test_copies_ties_nulls_and_lengths(spark, tables):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(0, 400)] + [(1000 + i, [float(i), 1.0, 0.5]) for i in range(30)]
    rows += [(2000, None), (2050, [0.0, 0.0, 0.0]), (2100, [1.0, None, 2.0]), (2150, [float("nan"), 1.0, 1.0]), (2200, []), (None, [1.0, 1.0, 1.0])]
    rows += [(3000, [1.0, 0.0]), (3001, [0.0, 1.0]), (3050, [-0.0, 1.0])]
    d, df = frame(spark, tables, rows)
    want, got = brute(rows, 5, 50), {}
    for r in nearest(df, is_query=F.col("vec_id") % 50 == 0, block=64).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert {q: [j for _, j in sorted(g)] for q, g in got.items()} == {q: [j for _, j in w] for q, w in want.items() if w}
    assert op2_nearest(spark, d).count() == sum(len(w) for w in want.values())


def test_scores_a_tenth_and_finds_nine_tenths():
    rng = np.random.default_rng(5)
    v = rng.standard_normal((20_000, 64))
    forest = ann.Forest(v, [[i] for i in range(len(v))], ann.TREES, ann.ASCENT, ann.SHARE)
    unit, found = v / np.sqrt((v * v).sum(axis=1))[:, None], 0
    first, end = forest.intervals(v[:40])
    for i in range(40):
        assert len(forest.candidates(first[:, i], end[:, i], 6)) <= 0.1 * len(v)
    got = [[] for _ in range(40)]
    for i, ids, _ in forest.nearest(v[:40], 6):
        got[i] += ids
    for i in range(40):
        found += len(set(got[i]) & set(np.argsort(-(unit @ unit[i]))[1:6].tolist()))
    assert found >= 0.9 * 5 * 40


def test_few_trees_and_many_small_blocks(spark, tables):
    rows = rows_of(600, dim=8, seed=3)
    _, df = frame(spark, tables, rows)
    got = nearest(df, is_query=F.col("vec_id") % 50 == 0, block=40, trees=4).collect()
    want = brute(rows, 5, 50)
    assert {(r.query_id, r.vec_id) for r in got} == {(q, j) for q, w in want.items() for _, j in w}


def test_components_whose_squares_overflow():
    v = np.array([[1e200, 1e200], [1e200, -1e200], [3e-200, 3e-200]])
    forest = ann.Forest(v, [[0], [1], [2]], 4, 2.0, 1.0)
    scores = {ids[0]: s for _, ids, s in forest.nearest(v[:1], 3)}
    assert scores == {0: pytest.approx(1.0), 1: pytest.approx(0.0), 2: pytest.approx(1.0)}


def test_six_vectors_of_which_five_share_all_bits(spark, tables):
    rows = [(i, [s * x for x in (1.0, 2.0, 3.0)]) for i, s in enumerate((1, 2, 4, 8, 16, -1))]
    d, _ = frame(spark, tables, rows)
    got = sorted((r.rank, r.vec_id) for r in op2_nearest(spark, d).collect())
    assert [rank for rank, _ in got] == [1, 2, 3, 4, 5] and {j for _, j in got} == {1, 2, 3, 4, 5} and got[-1] == (5, 5)


def test_empty(spark, tables):
    assert op2_nearest(spark, tables(embeddings=(SCHEMA, []))).count() == 0
    assert ann.hash_strings(np.ones((1, 3))).shape == (1, ann.TREES)
