import random
import re

import pytest

from docloom.llm import jaccard_join
from docloom.llm.jaccard_join import CROWD, DEPTH, LEAST, RECALL, TREES, lengths_needed, likely, misses, near_duplicates, op7_jaccard_join, runs_of


def sets_of(rows):
    out = []
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        out.append((i, frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
    return out


def brute(rows):
    sets = sets_of(rows)
    n = len(sets)
    links = {k: {j for j in range(n) if j != k and sets[k][1] and sets[j][1] and 10 * len(sets[k][1] & sets[j][1]) >= 8 * len(sets[k][1] | sets[j][1])} for k in range(n)}
    out, seen = [], {}
    for k in range(n):
        if k in seen:
            continue
        group, todo = set(), [k]
        while todo:
            x = todo.pop()
            if x not in group:
                group.add(x)
                todo += links[x]
        ids = [sets[x][0] for x in group if sets[x][0] is not None]
        for x in group:
            seen[x] = min(ids) if ids else None
    for k in range(n):
        out.append((sets[k][0], seen[k], len(links[k]), len({sets[j][1] for j in links[k]} - {sets[k][1]})))
    return sorted(out, key=repr)


def corpus(seed, groups):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["é", "日本", "x" * 50]
    rows, i = [], 0
    for size, length in groups:
        base = [rng.choice(words) for _ in range(length)]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randint(0, max(1, length // 60))):
                w[rng.randrange(length)] = rng.choice(words)
            rows.append((i, rng.choice([" ", "\n", "  "]).join(w)))
            i += 1
    rng.shuffle(rows)
    return rows


SCHEMA = "doc_id long, text string, node string, n int, root string"


def run(spark, tables, rows, **kw):
    d = tables(documents=(SCHEMA, [(*r, "x", 1, "y") for r in rows]))
    return sorted(map(tuple, near_duplicates(spark.read.parquet(f"{d}/documents.parquet"), **kw).collect()), key=repr)


def test_prefixes_shorten_to_the_target():
    import numpy as np

    assert TREES * misses(LEAST) < np.log1p(-RECALL) < TREES * misses(5)
    sizes = np.ones((3, TREES, DEPTH - LEAST + 1), dtype=np.int64)
    crowded = np.zeros((3, TREES), dtype=bool)
    crowded[1, :5], crowded[2] = True, True  # few crowded trees may stay whole; where all are, they shorten
    sizes[1, :5] = sizes[2] = np.linspace(5000, 100, DEPTH - LEAST + 1)
    need = lengths_needed(sizes, crowded, RECALL)
    assert (need[0] == LEAST).all() and (need[1, :5] == DEPTH).all() and (need[1, 5:] == LEAST).all()
    assert all(sum(misses(int(k)) for k in row) <= np.log1p(-RECALL) for row in need) and (need[2] == LEAST).any() and (need[2] > LEAST).any()


@pytest.mark.parametrize("tile,crowd", [(256, CROWD), (4, 6)])
def test_equals_brute_force(spark, tables, tile, crowd):
    rows = corpus(1, [(1, 80)] * 20 + [(2, 90)] * 10 + [(25, 120), (12, 400), (3, 6)])
    rows += [(900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "one  two"), (905, rows[0][1]), (905, rows[0][1]), (None, rows[0][1] + " tail"), (906, "z " * 3000), (907, "z " * 4000)]
    assert run(spark, tables, rows, tile=tile, crowd=crowd) == brute(rows)


def test_large_tiles_and_few_pairs_agree():
    import numpy as np

    rng = np.random.default_rng(0)
    left = [np.unique(rng.integers(0, 9000, 300).astype(np.uint64)) for _ in range(20)]
    right = [np.unique(rng.integers(0, 9000, 300).astype(np.uint64)) for _ in range(30)]
    want = np.array([[len(np.intersect1d(a, b)) for b in right] for a in left])
    assert (jaccard_join.intersections(left, right, np.ones((20, 30), bool)) == want).all()
    few = np.zeros((20, 30), bool)
    few[3, 4] = few[19, 29] = True
    assert (jaccard_join.intersections(left, right, few) == np.where(few, want, 0)).all()


def test_chains_form_one_class(spark, tables):
    base = [f"a{i}" for i in range(200)]
    rows = []
    for k in range(12):  # each differs from the one before, the ends are far apart
        for j in range(3):
            base[(37 * k + 61 * j) % 200] = f"b{k}-{j}"
        rows.append((k, " ".join(base)))
    assert run(spark, tables, rows) == brute(rows)


def test_empty_table(spark, tables):
    assert op7_jaccard_join(spark, tables(documents=("doc_id long, text string", []))).count() == 0
    assert [tuple(r) for r in op7_jaccard_join(spark, tables(documents=("doc_id long, text string", [(1, None)]))).collect()] == [(1, 1, 0, 0)]


def test_members_are_those_of_shared_prefixes(spark):
    rng = random.Random(3)
    strings = [(rng.randbytes(16), 1, t, bytes([rng.randrange(6)] * 4 + [0, rng.randrange(6)]) + rng.randbytes(10)) for t in range(2) for _ in range(120)]
    shared = {}
    for node, _, tree, string in strings:
        shared.setdefault((tree, string[: 2 * LEAST]), set()).add((node, tree, string))
    runs, members = runs_of(spark.createDataFrame(strings, "node binary, n long, tree int, string binary"), 7, 4)
    found = {(r.tree, bytes(r.key)): r.members for r in runs.filter(f"level = {LEAST}").collect()}
    assert found == {k: len(v) for k, v in shared.items() if len(v) > 1}
    given = [(bytes(r.node), r.tree, bytes(r.string)) for r in members.collect()]
    assert len(given) == len(set(given)) and set().union(*(v for v in shared.values() if len(v) > 1)) <= set(given)
    assert len(given) <= sum(len(v) for v in shared.values() if len(v) > 1) + 2 * 7


def test_marks_lose_no_key(spark):
    rows, wanted = spark.range(-500, 3000), spark.range(-500, 3000, 7)
    few, full = ({r.id for r in likely(rows, wanted, "id", words).collect()} for words in (1 << 10, 2))
    assert set(range(-500, 3000, 7)) <= few & full and len(few) < 600


def test_only_what_can_meet_is_shuffled(spark, tables):
    rng = random.Random(5)
    text = lambda n: " ".join(f"{rng.getrandbits(48):x}" for _ in range(n))
    rows = [(i, text(3000)) for i in range(150)] + [(150 + i, t + " tail") for i, t in enumerate([text(300)] * 8)] + [(200, text(300))]
    rows += [(201, rows[-1][1] + " tail")]
    d = tables(documents=("doc_id long, text string", rows))
    sc = spark.sparkContext._jsc.sc()

    def shuffled():
        sc.listenerBus().waitUntilEmpty()
        return sc.statusStore().executorList(False).apply(0).totalShuffleWrite()

    default = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where no side is small
    try:
        before = shuffled()
        found = [tuple(r) for r in op7_jaccard_join(spark, d).collect()]
        assert sorted(found, key=repr) == brute(rows)
        assert 0 < shuffled() - before < 0.2 * sum(len(t) for _, t in rows)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", default)
