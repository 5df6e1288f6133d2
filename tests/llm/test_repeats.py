import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from docloom.llm import repeats
from docloom.llm.repeats import common_prefix, matrix, multikey_sort
from docloom.llm.substring_dedup import op6_substring_dedup, remove_repeated_words
from docloom.llm.suffix_dedup import op4_suffix_dedup, remove_repeats

SCHEMA = "doc_id long, text string, kind int, data string, rid1 int"


def brute_bytes(rows, length):
    raws = [(t or "").encode() for _, t in rows]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for (i, _), r in zip(rows, raws):
        gone = np.zeros(len(r) + 1, dtype=bool)
        for k in range(len(r) - length + 1):
            if seen[r[k : k + length]] > 1:
                gone[k : k + length] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((i, len(r), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(r, dtype=np.uint8)[~gone[:-1]])).hexdigest()))
    return sorted(out, key=repr)


def brute_words(rows, window):
    low = lambda i: -(1 << 63) if i is None else i
    docs = [(low(i), re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())) for i, t in rows]
    first = {}
    for i, w in docs:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for (i, _), (n, w) in zip(rows, docs):
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < n:
                gone |= set(range(k, k + window))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed, docs=60, words=40):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé日") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    say = lambda n: rng.choice([" ", "\n"]).join(rng.choice(vocabulary) for _ in range(n))
    passages = [say(rng.randint(8, 40)) for _ in range(6)]
    rows = []
    for i in range(docs):
        parts = [say(rng.randint(0, words))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(passages)[rng.randint(0, 10) :], say(rng.randint(0, 6))]
        rows.append((i, " ".join(parts)))
    rows += [(1000, None), (1001, ""), (1002, " \n "), (1003, "a" * 700), (1004, "z " * 400), (1005, rows[3][1]), (1006, rows[3][1]), (1006, rows[3][1]), (1006, "other " + rows[4][1]), (None, rows[5][1]), (None, "q " * 90)]
    rows += [(1007, "0" * 500 + rows[7][1] + "\u0000" * 300)]
    rng.shuffle(rows)
    return rows


def frame(spark, tables, rows):
    return spark.read.parquet(tables(documents=(SCHEMA, [(*r, 1, "x", 2) for r in rows])) + "/documents.parquet")


@pytest.mark.parametrize("length,gram,size,segment", [(20, 6, 16 << 20, 1 << 21), (33, 8, 30_000, 64), (20, 5, 2000, 1 << 21), (9, 9, 20_000, 1 << 21)])
def test_bytes_equal_brute_force(spark, tables, monkeypatch, length, gram, size, segment):
    monkeypatch.setattr(repeats, "SEGMENT", segment)
    rows = corpus(length)
    got = sorted(map(tuple, remove_repeats(frame(spark, tables, rows), length=length, gram=gram, group_bytes=size).collect()), key=repr)
    assert got == brute_bytes(rows, length)


@pytest.mark.parametrize("window,gram,size", [(13, 4, 16 << 20), (13, 2, 6000), (5, 2, 2000), (6, 6, 20_000)])
def test_words_equal_brute_force(spark, tables, window, gram, size):
    rows = corpus(window + 100)
    got = sorted(map(tuple, remove_repeated_words(frame(spark, tables, rows), window=window, gram=gram, group_bytes=size).collect()), key=repr)
    assert got == brute_words(rows, window)


def test_queries(spark, tables):
    rng = random.Random(5)
    passage = " ".join(str(rng.random()) for _ in range(40))
    rows = [(i, f"{rng.random()} start {i} " + (passage if i % 3 else "") + f" end {rng.random()}" * rng.randint(1, 30)) for i in range(200)]
    d = tables(documents=(SCHEMA, [(*r, 1, "x", 2) for r in rows]))
    assert sorted(map(tuple, op4_suffix_dedup(spark, d).collect()), key=repr) == brute_bytes(rows, 200)
    assert sorted(map(tuple, op6_substring_dedup(spark, d).collect()), key=repr) == brute_words(rows, 13)
    empty = tables(documents=("doc_id long, text string", []))
    assert op4_suffix_dedup(spark, empty).count() == 0 and op6_substring_dedup(spark, empty).count() == 0


def test_stage_text_keeps_whole_characters(spark, tables):
    rows = [(1, "é" * 30 + "abc"), (2, "x" + "é" * 30)]
    kept = {r.doc_id: (r.kept, r.extra.data) for r in remove_repeats(frame(spark, tables, rows), length=21, gram=5, keep=("kind", "data")).collect()}
    assert kept == {1: ("abc", "x"), 2: ("x", "x")}


def test_multikey_sort_and_prefixes():
    rng = random.Random(2)
    rows = [bytes(rng.choice(b"ab\0") for _ in range(rng.randint(0, 24))) for _ in range(500)]
    m = matrix(rows, 24)
    order = multikey_sort(m)
    padded = [r.ljust(24, b"\0") for r in rows]
    assert [padded[i] for i in order] == sorted(padded)
    lcp = common_prefix(m, order, 1)
    for a, b, n in zip(order, order[1:], lcp[1:]):
        assert n == next((k for k in range(24) if padded[a][k] != padded[b][k]), 24)


def test_places_divide_only_what_is_common():
    rng = random.Random(1)
    common, rare = b"c" * 32, [bytes(rng.randrange(97, 120) for _ in range(80)) for _ in range(200)]
    many = [common + bytes(rng.randrange(97, 120) for _ in range(48)) for _ in range(300)]
    place = repeats.ranges_of(repeats.Kind(False, 200, 32), rare + many, 20)
    assert place.divides and {place(r)[1] for r in rare} == {201} and len({place(r)[0] for r in many}) > 5
    for a in many:
        for b in many:
            shared = next((k for k in range(80) if a[k] != b[k]), 80)
            # Windows with more to the right than two suffixes of different groups share are told apart there.
            assert place(a)[0] == place(b)[0] or place(a)[1] <= 200 - shared
    assert not repeats.ranges_of(repeats.Kind(False, 200, 32), rare, 20).divides
    words = repeats.Kind(True, 13, 4)
    place = repeats.prefixes_of(words, rare + many, 20)
    assert place.divides and {place(r)[1] for r in rare} == {14} and len({place(r)[0] for r in many}) > 5
