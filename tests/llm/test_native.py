"""Operators 9 and 10 against plain restatements, and that they stay free of Python on the executors."""

import hashlib
import random
import re

import pytest

from docloom.llm.exact_dedup import exact_duplicates, merge_runs, op10_exact_dedup, without_duplicates
from docloom.llm.url_filter import RULES, op9_url_filter

DOCS = "doc_id long, text string, id int, run string, digest string, keep_id int"


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    groups = {}
    for (i, _), n in zip(rows, norm):
        groups.setdefault(n, []).append(i)
    out = []
    for (i, _), n in zip(rows, norm):
        ids = [x for x in groups[n] if x is not None]
        keep = min(ids) if ids else None
        out.append((i, keep, len(groups[n]), i == keep, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=repr)


def rows():
    rng = random.Random(9)
    base = [" ".join(rng.choice("abc\u00a0é") for _ in range(4)) for _ in range(40)]
    out = [(i, rng.choice(base).replace(" ", rng.choice([" ", "\n", " \t\x0b", "\r\n"]))) for i in range(300)]
    return out + [(500, None), (501, ""), (502, " "), (503, "\t"), (504, "x" * 100_000), (504, "x" * 100_000), (None, "x" * 100_000), (None, "only here"), (505, " a"), (506, "a")]


@pytest.mark.parametrize("fan_in", [2, 32])
def test_copies(spark, tables, fan_in):
    d = tables(documents=(DOCS, [(*r, 1, "x", "y", 2) for r in rows()]))
    docs = spark.read.parquet(f"{d}/documents.parquet").repartition(9)
    assert sorted(map(tuple, exact_duplicates(docs, fan_in=fan_in).collect()), key=repr) == brute(rows())
    assert sorted(map(tuple, op10_exact_dedup(spark, d).collect()), key=repr) == brute(rows())
    left = without_duplicates(docs)
    assert left.columns == docs.columns and sorted(((r.doc_id, r.text) for r in left.collect()), key=repr) == sorted(((i, t) for (i, t), b in zip(rows(), [next(x for x in brute(rows()) if x[0] == i and x[4] == hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest()) for i, t in rows()]) if b[3]), key=repr)
    assert op10_exact_dedup(spark, tables(documents=("doc_id long, text string", []))).count() == 0


def test_merge_keeps_counts_over_many_runs(spark):
    runs = spark.range(0, 1000).selectExpr("id", "cast(cast(id % 7 as string) as binary) AS digest", "1 AS n_bytes", "0L AS check", "cast(id % 100 as int) AS run")
    assert sorted((r.keep_id, r.group_size) for r in merge_runs(runs, 100, 4).collect()) == [(k, 143 if k < 6 else 142) for k in range(7)]


def test_rules(spark, tables):
    urls = [
        None, "", "no scheme", "http://Example.COM/en/x", "https://www.example.com/en/", "http://a.www.example.com/en/1?x#y", "http://example.com/fr/", "http://example.com?en/", "http://b.net/es/q", "http://b.net/esx",
        "http://b.net/fr/", "http://net/fr/", "http://xnet/fr/", "x://y://z/p", "http://host.org", "http://com/", "http://notexample.com/en/", "http://b.net/ES/", "http://h.org/a\nb?c",
    ]
    got = {r.page_id: r for r in op9_url_filter(spark, tables(pages=("page_id long, url string, host int, rule string, bad int", [(i, u, 1, "x", 2) for i, u in enumerate(urls)]), labels=("doc_id long, quality int, toxic int", []))).collect()}
    assert len(got) == len(urls)
    for i, url in enumerate(urls):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
        fits = [(r, v) for r, v in RULES if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
        rule, verdict = max(fits, key=lambda f: len(f[0]), default=(None, "allow"))
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict), url


def test_reputation(spark, tables):
    pages = [(i, f"http://bad.site.org/{i}") for i in range(60)] + [(100 + i, f"http://good.org/{i}") for i in range(60)] + [(200, "http://new.site.org/"), (201, "http://once.good.org/"), (201, "http://once.good.org/"), (None, "http://good.org/null")]
    labels = [(i, 0, 1) for i in range(40)] + [(100 + i, 1, 0) for i in range(40)] + [(201, 1, 1), (202, 1, 1), (1, None, None), (1, 1, 0)]
    got = {}
    for r in op9_url_filter(spark, tables(pages=("page_id long, url string", pages), labels=("doc_id long, quality int, toxic int", labels))).collect():
        got.setdefault(r.page_id, []).append(r.verdict)
    assert {v for i in range(60) for v in got[i]} == {"block"} and {v for i in range(60) for v in got[100 + i]} == {"allow"}
    assert got[201] == ["allow", "allow"] and got[None] == ["allow"]  # one toxic page is not enough against a good domain
    assert op9_url_filter(spark, tables(pages=("page_id long, url string", []), labels=("doc_id long, quality int, toxic int", []))).count() == 0


def test_plans_are_native(spark, tables):
    d = tables(documents=("doc_id long, text string", [(1, "a")]), pages=("page_id long, url string", [(1, "http://a/")]), labels=("doc_id long, quality int, toxic int", [(1, 1, 0)]))
    for query in (op9_url_filter, op10_exact_dedup):
        plan = query(spark, d)._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow", plan)
