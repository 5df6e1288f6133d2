import random

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows():
    rng = random.Random(4)
    en = "the house and of that with this from there which about would their other into could then".split()
    fr = "la maison était après être où déjà français élève garçon très même façon leçon là à".split()
    say = lambda words, n: " ".join(rng.choice(words) + str(rng.randint(0, 9)) for _ in range(n))
    out = [(i, say(en if i % 2 else fr, 60), "en" if i % 2 else "fr", "s", 0) for i in range(200)]
    passage = say(en, 60)
    out += [(300, out[10][1].replace(" ", "\n"), "fr", "s", 0), (301, out[11][1] + " one", "en", "s", 0)]
    out += [(302, say(en, 200) + " " + passage + " " + say(en, 200), "en", "s", 0), (303, say(en, 200) + " " + passage, "en", "s", 0)]
    out += [(304, None, "en", "s", 0), (305, "", None, "s", 0), (306, "12 34 !!", "en", "s", 0)]
    return out, passage


def test_each_stage_takes_effect(spark, tables):
    given, passage = rows()
    d = tables(documents=(SCHEMA, given))
    docs = spark.read.parquet(f"{d}/documents.parquet")
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    gone = [{304, 305, 306}, {300}, {301}, set()]
    for (name, stage), lost in zip(corpus_pipeline.STAGES[:-1], gone):
        after = stage(spark, docs, d)
        assert after.columns == list(corpus_pipeline.COLUMNS), name
        after = corpus_pipeline.written(after, "test")
        assert ids(docs) - ids(after) == lost and not ids(after) - ids(docs), name
        docs = after
    left = {r.doc_id: (r.text, r.n_chars) for r in docs.collect()}
    assert passage[5:-5] not in left[302][0] and passage[5:-5] not in left[303][0]
    assert left[1][0] == given[1][1] and all(n == len(t) for t, n in left.values())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, d)
    assert ids(packed) == ids(docs)
    whole = corpus_pipeline.run(spark, d)
    assert whole.agg(F.sum("length")).first()[0] == packed.agg(F.sum("length")).first()[0]


def test_empty_table(spark, tables):
    assert corpus_pipeline.run(spark, tables(documents=(SCHEMA, []))).count() == 0


def test_odd_rows_and_clashing_columns(spark, tables):
    given, _ = rows()
    extra = ("score", "lang_pred", "rid1", "node", "id", "_id", "run", "kept")
    odd = [(1, given[1][1], "en", "s", 0), (1, "another text of the same id about the house and that with from there which would", "en", "s", 0), (None, "one without an id and of the house with that from there into could", "en", "s", 0)]
    d = tables(documents=(SCHEMA + "".join(f", {c} string" for c in extra), [(*r, *("x" for _ in extra)) for r in given + odd]))
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, d), "test")
        assert docs.columns == [*corpus_pipeline.COLUMNS, *extra], name
    texts = [(r.doc_id, r.text[:7]) for r in docs.collect()]
    assert (1, "another") in texts and (None, "one wit") in texts
    assert corpus_pipeline.STAGES[-1][1](spark, docs, d).count() >= docs.count()


def test_one_row_of_equal_and_near_texts_survives(spark, tables):
    given, _ = rows()
    say = lambda seed: " ".join(f"the{random.Random(seed * 1000 + k).randint(0, 10**6)} house" for k in range(40))
    no_id, alike, odd = say(1), say(2), say(3)
    more = [given[1], (1, given[1][1], "fr", "other", 0)]  # repeated rows
    more += [(None, t, "en", "s", 0) for t in (no_id, no_id, no_id.replace(" ", "  ", 3))]  # copies without an id
    more += [(None, alike + end, "en", "s", 0) for end in (" one", " two", " one")]  # near copies without an id
    more += [(500, odd + end, "en", "s", 0) for end in (" one", " two")]  # near copies of one id
    d = tables(documents=(SCHEMA, given + more))
    docs = spark.read.parquet(f"{d}/documents.parquet")
    near_alone = [r.text for r in corpus_pipeline.STAGES[2][1](spark, docs, d).collect() if r.text]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, d), "test")
    left = [r.text for r in docs.collect()]
    for texts in (near_alone, left):
        assert texts.count(given[1][1]) == 1
        for text in (no_id, alike, odd):
            assert sum(" ".join(t.split()).startswith(text) for t in texts) == 1
    assert "" not in left
