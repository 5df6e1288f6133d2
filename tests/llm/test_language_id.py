import zlib

import numpy as np
from pyspark.sql import functions as F

from docloom.llm import language_id
from docloom.llm.language_id import EMBED, FILTERS, WIDTHS, WINDOW, ByteNet, held_out, op8_language_id, windows_of

EN = "the cat sat on the mat and then the dog went with them through the house "
FR = "le chat était sur la chaise où il était resté après les gâteaux français "


def test_learns_and_is_honest_about_the_rest(spark, tables):
    rows = [(i, (EN if i % 2 else FR)[i % 20 :] * 3, "en" if i % 2 else "fr") for i in range(300)]
    odd = [(1000, None, "en"), (1001, "", "fr"), (1002, "123 ...", "en"), (1003, EN * 400, None), (None, FR, None), (1003, FR, None)]
    d = tables(documents=("doc_id long, text string, lang string, score int, held_out string", [(*r, 0, "x") for r in rows + odd]))
    got = op8_language_id(spark, d).collect()
    assert len(got) == len(rows) + len(odd)
    right = [r.lang_pred == ("en" if r.doc_id % 2 else "fr") for r in got if r.doc_id is not None and r.doc_id < 1000 and r.held_out]
    assert sum(right) >= 0.97 * len(right) > 30
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        if r.doc_id in (1000, 1001, 1002):
            assert r.lang_pred == "und"
    assert sorted(r.lang_pred for r in got if r.doc_id == 1003) == ["en", "fr"]


def test_without_labels_or_rows(spark, tables):
    schema = "doc_id long, text string, lang string"
    assert [r.lang_pred for r in op8_language_id(spark, tables(documents=(schema, [(1, "abc", None)]))).collect()] == ["und"]
    assert {r.lang_pred for r in op8_language_id(spark, tables(documents=(schema, [(1, "abc", "en"), (3, "de", "en"), (4, "f", None)]))).collect()} <= {"en", "und"}
    assert op8_language_id(spark, tables(documents=(schema, []))).count() == 0


def test_short_texts_are_told_apart_too(spark, tables):
    rows = [(i, (EN if i % 2 else FR)[i % 20 :] * 3, "en" if i % 2 else "fr") for i in range(300)]
    net = language_id.fit(spark.read.parquet(tables(documents=("doc_id long, text string, lang string", rows)) + "/documents.parquet"))
    cuts = [(t[at : at + 16], lang) for t, lang in ((EN, "en"), (FR, "fr")) for at in range(len(t) - 16)]
    found = language_id.identify(spark.createDataFrame(cuts, "text string, known string"), net, keep=("known",)).collect()
    assert sum(r.lang_pred == r.known for r in found) >= 0.95 * len(found)


def plain_forward(net, window):
    """Byte by byte: embed, every filter at every place, the largest value, softmax."""
    pooled, at, last = [], 0, WINDOW - max(WIDTHS) + 1
    for width, count in zip(WIDTHS, FILTERS):
        for f in range(at, at + count):
            best = -np.inf
            for place in range(last):
                best = max(best, sum(float(net.embed[window[place + i], e]) * float(net.conv[i * EMBED + e, f]) for i in range(width) for e in range(EMBED)))
            pooled.append(max(0.0, best + float(net.bias[f])))
        at += count
    logits = [sum(p * float(net.out[k, c]) for k, p in enumerate(pooled)) + float(net.out_bias[c]) for c in range(len(net.labels))]
    raised = np.exp(np.array(logits) - max(logits))
    return raised / raised.sum()


def test_forward_pass_equals_a_plain_restatement():
    net = ByteNet(["de", "en", "fr"])
    x, owner, length = windows_of([EN.encode() * 3, b"", "é".encode() * 65])
    assert owner.tolist() == [0] * (len(EN) * 3 // WINDOW + 1) + [2, 2] and length.sum() == len(EN) * 3 + 130
    for window, p in zip(x[:2], net.probabilities(x[:2])):
        assert np.allclose(plain_forward(net, window), p, atol=1e-4)


def test_only_the_text_is_an_input_of_a_prediction(spark, tables):
    rows = [(i, (EN if i % 2 else FR)[i % 20 :] * 2, "en" if i % 2 else "fr", "s") for i in range(80)]
    df = spark.read.parquet(tables(documents=("doc_id long, text string, lang string, source string", rows)) + "/documents.parquet")
    net = language_id.fit(df.filter(~held_out()))
    told = lambda d: sorted((r.text, r.lang_pred, r.score) for r in language_id.identify(d.withColumn("copy", F.col("text")), net, keep=("copy",)).withColumnRenamed("copy", "text").collect())
    other = df.select((F.col("doc_id") + 7).alias("doc_id"), "text", F.lit("xx").alias("lang"), F.lit("y").alias("source"))
    assert told(df) == told(other)
