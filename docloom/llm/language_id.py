"""Operator 8, language identification: a byte convolutional network in numpy.

Bytes are embedded, convolved with filters of several widths, max-pooled over a window of fixed length and
classified by softmax. It is fitted on the driver on at most ``FIT_DOCS`` labelled rows (the smallest by a hash of
their id; from each, one window of each length in ``FIT_LENGTHS``, at places spread by hash over the whole text; both are
parameters). Short ones teach it texts, and ends of texts, that do not fill a window. It is then applied to every window of every whole text, in Arrow batches, without a shuffle. A text's score is the length-weighted mean of its windows'
probabilities.

Defined results: null texts, empty texts and texts without a letter are ``und`` with score 0; without labelled
rows every text is ``und``; with one label every other text gets it. Rows of a null id are never held out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import small_batches, spread, table

FIT_DOCS, FIT_LENGTHS = 3000, (128, 64, 32, 16)
WINDOW, WIDTHS, FILTERS, EMBED = 128, (2, 3, 4), (8, 12, 12), 8
EPOCHS, BATCH, RATE = 6, 64, 0.01
UNKNOWN = "und"
#: Below this score the pipeline's filter treats a prediction as none.
LEAST_SCORE = 0.3


def windows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every text cut into windows: (windows x WINDOW bytes, zero-padded; owner of each; bytes in each)."""
    counts = np.array([-(-len(t) // WINDOW) for t in texts], dtype=np.int64)
    flat, at = bytearray(int(counts.sum()) * WINDOW), 0
    for t, n in zip(texts, counts):
        flat[at : at + len(t)] = t
        at += int(n) * WINDOW
    owner = np.repeat(np.arange(len(texts)), counts)
    length = np.full(len(owner), WINDOW, dtype=np.int64)
    ends = np.cumsum(counts) - 1
    has = counts > 0
    length[ends[has]] = np.array([len(t) for t in texts], dtype=np.int64)[has] - (counts[has] - 1) * WINDOW
    return np.frombuffer(flat, dtype=np.uint8).reshape(-1, WINDOW), owner, length


class ByteNet:
    def __init__(self, labels: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        widest, total = max(WIDTHS), sum(FILTERS)
        self.labels = labels
        self.embed = rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.mask = np.zeros((widest * EMBED, total), dtype=np.float32)
        at = 0
        for w, n in zip(WIDTHS, FILTERS):
            self.mask[: w * EMBED, at : at + n] = 1
            at += n
        self.conv = (rng.normal(0, 0.25, self.mask.shape) * self.mask).astype(np.float32)
        self.bias = np.zeros(total, dtype=np.float32)
        self.out = rng.normal(0, 0.1, (total, len(labels))).astype(np.float32)
        self.out_bias = np.zeros(len(labels), dtype=np.float32)

    def _columns(self, x: np.ndarray) -> np.ndarray:
        e, widest = self.embed[x], max(WIDTHS)
        n = WINDOW - widest + 1
        return np.concatenate([e[:, i : i + n] for i in range(widest)], axis=2)

    def _forward(self, x: np.ndarray):
        cols = self._columns(x)
        z = cols.reshape(-1, cols.shape[2]) @ self.conv
        z = z.reshape(len(x), -1, z.shape[1])
        pooled = z.max(axis=1) + self.bias
        hidden = np.maximum(pooled, 0)
        logits = hidden @ self.out + self.out_bias
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        return cols, z, hidden, p / p.sum(axis=1, keepdims=True)

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        names = ("embed", "conv", "bias", "out", "out_bias")
        m = {k: np.zeros_like(getattr(self, k)) for k in names}
        v = {k: np.zeros_like(getattr(self, k)) for k in names}
        step = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(x))
            for at in range(0, len(order), BATCH):
                pick = order[at : at + BATCH]
                xb, n = x[pick], len(pick)
                cols, z, hidden, p = self._forward(xb)
                d = p.copy()
                d[np.arange(n), y[pick]] -= 1
                d /= n
                grad = {"out": hidden.T @ d, "out_bias": d.sum(axis=0)}
                dh = (d @ self.out.T) * (hidden > 0)
                grad["bias"] = dh.sum(axis=0)
                top = z.argmax(axis=1)
                chosen = cols[np.arange(n)[:, None], top]  # n x filters x columns
                grad["conv"] = np.einsum("nfc,nf->cf", chosen, dh) * self.mask
                dcols = (dh[:, :, None] * self.conv.T[None]).reshape(n, len(self.bias), max(WIDTHS), EMBED)
                where = xb[np.arange(n)[:, None, None], top[:, :, None] + np.arange(max(WIDTHS))]
                grad["embed"] = np.zeros_like(self.embed)
                np.add.at(grad["embed"], where.ravel(), dcols.reshape(-1, EMBED))
                step += 1
                for k in names:
                    m[k] = 0.9 * m[k] + 0.1 * grad[k]
                    v[k] = 0.999 * v[k] + 0.001 * grad[k] ** 2
                    value = getattr(self, k) - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
                    setattr(self, k, value.astype(np.float32))

    def probabilities(self, x: np.ndarray, rows: int = 512) -> np.ndarray:
        out = np.empty((len(x), len(self.labels)), dtype=np.float32)
        for at in range(0, len(x), rows):
            out[at : at + rows] = self._forward(x[at : at + rows])[3]
        return out


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_docs: int = FIT_DOCS, fit_lengths: tuple[int, ...] = FIT_LENGTHS) -> ByteNet | None:
    """Fit on a bounded sample: a hash threshold first, so that no task gathers more than about twice ``fit_docs``."""
    place = lambda k, n: 1 + F.pmod(F.xxhash64(F.col(id_col), F.lit(k)), F.greatest(F.length(text_col) - n + 1, F.lit(1)))
    pieces = [F.substring(F.col(text_col), place(k, n).cast("int"), F.lit(n)) for k, n in enumerate(fit_lengths)]
    usable = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.xxhash64(id_col).alias("h"), F.array_distinct(F.array(*pieces)).alias("t"), F.col(lang_col).alias("y")
    )
    n = labelled.filter(F.col(lang_col).isNotNull()).count()
    if n > 2 * fit_docs:
        usable = usable.filter(F.pmod("h", F.lit(1_000_003)) < int(1_000_003 * 2 * fit_docs / n) + 1)
    rows = [(t.encode(), y) for found, y in usable.orderBy("h", "t", "y").limit(fit_docs).select("t", "y").toLocalIterator() for t in found if t]
    labels = sorted({y for _, y in rows})
    if not labels:
        return None
    net = ByteNet(labels)
    if len(labels) > 1:
        x, owner, _ = windows_of([t for t, _ in rows])
        at = {y: i for i, y in enumerate(labels)}
        net.fit(x, np.array([at[y] for _, y in rows])[owner])
    return net


def identify(docs: DataFrame, net: ByteNet | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: the ``keep`` columns, lang_pred and score. Only the text is an input of the prediction."""
    small_batches(docs.sparkSession)
    letter = regex.compile(r"\p{L}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if t and letter.search(t) else "" for t in batch.column(0).to_pylist()]
            pred, score = np.full(len(texts), -1), np.zeros(len(texts))
            if net is not None and texts:
                x, owner, length = windows_of([t.encode("utf-8", "surrogatepass") for t in texts])
                total = np.zeros((len(texts), len(net.labels)))
                np.add.at(total, owner, net.probabilities(x) * length[:, None])
                weight = np.bincount(owner, weights=length, minlength=len(texts))
                has = weight > 0
                total[has] /= weight[has, None]
                pred[has], score[has] = total[has].argmax(axis=1), np.clip(total[has].max(axis=1), 0, 1)
            names = [UNKNOWN if p < 0 else net.labels[p] for p in pred]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(names, pa.string()), pa.array(score)], names=[*keep, "lang_pred", "score"])

    rows = docs.select(text_col, *keep)
    schema = T.StructType([*rows.schema.fields[1:], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, schema)


def op8_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out())
    return identify(spread(docs.select("doc_id", "held_out", "text")), fit(docs.filter(~F.col("held_out"))), keep=("doc_id", "held_out"))
