"""Operator 6, substring deduplication: words covered by a window of ``WINDOW`` words that a smaller document has too.

The suffixes that can matter (see ``repeats``) are split by prefixes of variable length: the four words they begin with,
lengthened word by word (to eight) where a sample shows more than a group's share; each prefix goes to one of the
memory-sized groups. A group's sorted suffixes with the common prefixes of neighbours are its suffix tree; the inner
nodes deep enough for a window are the maximal repeats, and a leaf whose node holds a smaller document loses it. Windows
that a lengthened prefix does not cover are compared across groups. Words are compared as 64-bit hashes.

Defined results: null texts have no words; texts shorter than a window lose nothing; repeats inside one document or
between rows of one id alone remove nothing; a null id counts as smaller than all others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import table
from docloom.llm.repeats import GROUP_BYTES, NO_ID, Kind, covered, prefixes_of, repeated_windows
from docloom.llm.words import word_spans

WINDOW, GRAM = 13, 4


def remove_repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, keep_text: bool = False, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """One row per document: id, n_words, n_removed, kept_sha256 (and the kept words, if asked for)."""
    kind = Kind(True, window, gram)
    base, ranges = repeated_windows(kind, docs, id_col, text_col, prefixes_of, (), group_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {n: [] for n in ("rid1", "n_words", "n_removed", "kept_sha256", "kept")}
            for rid1, text, data in zip(*(batch.column(c) for c in ("rid1", "text", "data"))):
                raw = text.as_py().encode()
                starts, ends = word_spans(np.frombuffer(raw, dtype=np.uint8), np.array([0, len(raw)]))
                gone = covered(data.as_py(), len(starts), window)
                kept = b" ".join([raw[a:b] for a, b in zip(starts[~gone].tolist(), ends[~gone].tolist())]) if gone.any() else b" ".join(raw.translate(None).split())
                for n, v in zip(out, (rid1.as_py(), len(starts), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode() if keep_text else None)):
                    out[n].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("rid1", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())]))

    done = base.join(ranges, ["rid1", "rid2"], "left").select("rid1", "text", "data").mapInArrow(run, "rid1 long, n_words long, n_removed long, kept_sha256 string, kept string")
    out = done.select(F.when(F.col("rid1") != NO_ID, F.col("rid1")).alias(id_col), "n_words", "n_removed", "kept_sha256", "kept")
    return out if keep_text else out.drop("kept")


def op6_substring_dedup(spark, sf_dir):
    return remove_repeated_words(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+') AS w FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM w WHERE len(w) >= 13),
h AS MATERIALIZED (SELECT doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS h FROM x),
f AS (SELECT h, min(doc_id) AS first FROM h GROUP BY h),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM h JOIN f USING (h) WHERE doc_id > first),
g AS (SELECT doc_id, list(p) AS gone FROM r GROUP BY doc_id),
k AS (SELECT w.doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
  CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(gone, i)), lambda i: w[i]) END AS kept FROM w LEFT JOIN g USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, n_removed::BIGINT AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""
