"""Operator 4, suffix-array deduplication: bytes covered by a string of ``LENGTH`` bytes that starts anywhere else.

The suffixes that can matter (see ``repeats``) are range-partitioned by their leading tokens with splitters sampled from
the suffixes themselves; each bucket sorts its suffixes by multikey quicksort and compares neighbours, byte by byte.
Splitters fall between the leading 32 bytes that all suffixes to compare share, so nothing faces a boundary, unless one
such string fills several buckets: then splitters take up to 64 bytes, and what may be equal to something beyond a
boundary is compared across it.

Defined results: null counts as empty; matches never cross documents; texts shorter than ``LENGTH`` lose nothing;
equal rows are occurrences of each other. As a stage, characters that lose any byte go whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import table
from docloom.llm.repeats import GROUP_BYTES, NO_ID, Kind, covered, ranges_of, repeated_windows

LENGTH, GRAM = 200, 32


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, keep: tuple[str, ...] = (), group_bytes: int = GROUP_BYTES) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256; with ``keep``, also the kept text and those
    columns, as the struct ``extra``."""
    base, ranges = repeated_windows(Kind(False, length, gram), docs, id_col, text_col, ranges_of, keep, group_bytes)
    names = ("rid1", "n_bytes", "n_removed", "n_spans", "kept_sha256")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {n: [] for n in (*names, "kept")}
            for rid1, text, data in zip(*(batch.column(c) for c in ("rid1", "text", "data"))):
                raw = np.frombuffer(text.as_py().encode(), dtype=np.uint8)
                gone = covered(data.as_py(), len(raw), length)
                values = (rid1.as_py(), len(raw), int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()), hashlib.sha256(raw[~gone].tobytes()).hexdigest())
                for n, v in zip(names, values):
                    out[n].append(v)
                if keep:  # whole characters only: those that touch a removed byte go too
                    first = np.flatnonzero((raw & 0xC0) != 0x80)
                    broken = np.logical_or.reduceat(gone, first) if len(first) else np.zeros(0, bool)
                    out["kept"].append(raw[~np.repeat(broken, np.diff(np.append(first, len(raw))))].tobytes().decode())
            columns = [pa.array(out["rid1"], pa.int64()), *[pa.array(out[n], pa.int64()) for n in names[1:4]], pa.array(out["kept_sha256"], pa.string())]
            if keep:
                columns += [pa.array(out["kept"], pa.string()), batch.column("extra")]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *(("kept", "extra") if keep else ())])

    joined = base.join(ranges, ["rid1", "rid2"], "left").select("rid1", "text", "data", *(("extra",) if keep else ()))
    schema = T.StructType([T.StructField(n, T.StringType() if n == "kept_sha256" else T.LongType()) for n in names])
    if keep:
        schema = schema.add("kept", T.StringType()).add(base.schema["extra"])
    done = joined.mapInArrow(run, schema)
    return done.select(F.when(F.col("rid1") != NO_ID, F.col("rid1")).alias(id_col), *done.columns[1:])


def op4_suffix_dedup(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents"))


OP4_SQL = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS b FROM documents),
w AS MATERIALIZED (SELECT doc_id, i, md5(substr(b, 2 * i + 1, {2 * LENGTH})) AS h FROM (SELECT doc_id, b, unnest(range(0, length(b) // 2 - {LENGTH - 1})) AS i FROM d)),
r AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
x AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM w JOIN r USING (h)),
s AS (SELECT doc_id, i, sum(CASE WHEN p IS NULL OR i > p + {LENGTH} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM x),
g AS (SELECT doc_id, run, min(i) AS a, max(i) + {LENGTH} AS z FROM s GROUP BY 1, 2),
t AS (SELECT doc_id, count(*) AS n_spans, sum(z - a) AS n_removed, list(a ORDER BY a) AS starts, list(z ORDER BY a) AS ends FROM g GROUP BY 1)
SELECT d.doc_id, (length(b) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN t.doc_id IS NULL THEN b ELSE array_to_string(list_transform(range(0, len(starts) + 1),
    lambda k: substr(b, 2 * (CASE WHEN k = 0 THEN 0 ELSE ends[k] END) + 1, 2 * ((CASE WHEN k = len(starts) THEN length(b) // 2 ELSE starts[k + 1] END) - (CASE WHEN k = 0 THEN 0 ELSE ends[k] END)))), '') END)) AS kept_sha256
FROM d LEFT JOIN t ON d.doc_id = t.doc_id
"""
