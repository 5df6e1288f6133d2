"""Operator 10, exact duplicates: a tree merge of sorted digest runs, in DataFrame operations only.

Each input partition is a run: its (digest, length, second hash) keys in order, one entry per key with the smallest
identifier and a count. In binomial rounds, run 2i + 1 goes to run 2i: the two runs' slices (entries whose digests begin
alike) are exchanged, brought into one order and merged by a sorted aggregate, which keeps the smallest identifier of a
key. The last run holds the answer for the whole table. A key is verified by SHA-256, byte length and an independent
64-bit hash, at every level. A hot text is one entry per run after the first level, so no task receives its copies; the
slices of a run spread over all tasks, so the last rounds use all of them too.

Defined results: null text counts as the empty text; null ids lose to others and form the kept row only where a
group has no other; rows repeating both id and text share their fate; extra columns are ignored or passed on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import SPACES, table, without, written

#: Runs that meet in one merge; a round costs one shuffle of the distinct keys of each run, some 80 bytes a key.
FAN_IN = 2
KEY = ("digest", "n_bytes", "check")


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def digest_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One narrow row per document with its keys and the run (input partition) it belongs to, sorted by key."""
    norm = normalised(F.col(text_col))
    return docs.select(
        F.col(id_col).alias("id"),
        F.unhex(F.sha2(norm, 256)).alias("digest"),
        F.octet_length(norm).alias("n_bytes"),
        F.xxhash64(norm).alias("check"),
        F.spark_partition_id().alias("run"),
    ).sortWithinPartitions("digest")


def _merged(entries: DataFrame, count: Column) -> DataFrame:
    """One entry per run and key; entries that come in order leave in order. A null identifier loses to any other."""
    least = F.min(F.struct(F.col("keep_id").isNull().alias("none"), F.col("keep_id").alias("id")))
    return entries.groupBy("run", "slice", *KEY).agg(least["id"].alias("keep_id"), count.alias("group_size"))


def merge_runs(runs: DataFrame, n_runs: int, fan_in: int = FAN_IN) -> DataFrame:
    """The last run of the merge tree: one row per distinct key with ``keep_id`` and ``group_size``."""
    parts = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sliced = runs.select("run", F.substring("digest", 1, 2).alias("slice"), *KEY, F.col("id").alias("keep_id"))
    level = _merged(sliced, F.count(F.lit(1)))
    while n_runs > 1:
        n_runs = -(-n_runs // fan_in)
        meeting = level.withColumn("run", F.floor(F.col("run") / fan_in).cast("int")).repartition(parts, "run", "slice")
        level = _merged(meeting.sortWithinPartitions("run", "slice", *KEY), F.sum("group_size"))
    return level.drop("run", "slice")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = FAN_IN) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    runs = written(digest_runs(docs, id_col, text_col), "digest-runs")
    n_runs = (runs.agg(F.max("run").alias("m")).first()["m"] or 0) + 1
    best = merge_runs(runs, n_runs, fan_in)
    return runs.drop("run").join(best, list(KEY)).select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def without_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they came."""
    gone = exact_duplicates(docs, id_col, text_col).filter(~F.col("kept")).select(F.col(id_col).alias("_id"), F.col("text_sha256").alias("_sha")).distinct()
    sha = F.sha2(normalised(docs[text_col]), 256)
    return docs.join(gone, docs[id_col].eqNullSafe(gone["_id"]) & (sha == gone["_sha"]), "left_anti")


def one_of_equals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``without_duplicates``, but of rows that repeat both id and text one stays too: one row of each group."""
    gone = exact_duplicates(docs, id_col, text_col).filter(~F.col("kept")).select(F.col(id_col).alias("id"), F.col("text_sha256").alias("mark"))
    return without(docs, gone, id_col, F.sha2(normalised(F.col(text_col)), 256))


def op10_exact_dedup(spark, sf_dir):
    return exact_duplicates(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS s FROM documents),
g AS (SELECT s, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY s)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, s AS text_sha256 FROM n JOIN g USING (s)
"""
