"""Row numbers without a single-partition window, and small written intermediates."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_LOCAL: dict[str, str] = {}


def shared_path(spark: SparkSession, label: str) -> str:
    """A new place in the folder of ``spark.checkpoint.dir``. Only a local master may go without: there a temporary
    folder, one for each session, is shared by definition; a cluster without the setting is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        key = spark.sparkContext.applicationId
        if key not in _LOCAL:
            _LOCAL[key] = tempfile.mkdtemp(prefix="docloom-")
            atexit.register(shutil.rmtree, _LOCAL[key], ignore_errors=True)
        at = "file://" + _LOCAL[key]
    return f"{at.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Rows kept in the shared folder and read back."""
    path = shared_path(df.sparkSession, "rows")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_ordinal(df: DataFrame, keys: list[Column | str], name: str = "ord") -> DataFrame:
    """Number the rows from 0 in the order of keys: range-partitioned sort, then an offset per partition.

    The position within a partition is the lower part of the generated id; only the partitions' counts, one row
    each, are brought together. The sorted rows are written once, since range bounds are sampled anew in each plan.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbered = written(
        df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id())
    ).withColumns({"_part": F.shiftright("_id", 33), "_at": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))})
    counts = sorted((r["_part"], r["n"]) for r in numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect())
    offset, at = {}, 0
    for part, n in counts:
        offset[part], at = at, at + n
    start = F.create_map(*[F.lit(x) for kv in offset.items() for x in kv])[F.col("_part")] if offset else F.lit(0)
    return numbered.withColumn(name, (start + F.col("_at")).cast("bigint")).drop("_id", "_part", "_at")
