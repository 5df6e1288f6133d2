"""What the training-data operators share: table access, written intermediates, block counts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Whitespace of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: More tasks than this a stage never gets; beyond it partitions grow instead.
MAX_PARTS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Only a local master may go without (tests): there a
    temporary folder, one for each session, is shared by definition; a cluster without the setting is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        key = spark.sparkContext.applicationId
        if key not in _LOCAL:
            _LOCAL[key] = tempfile.mkdtemp(prefix="docloom-")
            atexit.register(shutil.rmtree, _LOCAL[key], ignore_errors=True)
        at = "file://" + _LOCAL[key]
    return at.rstrip("/")


_LOCAL: dict[str, str] = {}


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read the files again, so lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def without(docs: DataFrame, gone: DataFrame, id_col: str, mark: Column) -> DataFrame:
    """The rows of ``docs`` whose id and mark ``gone(id, mark)`` does not hold; of rows that repeat both, one stays, whole.

    Repeats go within each input partition first, so no task receives them all; one shuffle serves this and the join."""
    keys = ["_mark", "_null", "_key"]
    named = lambda c: (c.isNull().alias("_null"), F.coalesce(c.cast("string"), F.lit("")).alias("_key"))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), mark.alias("_mark"), *named(F.col(id_col))).dropDuplicates(keys)
    return rows.join(gone.select(F.col("mark").alias("_mark"), *named(F.col("id"))).distinct(), keys, "left_anti").select("_row.*")


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bound what one Arrow batch of long texts can hold; the byte limit applies where Spark has one."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def spread(scan: DataFrame) -> DataFrame:
    """A table read in fewer parts than there are cores, dealt over all of them; any other as it is.

    For scans only: asking a scan for its partitions runs nothing."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def parts_for(spark: SparkSession, n_bytes: int, target: int = 16 << 20) -> int:
    """Partitions for so many bytes, never fewer than the session's own setting and at most ``MAX_PARTS``."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MAX_PARTS, -(-int(n_bytes) // target)))


def text_bytes(df: DataFrame, col: str = "text") -> int:
    return df.agg(F.sum(F.octet_length(col)).alias("n")).first()["n"] or 0
