"""The canonical attachment row, and how any table becomes one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Column -> (Spark type, default expression). Order is semantic, so it is carried, never implied.
COLUMNS = {
    "ord": ("bigint", "0"),
    "chunk_ord": ("int", "0"),
    "attachy": ("string", "path"),
    "path": ("string", "''"),
    "commands": ("map<string,string>", "map()"),
    "kind": ("string", "null"),
    "content": ("binary", "null"),
    "text": ("string", "''"),
    "images": ("array<string>", "array()"),
    "audio": ("array<string>", "array()"),
    "metadata": ("map<string,string>", "map()"),
    "error": ("string", "null"),
}

#: What a splitter adds; null where it does not apply.
CHUNK_COLUMNS = ("chunk_type", "chunk_index", "total_chunks", "original_path")


def canonical(df: DataFrame) -> DataFrame:
    """Add the canonical columns that are missing; the rest of the table stays."""
    have = set(df.columns)
    if "path" not in have:
        df = df.withColumn("path", F.lit(""))
    return df.withColumns({c: F.expr(f"cast({default} as {kind})") for c, (kind, default) in COLUMNS.items() if c not in have and c != "path"})
