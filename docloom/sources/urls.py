"""Web scans: URLs become rows of responses, fetched where the rows are; what fails is a row with ``error``."""

from __future__ import annotations

import urllib.request
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TIMEOUT = 30
AGENT = "Mozilla/5.0 (compatible; docloom)"


def fetch(url: str, timeout: int = TIMEOUT) -> dict:
    try:
        if not url.startswith(("http://", "https://")):
            raise ValueError("not a web address")
        with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": AGENT}), timeout=timeout) as r:
            return {"status_code": r.status, "content_type": r.headers.get_content_type(), "content": r.read(), "error": None}
    except Exception as e:  # noqa: BLE001  a failed fetch is a row that says so
        return {"status_code": getattr(e, "code", None), "content_type": None, "content": None, "error": f"{type(e).__name__}: {e}"}


def responses(df: DataFrame, url: str = "path", timeout: int = TIMEOUT, get=fetch) -> DataFrame:
    """Add status_code, content_type, content and error. Spread the rows first where one partition holds them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(len(batch)):
                row = batch.iloc[i : i + 1]
                yield row.assign(**{k: pd.Series([v], index=row.index, dtype=object) for k, v in get(row[url].iloc[0], timeout).items()})

    keep = [c for c in df.columns if c not in ("status_code", "content_type", "content", "error")]
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep).mapInPandas(run, f"{kinds}, status_code int, content_type string, content binary, error string")


def pages(df: DataFrame, url: str = "path", timeout: int = 10, get=fetch) -> DataFrame:
    """Responses with their text as ``html``."""
    return responses(df, url, timeout, get).withColumn("html", F.make_valid_utf8(F.col("content").cast("string")))
