import sys
import uuid
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def tables(spark, tmp_path):
    """tables(name=(schema, rows), ...) writes parquet tables and returns their folder."""

    def make(**given):
        at = tmp_path / uuid.uuid4().hex
        for name, (schema, rows) in given.items():
            spark.createDataFrame(rows, schema).coalesce(2).write.parquet(f"{at}/{name}.parquet")
        return str(at)

    return make
