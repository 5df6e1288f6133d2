"""The catalogue against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from docloom.plans import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rounded(value):
    return round(value, 9) if isinstance(value, float) else int(value) if type(value).__name__ == "Decimal" else value


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sql, name):
    df = queries.QUERIES[name](spark, SF)
    rows, columns = df.collect(), sorted(df.columns)
    if name not in queries.ORACLES:
        assert rows
        return
    found = sql.execute(queries.ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    want = sorted((repr([rounded(dict(zip(names, r))[c]) for c in columns]) for r in found.fetchall()))
    assert sorted(repr([rounded(r[c]) for c in columns]) for r in rows) == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
