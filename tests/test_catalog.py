"""Every registered query of the library against its SQL, on the smallest tables."""

import datetime
import os

import duckdb
import pytest

from airledger.plans import catalog

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return f"{value:.5f}".replace("-0.00000", "0.00000")
    if isinstance(value, (datetime.date, datetime.datetime)) or value is None or isinstance(value, (bool, int)):
        return str(value)
    return plain(float(value)) if hasattr(value, "quantize") else str(value)


@pytest.mark.parametrize("name", list(SQL))
def test_query_matches_sql(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(row[c]) for c in columns) for row in df.collect())
    result = duck.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(tuple(plain(row[i]) for i in at) for row in result.fetchall())


@pytest.mark.parametrize("name", [n for n in catalog.queries() if n not in SQL])
def test_query_runs(spark, name):
    assert catalog.queries()[name](spark, DATA).count() >= 0
