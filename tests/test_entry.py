import os

import duckdb
import pytest

import __spark_entry__ as entry
from vecloom.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for f in os.listdir(DATA):
        connection.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return connection


def test_entry(spark):
    assert entry.entry(spark).count() == 10


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, tables, name):
    got = catalog.QUERIES[name](spark, DATA)
    if name not in catalog.ORACLE_SQL:
        assert got.count() > 0
        return
    want = tables.sql(catalog.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(want.select(*(f'"{c}"' for c in columns)).fetchall())
