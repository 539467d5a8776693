"""Every registered query with a SQL counterpart, compared on the smallest tables."""
import collections
import os

import pytest

import __spark_entry__ as entry_module

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables not present")
duckdb = pytest.importorskip("duckdb")
QUERIES, SQL = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, database, name):
    df = QUERIES[name](spark, DATA)
    result = database.execute(SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    at = [columns.index(c) for c in df.columns]
    want = collections.Counter(tuple(repr(r[i]) for i in at) for r in result.fetchall())
    got = collections.Counter(tuple(map(repr, r)) for r in df.collect())
    assert got == want


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


def test_sql_only_for_registered_queries():
    assert set(SQL) <= set(QUERIES)
