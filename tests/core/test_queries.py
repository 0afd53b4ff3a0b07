"""Every query with SQL against DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from cartoflux.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLE_SQL])
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.sql(ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    key = lambda names, row: repr(tuple(row[names.index(c)] for c in columns))
    assert sorted(key(df.columns, tuple(r)) for r in df.collect()) == sorted(key(want.columns, r) for r in want.fetchall())
