"""Every query with SQL against DuckDB on the same tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted((tuple(round(r[k], 5) if isinstance(r[k], float) else r[k] for k in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = duck.sql(entry.oracle_sql()[name])
    want = rows_of(rel.columns, rel.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1]) and got[1] == want[1]


def test_entry(spark):
    assert entry.entry(spark).count() > 0
