"""Every checked query with a SQL twin gives the same rows in DuckDB, over the whole tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

BASE = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(BASE), reason="test tables are not here")
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{BASE}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(repr(r[i]) for i in order) for r in records)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, BASE)
    got = df.collect()
    cur = duck.execute(ORACLES[name])
    want, cols = cur.fetchall(), [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert rows(df.columns, got) == rows(cols, want)


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(ORACLES)))
def test_rows_only_query_gives_rows(spark, name):
    assert entry.queries()[name](spark, BASE).count() > 0


def test_flagship(spark):
    assert {r.landscape for r in entry.entry(spark).collect()} == {"urban", "sparse", "hilly", "forested", "all"}
