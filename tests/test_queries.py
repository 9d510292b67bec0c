"""Every registered query that has SQL gives DuckDB's rows on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def same(v):
    return f"{v:.6g}" if isinstance(v, float) else str(v)


def rows_of(df):
    return sorted(tuple(same(r[c]) for c in sorted(df.columns)) for r in df.collect())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    want = duck.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in want.description]
    assert sorted(cols) == sorted(got.columns)
    order = [cols.index(c) for c in sorted(cols)]
    assert rows_of(got) == sorted(tuple(same(r[k]) for k in order) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql()) - {n for n in entry.queries() if n.startswith("op") or n == "pipeline"}))
def test_runs(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 50
