"""Queries against their SQL in an independent engine, over the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _norm(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(_norm, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


CORE = [k for k in entry.queries() if k in entry.oracle_sql() and not k.startswith("op")]


@pytest.mark.parametrize("name", CORE)
def test_query_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    names = sorted(df.columns)
    got = sorted((tuple(_norm(r[c]) for c in names) for r in df.collect()), key=repr)
    res = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in res.description]
    assert sorted(cols) == names
    assert got == sorted((tuple(_norm(r[cols.index(c)]) for c in names) for r in res.fetchall()), key=repr)
