"""Every query with SQL against DuckDB, row for row; the others run and give rows."""

import duckdb
import pytest

import __spark_entry__ as entry
from chronoweave.plans import oracle, queries
from conftest import DATA

SF = f"{DATA}/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def norm(x):
    return round(x, 6) if isinstance(x, float) else x


def key(r):
    return tuple(map(repr, r))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=key)
    if name not in oracle.ORACLE:
        assert got
        return
    rel = duck.sql(oracle.ORACLE[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    want = sorted((tuple(norm(r[i]) for i in at) for r in rel.fetchall()), key=key)
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(oracle.ORACLE) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
