"""Each catalog query beside its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry
from loomline.plans import catalog, log_queries, oracle

QUERIES, ORACLE_SQL = catalog.QUERIES | log_queries.QUERIES, oracle.ORACLE_SQL | log_queries.ORACLE_SQL


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return value


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for f in os.listdir(small):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{small}/{f}')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(name, spark, small, duck):
    df = QUERIES[name](spark, small)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    cursor = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)
    assert got == want


def test_entry(spark, small):
    assert set(QUERIES) == set(ORACLE_SQL) | {"vocabulary_rows", "vocabulary_render"}  # these are held against brute force in test_one_pass.py
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
