"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def sql(data):
    c = duckdb.connect()
    c.sql("set timezone='UTC'")
    for f in os.listdir(data):
        c.sql(f"create view {f.split('.')[0]} as select * from '{data}/{f}'")
    return c


def norm(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple("NULL" if r[i] is None else repr(r[i] + 0.0) if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


def core():
    from quern.plans import pipeline_queries, registry

    return [*registry.QUERIES, *pipeline_queries.QUERIES]


@pytest.mark.parametrize("name", core())
def test_query(spark, data, sql, name):
    df = entry.queries()[name](spark, data)
    rows = df.collect()
    if name in entry.oracle_sql():
        want = sql.sql(entry.oracle_sql()[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert norm(df.columns, rows) == norm(want.columns, want.fetchall())


def test_entry(spark, data):
    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
