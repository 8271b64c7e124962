"""The registered queries of the text problems against their SQL."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from quern.llm import queries as P


def norm(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple("NULL" if r[i] is None else repr(r[i] + 0.0) if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", list(P.SQL))
def test_query(spark, data, name):
    larger = data.replace("sf0.001", "sf0.01")  # shares need enough documents to be met
    data = larger if os.path.isdir(larger) else data
    sql = duckdb.connect()
    sql.sql("set timezone='UTC'")
    for f in os.listdir(data):
        sql.sql(f"create view {f.split('.')[0]} as select * from '{data}/{f}'")
    df = entry.queries()[name](spark, data)
    want = sql.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert norm(df.columns, df.collect()) == norm(want.columns, want.fetchall())
