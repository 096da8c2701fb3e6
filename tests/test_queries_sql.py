"""Every query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from cairn.plans import incremental_queries, index_queries, queries, sql

ALL = queries.QUERIES | index_queries.QUERIES | incremental_queries.QUERIES
SQL = sql.SQL | index_queries.SQL | incremental_queries.SQL


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in os.listdir(data):
        con.execute(f"create view {f.split('.')[0]} as select * from '{data}/{f}'")
    return con


def cell(v):
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, float):
        return None if v != v else round(v, 9)
    return v


def rows(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([cell(r[i]) for i in order]) for r in records)


@pytest.mark.parametrize("name", sorted(ALL))
def test_query(spark, data, duck, name):
    got = ALL[name](spark, data)
    records = [tuple(r) for r in got.collect()]
    if name not in SQL:
        return
    want = duck.execute(SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    assert rows(got.columns, records) == rows(names, want.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns[0] == "query_id"
    assert set(entry.oracle_sql()) <= set(entry.queries())
