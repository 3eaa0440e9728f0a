"""Every registered query with SQL gives the same rows as its SQL, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from brindle.plans import registry

NAMES = sorted(registry.oracle_sql())


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for f in os.listdir(small):
        con.execute(f"create view {f.split('.')[0]} as select * from '{small}/{f}'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(float(r[i]) + 0.0) if isinstance(r[i], (int, float)) and not isinstance(r[i], bool) else repr(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, small, duck, name):
    df = registry.queries()[name](spark, small)
    cur = duck.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, cur.fetchall())


def test_every_query_is_named_once_and_entry_runs(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    if os.path.isdir("/root/testdata/sf0.001"):
        assert entry.entry(spark).count() > 0
