"""Every query that has SQL gives the SQL's rows."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from moenda.plans import catalog

SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for f in os.listdir(data):
        c.execute(f"create view {f.split('.')[0]} as select * from '{data}/{f}'")
    return c


def rows_of(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(map(repr, frame.where(frame.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, data, name):
    got = entry.queries()[name](spark, data).toPandas()
    if name in SQL:
        want = con.sql(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows_of(got) == rows_of(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
