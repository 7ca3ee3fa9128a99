"""Queries of the subpackage against their SQL, and that all of them run."""

import os

import duckdb
import pytest

from moenda.llm import catalog

COLUMNS = {"p2_found": ["row_number", "line_no"], "p3_found": ["row_number", "line_no"], "p4_found": ["kept_row", "copy_row"], "p6_found": ["doc_id_a", "doc_id_b"], "p7_ids": ["doc_id", "ids"], "p9_found": ["doc_id"]}


def rows_of(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(map(repr, frame.where(frame.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_sql(spark, data, name):
    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"create view {f.split('.')[0]} as select * from '{data}/{f}'")
    got, want = catalog.queries()[name](spark, data).toPandas(), con.sql(catalog.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows_of(got) == rows_of(want)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.SQL)))
def test_runs(spark, data, name):
    df = catalog.queries()[name](spark, data)
    assert df.columns == COLUMNS.get(name, df.columns)
    rows = df.collect()
    if name in COLUMNS and name != "p7_ids":
        assert len(rows) == len(set(rows)) and all(v is not None for r in rows for v in r)
