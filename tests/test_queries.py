"""Every query against its SQL form in DuckDB, on the smallest tables; those without one must give rows."""

import glob
import os

import duckdb
import pytest

from glyphmill.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def rows(columns, data):
    place = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in place) for r in data), key=repr)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    run, sql = QUERIES[name]
    df = run(spark, SF)
    got = df.collect()
    if sql is None:
        assert got
        return
    want = con.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, got) == rows(want.columns, want.fetchall())
