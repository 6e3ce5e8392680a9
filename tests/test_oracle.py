"""Every query with a SQL twin gives the same rows in Spark and DuckDB (smallest tables)."""

import os

import duckdb
import pytest

from voxelith.registry import QUERIES, SQL

@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf_dir}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*cols).collect()), key=str)
    q = duck.execute(SQL[name])
    names = [c[0] for c in q.description]
    want = sorted((tuple(r[names.index(c)] for c in cols) for r in q.fetchall()), key=str)
    assert sorted(names) == cols and len(got) == len(want)
    # both sides round alike, so doubles are equal, or both not a number
    for a, b in zip(got, want, strict=True):
        assert all(x == y or (x != x and y != y) for x, y in zip(a, b, strict=True)), (a, b)
