"""Every registered query of this folder against its SQL in an independent database, at the smallest scale."""

import os

import duckdb
import pytest

from dyadix.queries import ORACLE, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in os.listdir(DIR):
        con.execute(f"create view {name.split('.')[0]} as select * from '{DIR}/{name}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    got = QUERIES[name](spark, DIR).toPandas()
    if name not in ORACLE:
        assert len(got)
        return
    want = db.execute(ORACLE[name]).fetchdf()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and len(got) == len(want)
    a, b = (d[columns].astype(str).sort_values(columns).reset_index(drop=True) for d in (got, want))
    assert a.equals(b)
