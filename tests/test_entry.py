"""The driver contract: names, and each query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(set(entry.audit.oracle_sql())))
def test_query_equals_its_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    made = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in made.description]
    assert sorted(columns) == sorted(got.columns)
    order = sorted(columns)
    want = sorted(repr(tuple(r[columns.index(c)] for c in order)) for r in made.fetchall())
    assert sorted(repr(tuple(r[c] for c in order)) for r in got.collect()) == want
