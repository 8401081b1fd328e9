"""Every query with SQL gives the same rows as DuckDB over the smallest tables; the others run."""

import glob
import os

import pytest

from corvane.plans import catalogue

DATA = os.environ.get("CORVANE_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def normal(v):
    if isinstance(v, float):
        return round(v, 7)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(normal(x) for x in v)
    return v


def same(spark, con, run, sql):
    df = run(spark, DATA)
    got = sorted((tuple(normal(v) for v in r) for r in df.collect()), key=repr)
    relation = con.sql(sql)
    names = list(relation.columns)
    assert sorted(names) == sorted(df.columns)
    at = [names.index(c) for c in df.columns]
    want = sorted((tuple(normal(r[i]) for i in at) for r in relation.fetchall()), key=repr)
    assert got == want


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_as_sql(spark, con, name):
    same(spark, con, catalogue.QUERIES[name], catalogue.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, DATA).columns
    assert catalogue.QUERIES[name](spark, DATA).count() > 0
