"""Every catalogue query with SQL gives what DuckDB gives, on the smallest test tables."""

import glob
import math
import os

import pytest

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")

from osnowa.plans import catalogue  # noqa: E402


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)) or type(v).__name__ in ("Decimal",):
        return round(float(v), 4)
    return str(v)


def rows(pdf):
    cols = sorted(pdf.columns)
    return sorted(repr([plain(x) for x in r]) for r in pdf[cols].itertuples(index=False, name=None)), cols


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query(spark, duck, name):
    got, gcols = rows(catalogue.QUERIES[name](spark, DATA).toPandas())
    want, wcols = rows(duck.execute(catalogue.SQL[name]).df())
    assert gcols == wcols
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_runs(spark, name):
    got = catalogue.QUERIES[name](spark, DATA)
    assert len(set(got.columns)) == len(got.columns) > 0
    rows = got.collect()
    assert rows and all(len(r) == len(got.columns) for r in rows)
