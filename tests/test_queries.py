"""Every registered query with SQL against DuckDB on the smallest test tables."""

import decimal
import glob
import os

import duckdb
import pytest

from leadlake import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def norm(v):
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return tuple((k, norm(x)) for k, x in sorted(v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return round(float(v), 6) if isinstance(v, (float, decimal.Decimal)) else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, db, name):
    df = catalog.QUERIES[name](spark, DATA)
    got = sorted((repr(norm(r.asDict())) for r in df.collect()))
    cursor = db.execute(catalog.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    want = sorted(repr(norm(dict(zip(columns, r)))) for r in cursor.fetchall())
    assert sorted(df.columns) == sorted(columns)
    assert got == want and want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0
