"""Queries against their SQL on texts that the test tables lack."""

import duckdb
import pytest

from leadlake import catalog

TEXTS = ("", " ", "{a", "[at] x", " [x", "%PDF", "<!doctype html>", "A.", "É", None)


@pytest.mark.parametrize("name", ["F06_validation"])
def test_odd_texts_equal_the_sql(spark, tmp_path, name):
    rows = [(60 * i + k, t) for i, t in enumerate(TEXTS) for k in range(6)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted(repr(tuple(r)) for r in catalog.QUERIES[name](spark, str(tmp_path)).collect())
    assert got == sorted(repr(r) for r in db.execute(catalog.ORACLES[name]).fetchall())
