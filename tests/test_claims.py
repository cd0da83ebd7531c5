"""The check of claims against the facts of a row."""

import os

import pytest
from pyspark.sql import functions as F

from leadlake import catalog
from leadlake.operators import briefs

DATA = "/root/testdata/sf0.001"


def test_facts_support_what_verify_says(spark):
    told = [[("₹5.0 crore", "Value: ₹5.0 crore"), ("2001-08-30", "Date: 2001-08-30")], [("a@b.example", "Mail: a@b.example"), ("12", None)], [], None]
    texts = ["worth 5 cr in 2001, call x@y.example", "write to a@b.example, 12 or 34", "in 2001", "nothing"]
    row = [(k, [("F", "x", s, v, 3, None, None) for v, s in f] if f is not None else None, t) for k, (f, t) in enumerate(zip(told, texts))]
    fact = "struct<fact_id: string, kind: string, statement: string, value: string, tier: int, confidence: double, source_url: string>"
    leads = spark.createDataFrame(row, f"k long, facts array<{fact}>, body string")
    parts = F.array(F.struct(F.lit(1).alias("ord"), F.col("body")), F.struct(F.lit(2).alias("ord"), F.lit("99").alias("body")))
    got = briefs.verified(leads, parts).select("k", F.explode("checked").alias("x")).select("k", "x.*")
    facts = leads.select("k", F.explode("facts").alias("f")).select("k", "f.*")
    want = briefs.verify(leads.select("k", F.explode(parts).alias("x")).select("k", "x.*"), facts, "k")
    order = lambda df: sorted(map(tuple, df.select("k", "ord", "numbers", "contacts", "status").collect()))
    assert order(got) == order(want) and len(order(got)) == 8


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")
def test_a_row_is_scanned_once(spark):
    """For numbers, addresses and phones, of the facts and of the sections: six scans, and no derived filter repeats them."""
    key = "spark.sql.maxPlanStringLength"
    spark.conf.set(key, "100000000")
    try:
        plan = catalog.QUERIES["C09_verified_claims"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
        brief = catalog.QUERIES["C08_rendered_briefs"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset(key)
    assert 0 < plan.count("regexp_extract_all") <= 6
    assert brief.count("No major risk is known.") == 1
