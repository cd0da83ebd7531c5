"""Headline queries over every order line."""

import glob
import os

import duckdb
import pytest

from leadlake import catalog
from leadlake.operators import headlines as he

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def test_leads_and_report_of_every_line(spark, db):
    lines = db.execute("SELECT count(*) FROM lineitem JOIN part ON l_partkey = p_partkey").fetchone()[0]
    assert sum(r.fetched for r in catalog.QUERIES["A22_extraction_report"](spark, DATA).collect()) == lines
    pairs = {(r.company, r.vertical) for r in catalog.QUERIES["C13_headline_leads"](spark, DATA).collect()}
    # every part and vertical of the first lines of each title key
    want = db.execute(r"""WITH h AS (SELECT p_name, CASE WHEN l_suppkey % 2 = 0 THEN 'Banking' ELSE 'Pharma' END AS vertical, l_orderkey * 1000 + l_linenumber * 100 + l_partkey % 100 AS f, l_suppkey AS s,
      substr(regexp_replace(lower(CASE WHEN l_linenumber % 3 = 0 THEN 'Order win: ' ELSE '' END || p_name || ' Infra wins ₹' || (l_quantity::BIGINT) || '.5 ' || CASE WHEN l_linenumber % 2 = 0 THEN 'crore' ELSE 'billion' END
      || ' order from Ministry of ' || p_type || ' for works - Daily ' || (l_suppkey % 5)), '[^\p{L}\p{N}_]+', '', 'g'), 1, 60) AS k FROM lineitem JOIN part ON l_partkey = p_partkey)
      SELECT DISTINCT p_name || ' Infra', vertical FROM (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY k ORDER BY f, s) = 1)""").fetchall()
    assert pairs == set(want)
    assert catalog.QUERIES["F20_lead_rows"](spark, DATA).count() == 5 * len(pairs)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_no_pattern_is_compiled_for_each_title(spark):
    rows = [
        ("Order win: Tata Infra - East wins ₹5 crore order from Ministry of Steel for works", "Tata Infra", "Ministry of Steel"),
        ("one two three four five: Acme bags Rs. 1,000.5 cr from Odisha, says it", "one two three four five: Acme", "Odisha"),
        ("Acme\tLtd bags RS 3 billion from PSU Works, says it", "Acme\tLtd", "PSU Works"),
        ("B C D E F G H I wins ₹5 crore goa", "B C D E F G H I", "Government (India)"),
        ("B C D E F G H I J wins ₹5 crore goa", None, None),
        ("Ministry of Steel wins ₹5 crore goa", None, None),
        ("“Éclat Works” wins ₹5 crore goa", "Éclat Works", "Government (India)"),
        ("lower only wins ₹5 crore goa", None, None),
        ("₹5 crore goa", None, None),
        ("wins ₹5 crore goa", None, None),
        (None, None, None),
    ]
    df = spark.createDataFrame([(k, r[0], "V") for k, r in enumerate(rows)], "id int, title string, vertical string")
    out = he.extract(df)
    got = {r.id: (r.company, r.government_buyer) for r in out.collect()}
    assert got == {k: r[1:] for k, r in enumerate(rows) if r[1]}
    assert "split(" not in plan(out)  # split compiles its pattern for every row


def test_title_keys_are_made_once(spark):
    titles = ["A <b>win</b>!", "a WIN", "", "<i></i>", None, "B < win", "other"]
    df = spark.createDataFrame([(k, 7, "V", t) for k, t in enumerate(titles)], "feed_ord bigint, supp bigint, vertical string, title string")
    out = he.deduplicated(df, 10)
    assert sorted(r.feed_ord for r in out.collect()) == [0, 5, 6]
    assert plan(out).count("(?U)") == 1
