"""The driver's tables as the library's domain tables, in Spark and, for the oracles, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2001-08-31"
_TYPES = {"F": "contract_award", "O": "scheme", "P": "work_order"}
_SECTORS = {"BUILDING": "Smart Cities", "AUTOMOBILE": "Defence", "MACHINERY": "e-Governance", "HOUSEHOLD": "Healthcare", "FURNITURE": "IT"}
_PROJECTS = {
    "1-URGENT": "Smart city data centre", "2-HIGH": "construction project execution", "3-MEDIUM": "skill training mission",
    "4-NOT SPECIFIED": "digital governance platform", "5-LOW": "supply of goods",
}
_FEEDBACK = {"view": "lead_viewed", "click": "contacted", "signup": "meeting_booked", "purchase": "opportunity_created", "error": "not_relevant"}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def pick(column, values: dict, other=None):
    """A small constant lookup as a CASE expression."""
    out = None
    for k, v in values.items():
        out = F.when(F.col(column) == k, v) if out is None else out.when(F.col(column) == k, v)
    return out.otherwise(other)


def _case(column: str, values: dict) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


def events(spark: SparkSession, d: str) -> DataFrame:
    """Award events: orders with customer and nation."""
    o, c, n = table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "nation")
    joined = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), c.c_nationkey == n.n_nationkey)  # nation: 25 rows by definition
    return joined.select(
        F.col("o_orderkey").alias("event_id"), F.col("c_custkey").alias("company_id"), F.col("c_name").alias("awardee"), F.col("n_name").alias("buyer"),
        pick("c_mktsegment", _SECTORS).alias("sector"), F.round(F.col("o_totalprice") * 10000).cast("long").alias("value"),
        F.to_date("o_orderdate").alias("event_date"), pick("o_orderstatus", _TYPES).alias("event_type"),
        F.when(F.col("o_orderkey") % 10 == 0, "USD").otherwise("INR").alias("currency"), pick("o_orderpriority", _PROJECTS).alias("project"),
        F.concat(F.lit("ORD/"), "o_orderkey").alias("reference"),
    )


def reports(spark: SparkSession, d: str) -> DataFrame:
    """Several reports of each award: one per order line, with identifier variants, small value and date changes."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.col("l_linenumber").alias("ln")).distinct()
    ln = F.col("ln")
    return lines.join(events(spark, d), "event_id").select(
        (F.col("event_id") * 8 + ln).alias("report_id"), "event_id", "company_id", "buyer", F.col("awardee").alias("company"), "event_type",
        (F.col("value") + F.col("value") * ln / 1000).cast("long").alias("value"), F.date_add("event_date", ln % 4).alias("event_date"),
        F.when(ln % 3 == 0, None).when(ln % 2 == 0, F.concat(F.lit("ORD/"), "event_id")).otherwise(F.concat(F.lit("ord "), "event_id")).alias("reference"),
    )


def companies(spark: SparkSession, d: str) -> DataFrame:
    """Company observations: three customers in a row are one company under different spellings and identifiers."""
    k = F.col("c_custkey")
    base = (k - k % 3).cast("long")
    name = F.concat(F.lit("Acme "), F.when(k % 6 < 3, "Infra").otherwise("Data"), F.lit(" "), base)
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    return c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).select(
        k.alias("obs_id"),
        F.when(k % 4 == 0, F.concat(F.lit("M/s "), name, F.lit(" Pvt Ltd"))).when(k % 4 == 1, F.concat(name, F.lit("  Limited"))).when(k % 4 == 2, F.concat(name, F.lit(" Private Limited"))).otherwise(F.upper(name)).alias("raw_name"),
        F.when(k % 5 == 0, F.concat(F.lit(" cin"), base)).when(k % 17 == 0, F.concat(F.lit("CIN"), k)).alias("cin"), F.when(k % 7 == 0, F.concat(F.lit("GST"), base)).alias("gstin"),
        F.when(k % 11 == 0, F.concat(F.lit("PAN"), base)).alias("pan"), F.when(k % 2 == 1, F.concat(F.lit("https://www.C"), base, F.lit(".example.com/about?x=1"))).alias("website"),
        F.when(k % 9 != 0, F.concat(F.lit("City "), (base % 50).cast("string"))).alias("city"), F.col("n_name").alias("state"), F.col("c_acctbal").alias("balance"),
    )


def feedback(spark: SparkSession, d: str) -> DataFrame:
    """Feedback log: user events."""
    return table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("lead_id"), pick("event_type", _FEEDBACK).alias("event_type"), F.col("ts").alias("occurred_at"))


def leads(spark: SparkSession, d: str) -> DataFrame:
    """Lead meta: customers with a score and dimensions."""
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(
        k.alias("lead_id"), F.pmod(F.floor("c_acctbal"), F.lit(101)).cast("int").alias("score"), pick("c_mktsegment", _SECTORS).alias("sector"),
        F.when(k % 13 == 0, None).otherwise(F.concat(F.lit("product-"), (k % 5).cast("string"))).alias("product"),
        F.when(k % 3 == 0, "scheme").when(k % 3 == 1, "award").otherwise("work_order").alias("event_type"), F.col("c_name").alias("company"),
    )


def claims(spark: SparkSession, d: str) -> DataFrame:
    """Enrichment claims about a company (customer) from its orders: source, tier, field, value, confidence."""
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    field = F.element_at(F.array(*map(F.lit, ("website", "industry", "hq_location", "employee_range", "recent_contracts", "funding_signals"))), (k % 6 + 1).cast("int"))
    return o.select(
        F.col("o_custkey").alias("company_id"), k.alias("seq"), field.alias("field"), F.concat(F.lit("Value  "), (F.floor(F.col("o_totalprice") / 100000)).cast("string")).alias("value"),
        F.concat(F.lit("source-"), (k % 7).cast("string")).alias("source_name"), (F.lit(1) + k % 4).cast("int").alias("tier"), ((k % 50 + 40) / 100).alias("confidence"), F.col("o_orderdate").alias("retrieved_at"),
    )


def contacts(spark: SparkSession, d: str) -> DataFrame:
    """Contact candidates of companies (nations) from two sources."""
    titles = ("Chief Information Officer", "Director of IT", "VP Sales", "Head of Procurement", "Project Manager", "Analyst", None)
    k = F.col("c_custkey")
    title = F.element_at(F.array(*map(F.lit, titles)), (k % 7 + 1).cast("int"))
    name = F.concat(F.when(k % 2 == 0, "Dr. ").otherwise("dr "), F.lit("Person "), (F.floor(k / 2) % 40).cast("string"))
    return table(spark, d, "customer").select(
        k.alias("seq"), F.col("c_nationkey").alias("company_id"), name.alias("name"), title.alias("title"),
        F.when(k % 3 == 0, F.concat(F.lit("p"), k, F.when(k % 6 == 0, "@gmail.com").otherwise("@corp.example"))).alias("email"),
        F.when(k % 4 == 0, F.concat(F.lit("+91 98"), F.lpad(k.cast("string"), 8, "0"))).alias("phone"), F.concat(F.lit("source-"), (k % 2).cast("string")).alias("source_name"),
        ((k % 40 + 50) / 100).alias("confidence"), (k % 5 == 0).alias("verified"), (F.col("c_acctbal") < 0).alias("do_not_contact"),
    )


#: The same tables as SQL over the driver's views.
VIEWS = {
    "ev": f"""SELECT o_orderkey AS event_id, c_custkey AS company_id, c_name AS awardee, n_name AS buyer, {_case("c_mktsegment", _SECTORS)} AS sector,
      round(o_totalprice * 10000)::BIGINT AS value, o_orderdate::DATE AS event_date, {_case("o_orderstatus", _TYPES)} AS event_type,
      CASE WHEN o_orderkey % 10 = 0 THEN 'USD' ELSE 'INR' END AS currency, {_case("o_orderpriority", _PROJECTS)} AS project, 'ORD/' || o_orderkey AS reference
      FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "rp": """SELECT event_id * 8 + ln AS report_id, event_id, company_id, buyer, awardee AS company, event_type, trunc(value + value * ln / 1000)::BIGINT AS value,
      event_date + (ln % 4)::INTEGER AS event_date, CASE WHEN ln % 3 = 0 THEN NULL WHEN ln % 2 = 0 THEN 'ORD/' || event_id ELSE 'ord ' || event_id END AS reference
      FROM (SELECT DISTINCT l_orderkey AS event_id, l_linenumber AS ln FROM lineitem) JOIN ev USING (event_id)""",
    "co": """SELECT k AS obs_id, CASE k % 4 WHEN 0 THEN 'M/s ' || name || ' Pvt Ltd' WHEN 1 THEN name || '  Limited' WHEN 2 THEN name || ' Private Limited' ELSE upper(name) END AS raw_name,
      CASE WHEN k % 5 = 0 THEN ' cin' || base WHEN k % 17 = 0 THEN 'CIN' || k END AS cin, CASE WHEN k % 7 = 0 THEN 'GST' || base END AS gstin, CASE WHEN k % 11 = 0 THEN 'PAN' || base END AS pan,
      CASE WHEN k % 2 = 1 THEN 'https://www.C' || base || '.example.com/about?x=1' END AS website, CASE WHEN k % 9 <> 0 THEN 'City ' || (base % 50) END AS city, n_name AS state, c_acctbal AS balance
      FROM (SELECT *, c_custkey AS k, c_custkey - c_custkey % 3 AS base, 'Acme ' || CASE WHEN c_custkey % 6 < 3 THEN 'Infra' ELSE 'Data' END || ' ' || (c_custkey - c_custkey % 3) AS name FROM customer)
      JOIN nation ON c_nationkey = n_nationkey""",
    "fb": f"SELECT event_id AS seq, user_id AS lead_id, {_case('event_type', _FEEDBACK)} AS event_type, ts AS occurred_at FROM events",
    "ld": f"""SELECT c_custkey AS lead_id, ((floor(c_acctbal)::BIGINT % 101 + 101) % 101)::INTEGER AS score, {_case("c_mktsegment", _SECTORS)} AS sector,
      CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE 'product-' || (c_custkey % 5) END AS product,
      CASE c_custkey % 3 WHEN 0 THEN 'scheme' WHEN 1 THEN 'award' ELSE 'work_order' END AS event_type, c_name AS company FROM customer""",
    "cl": """SELECT o_custkey AS company_id, o_orderkey AS seq, list_extract(['website', 'industry', 'hq_location', 'employee_range', 'recent_contracts', 'funding_signals'], (o_orderkey % 6 + 1)::BIGINT) AS field,
      'Value  ' || floor(o_totalprice / 100000)::BIGINT AS value, 'source-' || (o_orderkey % 7) AS source_name, (1 + o_orderkey % 4)::INTEGER AS tier, (o_orderkey % 50 + 40) / 100 AS confidence, o_orderdate AS retrieved_at FROM orders""",
    "ct": """SELECT c_custkey AS seq, c_nationkey AS company_id, CASE WHEN c_custkey % 2 = 0 THEN 'Dr. ' ELSE 'dr ' END || 'Person ' || ((c_custkey // 2) % 40) AS name,
      list_extract(['Chief Information Officer', 'Director of IT', 'VP Sales', 'Head of Procurement', 'Project Manager', 'Analyst', NULL], (c_custkey % 7 + 1)::BIGINT) AS title,
      CASE WHEN c_custkey % 3 = 0 THEN 'p' || c_custkey || CASE WHEN c_custkey % 6 = 0 THEN '@gmail.com' ELSE '@corp.example' END END AS email,
      CASE WHEN c_custkey % 4 = 0 THEN '+91 98' || lpad(c_custkey::VARCHAR, 8, '0') END AS phone, 'source-' || (c_custkey % 2) AS source_name,
      (c_custkey % 40 + 50) / 100 AS confidence, c_custkey % 5 = 0 AS verified, c_acctbal < 0 AS do_not_contact FROM customer""",
}
_NEEDS = {"rp": ("ev",)}
#: Common table expressions that are computed once for all that reads them.
ONCE = ("l0", "l2")


def sql(body: str, *views: str, more: dict[str, str] | None = None) -> str:
    """SQL over domain views: body with the views it needs (and others given as text) as common table expressions."""
    names: list[str] = []
    for v in views:
        names += [x for x in (*_NEEDS.get(v, ()), v) if x not in names]
    parts = [f"{v} AS ({VIEWS[v]})" for v in names] + [f"{k} AS {'MATERIALIZED ' * (k in ONCE)}({v})" for k, v in (more or {}).items()]
    return (f"WITH {', '.join(parts)} " if parts else "") + body
