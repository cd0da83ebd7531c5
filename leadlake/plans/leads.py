"""Queries of rules, scores and the board."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from leadlake.functions import values as v
from leadlake.operators import board as bd
from leadlake.operators import opportunities as op
from leadlake.operators import scoring as sc
from leadlake.plans import fixtures as fx
from leadlake.plans.fixtures import sql
from leadlake.plans.registry import query
from leadlake.plans.scalars import VALUE_TEXT_SQL, grade_sql


def as_of():
    return F.to_date(F.lit(fx.AS_OF))


def _list(values) -> str:
    return "[" + ", ".join("'" + str(x).replace("'", "''") + "'" for x in values) + "]::VARCHAR[]"


RULES_SQL = " UNION ALL ".join(
    f"SELECT '{r[0]}' AS product_id, '{r[1]}' AS name, '{r[2]}' AS category, {_list(r[3])} AS triggers, {_list(r[4])} AS keywords, {r[5] or 'NULL'}::DOUBLE AS min_value, {_list(r[6])} AS sectors, '{r[7]}' AS need_key, '{r[8]}' AS need, {r[9]} AS tier, '{r[10]}' AS timing, {_list(r[11])} AS signals"
    for r in op.RULES
)
SIGNALS_SQL = "SELECT company_id, 'expansion_activity' AS signal, 0.8 AS confidence FROM ev GROUP BY company_id HAVING count(*) >= 12 UNION ALL SELECT company_id, 'technology_activity', NULL FROM ev WHERE project LIKE '%digital%' GROUP BY company_id HAVING count(*) >= 3"
MATCH_SQL = """SELECT e.*, r.*, coalesce(r.min_value, 0) AS threshold, (len(r.sectors) = 0 OR coalesce(list_bool_or(list_transform(r.sectors, lambda x: contains(lower(e.sector), lower(x)) OR contains(lower(x), lower(e.sector)))), false)) AS sector_ok,
  lower(concat_ws(' ', e.event_type, e.awardee, e.sector, e.project)) AS txt FROM ev e JOIN rl r ON list_contains(r.triggers, e.event_type)"""
MATCHED_SQL = "SELECT * FROM ma WHERE (sector_ok OR list_bool_or(list_transform(keywords, lambda k: contains(txt, k)))) AND (threshold = 0 OR value >= threshold)"
OPP_SQL = """SELECT m.*, list_filter(m.signals, lambda s: list_contains(coalesce(k.names, []), s)) AS corroborated_by,
  (CASE m.tier WHEN 3 THEN 0.85 WHEN 2 THEN 0.5 ELSE 0.3 END + CASE WHEN threshold <> 0 THEN round(0.15 * least(1.0, value / (threshold * 5)), 3) ELSE 0 END
  + CASE WHEN sector_ok AND len(sectors) > 0 THEN 0.15 ELSE 0 END
  + coalesce(list_sum(list_transform(list_filter(m.signals, lambda s: list_contains(coalesce(k.names, []), s)), lambda s: CASE WHEN s = 'expansion_activity' THEN 0.12 ELSE 0.09 END)), 0))::DECIMAL(10,3)::DOUBLE AS total
  FROM mt m LEFT JOIN (SELECT company_id, list(signal) AS names FROM sg GROUP BY company_id) k USING (company_id)"""
MORE = {"rl": RULES_SQL, "ma": MATCH_SQL, "mt": MATCHED_SQL, "sg": SIGNALS_SQL, "opp": OPP_SQL}
OPP_FINAL = "CASE WHEN len(corroborated_by) > 0 AND tier = 1 THEN 2 ELSE tier END AS tier, least(0.95, total) AS confidence"


def signals(e):
    """Company signals from the events of a company."""
    busy = e.groupBy("company_id").agg(F.count("*").alias("n"), F.count_if(F.col("project").contains("digital")).alias("m"))
    pair = F.array(F.when(F.col("n") >= 12, F.struct(F.lit("expansion_activity").alias("signal"), F.lit(0.8).alias("confidence"))), F.when(F.col("m") >= 3, F.struct(F.lit("technology_activity").alias("signal"), F.lit(None).cast("double").alias("confidence"))))
    return busy.select("company_id", F.explode(F.filter(pair, lambda x: x.isNotNull())).alias("x")).select("company_id", "x.*")


def opportunities(s, d):
    e = fx.events(s, d)
    return op.detect(e, op.default_rules(s), signals(e))


@query("J12_rule_matches", sql("SELECT event_id, product_id, need_key, sector_ok, threshold FROM mt", "ev", more=MORE))
def j12(s, d):
    return op.matches(fx.events(s, d), op.default_rules(s)).select("event_id", "product_id", "need_key", "sector_ok", "threshold")


@query("J13_rule_lookup", sql("SELECT p_partkey AS product_id, coalesce(i.product_id, c.product_id) AS rule_id, coalesce(i.product_id, c.product_id) IS NOT NULL AS has_rule FROM (SELECT *, CASE WHEN p_partkey % 10 = 0 THEN 'cloud-1' ELSE 'p-' || p_partkey END AS pid, CASE WHEN p_size % 2 = 0 THEN 'cybersecurity' ELSE p_type END AS cat FROM part) LEFT JOIN rl i ON i.product_id = pid LEFT JOIN rl c ON c.category = cat", more={"rl": RULES_SQL}))
def j13(s, d):
    k = F.col("p_partkey")
    products = fx.table(s, d, "part").select(k.alias("part"), F.when(k % 10 == 0, "cloud-1").otherwise(F.concat(F.lit("p-"), k)).alias("product_id"), F.when(F.col("p_size") % 2 == 0, "cybersecurity").otherwise(F.col("p_type")).alias("category"))
    return op.rule_for(products, op.default_rules(s)).select(F.col("part").alias("product_id"), "rule_id", "has_rule")


@query("J14_corroboration", sql("SELECT event_id, product_id, list_sort(corroborated_by) AS corroborated_by FROM opp WHERE len(corroborated_by) > 0", "ev", more=MORE))
def j14(s, d):
    return opportunities(s, d).filter(F.size("corroborated_by") > 0).select("event_id", "product_id", F.array_sort("corroborated_by").alias("corroborated_by"))


@query("J15_target_products", sql("SELECT event_id, product_id FROM mt WHERE category IN ('cybersecurity', 'cloud_infrastructure')", "ev", more=MORE))
def j15(s, d):
    targets = ["cybersecurity", "cloud_infrastructure"]
    rules = op.default_rules(s)
    return op.matches(fx.events(s, d), rules.filter(F.col("category").isin(targets)) if targets else rules).select("event_id", "product_id")


@query("X29_confidence", sql(f"SELECT event_id, product_id, {OPP_FINAL} FROM opp", "ev", more=MORE))
def x29(s, d):
    return opportunities(s, d).select("event_id", "product_id", "tier", "confidence")


@query("X30_reasons", sql(f"""SELECT event_id, product_id, kind || ' worth ' || vt || ' in ' || sector || ' — ' || awardee AS trigger, awardee || ': ' || kind || ' worth ' || vt || ' in ' || sector || '. Rule ' || name || ' suggests: ' || lower(need) || '. ' ||
  CASE WHEN len(corroborated_by) > 0 THEN 'Supported by signals: ' || array_to_string(corroborated_by, ', ') ELSE 'No company signal supports it yet; this is a ' || CASE tier WHEN 2 THEN 'inference' ELSE 'speculation' END END AS reasoning
  FROM (SELECT *, replace(event_type, '_', ' ') AS kind, {VALUE_TEXT_SQL} AS vt FROM opp)""", "ev", more=MORE))
def x30(s, d):
    return op.explained(opportunities(s, d), v.value_text(F.col("value"), F.col("currency"))).select("event_id", "product_id", "trigger", "reasoning")


@query("O2_ranked_opportunities", sql(f"SELECT event_id, product_id, row_number() OVER (PARTITION BY event_id ORDER BY confidence DESC, product_id) AS place FROM (SELECT event_id, product_id, {OPP_FINAL} FROM opp)", "ev", more=MORE))
def o2(s, d):
    return opportunities(s, d).select("event_id", "product_id", F.row_number().over(W.partitionBy("event_id").orderBy(F.desc("confidence"), "product_id")).alias("place"))


@query("F27_tiers", sql(f"SELECT tier, count(*) AS n FROM (SELECT {OPP_FINAL} FROM opp) GROUP BY tier", "ev", more=MORE))
def f27(s, d):
    return opportunities(s, d).groupBy("tier").agg(F.count("*").alias("n"))


@query("F25_evidence_rows", sql("SELECT event_id, product_id, 'event' AS kind, reference AS evidence FROM opp UNION ALL SELECT event_id, product_id, 'company_signal', unnest(corroborated_by) FROM opp", "ev", more=MORE))
def f25(s, d):
    o = opportunities(s, d)
    every = F.concat(F.array(F.struct(F.lit("event").alias("kind"), F.col("reference").alias("evidence"))), F.transform("corroborated_by", lambda x: F.struct(F.lit("company_signal").alias("kind"), x.alias("evidence"))))
    return o.select("event_id", "product_id", F.explode(every).alias("x")).select("event_id", "product_id", "x.*")


@query("V7_reasoner_adjustments", sql(f"SELECT event_id, product_id, greatest(0, least(0.95, confidence + CASE WHEN event_id % 3 = 0 THEN 0.1 WHEN event_id % 3 = 1 THEN -0.05 ELSE 0 END))::DECIMAL(10,3)::DOUBLE AS confidence FROM (SELECT event_id, product_id, {OPP_FINAL} FROM opp)", "ev", more=MORE))
def v7(s, d):
    """Adjustments from a supplied table, held to ±0.1, applied to confidences held to 0..0.95."""
    o = opportunities(s, d).select("event_id", "product_id", "confidence")
    notes = fx.table(s, d, "orders").filter("o_orderkey % 3 < 2").select(F.col("o_orderkey").alias("event_id"), F.when(F.col("o_orderkey") % 3 == 0, 0.7).otherwise(-0.05).alias("adjust"))
    held = F.greatest(F.lit(-0.1), F.least(F.lit(0.1), F.coalesce("adjust", F.lit(0.0))))
    return o.join(notes, "event_id", "left").select("event_id", "product_id", F.greatest(F.lit(0.0), F.least(F.lit(0.95), F.col("confidence") + held)).cast("decimal(10,3)").cast("double").alias("confidence"))


# --- scores ---

TARGETS = ["Smart Cities", "Governance", "BFSI"]


def score_inputs(s, d):
    """One scoring input per opportunity."""
    o = opportunities(s, d)
    k = F.col("company_id")
    return o.select(
        "event_id", "product_id", "company_id", "awardee", "buyer", "event_type", "value", F.when(F.col("event_id") % 8 != 0, F.col("event_date")).alias("event_date"), F.col("sector").alias("event_sector"),
        F.when(k % 3 == 0, "Information Technology").alias("company_industry"), F.when(k % 4 == 0, "51-200").when(k % 4 == 1, "1000+").alias("employee_range"),
        F.array(*map(F.lit, TARGETS)).alias("target_sectors"), F.array(F.lit("51-200")).alias("ideal_ranges"), F.col("confidence").alias("opportunity_confidence"),
        F.filter(F.array(F.when(F.col("event_id") % 2 == 0, F.lit(0.9)), F.when(F.col("event_id") % 5 == 0, F.lit(0.4))), lambda x: x.isNotNull()).alias("evidence_confidences"),
        (k % 3).cast("int").alias("num_contacts"), F.when(k % 6 == 1, "c_level").when(k % 6 == 2, "manager").alias("best_seniority"),
    )


INPUT_SQL = f"SELECT event_id, product_id, company_id, awardee, buyer, event_type, value, CASE WHEN event_id % 8 <> 0 THEN event_date END AS event_date, sector, confidence FROM (SELECT * EXCLUDE (tier), {OPP_FINAL} FROM opp)"
PARTS_SQL = f"""SELECT *, CASE WHEN sector IN ('Smart Cities', 'e-Governance', 'IT') THEN 1.0 ELSE 0.0 END AS f1,
  0.7 * CASE WHEN coalesce(value, 0) <> 0 THEN least(1.0, value / 1e9) ELSE 0.3 END + 0.3 * CASE event_type WHEN 'contract_award' THEN 1.0 WHEN 'work_order' THEN 0.9 ELSE 0.6 END AS f2,
  confidence / 0.85 AS f3, CASE WHEN event_date IS NULL THEN 0.3 WHEN age <= 30 THEN 1.0 WHEN age >= 365 THEN 0.0 ELSE 1.0 - (age - 30) / 335.0::DOUBLE END AS f4,
  CASE WHEN company_id % 3 = 0 THEN 0.4 ELSE 0 END + CASE company_id % 4 WHEN 0 THEN 0.6 WHEN 1 THEN 0.3 ELSE 0 END AS f5,
  CASE WHEN company_id % 3 = 0 THEN 0 WHEN company_id % 6 = 1 THEN 1.0 WHEN company_id % 6 = 2 THEN 0.6 ELSE 0.5 END AS f6,
  CASE WHEN event_id % 10 = 0 THEN 0.65 WHEN event_id % 2 = 0 THEN 0.9 WHEN event_id % 5 = 0 THEN 0.4 ELSE confidence END AS f7
  FROM (SELECT *, date_diff('day', event_date, DATE '{fx.AS_OF}') AS age FROM si)"""


def _pts(f: str, most: int) -> str:
    return f"round_even((least(1.0, greatest(0.0, {f}))::DOUBLE * {most})::DECIMAL(18,9), 0)::INTEGER"


SCORE_SQL = "SELECT *, " + ", ".join(f"{_pts(f'f{i}', m)} AS p{i}" for i, m in enumerate((25, 20, 20, 15, 10, 5, 5), 1)) + " FROM pa"
SCORED = MORE | {"si": INPUT_SQL, "pa": PARTS_SQL, "sc": SCORE_SQL, "st": "SELECT *, p1 + p2 + p3 + p4 + p5 + p6 + p7 AS total FROM sc"}


def scored(s, d, rows=None):
    return sc.score(score_inputs(s, d), rows or sc.config(), as_of())


for _i, (_name, _key) in enumerate((("X31", "sector_relevance"), ("X32", "event_significance"), ("X33", "product_fit"), ("X34", "recency"), ("X35", "company_fit"), ("X36", "contact_availability"), ("A24", "evidence_confidence")), 1):

    def _one(s, d, i=_i, key=_key):
        only = [r for r in sc.config() if r[1] == key]
        return scored(s, d, only).select("event_id", "product_id", F.col("components")[0]["points"].alias("points"))

    query(f"{_name}_{_key}", sql(f"SELECT event_id, product_id, p{_i} AS points FROM st", "ev", more=SCORED))(_one)


@query("X37_half_even_points", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round_even((l_quantity / 50 * 25)::DECIMAL(18,9), 0)::INTEGER AS points FROM lineitem")
def x37(s, d):
    return fx.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", sc.points(F.col("l_quantity") / 50, 25).alias("points"))


@query("A10_lead_score", sql(f"SELECT event_id, product_id, 'lead-score-v1' AS version, total, {grade_sql('total')} AS grade, [p1, p2, p3, p4, p5, p6, p7] AS points FROM st", "ev", more=SCORED))
def a10(s, d):
    return scored(s, d).select("event_id", "product_id", "version", "total", "grade", F.transform("components", lambda c: c["points"]).alias("points"))


@query("X38_explanation", sql("SELECT event_id, product_id, " + " || chr(10) || ".join(f"'{label}: ' || p{i} || '/{most}'" for i, (_, label, most, _p) in enumerate(sc.DEFAULT, 1)) + " AS explanation FROM st", "ev", more=SCORED))
def x38(s, d):
    return scored(s, d).select("event_id", "product_id", sc.explanation().alias("explanation"))


@query("C6_scores_by_version", sql("SELECT event_id, product_id, 'lead-score-v1' AS version, total FROM st UNION ALL SELECT event_id, product_id, 'recent-first', " + " + ".join(_pts(f"f{i}", m) for i, m in enumerate((15, 20, 20, 25, 10, 5, 5), 1)) + " FROM pa", "ev", more=SCORED))
def c6(s, d):
    return scored(s, d, sc.config() + sc.config("recent-first", sector_relevance=15, recency=25)).select("event_id", "product_id", "version", "total")


@query("J19_weighted_evidence", sql("SELECT event_id, avg(w) AS mean FROM (SELECT event_id, 0.9 * 0.98 AS w FROM ev WHERE event_id % 2 = 0 UNION ALL SELECT event_id, 0.4 * 0.65 FROM ev WHERE event_id % 5 = 0) GROUP BY event_id", "ev"))
def j19(s, d):
    e = fx.events(s, d)
    rows = e.filter("event_id % 2 = 0").select("event_id", F.lit(0.9).alias("c"), F.lit("https://pib.gov.in/a").alias("url")).unionByName(e.filter("event_id % 5 = 0").select("event_id", F.lit(0.4).alias("c"), F.lit("https://news.example.com").alias("url")))
    return rows.groupBy("event_id").agg(F.avg(F.col("c") * v.authority(F.col("url"))).alias("mean"))


# --- board ---


def board_leads(s, d):
    """Scored opportunities as board rows."""
    return scored(s, d).select(
        F.concat_ws("-", F.col("event_id").cast("string"), "product_id").alias("lead_id"), F.concat(F.lit("org-"), (F.col("company_id") % 3).cast("string")).alias("organization_id"),
        F.col("awardee").alias("company"), "buyer", F.col("event_sector").alias("sector"), F.col("product_id").alias("product"), "event_type", "event_date", "value", F.col("total").alias("score"), "grade",
        F.when(F.col("event_id") % 7 == 0, "contacted").otherwise("new").alias("status"),
    )


BOARD = SCORED | {"bl": f"SELECT event_id || '-' || product_id AS lead_id, 'org-' || (company_id % 3) AS organization_id, awardee AS company, buyer, sector, product_id AS product, event_type, event_date, value, total AS score, {grade_sql('total')} AS grade, CASE WHEN event_id % 7 = 0 THEN 'contacted' ELSE 'new' END AS status FROM st"}


@query("F01_board_filters", sql(f"SELECT lead_id, score FROM bl WHERE organization_id = 'org-1' AND score >= 50 AND contains(lower(company), '00') AND date_diff('day', event_date, DATE '{fx.AS_OF}') <= 900 AND sector = 'Smart Cities' AND status = 'new'", "ev", more=BOARD))
def f01(s, d):
    return bd.board(board_leads(s, d), as_of(), org="org-1", score_min=50, company="00", date_days=900, sector="Smart Cities", status="new").select("lead_id", "score")


@query("F02_tenant_scope", sql("SELECT organization_id, count(*) AS leads FROM bl WHERE organization_id = 'org-2' GROUP BY 1", "ev", more=BOARD))
def f02(s, d):
    return bd.board(board_leads(s, d), as_of(), org="org-2").groupBy("organization_id").agg(F.count("*").alias("leads"))


@query("F16_lead_summary", sql(f"SELECT lead_id, company, score, grade, {VALUE_TEXT_SQL.replace('currency', chr(39) + 'INR' + chr(39))} AS value_text, CASE WHEN event_date IS NULL THEN 'undated' ELSE date_diff('day', event_date, DATE '{fx.AS_OF}') || ' days ago' END AS why_now FROM bl", "ev", more=BOARD))
def f16(s, d):
    age = F.datediff(as_of(), "event_date")
    return board_leads(s, d).select("lead_id", "company", "score", "grade", v.value_text(F.col("value"), F.lit("INR")).alias("value_text"), F.when(F.col("event_date").isNull(), "undated").otherwise(F.concat(age.cast("string"), F.lit(" days ago"))).alias("why_now"))


@query("F19_usefulness", sql("SELECT lead_id, CASE WHEN value > 0 AND score >= 60 AND event_date IS NOT NULL THEN 'USEFUL' WHEN value > 0 THEN 'PARTIAL' ELSE 'WEAK' END AS verdict, list_filter([CASE WHEN coalesce(company, '') = '' THEN 'no company' END, CASE WHEN coalesce(value, 0) = 0 THEN 'no deal value' END, CASE WHEN score < 45 THEN 'low score' END, CASE WHEN event_date IS NULL THEN 'no why-now' END], lambda x: x IS NOT NULL) AS gaps, coalesce(date_diff('day', event_date, DATE '" + fx.AS_OF + "') > 365, false) AS outdated FROM bl", "ev", more=BOARD))
def f19(s, d):
    has = F.coalesce("value", F.lit(0)) != 0
    gap = lambda c, t: F.when(c, t)
    gaps = F.filter(F.array(gap(F.coalesce("company", F.lit("")) == "", "no company"), gap(~has, "no deal value"), gap(F.col("score") < 45, "low score"), gap(F.col("event_date").isNull(), "no why-now")), lambda x: x.isNotNull())
    b = board_leads(s, d).withColumn("gaps", gaps)
    return b.select("lead_id", F.when(has & (F.col("score") >= 60) & (F.size("gaps") == 0), "USEFUL").when(has, "PARTIAL").otherwise("WEAK").alias("verdict"), "gaps", F.coalesce(F.datediff(as_of(), "event_date") > 365, F.lit(False)).alias("outdated"))


@query("A19_board_kpis", sql("SELECT count(*) AS leads, round(avg(score))::BIGINT AS mean_score, count(*) FILTER (WHERE score >= 80) AS hot_leads, round(coalesce(sum(value), 0) / 10000000)::BIGINT AS pipeline_crore FROM bl", "ev", more=BOARD))
def a19(s, d):
    return bd.kpis(board_leads(s, d))


@query("A20_facets", sql(" UNION ALL ".join(f"SELECT DISTINCT '{c}' AS facet, {c} AS value FROM bl WHERE coalesce({c}, '') <> ''" for c in ("sector", "product", "event_type", "buyer")), "ev", more=BOARD))
def a20(s, d):
    return bd.facets(board_leads(s, d), "sector", "product", "event_type", "buyer")


@query("O1_board_order", sql("SELECT lead_id, event_date, score, row_number() OVER (ORDER BY event_date DESC NULLS LAST, score DESC, lead_id) AS place FROM bl", "ev", more=BOARD))
def o1(s, d):
    """The whole board in order, each lead with its place."""
    return bd.placed(board_leads(s, d)).select("lead_id", "event_date", "score", "place")


@query("C10_lead_board", sql("SELECT lead_id, company, sector, product, event_date, value, score, grade FROM bl WHERE score >= 60 ORDER BY event_date DESC NULLS LAST, score DESC, lead_id", "ev", more=BOARD))
def c10(s, d):
    return bd.in_order(bd.board(board_leads(s, d), as_of(), score_min=60)).select("lead_id", "company", "sector", "product", "event_date", "value", "score", "grade")


@query("C05_opportunities", sql(f"SELECT event_id, product_id, category, need_key, timing, {OPP_FINAL} FROM opp", "ev", more=MORE))
def c05(s, d):
    return opportunities(s, d).select("event_id", "product_id", "category", "need_key", "timing", "tier", "confidence")


@query("J29_rule_detail", sql("SELECT event_id, product_id, timing, len(signals) AS signals FROM opp", "ev", more=MORE))
def j29(s, d):
    o = opportunities(s, d).select("event_id", "product_id")
    rules = op.default_rules(s).select("product_id", "timing", F.size("signals").cast("long").alias("signals"))
    return o.join(op.small(rules), "product_id", "left").select("event_id", "product_id", F.coalesce("timing", F.lit("unknown")).alias("timing"), "signals")


@query("T4_changed_leads", sql("SELECT lead_id, CASE WHEN score % 2 = 0 THEN 'changed' ELSE 'removed' END AS change FROM bl WHERE score % 2 = 0 OR (score % 5 = 0)", "ev", more=BOARD))
def t4(s, d):
    """Which leads differ between two snapshots, by a hash of the whole row."""
    old = board_leads(s, d)
    new = old.filter("score % 2 = 0 or score % 5 <> 0").withColumn("score", F.when(F.col("score") % 2 == 0, F.col("score") + 1).otherwise(F.col("score")))
    return changes(old, new, "lead_id")


def changes(old, new, key):
    """(key, change): added, removed or changed rows between two snapshots."""
    sign = lambda df, n: df.select(key, F.xxhash64(*sorted(df.columns)).alias(n))
    both = sign(old, "a").join(sign(new, "b"), key, "full")
    return both.filter(~F.col("a").eqNullSafe(F.col("b"))).select(key, F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed").alias("change"))
