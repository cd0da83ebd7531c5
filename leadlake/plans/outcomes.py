"""Queries of feedback analytics, evaluation, history and maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadlake.functions import values as v
from leadlake.operators import feedback as fb
from leadlake.operators import history as hi
from leadlake.plans import fixtures as fx
from leadlake.plans.fixtures import sql
from leadlake.plans.registry import query
from leadlake.plans.scalars import case, grade_sql

OUT_SQL = f"""SELECT lead_id, CASE WHEN c THEN 'converted' WHEN b THEN 'negative' WHEN e THEN 'engaged' ELSE 'view' END AS label, c AS converted, NOT c AND b AS negative, n AS events, d AS data_errors, via AS converted_via
  FROM (SELECT lead_id, bool_or(k = 'converted') AS c, bool_or(k IN ('negative', 'data_error')) AS b, bool_or(k = 'engaged') AS e, count(*) AS n, count(*) FILTER (WHERE k = 'data_error') AS d, arg_min(event_type, seq) FILTER (WHERE k = 'converted') AS via
  FROM (SELECT *, {case('event_type', v.FEEDBACK_CLASS)} AS k FROM fb) GROUP BY lead_id)"""
RATES = "count(converted) AS leads, count(*) FILTER (WHERE converted) AS converted, count(*) FILTER (WHERE negative) AS negative, count(*) FILTER (WHERE converted OR negative) AS decided, coalesce(round(count(*) FILTER (WHERE converted) / nullif(count(*) FILTER (WHERE converted OR negative), 0), 3), 0) AS conversion_rate"
FB = {"oc": OUT_SQL, "j": "SELECT * FROM ld LEFT JOIN oc USING (lead_id)"}


def few(s, d):
    """Feedback of the leads that exist; the log names far more events than the test leads need."""
    return fx.feedback(s, d)


def joined(s, d):
    return fb.with_outcome(fx.leads(s, d), few(s, d))


@query("A01_lead_outcomes", sql("SELECT * FROM oc", "fb", more={"oc": OUT_SQL}))
def a01(s, d):
    return fb.outcomes(few(s, d))


@query("A02_conversion_by_bucket", sql(f"SELECT b.bucket, coalesce(leads, 0) AS leads, coalesce(converted, 0) AS converted, coalesce(negative, 0) AS negative, coalesce(decided, 0) AS decided, coalesce(conversion_rate, 0) AS conversion_rate FROM (VALUES ('0-19'), ('20-39'), ('40-59'), ('60-79'), ('80-100')) b(bucket) LEFT JOIN (SELECT CASE WHEN score < 20 THEN '0-19' WHEN score < 40 THEN '20-39' WHEN score < 60 THEN '40-59' WHEN score < 80 THEN '60-79' ELSE '80-100' END AS bucket, {RATES} FROM j GROUP BY 1) USING (bucket)", "fb", "ld", more=FB))
def a02(s, d):
    return fb.by_bucket(joined(s, d))


@query("A03_conversion_by_dimension", sql(" UNION ALL ".join(f"SELECT '{c}' AS dimension, coalesce({c}, 'unknown') AS key, {RATES} FROM j GROUP BY 2" for c in ("event_type", "product", "sector")), "fb", "ld", more=FB))
def a03(s, d):
    return fb.by_dimension(joined(s, d), "event_type", "product", "sector")


@query("A04_precision", sql("SELECT count(converted) AS high_leads, count(*) FILTER (WHERE converted OR negative) AS decided, count(*) FILTER (WHERE converted) AS converted, round(count(*) FILTER (WHERE converted) / nullif(count(*) FILTER (WHERE converted OR negative), 0), 3) AS precision FROM j WHERE score >= 80", "fb", "ld", more=FB))
def a04(s, d):
    return fb.precision(joined(s, d))


SHORT_LEADS = {
    "dl": "SELECT lead_id AS who, lead_id || '-' || (seq // 100) AS lead_id, seq, event_type FROM fb",
    "oc": OUT_SQL.replace("FROM fb", "FROM dl"),
    "j": "SELECT * FROM (SELECT DISTINCT dl.lead_id, score, product, sector, ld.event_type FROM dl JOIN ld ON ld.lead_id = dl.who) LEFT JOIN oc USING (lead_id)",
}


def short_leads(s, d):
    """A user's feedback within a hundred log entries as one lead; over the whole log every user converts."""
    part = F.concat("lead_id", F.lit("-"), F.floor(F.col("seq") / 100).cast("string"))
    log = few(s, d).select(F.col("lead_id").alias("who"), part.alias("lead_id"), "seq", "event_type")
    meta = fx.leads(s, d).withColumnRenamed("lead_id", "who").join(log.select("who", "lead_id").distinct(), "who")
    return fb.with_outcome(meta, log.drop("who"))


@query("A05_false_positives", sql(" UNION ALL ".join(f"SELECT '{c}' AS dimension, coalesce({c}, 'unknown') AS key, count(*) AS n FROM j WHERE score >= 80 AND negative GROUP BY 2" for c in ("product", "sector", "event_type")), "fb", "ld", more=SHORT_LEADS))
def a05(s, d):
    return fb.false_positives(short_leads(s, d), "product", "sector", "event_type")


@query("A06_totals", sql("SELECT count(*) AS events, count(DISTINCT lead_id) AS leads FROM fb", "fb"))
def a06(s, d):
    return few(s, d).agg(F.count("*").alias("events"), F.countDistinct("lead_id").alias("leads"))


@query("O4_ordered_groups", sql(f"SELECT key, leads, row_number() OVER (ORDER BY leads DESC, key) AS place FROM (SELECT coalesce(product, 'unknown') AS key, {RATES} FROM j GROUP BY 1)", "fb", "ld", more=FB))
def o4(s, d):
    """A report of a handful of groups, numbered after the aggregation."""
    from pyspark.sql import Window as W

    return fb.by_dimension(joined(s, d), "product").select("key", "leads", F.row_number().over(W.orderBy(F.desc("leads"), "key")).alias("place"))


@query("O5_false_negatives", sql("SELECT lead_id, company, score, event_type, product, sector, converted_via FROM j WHERE score < 45 AND converted ORDER BY score, lead_id", "fb", "ld", more=FB))
def o5(s, d):
    return fb.false_negatives(joined(s, d)).select("lead_id", "company", "score", "event_type", "product", "sector", "converted_via")


@query("J22_meta_with_outcomes", sql("SELECT lead_id, score, label FROM j", "fb", "ld", more=FB))
def j22(s, d):
    return joined(s, d).select("lead_id", "score", "label")


@query("C11_feedback_report", sql(f"SELECT 'total' AS part, 'events' AS key, count(*)::DOUBLE AS value FROM fb UNION ALL SELECT 'total', 'leads', count(*) FROM oc UNION ALL SELECT 'sector', coalesce(sector, 'unknown'), coalesce(round(count(*) FILTER (WHERE converted) / nullif(count(*) FILTER (WHERE converted OR negative), 0), 3), 0) FROM j GROUP BY 2", "fb", "ld", more=FB))
def c11(s, d):
    totals = few(s, d).agg(F.count("*").alias("events"), F.countDistinct("lead_id").alias("leads"))
    total = totals.select(F.explode(F.create_map(F.lit("events"), "events", F.lit("leads"), "leads")).alias("key", "value")).select(F.lit("total").alias("part"), "key", F.col("value").cast("double").alias("value"))
    return total.unionByName(fb.by_dimension(joined(s, d), "sector").select(F.col("dimension").alias("part"), "key", F.col("conversion_rate").alias("value")))


@query("F21_lead_status", sql(f"SELECT lead_id, arg_max(status, {{'t': occurred_at, 's': seq}}) AS status FROM (SELECT *, {case('event_type', v.FEEDBACK_STATUS)} AS status FROM fb) WHERE status IS NOT NULL GROUP BY lead_id", "fb"))
def f21(s, d):
    return fb.lead_status(few(s, d))


@query("F29_quality_queue", sql("SELECT f.seq, f.lead_id, l.company FROM (SELECT *, CASE WHEN event_type = 'not_relevant' AND seq % 2 = 0 THEN 'incorrect_company' ELSE event_type END AS t FROM fb) f JOIN ld l USING (lead_id) WHERE t IN ('incorrect_company', 'incorrect_opportunity', 'incorrect_contact')", "fb", "ld"))
def f29(s, d):
    log = few(s, d).withColumn("event_type", F.when((F.col("event_type") == "not_relevant") & (F.col("seq") % 2 == 0), "incorrect_company").otherwise(F.col("event_type")))
    wrong = log.filter(F.col("event_type").isin("incorrect_company", "incorrect_opportunity", "incorrect_contact"))
    return wrong.join(fx.leads(s, d).select("lead_id", "company"), "lead_id").select("seq", "lead_id", "company")


@query("F30_lead_history", sql("SELECT lead_id, list(event_type ORDER BY seq) AS history FROM fb GROUP BY lead_id", "fb"))
def f30(s, d):
    """Whole feedback history of every lead, in order; one lead's rows only are gathered."""
    h = few(s, d).groupBy("lead_id").agg(F.array_sort(F.collect_list(F.struct("seq", "event_type"))).alias("h"))
    return h.select("lead_id", F.transform("h", lambda x: x["event_type"]).alias("history"))


@query("S11_feedback_rows", sql(f"SELECT seq, lead_id, {case('event_type', v.FEEDBACK_OUTCOME)} AS outcome, '[' || event_type || '] note ' || seq AS note, {case('event_type', v.FEEDBACK_CLASS)} = 'data_error' AS data_quality FROM fb", "fb"))
def s11(s, d):
    t = F.col("event_type")
    return few(s, d).select("seq", "lead_id", v.lookup(t, v.FEEDBACK_OUTCOME).alias("outcome"), F.concat(F.lit("["), t, F.lit("] note "), "seq").alias("note"), (v.lookup(t, v.FEEDBACK_CLASS) == "data_error").alias("data_quality"))


EX_SQL = "SELECT d.doc_id AS lead_id, (length(text) % 101) AS score, quality = 1 AND toxic = 0 AS converted, quality IS NOT NULL AS decided FROM documents d LEFT JOIN labels l USING (doc_id)"
EVAL = "SELECT version, tp, fp, fn, tn, p AS precision, r AS recall, CASE WHEN p > 0 AND r > 0 THEN round(2 * p * r / (p + r), 3) END AS f1, round((tp + tn) / nullif(tp + fp + fn + tn, 0), 3) AS accuracy FROM (SELECT *, round(tp / nullif(tp + fp, 0), 3) AS p, round(tp / nullif(tp + fn, 0), 3) AS r FROM (SELECT version, count(*) FILTER (WHERE score >= 80 AND converted) AS tp, count(*) FILTER (WHERE score >= 80 AND NOT converted) AS fp, count(*) FILTER (WHERE score < 80 AND converted) AS fn, count(*) FILTER (WHERE score < 80 AND NOT converted) AS tn FROM vs WHERE decided GROUP BY version))"
VERSIONS = {"ex": EX_SQL, "vs": "SELECT 'v1' AS version, * FROM ex UNION ALL SELECT 'v2', lead_id, least(100, score + 15), converted, decided FROM ex"}


def examples(s, d):
    """Labelled documents as evaluation examples under two versions; the configurations are joined, not crossed by hand."""
    docs, labels = fx.table(s, d, "documents"), fx.table(s, d, "labels")
    ex = docs.select("doc_id", (F.length("text") % 101).alias("score")).join(labels, "doc_id", "left")
    ex = ex.select(F.col("doc_id").alias("lead_id"), "score", ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("converted"), F.col("quality").isNotNull().alias("decided"))
    both = F.explode(F.array(F.struct(F.lit("v1").alias("version"), F.col("score").alias("s")), F.struct(F.lit("v2").alias("version"), F.least(F.lit(100), F.col("score") + 15).alias("s"))))
    return ex.select("lead_id", "converted", "decided", both.alias("x")).select("x.version", "lead_id", F.col("x.s").alias("score"), "converted", "decided")


@query("A07_confusion", sql(EVAL, more=VERSIONS))
def a07(s, d):
    return fb.evaluate(examples(s, d))


@query("A08_version_deltas", sql("SELECT " + ", ".join(f"CASE WHEN a.{m} IS NOT NULL OR b.{m} IS NOT NULL THEN round(coalesce(b.{m}, 0) - coalesce(a.{m}, 0), 3) END AS delta_{m}" for m in ("precision", "recall", "f1", "accuracy")) + " FROM m a, m b WHERE a.version = 'v1' AND b.version = 'v2'", more=VERSIONS | {"m": EVAL}))
def a08(s, d):
    return fb.compare(fb.evaluate(examples(s, d)), "v1", "v2")


@query("J23_examples_by_config", sql("SELECT version, lead_id, score FROM vs", more=VERSIONS))
def j23(s, d):
    return examples(s, d).select("version", "lead_id", "score")


@query("A09_audit", sql("SELECT lead_id, CASE WHEN lead_id % 11 = 0 THEN 'old' ELSE 'v1' END AS version, CASE WHEN lead_id % 7 = 0 THEN score + 1 ELSE score END AS total, CASE WHEN lead_id % 11 = 0 THEN 'missing_config' ELSE 'mismatch' END AS problem FROM ld WHERE lead_id % 11 = 0 OR lead_id % 7 = 0", "ld"))
def a09(s, d):
    k = F.col("lead_id")
    again = fx.leads(s, d).select("lead_id", F.lit("v1").alias("version"), F.col("score").alias("total"))
    stored = again.select("lead_id", F.when(k % 11 == 0, "old").otherwise("v1").alias("version"), F.when(k % 7 == 0, F.col("total") + 1).otherwise(F.col("total")).alias("total"))
    return fb.audit(stored, again)


@query("C12_evaluation", sql(f"SELECT version, accuracy FROM ({EVAL})", more=VERSIONS))
def c12(s, d):
    return fb.evaluate(examples(s, d)).select("version", "accuracy")


# --- history and windows ---


def score_rows(s, d):
    """Scores of companies over time: their orders."""
    return fx.table(s, d, "orders").select(F.col("o_custkey").alias("lead_id"), F.col("o_orderkey").alias("seq"), F.col("o_orderdate").alias("scored_at"), F.floor(F.col("o_totalprice") / 5000).alias("score"), (F.col("o_orderkey") % 9 == 0).alias("is_current"))


SR = "SELECT o_custkey AS lead_id, o_orderkey AS seq, o_orderdate AS scored_at, floor(o_totalprice / 5000)::BIGINT AS score, o_orderkey % 9 = 0 AS is_current FROM orders"


@query("W01_current_score", sql("SELECT lead_id, seq, score FROM sr QUALIFY row_number() OVER (PARTITION BY lead_id ORDER BY is_current DESC, scored_at DESC, seq DESC) = 1", more={"sr": SR}))
def w01(s, d):
    return hi.first_by(score_rows(s, d), ["lead_id"], F.desc("is_current"), F.desc("scored_at"), F.desc("seq")).select("lead_id", "seq", "score")


@query("W02_supersede_scores", sql("SELECT lead_id, seq, row_number() OVER (PARTITION BY lead_id ORDER BY seq DESC) = 1 AS is_current FROM sr", more={"sr": SR}))
def w02(s, d):
    rows = score_rows(s, d)
    return hi.supersede(rows.filter("seq % 2 = 0"), rows.filter("seq % 2 = 1"), ["lead_id"], "seq").select("lead_id", "seq", "is_current")


@query("W03_supersede_enrichment", sql("SELECT company_id, source_name, seq, row_number() OVER (PARTITION BY company_id, source_name ORDER BY seq DESC) = 1 AS is_current FROM cl", "cl"))
def w03(s, d):
    c = fx.claims(s, d)
    return hi.supersede(c.filter("seq % 3 > 0"), c.filter("seq % 3 = 0"), ["company_id", "source_name"], "seq").select("company_id", "source_name", "seq", "is_current")


@query("W04_best_contact", sql("SELECT company_id, seq FROM ct WHERE NOT do_not_contact QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY verified DESC, coalesce(confidence, 0) DESC, seq) = 1", "ct"))
def w04(s, d):
    return hi.first_by(fx.contacts(s, d).filter("not do_not_contact"), ["company_id"], F.desc("verified"), F.desc(F.coalesce("confidence", F.lit(0.0))), F.col("seq")).select("company_id", "seq")


@query("W05_latest_brief", "SELECT conv_id, arg_max(text, turn) AS latest, arg_min(text, turn) AS first FROM conversations GROUP BY conv_id")
def w05(s, d):
    return fx.table(s, d, "conversations").groupBy("conv_id").agg(F.max_by("text", "turn").alias("latest"), F.min_by("text", "turn").alias("first"))


@query("W07_duplicate_documents", "SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS original, doc_id <> min(doc_id) OVER (PARTITION BY sha256(text)) AS is_duplicate FROM documents WHERE text IS NOT NULL")
def w07(s, d):
    """First document of each content; an aggregation and a join on the hash, so that a third of all rows under one
    hash is still spread."""
    rows = fx.table(s, d, "documents").filter("text is not null").select("doc_id", F.sha2("text", 256).alias("h"))
    first = rows.groupBy("h").agg(F.min("doc_id").alias("original"))
    return rows.join(first, "h").select("doc_id", "original", (F.col("doc_id") != F.col("original")).alias("is_duplicate"))


@query("W08_numbered_facts", sql("SELECT company_id, seq, 'F' || row_number() OVER (PARTITION BY company_id ORDER BY seq) AS label FROM cl", "cl"))
def w08(s, d):
    return hi.numbered(fx.claims(s, d), ["company_id"], "F", F.col("seq")).select("company_id", "seq", "label")


@query("W10_first_items", sql("SELECT company_id, field, seq FROM cl QUALIFY row_number() OVER (PARTITION BY company_id, field ORDER BY seq) <= 3", "cl"))
def w10(s, d):
    from pyspark.sql import Window as W

    return fx.claims(s, d).withColumn("rn", F.row_number().over(W.partitionBy("company_id", "field").orderBy("seq"))).filter("rn <= 3").select("company_id", "field", "seq")


@query("W11_profile_row", sql("SELECT company_id, seq FROM cl WHERE tier >= 3 QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY retrieved_at DESC, seq DESC) = 1", "cl"))
def w11(s, d):
    return hi.first_by(fx.claims(s, d).filter("tier >= 3"), ["company_id"], F.desc("retrieved_at"), F.desc("seq")).select("company_id", "seq")


@query("W12_primary_awardee", sql("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'bidder ' || event_id ELSE awardee END AS awardee FROM ev", "ev"))
def w12(s, d):
    who = lambda n, r: F.struct(n.alias("name"), F.lit(r).alias("role"))
    entities = F.when(F.col("event_id") % 3 == 0, F.array(who(F.concat(F.lit("bidder "), "event_id"), "bidder"))).otherwise(F.array(who(F.concat(F.lit("bidder "), "event_id"), "bidder"), who(F.col("awardee"), "awardee")))
    e = fx.events(s, d).select("event_id", entities.alias("entities"))
    return e.select("event_id", F.coalesce(F.get(F.filter("entities", lambda x: x["role"] == "awardee"), F.lit(0)), F.get("entities", F.lit(0)))["name"].alias("awardee"))


@query("S08_upsert", sql("SELECT lead_id, CASE WHEN lead_id % 4 = 0 THEN score + 1 ELSE score END AS score, CASE WHEN lead_id % 4 = 0 THEN 2 ELSE 1 END AS version FROM ld", "ld"))
def s08(s, d):
    old = fx.leads(s, d).select("lead_id", "score", F.lit(1).alias("version"))
    return hi.upsert(old, old.filter("lead_id % 4 = 0").select("lead_id", (F.col("score") + 1).alias("score"), F.lit(2).alias("version")), ["lead_id"], "version")


@query("J21_new_contacts", sql("SELECT company_id, min(seq) AS seq FROM ct WHERE email IS NOT NULL AND seq % 2 = 1 AND NOT EXISTS (SELECT 1 FROM ct t WHERE t.seq % 2 = 0 AND t.company_id = ct.company_id AND t.phone = ct.phone) GROUP BY company_id, email", "ct"))
def j21(s, d):
    c = fx.contacts(s, d)
    return hi.append_new(c.filter("seq % 2 = 0"), c.filter("email is not null and seq % 2 = 1"), ["company_id", "email"], F.col("seq")).select("company_id", "seq")


@query("A23_stage_metrics", "SELECT event_type AS stage, count(*) AS attempts, count(*) FILTER (WHERE value < 5) AS failures, round(100.0 * count(*) FILTER (WHERE value < 5) / count(*), 2) AS failure_percent, round(avg(value), 6) AS mean_ms FROM events GROUP BY event_type")
def a23(s, d):
    bad = F.count_if(F.col("value") < 5)
    return fx.table(s, d, "events").groupBy(F.col("event_type").alias("stage")).agg(F.count("*").alias("attempts"), bad.alias("failures"), F.round(100.0 * bad / F.count("*"), 2).alias("failure_percent"), F.round(F.avg("value"), 6).alias("mean_ms"))


@query("A21_run_report", "SELECT source, count(*) AS discovered, count(*) FILTER (WHERE text IS NOT NULL) AS fetched, count(DISTINCT text) AS stored, count(*) FILTER (WHERE text IS NOT NULL) - count(DISTINCT text) AS duplicate FROM documents GROUP BY source")
def a21(s, d):
    rows = fx.table(s, d, "documents").select("source", F.sha2("text", 256).alias("h"))
    per = rows.groupBy("source", "h").agg(F.count("*").alias("n"))  # one hash's rows are summed before the source's
    known = F.sum(F.when(F.col("h").isNotNull(), F.col("n")).otherwise(0))
    return per.groupBy("source").agg(F.sum("n").alias("discovered"), known.alias("fetched"), F.count("h").alias("stored"), (known - F.count("h")).alias("duplicate"))
