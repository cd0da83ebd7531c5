"""Scores, rules, feedback, contacts, briefs and headlines on known cases."""

import pytest
from pyspark.sql import functions as F

from leadlake.operators import briefs, contacts, documents, enrichment, feedback, headlines, history, opportunities, quality, scoring
from leadlake.operators import board as bd

INPUT = "event_type string, value double, event_date date, event_sector string, company_industry string, employee_range string, target_sectors array<string>, ideal_ranges array<string>, opportunity_confidence double, evidence_confidences array<double>, num_contacts int, best_seniority string"


def test_scores_add_up_and_are_the_same_again(spark):
    high = ("contract_award", 2e9, None, "Smart Cities", "Smart Cities", "1000+", ["smart cities"], ["1000+"], 0.9, [0.95, 0.9], 2, "c_level")
    low = ("policy", None, None, "Textiles", None, None, ["smart cities"], [], 0.1, [], 0, None)
    df = spark.createDataFrame([high, low], INPUT).withColumn("event_date", F.when(F.col("value") > 0, F.to_date(F.lit("2026-08-20"))))
    as_of = F.to_date(F.lit("2026-08-25"))
    rows = scoring.score(df, scoring.config() + scoring.config("b", sector_relevance=15, recency=25), as_of).collect()
    assert all(sum(c.points for c in r.components) == r.total and all(0 <= c.points <= c.max_points for c in r.components) for r in rows)
    v1 = {r.event_type: r for r in rows if r.version == "lead-score-v1"}
    assert v1["contract_award"].total >= 85 and v1["contract_award"].grade == "A" and v1["policy"].total < 25
    assert rows == scoring.score(df, scoring.config() + scoring.config("b", sector_relevance=15, recency=25), as_of).collect()
    with pytest.raises(ValueError):
        scoring.config("bad", recency=1)


def test_half_even_points(spark):
    got = [r.p for r in spark.createDataFrame([(x,) for x in (0.1, 0.3, 0.5, 2.0, -1.0)], "f double").select(scoring.points(F.col("f"), 5).alias("p")).collect()]
    assert got == [0, 2, 2, 5, 0]


def test_rules(spark):
    e = spark.createDataFrame([(1, 1, "contract_award", "Defence", 200_000_000, "A", "surveillance grid"), (2, 2, "contract_award", "Textiles", 200_000_000, "B", "yarn"), (3, 3, "contract_award", "Defence", 1000, "C", "x")], "event_id long, company_id long, event_type string, sector string, value long, awardee string, project string")
    signals = spark.createDataFrame([(1, "technology_activity", 1.0)], "company_id long, signal string, confidence double")
    got = {(r.event_id, r.product_id): r for r in opportunities.detect(e, opportunities.default_rules(spark), signals).collect()}
    assert (1, "cyber-1") in got and (2, "cyber-1") not in got and (3, "cyber-1") not in got
    r = got[1, "cyber-1"]
    assert r.confidence == pytest.approx(0.5 + 0.15 * 0.4 + 0.15 + 0.15) and r.corroborated_by == ["technology_activity"]


LOG = [
    (1, "L1", "lead_viewed"), (2, "L1", "meeting_booked"), (3, "L1", "lead_rejected"), (4, "L2", "not_relevant"), (5, "L3", "contacted"),
    (6, "L4", "incorrect_company"), (7, "L5", "opportunity_created"), (8, "L5", "meeting_booked"), (9, "L9", "lead_viewed"),
]


def test_feedback(spark):
    log = spark.createDataFrame(LOG, "seq long, lead_id string, event_type string").withColumn("occurred_at", F.timestamp_seconds("seq"))
    meta = spark.createDataFrame([("L1", 90, "a"), ("L2", 85, None), ("L3", 82, "a"), ("L4", 40, "a"), ("L5", 30, "b"), ("L6", 95, "b")], "lead_id string, score int, sector string")
    o = {r.lead_id: r for r in feedback.outcomes(log).collect()}
    assert o["L1"].label == "converted" and o["L1"].converted_via == "meeting_booked" and o["L4"].negative and o["L5"].converted_via == "opportunity_created"
    j = feedback.with_outcome(meta, log)
    p = feedback.precision(j).first()
    assert (p.high_leads, p.decided, p.converted, p.precision) == (3, 2, 1, 0.5)
    b = {r.bucket: r for r in feedback.by_bucket(j).collect()}
    assert b["80-100"].leads == 3 and b["0-19"].leads == 0 and b["0-19"].conversion_rate == 0
    assert [r.lead_id for r in feedback.false_negatives(j).collect()] == ["L5"]
    assert {(r.key, r.n) for r in feedback.false_positives(j, "sector").collect()} == {("unknown", 1)}
    assert {r.lead_id: r.status for r in feedback.lead_status(log).collect()}["L1"] == "disqualified"


def test_evaluation(spark):
    ex = spark.createDataFrame([("a", 90, True, True), ("a", 85, False, True), ("a", 20, True, True), ("a", 10, False, True), ("a", 99, True, False)], "version string, score int, converted boolean, decided boolean")
    r = feedback.evaluate(ex).first()
    assert (r.tp, r.fp, r.fn, r.tn, r.precision, r.recall, r.f1, r.accuracy) == (1, 1, 1, 1, 0.5, 0.5, 0.5, 0.5)


def test_claims(spark):
    c = spark.createDataFrame([(1, 1, "industry", "IT", "a", 2, 0.8), (1, 2, "industry", " it ", "b", 2, 0.7), (1, 3, "industry", "Pharma", "c", 3, 0.6), (1, 4, "hiring_signals", "x", "a", 1, 0.5), (1, 5, "hiring_signals", "X", "b", 1, 0.9)], "company_id long, seq long, field string, value string, source_name string, tier int, confidence double")
    s = enrichment.merge_scalars(c).first()
    assert (s.value, s.confidence, s.conflict) == ("Pharma", 0.5, True)
    assert enrichment.merge_lists(c).first()["items"] == ["X"]
    assert enrichment.profiles(spark.createDataFrame([(1,)], "company_id long"), c).filter("status = 'unknown'").count() == 11


def test_contacts(spark):
    c = spark.createDataFrame([(1, 1, "Dr. A Rao", "CIO", "a@gmail.com", None, "s1", 0.7, False), (2, 1, "dr a rao", None, "a@corp.example", "1", "s2", 0.8, False), (3, 1, "B", "Analyst", "stop@x.example", None, "s1", 0.9, True)], "seq long, company_id long, name string, title string, email string, phone string, source_name string, confidence double, verified boolean")
    m = contacts.comply(contacts.merge(c), spark.createDataFrame([("STOP@x.example",)], "email string")).collect()
    assert len(m) == 1 and m[0].email is None and m[0].confidence == 0.5 and not m[0].verified and m[0].phone == "1" and m[0].corroborations == 2


def test_briefs_round_trip_and_verification(spark):
    s = spark.createDataFrame([(1, 1, "Why now", "Worth ₹50 cr\nsince 2026"), (1, 2, "Who", "Call x@y.example")], "lead long, ord int, title string, body string")
    back = sorted((r.ord, r.title, r.body) for r in briefs.parse(briefs.render(s, "lead"), "lead").collect())
    assert back == [(1, "Why now", "Worth ₹50 cr\nsince 2026"), (2, "Who", "Call x@y.example")]
    f = spark.createDataFrame([(1, "event.value", "Value: ₹50.0 crore", "2026-08-01")], "lead long, kind string, statement string, value string")
    got = {r.ord: r for r in briefs.verify(s, f, "lead").collect()}
    assert got[1].status == "ok" and got[2].contacts == ["x@y.example"] and got[2].status == "flagged"


def test_headlines(spark):
    titles = [
        "Order win: RailTel Corp bags Rs 50 crore order from Ministry of Power for works", "We win ₹50 cr order from government", "Acme Infra wins ₹2.5 billion contract from Odisha",
        "Stocks to watch as Acme wins ₹5 crore government order", "Acme wins order from government", "Ministry of Power awarded ₹5 crore",
    ]
    df = spark.createDataFrame([(i, i, t, "Banking") for i, t in enumerate(titles)], "feed_ord long, supp long, title string, vertical string")
    got = {r.feed_ord: (r.company, r.government_buyer, r.value) for r in headlines.extract(df).collect()}
    assert got == {0: ("RailTel Corp", "Ministry of Power", 5e8), 2: ("Acme Infra", "Odisha", 2.5e9)}


def test_documents_and_history(spark):
    files = spark.createDataFrame([(1, bytearray(b""), None, "a"), (2, bytearray(b"%PDF-1"), "text/html", "a.pdf"), (3, bytearray(b"<html><script>x</script><p>Hi&amp;</p>"), None, "x"), (4, bytearray(b"\xff\xfe\x00\x01"), None, None), (5, bytearray(b"plain"), None, "a.txt"), (6, bytearray(b"plain"), None, "b.txt")], "doc_id long, content binary, declared_mime string, name string")
    got = {r.doc_id: (r.status, r.doc_class) for r in documents.processed(files).collect()}
    assert got == {1: ("failed", "unknown"), 2: ("needs_ocr", "pdf"), 3: ("succeeded", "html"), 4: ("failed", "unknown"), 5: ("succeeded", "text"), 6: ("duplicate", "text")}
    assert documents.validated(files).filter("doc_id = 2").first().warnings
    rows = spark.createDataFrame([("k", 1), ("k", 2)], "key string, version int")
    assert [r.version for r in history.supersede(rows.limit(0), rows, ["key"], "version").filter("is_current").collect()] == [2]
    assert quality.repeated_keys(spark.createDataFrame([("a",), ("a",), (None,), (None,)], "k string"), "k").count() == 1


def test_board_filters(spark):
    d = spark.createDataFrame([(1, "o", "Acme", 90, "2026-08-01"), (2, "o", "Beta", 50, None), (3, "p", "Acme", 95, "2020-01-01")], "lead_id long, organization_id string, company string, score int, event_date string").withColumn("event_date", F.to_date("event_date"))
    as_of = F.to_date(F.lit("2026-08-25"))
    assert [r.lead_id for r in bd.in_order(bd.board(d, as_of, org="o")).collect()] == [1, 2]
    assert [r.lead_id for r in bd.board(d, as_of, date_days=30).collect()] == [1]
    assert sorted(r.lead_id for r in bd.board(d, as_of, date_days=30, keep_undated=True).collect()) == [1, 2]
    assert bd.board(d, as_of, company="acm", score_min=91).count() == 1


def test_repeated_signals_of_a_company(spark):
    """A company that has a signal twice counts it once, with its highest confidence."""
    events = spark.createDataFrame([(1, 7, "contract_award", "IT", 10**9, "Acme", "digital governance platform")], "event_id long, company_id long, event_type string, sector string, value long, awardee string, project string")
    rules = opportunities.default_rules(spark)
    name = rules.select(F.explode("signals").alias("s")).first().s
    once = [(7, name, 0.5)]
    cols = "company_id long, signal string, confidence double"
    plain = opportunities.detect(events, rules, spark.createDataFrame(once, cols)).orderBy("product_id").collect()
    again = opportunities.detect(events, rules, spark.createDataFrame([*once, (7, name, 0.2), (7, None, 0.9), *once], cols)).orderBy("product_id").collect()
    assert again == plain and any(r.corroborated_by for r in plain)


def test_places_on_the_board_and_its_pages(spark):
    rows = [(i, None if i % 7 == 0 else f"2026-01-{i % 28 + 1:02d}", i * 37 % 50) for i in range(300)]
    leads = spark.createDataFrame(rows, "lead_id long, event_date string, score long").repartition(5)
    want = {r[0]: k for k, r in enumerate(sorted(rows, key=lambda r: (r[1] is None, [-ord(c) for c in r[1] or ""], -r[2], r[0])), 1)}
    assert {r.lead_id: r.place for r in bd.placed(leads).collect()} == want
    for page in (0, 1, 2, 5):
        assert {r.lead_id: r.place for r in bd.placed(leads, page, 60).collect()} == {i: p for i, p in want.items() if page * 60 < p <= page * 60 + 60}
    assert bd.placed(leads.limit(0)).count() == 0


def test_errors_of_the_cluster_are_no_errors_of_a_source(spark):
    refs = spark.createDataFrame([(1, "a")], "obs_id long, value string")

    def lost(refs):
        raise RuntimeError("Job aborted due to stage failure: ExecutorLostFailure (executor 3 exited)")

    def timed_out(refs):
        raise TimeoutError("timed out")

    found, errors = enrichment.collect(refs, {"good": lambda r: r, "bad": timed_out}, ("obs_id", "value"))
    assert [r.source for r in found.collect()] == ["good"] and set(errors) == {"bad"}
    with pytest.raises(RuntimeError, match="ExecutorLostFailure"):
        enrichment.collect(refs, {"good": lambda r: r, "lost": lost}, ("obs_id", "value"))


def _exchanges(df):
    """How many exchanges by lead_id a plan has: a row's own arrays need none."""
    return df._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(lead_id")


def test_briefs_and_their_checks_stay_within_the_row(spark):
    facts = F.array(*(F.struct(F.lit(f"F{i}").alias("fact_id"), F.lit("k").alias("kind"), F.lit(s).alias("statement"), F.lit(x).alias("value"), F.lit(3).alias("tier"), F.lit(None).cast("double").alias("confidence")) for i, (s, x) in enumerate([("Worth 12 crore", "12"), ("On 2024-01-02", "2024-01-02"), ("Mail a@b.example", None)])))
    bodies = ["12 crore in 2024", "13 crore", "ask a@b.example or c@d.example", None]
    parts = F.array(*(F.struct(F.lit(k).alias("ord"), F.lit(f"T{k}").alias("title"), F.lit(b).alias("body")) for k, b in enumerate(bodies, 1)))
    leads = spark.range(3).select(F.col("id").cast("string").alias("lead_id"), facts.alias("facts"), F.lit(50).alias("total"), F.lit(0.5).alias("confidence"))
    rows = leads.select("lead_id", F.explode(parts).alias("x")).select("lead_id", "x.*")
    want = briefs.verify(rows, leads.select("lead_id", F.explode("facts").alias("f")).select("lead_id", "f.*"), "lead_id")
    checked = briefs.verified(leads, parts)
    got = checked.select("lead_id", F.explode("checked").alias("x")).select("lead_id", "x.*")
    key = lambda df: sorted(map(repr, df.select("lead_id", "ord", "numbers", "contacts", "status").collect()))
    assert key(got) == key(want) and len(key(got)) == 12
    want = sorted(map(repr, briefs.status(want, leads, "lead_id").collect()))
    assert sorted(map(repr, briefs.row_status(checked, "lead_id").collect())) == want
    text = leads.select("lead_id", briefs.markdown(F.slice(parts, 1, 3)).alias("content"))
    rendered = briefs.render(rows.filter("ord < 4"), "lead_id")
    assert sorted(map(repr, text.collect())) == sorted(map(repr, rendered.collect()))
    assert _exchanges(got) == _exchanges(text) == 0


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString().splitlines()


def test_event_texts_are_made_once_and_signals_meet_events(spark):
    """Not in the condition, where each keyword would make them again, and not after the rules have multiplied the rows."""
    cols = "event_id long, company_id long, event_type string, awardee string, sector string, project string, value long"
    e = spark.createDataFrame([(k, k % 3, "contract_award", f"A{k}", "Smart Cities", "digital", 10**9) for k in range(9)], cols)
    signals = spark.createDataFrame([(1, "technology_activity", 0.5)], "company_id long, signal string, confidence double")
    found = opportunities.detect(e, opportunities.default_rules(spark), signals)
    plan = plan_of(found)
    joins = [x for x in plan if "Join " in x]
    assert len(joins) == 2 and "event_type" in joins[0] and not any("concat_ws" in x or "lower(" in x for x in joins)
    assert {r.company_id for r in found.collect() if r.corroborated_by} == {1}


def test_versions_share_points(spark):
    """Seven components and two that differ in the second version: nine figures, each computed once, for components and total."""
    row = {"event_type": "work_order", "value": 10**8, "event_date": "2001-08-01", "event_sector": "IT", "company_industry": "IT", "employee_range": "51-200", "opportunity_confidence": 0.5, "num_contacts": 1, "best_seniority": "vp"}
    df = spark.createDataFrame([row]).withColumns({"event_date": F.to_date("event_date"), "target_sectors": F.array(F.lit("IT")), "ideal_ranges": F.array(F.lit("51-200")), "evidence_confidences": F.array(F.lit(0.4))})
    out = scoring.score(df, scoring.config() + scoring.config("b", sector_relevance=15, recency=25), F.to_date(F.lit("2001-08-31")))
    assert sum(x.count("bround(") for x in plan_of(out)) == 9
    assert all(r.total == sum(c["points"] for c in r.components) for r in out.collect()) and out.count() == 2
