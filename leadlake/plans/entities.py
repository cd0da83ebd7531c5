"""Queries of event and company matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadlake.functions import text as tx
from leadlake.operators import matching as m
from leadlake.plans import fixtures as fx
from leadlake.plans.fixtures import sql
from leadlake.plans.registry import query
from leadlake.plans.scalars import CORE_SQL, DOMAIN_SQL, FULL_SQL
from leadlake.session import stored

FP = {"fp": "SELECT report_id AS seq, nullif(upper(regexp_replace(reference, '[^A-Za-z0-9]+', '', 'g')), '') AS i, buyer, company, value, event_date FROM rp"}
J1 = "SELECT DISTINCT a, seq AS b, 0.98 AS confidence FROM (SELECT seq, min(seq) OVER (PARTITION BY i) AS a FROM fp WHERE i IS NOT NULL) WHERE a < seq"
J2 = "SELECT a.seq AS a, b.seq AS b, 0.9 AS confidence FROM fp a JOIN fp b ON a.buyer = b.buyer AND a.company = b.company AND a.seq < b.seq AND abs(a.value - b.value) <= greatest(abs(a.value), abs(b.value)) * 0.02 AND abs(date_diff('day', a.event_date, b.event_date)) <= 3"
#: Reports with one company, buyer and type have one text. All company names of the test tables have a ratio of 0.6 or more.
J3 = {
    "cls": "SELECT company, buyer, event_type, min(report_id) AS a FROM rp GROUP BY ALL",
    "tok": "SELECT a, ('0x' || substr(md5(t), 31, 2))::INTEGER % 128 AS k, count(*) AS n FROM (SELECT a, unnest(regexp_extract_all(lower(concat_ws(' ', event_type, company, buyer)), '[a-z0-9]+')) AS t FROM cls) GROUP BY ALL",
    "nrm": "SELECT a, sqrt(sum(n * n)) AS s FROM tok GROUP BY a",
    "dots": "SELECT x.a AS a, y.a AS b, sum(x.n * y.n) AS d FROM tok x JOIN tok y ON x.k = y.k AND x.a < y.a GROUP BY ALL",
}
J3_SQL = "SELECT d.a, d.b, 0.85 AS confidence FROM dots d JOIN nrm x ON x.a = d.a JOIN nrm y ON y.a = d.b WHERE d / (x.s * y.s) >= 0.86 UNION ALL SELECT a, report_id, 0.85 FROM rp JOIN cls USING (company, buyer, event_type) WHERE report_id > a"


def prints(s, d):
    return m.fingerprints(fx.reports(s, d))


@query("F26_fingerprints", sql("SELECT report_id AS seq, list_filter([nullif(upper(regexp_replace(reference, '[^A-Za-z0-9]+', '', 'g')), '')], lambda x: x IS NOT NULL) AS identifiers, lower(replace(buyer, '_', ' ')) AS buyer, lower(replace(company, '#', ' ')) AS company, value, event_date FROM rp", "rp"))
def f26(s, d):
    return prints(s, d)


@query("J01_identifier_matches", sql(J1, "rp", more=FP))
def j01(s, d):
    return m.identifier_edges(prints(s, d))


#: The first reports of equal buyer, company, value and date with each other, and all others with the first of theirs.
J2_SQL = J2.replace("FROM fp a JOIN fp b", "FROM one a JOIN one b") + " UNION ALL SELECT f AS a, seq AS b, 0.9 AS confidence FROM (SELECT seq, min(seq) OVER (PARTITION BY buyer, company, value, event_date) AS f FROM fp) WHERE f < seq"


@query("J02_composite_matches", sql(J2_SQL, "rp", more=FP | {"one": "SELECT min(seq) AS seq, buyer, company, value, event_date FROM fp GROUP BY ALL"}))
def j02(s, d):
    return m.composite_edges(prints(s, d))


def texts(s, d):
    return fx.reports(s, d).select(F.col("report_id").alias("seq"), F.concat_ws(" ", "event_type", "company", "buyer").alias("text"))


@query("J03_semantic_matches", sql(J3_SQL, "rp", more=J3))
def j03(s, d):
    return m.semantic_edges(prints(s, d), texts(s, d))


_BLOCKS = (("event_date", 1), ("company", 1), ("i", 1), ("event_date, company", -1), ("event_date, i", -1), ("company, i", -1), ("event_date, company, i", 1))


@query("J04_event_candidates", sql("SELECT seq, " + " + ".join(f"{sign} * CASE WHEN {'i IS NOT NULL' if 'i' in by.split(', ') else 'true'} THEN count(*) OVER (PARTITION BY {by}) ELSE 0 END" for by, sign in _BLOCKS) + " - 1 AS candidates, least(min(seq) OVER (PARTITION BY event_date), min(seq) OVER (PARTITION BY company), CASE WHEN i IS NOT NULL THEN min(seq) OVER (PARTITION BY i) END) AS first_seq FROM fp", "rp", more=FP))
def j04(s, d):
    """How many reports each one has to be compared with, and the earliest of them."""
    return m.candidate_counts(prints(s, d)).withColumnRenamed("first", "first_seq")


LEAD = "SELECT seq, min(seq) OVER (PARTITION BY i) AS canonical FROM fp WHERE i IS NOT NULL"


@query("J05_leader_clusters_by_identifier", sql(LEAD, "rp", more=FP))
def j05(s, d):
    p = stored(prints(s, d).filter(F.size("identifiers") > 0).select("seq", "identifiers"))
    return m.leaders(p.select("seq"), groups=((m.identifier_keys(p), None, 0.98),)).select("seq", "canonical")


@query("C02_canonical_events")
def c02(s, d):
    """Reports to canonical events, by identifiers, composite and text, each with the company of its awardee."""
    r = fx.reports(s, d)
    none = {k: F.lit(None).cast("string") for k in ("cin", "gstin", "pan", "website", "city", "state")}
    names = r.groupBy(F.col("company").alias("raw_name")).agg(F.min("report_id").alias("obs_id")).withColumns(none)
    known = m.resolve(m.company_forms(names)).join(names.select("obs_id", "raw_name"), "obs_id").select("raw_name", "company_id")
    companies = r.select(F.col("report_id").alias("seq"), F.col("company").alias("raw_name")).join(known, "raw_name").select("seq", "company_id")
    return m.canonical_events(r, m.canonicalise(prints(s, d), texts(s, d)), companies)


@query("A18_event_evidence", sql(f"SELECT l.canonical, count(*) AS sources, min(event_date) AS first_seen, max(event_date) AS last_seen, list_sort(list(DISTINCT value)) AS reported_values FROM rp JOIN ({LEAD}) l ON l.seq = rp.report_id GROUP BY l.canonical", "rp", more=FP))
def a18(s, d):
    return m.canonical_events(fx.reports(s, d), j05(s, d))


@query("W09_best_match", sql("SELECT b AS seq, arg_max(a, {'c': confidence, 'n': -a}) AS best, max(confidence) AS confidence FROM (SELECT a, b, max(confidence) AS confidence FROM (" + J1 + " UNION ALL " + J2 + ") GROUP BY a, b) GROUP BY b", "rp", more=FP))
def w09(s, d):
    return m.best_matches(prints(s, d))


@query("U04_shared_identifiers", sql("SELECT a.report_id AS a, b.report_id AS b, len(list_intersect([a.event_id, a.company_id], [b.event_id, b.company_id])) AS shared FROM rp a JOIN rp b ON a.event_id = b.event_id AND a.report_id < b.report_id WHERE len(list_intersect([a.event_id, a.company_id], [b.event_id, b.company_id])) > 0", "rp"))
def u04(s, d):
    r = fx.reports(s, d).select("report_id", "event_id", F.array("event_id", "company_id").alias("ids"))
    a, b = r.select(F.col("report_id").alias("a"), "event_id", F.col("ids").alias("ia")), r.select(F.col("report_id").alias("b"), "event_id", F.col("ids").alias("ib"))
    return a.join(b, "event_id").filter((F.col("a") < F.col("b")) & F.arrays_overlap("ia", "ib")).select("a", "b", F.size(F.array_intersect("ia", "ib")).cast("long").alias("shared"))


# --- companies ---

CF = {"cf": f"SELECT obs_id, nullif({CORE_SQL}, '') AS core, {FULL_SQL} AS full_name, nullif(upper(trim(cin)), '') AS cin, nullif(upper(trim(gstin)), '') AS gstin, nullif(upper(trim(pan)), '') AS pan, {DOMAIN_SQL} AS domain, lower(trim(city)) AS city, lower(trim(state)) AS state FROM co"}
CONFLICT = "(coalesce(a.cin <> b.cin, false) OR coalesce(a.gstin <> b.gstin, false) OR coalesce(a.pan <> b.pan, false))"


def forms(s, d):
    return m.company_forms(fx.companies(s, d))


#: All pairs of observations that may match, each b with every earlier a; of each b the best, the earliest of equals.
def _pairs(k: str, more: str = "") -> str:
    return f"SELECT a.obs_id AS a, b.obs_id AS b{more} FROM cf a JOIN cf b ON a.{k} = b.{k} AND a.obs_id < b.obs_id WHERE NOT {CONFLICT}"


@query("J06_company_keys", sql("SELECT arg_max(a, {'c': confidence, 'n': -a}) AS a, b, arg_max(kind, {'c': confidence, 'n': -a}) AS kind, max(confidence) AS confidence FROM (" + " UNION ALL ".join(_pairs(k, f", '{k}' AS kind, {c} AS confidence") for k, c in m.KEYS) + ") GROUP BY b", "co", more=CF))
def j06(s, d):
    return m.key_matches(forms(s, d))


@query("J07_registration_conflicts", sql("SELECT DISTINCT a, b FROM (" + " UNION ALL ".join(f"SELECT min(a.obs_id) AS a, b.obs_id AS b FROM cf a JOIN cf b ON a.core = b.core WHERE a.{k} <> b.{k} GROUP BY b.obs_id" for k in m.IDS) + ")", "co", more=CF))
def j07(s, d):
    return m.conflicts(forms(s, d))


PLACE = "CASE WHEN coalesce(a.city = b.city, false) OR coalesce(a.state = b.state, false) THEN 0.92 ELSE 0.85 END"


@query("J08_company_names", sql("SELECT arg_max(a, {'c': confidence, 'n': -a}) AS a, b, max(confidence) AS confidence FROM (" + _pairs("core", f", {PLACE} AS confidence") + ") GROUP BY b", "co", more=CF))
def j08(s, d):
    return m.name_matches(forms(s, d))


@query("J09_similar_names")
def j09(s, d):
    """Products whose whole names are alike; of products with one name the first stands for all."""
    names = fx.table(s, d, "part").select(tx.party_name(F.col("p_name")).alias("name"), "p_partkey").filter("name is not null")
    return m.fuzzy_pairs(names.groupBy("name").agg(F.min("p_partkey").alias("id")).select("id", "name"))


@query("X41_name_ratio")
def x41(s, d):
    """Full names of observations against that of the first one with their domain."""
    f = forms(s, d).filter("domain is not null").select("obs_id", "domain", "full")
    first = f.groupBy("domain").agg(F.min(F.struct("obs_id", "full")).alias("x"))
    m.ship(s)
    return f.join(first, "domain").filter("x.obs_id < obs_id").select(F.col("x.obs_id").alias("a"), F.col("obs_id").alias("b"), m.name_ratio(F.col("x.full"), F.col("full")).alias("ratio"))


_KINDS = ("cin", "gstin", "pan", "domain", "core", "full_name")


@query("J10_company_candidates", sql("SELECT obs_id, kind, min(obs_id) OVER (PARTITION BY kind, value) AS block, count(*) OVER (PARTITION BY kind, value) AS holders FROM (" + " UNION ALL ".join(f"SELECT obs_id, '{k.removesuffix('_name')}' AS kind, {k} AS value FROM cf WHERE {k} IS NOT NULL" for k in _KINDS) + ") QUALIFY holders > 1", "co", more=CF))
def j10(s, d):
    """The blocks whose members are each observation's candidates: membership instead of all pairs of a block."""
    return m.candidates(forms(s, d))


@query("U06_candidate_union", sql("SELECT obs_id AS id FROM cf WHERE core IS NOT NULL AND core LIKE '%1' UNION SELECT obs_id FROM cf WHERE full_name LIKE '%1 limited'", "co", more=CF))
def u06(s, d):
    f = forms(s, d)
    return f.filter(F.col("core").endswith("1")).select(F.col("obs_id").alias("id")).union(f.filter(F.col("full").endswith("1 limited")).select("obs_id")).distinct()


#: The fold, one observation after the other, over the list of all companies made so far.
_IDS = "cin, gstin, pan, domain, city, state".split(", ")
_WEIGHT = "CASE WHEN " + " OR ".join(f"coalesce(o.{k} <> c.{k}, false)" for k in m.IDS) + " THEN 0 " + " ".join(f"WHEN o.{k} = c.{k} THEN {w}" for k, w in m.KEYS) + " WHEN o.core = c.core OR (o.core IS NOT NULL AND list_contains(c.aliases, o.full_name)) THEN CASE WHEN coalesce(o.city = c.city, false) OR coalesce(o.state = c.state, false) THEN 0.92 ELSE 0.85 END ELSE 0 END"
_MERGED = "{'id': c.id, 'core': c.core, 'aliases': list_distinct(list_append(c.aliases, full_name)), " + ", ".join(f"'{k}': coalesce(c.{k}, {k})" for k in _IDS) + "}"
_NEW = "{'id': obs_id, 'core': core, 'aliases': [full_name], " + ", ".join(f"'{k}': {k}" for k in _IDS) + "}"
FOLD = {
    "ob": "SELECT *, row_number() OVER (ORDER BY obs_id) AS n FROM cf",
    "f": f"""SELECT 0::BIGINT AS n, NULL::BIGINT AS obs_id, NULL::BIGINT AS company_id, NULL::DOUBLE AS confidence, []::STRUCT(id BIGINT, core VARCHAR, aliases VARCHAR[], {", ".join(k + " VARCHAR" for k in _IDS)})[] AS made
      UNION ALL SELECT n, obs_id, CASE WHEN w > 0 THEN made[k].id ELSE obs_id END, CASE WHEN w > 0 THEN w END,
        CASE WHEN w > 0 THEN list_transform(made, lambda c, j: CASE WHEN j = k THEN {_MERGED} ELSE c END) ELSE list_append(made, {_NEW}) END
      FROM (SELECT *, coalesce(list_max(weights), 0) AS w, list_position(weights, list_max(weights)) AS k
        FROM (SELECT o.*, f.made, list_transform(f.made, lambda c: ({_WEIGHT})::DOUBLE) AS weights FROM f JOIN ob o ON o.n = f.n + 1))""",
}


@query("J11_resolved_companies", sql("SELECT obs_id, company_id, confidence FROM f WHERE n > 0", "co", more=CF | FOLD).replace("WITH", "WITH RECURSIVE", 1))
def j11(s, d):
    return m.resolve(forms(s, d))


@query("A17_company_aliases", sql("SELECT core, count(DISTINCT full_name) AS aliases FROM cf WHERE core IS NOT NULL GROUP BY core", "co", more=CF))
def a17(s, d):
    return forms(s, d).filter("core is not null").groupBy("core").agg(F.size(F.collect_set("full")).cast("long").alias("aliases"))
