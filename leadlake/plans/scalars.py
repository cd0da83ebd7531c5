"""Queries of the column functions (X) and of plain projections and filters over them (F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadlake.functions import text as tx
from leadlake.functions import values as v
from leadlake.plans import fixtures as fx
from leadlake.plans.registry import query
from leadlake.plans.fixtures import sql

LEGAL_SQL = "[" + ", ".join(f"'{w}'" for w in tx.LEGAL_WORDS) + "]"
HONORIFIC_SQL = r"trim(regexp_replace(trim(raw_name), '^(m\s*/\s*s\.?\s*|messrs[ .]+|ms[ .]+)', '', 'i'))"
FULL_SQL = rf"lower(trim(regexp_replace({HONORIFIC_SQL}, '[^A-Za-z0-9]+', ' ', 'g')))"
CORE_SQL = f"array_to_string(list_filter(string_split({FULL_SQL}, ' '), lambda w: NOT list_contains({LEGAL_SQL}, w) AND w <> ''), ' ')"
DOMAIN_SQL = r"nullif(regexp_replace(regexp_replace(regexp_replace(lower(trim(website)), '^https?://', ''), '^www\.', ''), '[/?].*$', ''), '')"


def case(column: str, values: dict, other: str = "NULL") -> str:
    return f"CASE {column} " + " ".join(f"WHEN {k!r} THEN {x!r}" for k, x in values.items()) + f" ELSE {other} END"


def grade_sql(c: str) -> str:
    return f"CASE WHEN {c} >= 80 THEN 'A' WHEN {c} >= 65 THEN 'B' WHEN {c} >= 45 THEN 'C' WHEN {c} >= 25 THEN 'D' ELSE 'F' END"


@query("X01_identifier", sql("SELECT report_id, nullif(upper(regexp_replace(reference, '[^A-Za-z0-9]+', '', 'g')), '') AS identifier FROM rp", "rp"))
def x01(s, d):
    return fx.reports(s, d).select("report_id", tx.identifier(F.col("reference")).alias("identifier"))


@query("X02_party_name", "SELECT c_custkey, nullif(lower(trim(regexp_replace(c_name, '[^A-Za-z0-9]+', ' ', 'g'))), '') AS name FROM customer")
def x02(s, d):
    return fx.table(s, d, "customer").select("c_custkey", tx.party_name(F.col("c_name")).alias("name"))


@query("X03_company_name", sql(rf"SELECT obs_id, regexp_replace({HONORIFIC_SQL}, '\s+', ' ', 'g') AS display, {CORE_SQL} AS core, {FULL_SQL} AS normalized_full FROM co", "co"))
def x03(s, d):
    c = F.col("raw_name")
    return fx.companies(s, d).select("obs_id", tx.company_display(c).alias("display"), tx.company_core(c).alias("core"), tx.company_full(c).alias("normalized_full"))


@query("X04_domain", r"SELECT page_id, nullif(regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^https?://', ''), '^www\.', ''), '[/?].*$', ''), '') AS domain FROM pages")
def x04(s, d):
    return fx.table(s, d, "pages").select("page_id", tx.domain(F.col("url")).alias("domain"))


@query("X05_person_name", sql(r"SELECT seq, trim(regexp_replace(regexp_replace(lower(name), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g')) AS person FROM ct", "ct"))
def x05(s, d):
    return fx.contacts(s, d).select("seq", tx.person_name(F.col("name")).alias("person"))


@query("X06_slugs", "SELECT p_partkey, trim(regexp_replace(lower(p_name || ' / ' || p_brand), '[^a-z0-9]+', '_', 'g'), '_') AS slug, coalesce(nullif(substr(trim(regexp_replace(lower(p_name || ' / ' || p_brand), '[^a-z0-9]+', '-', 'g'), '-'), 1, 120), ''), 'source') AS source_slug FROM part")
def x06(s, d):
    c = F.concat("p_name", F.lit(" / "), "p_brand")
    return fx.table(s, d, "part").select("p_partkey", tx.slug(c).alias("slug"), tx.source_slug(c).alias("source_slug"))


@query("X07_closeness", sql("SELECT a.report_id, b.report_id AS other_id, abs(a.value - b.value) <= greatest(abs(a.value), abs(b.value)) * 0.02 AS value_close, abs(date_diff('day', a.event_date, b.event_date)) <= 3 AS date_close FROM rp a JOIN rp b ON a.event_id = b.event_id AND a.report_id < b.report_id", "rp"))
def x07(s, d):
    r = fx.reports(s, d)
    a, b = r.alias("a"), r.alias("b")
    j = a.join(b, (F.col("a.event_id") == F.col("b.event_id")) & (F.col("a.report_id") < F.col("b.report_id")))
    return j.select(F.col("a.report_id").alias("report_id"), F.col("b.report_id").alias("other_id"), v.value_close(F.col("a.value"), F.col("b.value")).alias("value_close"), v.date_close(F.col("a.event_date"), F.col("b.event_date")).alias("date_close"))


#: Value text of whole amounts; t counts tenths of a crore, rounded half up.
VALUE_TEXT_SQL = """CASE WHEN currency <> 'INR' THEN format('{:,}', value) || ' ' || currency WHEN value >= 10000000 THEN '₹' || ((value + 500000) // 1000000 // 10) || '.' || ((value + 500000) // 1000000 % 10) || ' cr' ELSE '₹' || format('{:,}', value) END"""


@query("X08_value_text", sql(f"SELECT event_id, {VALUE_TEXT_SQL} AS text FROM ev", "ev"))
def x08(s, d):
    return fx.events(s, d).select("event_id", v.value_text(F.col("value"), F.col("currency")).alias("text"))


HEADLINE = "CASE WHEN l_linenumber % 3 = 0 THEN 'Order win: ' ELSE '' END || p_name || ' Infra wins ₹' || (l_quantity::BIGINT) || '.5 ' || CASE WHEN l_linenumber % 2 = 0 THEN 'crore' ELSE 'billion' END || ' order from Ministry of ' || p_type || ' for works - Daily ' || (l_suppkey % 5)"


def headlines(s, d):
    """Headlines made of order lines and parts, with a source and an RFC 822 date."""
    lines, parts = fx.table(s, d, "lineitem"), fx.table(s, d, "part")
    j = lines.join(parts, lines.l_partkey == parts.p_partkey)
    title = F.concat(
        F.when(F.col("l_linenumber") % 3 == 0, "Order win: ").otherwise(""), "p_name", F.lit(" Infra wins ₹"), F.col("l_quantity").cast("long").cast("string"), F.lit(".5 "),
        F.when(F.col("l_linenumber") % 2 == 0, "crore").otherwise("billion"), F.lit(" order from Ministry of "), "p_type", F.lit(" for works - Daily "), (F.col("l_suppkey") % 5).cast("string"),
    )
    vertical = F.when(F.col("l_suppkey") % 2 == 0, "Banking").otherwise("Pharma")
    feed = (F.col("l_orderkey") * 1000 + F.col("l_linenumber") * 100 + F.col("l_partkey") % 100).alias("feed_ord")
    return j.select(feed, F.col("l_suppkey").alias("supp"), vertical.alias("vertical"), title.alias("title"), F.concat(F.date_format("l_shipdate", "E, dd MMM yyyy"), F.lit(" 10:00:00 GMT")).alias("date"))


HEADLINES_SQL = f"SELECT l_orderkey * 1000 + l_linenumber * 100 + l_partkey % 100 AS feed_ord, l_suppkey AS supp, CASE WHEN l_suppkey % 2 = 0 THEN 'Banking' ELSE 'Pharma' END AS vertical, {HEADLINE} AS title, strftime(l_shipdate, '%a, %d %b %Y') || ' 10:00:00 GMT' AS date FROM lineitem JOIN part ON l_partkey = p_partkey"


@query("X09_amount_inr", sql("SELECT feed_ord, supp, CASE WHEN n <> '' THEN replace(n, ',', '')::DOUBLE * CASE WHEN u = 'billion' THEN 1e9 ELSE 1e7 END END AS amount FROM (SELECT *, regexp_extract(title, '(?i)(?:₹|Rs\\.?)\\s?([\\d,]+(?:\\.\\d+)?)\\s*(crore|cr|billion)\\b', 1) AS n, lower(regexp_extract(title, '(?i)(?:₹|Rs\\.?)\\s?([\\d,]+(?:\\.\\d+)?)\\s*(crore|cr|billion)\\b', 2)) AS u FROM hl)", more={"hl": HEADLINES_SQL}))
def x09(s, d):
    return headlines(s, d).select("feed_ord", "supp", v.amount_inr(F.col("title")).alias("amount"))


@query("X10_feed_date", sql("SELECT feed_ord, supp, try_strptime(substr(date, 6, 11), '%d %b %Y')::DATE AS day FROM hl", more={"hl": HEADLINES_SQL}))
def x10(s, d):
    return headlines(s, d).select("feed_ord", "supp", v.feed_date(F.col("date")).alias("day"))


@query("X11_title_key", sql(r"SELECT feed_ord, supp, substr(regexp_replace(lower(title), '[^\p{L}\p{N}_]+', '', 'g'), 1, 60) AS title_key FROM hl", more={"hl": HEADLINES_SQL}))
def x11(s, d):
    return headlines(s, d).select("feed_ord", "supp", tx.title_key(F.col("title")).alias("title_key"))


def unescaped_sql(x: str) -> str:
    """The entities that the test pages hold, as characters."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
        x = f"replace({x}, '{entity}', '{char}')"
    return x


@query("X12_without_tags", "SELECT page_id, md5(" + unescaped_sql("trim(regexp_replace(coalesce(html, ''), '<[^>]+>', '', 'g'))") + ") AS text_md5 FROM pages")
def x12(s, d):
    return fx.table(s, d, "pages").select("page_id", F.md5(tx.unescaped(tx.without_tags(F.col("html")))).alias("text_md5"))


@query("X13_vocabularies", sql(f"SELECT f.seq, {case('f.event_type', v.FEEDBACK_CLASS)} AS outcome_class, {case('f.event_type', v.FEEDBACK_OUTCOME)} AS outcome, {case('f.event_type', v.FEEDBACK_STATUS)} AS status FROM fb f", "fb"))
def x13(s, d):
    c = F.col("event_type")
    return fx.feedback(s, d).select("seq", v.lookup(c, v.FEEDBACK_CLASS).alias("outcome_class"), v.lookup(c, v.FEEDBACK_OUTCOME).alias("outcome"), v.lookup(c, v.FEEDBACK_STATUS).alias("status"))


@query("X13_event_types", sql(f"SELECT event_id, {case('event_type', v.EVENT_TYPES, repr('other'))} AS canonical_type, {case(case('event_type', v.EVENT_TYPES, repr('other')), v.EVENT_LABELS, repr('Event'))} AS label FROM ev", "ev"))
def x13b(s, d):
    kind = v.lookup(F.col("event_type"), v.EVENT_TYPES, "other")
    return fx.events(s, d).select("event_id", kind.alias("canonical_type"), v.lookup(kind, v.EVENT_LABELS, "Event").alias("label"))


@query("X14_currency", "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'INR' WHEN 1 THEN 'INR' WHEN 2 THEN 'USD' WHEN 3 THEN 'EUR' END AS currency FROM orders")
def x14(s, d):
    raw = F.element_at(F.array(*map(F.lit, ("Indian rupees", "Rs.", " us$ usd", "euro", ""))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return fx.table(s, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 3, v.currency_code(F.lit("eur"))).otherwise(v.currency_code(raw)).alias("currency"))


@query("X15_strong_identifiers", sql("SELECT event_id, list_filter([CASE WHEN event_type = 'scheme' THEN reference END, CASE WHEN event_type <> 'scheme' THEN 'C-' || event_id END, CASE WHEN event_id % 3 = 0 THEN '' END, CASE WHEN event_id % 4 = 0 THEN 'P-' || company_id END, reference], lambda x: x IS NOT NULL AND x <> '') AS identifiers FROM ev", "ev"))
def x15(s, d):
    e = identified(fx.events(s, d))
    return e.select("event_id", strong_identifiers().alias("identifiers"))


def identified(e):
    """Events with the five identifier columns."""
    scheme = F.col("event_type") == "scheme"
    return e.withColumns({
        "notice_number": F.when(scheme, F.col("reference")), "contract_number": F.when(~scheme, F.concat(F.lit("C-"), "event_id")),
        "work_order_number": F.when(F.col("event_id") % 3 == 0, ""), "project_id": F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("P-"), "company_id")),
    })


def strong_identifiers():
    """The identifiers in priority order, without nulls and empty ones."""
    return F.filter(F.array("notice_number", "contract_number", "work_order_number", "project_id", "reference"), lambda x: x.isNotNull() & (x != ""))


@query("X16_dedup_key", sql("SELECT event_id, sha1(concat_ws('|', event_type, lower(trim(awardee)), value || '.00', event_date::VARCHAR, lower(trim(buyer)), lower(trim(project)))) AS dedup_key FROM ev", "ev"))
def x16(s, d):
    return fx.events(s, d).select("event_id", v.dedup_key(*map(F.col, ("event_type", "awardee", "value", "event_date", "buyer", "project"))).alias("dedup_key"))


@query("X17_lead_id", sql("SELECT company_id, 'news-' || substr(sha1(concat_ws('|', 'org', lower(company), coalesce(product, ''))), 1, 24) AS id FROM (SELECT lead_id AS company_id, company, product FROM ld)", "ld"))
def x17(s, d):
    key = F.sha1(F.concat_ws("|", F.lit("org"), F.lower("company"), F.coalesce("product", F.lit(""))).cast("binary"))
    return fx.leads(s, d).select(F.col("lead_id").alias("company_id"), F.concat(F.lit("news-"), F.substring(key, 1, 24)).alias("id"))


@query("X18_hashes", "SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5, strlen(text) AS bytes FROM documents")
def x18(s, d):
    return fx.table(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.md5("text").alias("md5"), F.octet_length("text").cast("long").alias("bytes"))


@query("X19_document_class", "SELECT page_id, 'html' AS doc_class, 0.95 AS confidence FROM pages UNION ALL SELECT doc_id + 1000000000, CASE WHEN doc_id % 4 = 0 THEN 'pdf' WHEN doc_id % 4 = 1 THEN 'json' ELSE 'text' END, CASE WHEN doc_id % 4 >= 2 THEN 0.7 ELSE 0.95 END FROM documents WHERE text IS NOT NULL AND length(text) > 0")
def x19(s, d):
    pages = fx.table(s, d, "pages").select("page_id", F.col("html").cast("binary").alias("content"))
    k = F.col("doc_id")
    body = F.concat(F.when(k % 4 == 0, "%PDF-1.7 ").when(k % 4 == 1, ' {"a": 1} ').otherwise("x"), "text").cast("binary")
    docs = fx.table(s, d, "documents").filter("length(text) > 0").select((k + 1000000000).alias("page_id"), body.alias("content"))
    found = v.document_class(F.col("content"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    both = pages.unionByName(docs).select("page_id", found["doc_class"].alias("doc_class"))
    return both.select("page_id", "doc_class", F.when(F.col("doc_class") == "text", 0.7).otherwise(0.95).alias("confidence"))


@query("X20_document_kind", "SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'csv' WHEN page_id % 5 = 1 THEN 'json' WHEN page_id % 5 = 2 THEN 'pdf' ELSE 'html' END AS kind FROM pages")
def x20(s, d):
    k = F.col("page_id")
    hint, mime = F.when(k % 5 == 0, "csv"), F.when(k % 5 == 1, "Application/JSON")
    url = F.when(k % 5 == 2, F.concat(F.lit("https://x.example/"), k, F.lit(".PDF?y=1"))).otherwise(F.lit("https://x.example/a"))
    return fx.table(s, d, "pages").select("page_id", v.document_kind(hint, mime, url, F.col("html").cast("binary")).alias("kind"))


@query("X21_title", "SELECT page_id, coalesce(nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), ''), string_split(regexp_replace(split_part(url, '?', 1), '/+$', ''), '/')[-1]) AS title FROM pages")
def x21(s, d):
    last = F.element_at(F.split(F.regexp_replace(F.substring_index("url", "?", 1), "/+$", ""), "/"), -1)
    return fx.table(s, d, "pages").select("page_id", F.coalesce(tx.empty_to_null(F.regexp_extract("html", "<title>([^<]*)</title>", 1)), last).alias("title"))


@query("X22_base_url", "SELECT page_id, nullif(regexp_extract(url, '^([a-z]+://[^/?#]+)', 1), '') AS base_url FROM pages")
def x22(s, d):
    return fx.table(s, d, "pages").select("page_id", tx.base_url(F.col("url")).alias("base_url"))


SENIORITY_SQL = r"CASE WHEN regexp_matches(t, 'chief|ceo|cio|ciso|cto|cfo|cmo|chro|founder|president') THEN 'c_level' WHEN regexp_matches(t, '\bvp\b') THEN 'vp' WHEN contains(t, 'director') THEN 'director' WHEN contains(t, 'head') THEN 'head' WHEN regexp_matches(t, 'manager|lead') THEN 'manager' WHEN t <> '' THEN 'staff' ELSE 'unknown' END"


@query("X26_seniority", sql(f"SELECT seq, {SENIORITY_SQL} AS seniority FROM (SELECT seq, lower(coalesce(title, '')) AS t FROM ct)", "ct"))
def x26(s, d):
    return fx.contacts(s, d).select("seq", tx.seniority(F.col("title")).alias("seniority"))


@query("X27_free_mail", sql("SELECT seq, coalesce(split_part(email, '@', 2) IN ('gmail.com', 'yahoo.com', 'outlook.com'), false) AS free FROM ct", "ct"))
def x27(s, d):
    return fx.contacts(s, d).select("seq", tx.is_free_mail(F.col("email")).alias("free"))


@query("X39_X40_hashed_similarity", sql("""SELECT event_id, round(coalesce(sum(x.n * y.n) / sqrt(any_value(nx)) / sqrt(any_value(ny)), 0), 6) AS cosine FROM (SELECT event_id FROM ev)
  LEFT JOIN t x USING (event_id) LEFT JOIN r y ON x.b = y.b AND x.event_id = y.event_id LEFT JOIN (SELECT event_id, sum(n * n) AS nx FROM t GROUP BY 1) USING (event_id) LEFT JOIN (SELECT event_id, sum(n * n) AS ny FROM r GROUP BY 1) USING (event_id) GROUP BY event_id""", "ev", more={
    "w": "SELECT event_id, unnest(regexp_extract_all(lower(concat_ws(' ', event_type, awardee, project)), '[a-z0-9]+')) AS t FROM ev",
    "t": "SELECT event_id, ('0x' || substr(md5(t), 31, 2))::INTEGER % 128 AS b, count(*) AS n FROM w GROUP BY ALL",
    "u": "SELECT event_id, unnest(regexp_extract_all(lower(concat_ws(' ', awardee, sector, 'digital governance')), '[a-z0-9]+')) AS t FROM ev",
    "r": "SELECT event_id, ('0x' || substr(md5(t), 31, 2))::INTEGER % 128 AS b, count(*) AS n FROM u GROUP BY ALL"}))
def x39(s, d):
    a, b = v.hashed_embedding(F.concat_ws(" ", "event_type", "awardee", "project")), v.hashed_embedding(F.concat_ws(" ", "awardee", "sector", F.lit("digital governance")))
    e = fx.events(s, d).select("event_id", a.alias("a"), b.alias("b"))
    return e.select("event_id", F.round(v.cosine(F.col("a"), F.col("b")), 6).alias("cosine"))


@query("X42_number_tokens", r"""SELECT doc_id, list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '(?i)\d{4}-\d{2}-\d{2}|₹?\s?\d[\d,]*(?:\.\d+)?\s?(?:cr|crore|lakh|lakhs|million|billion|bn|mn)?'),
  lambda t: regexp_replace(replace(replace(replace(replace(regexp_replace(lower(trim(t)), '[,₹ ]', '', 'g'), 'crore', 'cr'), 'lakhs', 'lakh'), 'million', 'mn'), 'billion', 'bn'), '\.0(cr|lakh|mn|bn|$)', '\1', 'g')), lambda t: t <> ''))) AS numbers FROM documents""")
def x42(s, d):
    return fx.table(s, d, "documents").select("doc_id", tx.number_tokens(F.col("text")).alias("numbers"))


@query("X42_contact_tokens", r"SELECT doc_id, list_sort(list_distinct(list_concat(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}'), list_transform(regexp_extract_all(text, '(?:\+?\d[\d\-\s]{7,}\d)'), lambda p: trim(p))))) AS contacts FROM documents")
def x42b(s, d):
    return fx.table(s, d, "documents").select("doc_id", tx.contact_tokens(F.col("text")).alias("contacts"))


@query("X43_grounded_form", r"SELECT item_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS form FROM benchmark")
def x43(s, d):
    return fx.table(s, d, "benchmark").select("item_id", tx.grounded_form(F.col("text")).alias("form"))


@query("X44_grade", sql(f"SELECT lead_id, {grade_sql('score')} AS grade FROM ld", "ld"))
def x44(s, d):
    return fx.leads(s, d).select("lead_id", v.grade(F.col("score")).alias("grade"))


@query("X45_text_density", "SELECT doc_id, CASE WHEN length(text) < 20 THEN 0.0 WHEN length(text) / pages < 100 THEN 0.6 WHEN length(text) / pages < 500 THEN 0.8 ELSE 0.95 END AS confidence, length(text) < 20 AS needs_ocr FROM (SELECT doc_id, text, 1 + doc_id % 5 AS pages FROM documents)")
def x45(s, d):
    n, per = F.length("text"), F.length("text") / F.col("pages")
    docs = fx.table(s, d, "documents").withColumn("pages", 1 + F.col("doc_id") % 5)
    return docs.select("doc_id", F.when(n < 20, 0.0).when(per < 100, 0.6).when(per < 500, 0.8).otherwise(0.95).alias("confidence"), (n < 20).alias("needs_ocr"))


PRODUCTS = {"e-Governance": "egov", "Digital Learning": "digital_learning", "Pharma": "pharma", "eHealth": "ehealth", "Banking": "bfsi", "Finance": "bfsi"}


@query("X46_vertical_product", sql("SELECT feed_ord, supp, CASE vertical WHEN 'Banking' THEN 'bfsi' ELSE 'pharma' END AS product FROM hl", more={"hl": HEADLINES_SQL}))
def x46(s, d):
    return headlines(s, d).select("feed_ord", "supp", v.lookup(F.col("vertical"), PRODUCTS).alias("product"))


@query("X47_identity_key", sql(f"SELECT obs_id, lower(coalesce({DOMAIN_SQL}, nullif(trim(cin), ''), raw_name)) AS identity FROM co", "co"))
def x47(s, d):
    return fx.companies(s, d).select("obs_id", F.lower(F.coalesce(tx.domain(F.col("website")), F.nullif(F.trim("cin"), F.lit("")), F.col("raw_name"))).alias("identity"))


AUTHORITY_SQL = "CASE WHEN url IS NULL OR url = '' THEN 1.0 " + " ".join(f"WHEN contains(host, '{k}') THEN {w}" for k, w in v.AUTHORITIES) + " WHEN ends_with(host, '.gov.in') OR ends_with(host, '.nic.in') THEN 0.96 ELSE 0.65 END"
URLS = ("https://www.pib.gov.in/x", "http://eproc.nic.in/a", "https://m.economictimes.com:8080/b", "https://blog.example.com/", None)


@query("J18_source_authority", f"SELECT page_id, {AUTHORITY_SQL} AS weight FROM (SELECT *, lower(coalesce(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), ''), url)) AS host FROM (SELECT page_id, CASE page_id % 6 WHEN 0 THEN '{URLS[0]}' WHEN 1 THEN '{URLS[1]}' WHEN 2 THEN '{URLS[2]}' WHEN 3 THEN '{URLS[3]}' WHEN 4 THEN NULL ELSE url END AS url FROM pages))")
def j18(s, d):
    k = F.col("page_id") % 6
    url = F.when(k < 5, F.element_at(F.array(*map(F.lit, URLS)), F.least(k + 1, F.lit(5)).cast("int"))).otherwise(F.col("url"))
    return fx.table(s, d, "pages").select("page_id", v.authority(url).alias("weight"))


def news_signals(articles):
    """(company_id, seq, title, snippet) -> one claim row per signal; every article is an announcement."""
    hay = F.lower(F.concat("title", F.lit(" "), "snippet"))
    claim = lambda field, conf: F.struct(F.lit(field).alias("field"), F.lit(conf).alias("confidence"))
    found = [F.when(F.greatest(*(hay.contains(k) for k in words)), claim(field, 0.65)) for field, words in v.NEWS_FAMILIES.items()]
    return articles.withColumn("x", F.explode(F.filter(F.array(claim("recent_announcements", 0.6), *found), lambda c: c.isNotNull()))).select("company_id", "seq", "x.field", "x.confidence", F.col("title").alias("value"), F.substring("snippet", 1, 300).alias("evidence"))


_NEWS = "SELECT company_id, event_id AS seq, awardee || ' ' || project AS title, event_type || ' ' || reference AS snippet FROM ev"
_NEWS_SQL = " UNION ALL ".join([f"SELECT company_id, seq, 'recent_announcements' AS field, 0.6 AS confidence, title AS value, substr(snippet, 1, 300) AS evidence FROM nw"] + [f"SELECT company_id, seq, '{f}', 0.65, title, substr(snippet, 1, 300) FROM nw WHERE " + " OR ".join(f"contains(lower(title || ' ' || snippet), '{w}')" for w in words) for f, words in v.NEWS_FAMILIES.items()])


@query("X25_news_signals", sql(_NEWS_SQL, "ev", more={"nw": _NEWS}))
def x25(s, d):
    e = fx.events(s, d)
    return news_signals(e.select("company_id", F.col("event_id").alias("seq"), F.concat("awardee", F.lit(" "), "project").alias("title"), F.concat("event_type", F.lit(" "), "reference").alias("snippet")))
