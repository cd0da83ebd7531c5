"""Queries of sources, sinks and streams. Files they read are first written from the test tables into the session's
shared folder."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from leadlake.functions import text as tx
from leadlake.functions import values as v
from leadlake.operators import enrichment as en
from leadlake.operators import opportunities as op
from leadlake.operators import scoring as sc
from leadlake.plans import fixtures as fx
from leadlake.plans.fixtures import sql
from leadlake.plans.leads import BOARD, MORE, SCORED, _pts, as_of, board_leads, score_inputs
from leadlake.plans.registry import query
from leadlake.plans.scalars import case
from leadlake.session import shared_path, ship, stored
from leadlake.sources import readers as rd
from leadlake.sources import writers as wr
from leadlake.streaming import jobs


@query("S01_feed_entries", "SELECT p_name || ' ' || p_partkey AS title, CASE WHEN p_partkey % 2 = 0 THEN 'https://x.example/' || p_partkey ELSE 'https://feed.example' END AS link, 'Type ' || p_type AS summary, CASE WHEN p_partkey % 3 = 0 THEN 'g' || p_partkey WHEN p_partkey % 2 = 0 THEN 'https://x.example/' || p_partkey ELSE 'https://feed.example' END AS entry_id FROM part")
def s01(s, d):
    path, k = shared_path(s, "feed"), F.col("p_partkey")
    one = F.concat(
        F.lit("<item><title>"), "p_name", F.lit(" "), k, F.lit("</title>"), F.when(k % 2 == 0, F.concat(F.lit("<link>https://x.example/"), k, F.lit("</link>"))).otherwise(""),
        F.lit("<description>Type "), "p_type", F.lit("</description>"), F.when(k % 3 == 0, F.concat(F.lit("<guid>g"), k, F.lit("</guid>"))).otherwise(""), F.lit("</item>"),
    )
    pages = fx.table(s, d, "part").select(F.floor(k / 100).alias("page"), one.alias("item")).groupBy("page").agg(F.array_join(F.collect_list("item"), "").alias("items"))
    wr.whole_files(pages.select(F.concat(F.lit("<rss><channel>"), "items", F.lit("</channel></rss>")).alias("value")), path)
    return rd.feed_entries(s, path, "https://feed.example").select("title", "link", "summary", "entry_id")


@query("S02_json_records", "SELECT p_partkey AS row, CASE WHEN p_partkey % 2 = 0 THEN 'r' || p_partkey ELSE p_partkey::VARCHAR END AS ref, p_name AS name FROM part")
def s02(s, d):
    path, k = shared_path(s, "records"), F.col("p_partkey")
    pages = fx.table(s, d, "part").groupBy(F.floor(k / 100).alias("page")).agg(F.array_sort(F.collect_list(F.struct(k.alias("k"), F.when(k % 2 == 0, F.concat(F.lit("r"), k)).alias("ref"), F.col("p_name").alias("name")))).alias("records"))
    one = pages.select((F.col("page") * 100).alias("offset"), F.transform("records", lambda r: F.struct(r["ref"].alias("ref"), r["name"].alias("name"))).alias("records"))
    one.select(F.to_json(F.struct("offset", "records")).alias("value")).repartition(4).write.option("lineSep", "\n").text(path)
    pages = s.read.schema("offset bigint, records array<struct<ref: string, name: string>>").json(path)
    again = shared_path(s, "pages")
    wr.whole_files(pages.select(F.to_json(F.struct("offset", "records")).alias("value")), again)
    return rd.json_records(s, again, "ref: string, name: string").select("row", "ref", "record.name")


@query("S03_csv_rows", "SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def s03(s, d):
    path = shared_path(s, "csv")
    fx.table(s, d, "supplier").select("s_suppkey", "s_name", "s_nationkey").write.option("header", True).csv(path)
    return rd.csv_rows(s, path, "s_suppkey long, s_name string, s_nationkey int")


@query("S04_file_bytes", "SELECT source, count(*) AS docs, sum(strlen(url))::BIGINT AS bytes FROM (SELECT 'src' || (page_id % 4) AS source, regexp_replace(url, '\\s', '', 'g') AS url FROM pages) GROUP BY source")
def s04(s, d):
    """Whole files with provenance: text files in a folder per source, as many as tasks wrote, counted by their lines."""
    path = shared_path(s, "files")
    p = fx.table(s, d, "pages").select(F.concat(F.lit("src"), (F.col("page_id") % 4).cast("string")).alias("source"), F.regexp_replace("url", r"\s", "").alias("value"))
    p.write.partitionBy("source").option("maxRecordsPerFile", 1000).text(path)
    files = rd.file_bytes(s, f"{path}/*/*.txt", "landed")
    lines = (F.size(F.split(F.col("content").cast("string"), "\n")) - 1).cast("long")
    return files.groupBy(F.regexp_extract("url", "source=([^/]+)/", 1).alias("source")).agg(F.sum(lines).alias("docs"), F.sum(F.col("bytes") - lines).alias("bytes"))


@query("S05_json_documents", "SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN replace(props, ': ', ':') END AS canonical, CASE WHEN event_id % 10 = 0 THEN 'failed' ELSE 'succeeded' END AS status FROM events")
def s05(s, d):
    e = fx.table(s, d, "events").select("event_id", F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("{"), "props")).otherwise(F.col("props")).alias("body"))
    return rd.json_documents(e, "body").select("event_id", "canonical", "status")


@query("S09_exported_leads", sql("SELECT lead_id, organization_id, {'company': company, 'sector': sector, 'score': score, 'grade': grade} AS summary FROM bl", "ev", more=BOARD))
def s09(s, d):
    path = shared_path(s, "export")
    wr.export_leads(board_leads(s, d).select("organization_id", "lead_id", F.struct("company", "sector", "score", "grade").alias("summary")), path)
    return s.read.schema("lead_id string, summary struct<company: string, sector: string, score: int, grade: string>, organization_id string").json(path)


@query("S10_candidate_files", "SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'Banking' ELSE 'Pharma' END AS vertical, s_name AS title FROM supplier")
def s10(s, d):
    path = shared_path(s, "candidates")
    t = fx.table(s, d, "supplier").select((F.col("s_suppkey") % 50).alias("file"), F.when(F.col("s_suppkey") % 2 == 0, "Banking").otherwise("Pharma").alias("v"), F.struct(F.col("s_name").alias("title"), F.lit("Daily").alias("source"), F.lit("").alias("date")).alias("x"))
    m = t.groupBy("file", "v").agg(F.collect_list("x").alias("l")).groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("v", "l"))).alias("bySector"))
    m.select("bySector").write.option("maxRecordsPerFile", 1).json(path)
    return rd.candidates_by_sector(s, path).select("vertical", "title")


@query("S12_seeded_reference", "WITH p AS (SELECT lower(p_brand || '-' || p_type) AS slug, p_size FROM part) SELECT DISTINCT slug FROM p WHERE slug NOT IN (SELECT slug FROM p WHERE p_size > 49)")
def s12(s, d):
    """Brands by type: those of the largest parts are known, the others are seeded once each, however often it runs."""
    p = fx.table(s, d, "part").select(F.lower(F.concat_ws("-", "p_brand", "p_type")).alias("slug"), "p_size")
    known = p.filter("p_size > 49").select("slug").distinct()
    once = wr.seed(known, p.select("slug"), ["slug"])
    return once.unionByName(wr.seed(known.unionByName(once), p.select("slug"), ["slug"]))


def _fifty(doc_id):
    return F.floor(doc_id / 50).alias("part")


def _lang():
    return F.regexp_extract("url", "lang=([^/]+)/", 1).alias("lang")


@query("S14_text_files", "SELECT lang, part, md5(string_agg(text || CASE WHEN doc_id % 7 = 0 THEN chr(65533) || '(' ELSE '' END || chr(10), '' ORDER BY doc_id)) AS text_md5 FROM (SELECT lang, doc_id // 50 AS part, doc_id, text FROM documents WHERE lang IS NOT NULL AND text IS NOT NULL) GROUP BY lang, part")
def s14(s, d):
    """Whole text files, one for each language and fifty documents, with the number of the fifty as their first line; every
    seventh document ends in bytes that are no UTF-8."""
    path = shared_path(s, "texts")
    bad = F.unhex(F.lit("C328")).cast("string")
    docs = fx.table(s, d, "documents").filter("lang is not null and text is not null")
    text = F.concat("text", F.when(F.col("doc_id") % 7 == 0, bad).otherwise(""))
    each = docs.groupBy("lang", _fifty(F.col("doc_id"))).agg(F.array_sort(F.collect_list(F.struct("doc_id", text.alias("text")))).alias("x"))  # fifty documents
    wr.whole_files(each.select("lang", F.concat_ws("\n", F.col("part").cast("string"), F.col("x.text")).alias("value")), path, "lang")
    t = rd.text_files(s, path).withColumn("_n", F.instr("text", "\n"))
    part = F.substring("text", F.lit(1), F.col("_n") - 1).cast("long")
    return t.select(_lang(), part.alias("part"), F.md5(F.substring("text", F.col("_n") + 1, F.length("text"))).alias("text_md5"))


_XML = "replace(replace(text, '&', '&amp;'), '<', '&lt;')"


@query("S14_xml_files", f"SELECT lang, part, md5('<?xml version=\"1.0\"?>' || chr(10) || '<documents>' || chr(10) || string_agg('<document id=\"' || doc_id || '\">' || {_XML} || '</document>' || chr(10), '' ORDER BY doc_id) || '</documents>' || chr(10)) AS text_md5 FROM (SELECT lang, doc_id // 50 AS part, doc_id, text FROM documents WHERE lang IS NOT NULL AND text IS NOT NULL) GROUP BY lang, part")
def s14_xml(s, d):
    """Whole XML files as one text each, tags and all: one for each language and fifty documents, which their ids tell."""
    path = shared_path(s, "xml")
    docs = fx.table(s, d, "documents").filter("lang is not null and text is not null")
    text = F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    line = F.concat(F.lit('<document id="'), "doc_id", F.lit('">'), text, F.lit("</document>"))
    each = docs.groupBy("lang", _fifty(F.col("doc_id"))).agg(F.array_sort(F.collect_list(F.struct("doc_id", line.alias("line")))).alias("x"))  # fifty documents
    value = F.concat_ws("\n", F.lit('<?xml version="1.0"?>'), F.lit("<documents>"), F.col("x.line"), F.lit("</documents>"))
    wr.whole_files(each.select("lang", value.alias("value")), path, "lang")
    part = _fifty(F.regexp_extract("text", '<document id="([^"]+)">', 1).cast("long"))
    return rd.text_files(s, path).select(_lang(), part, F.md5("text").alias("text_md5"))


# --- streams ---


def _stream(s, d, name, columns):
    return s.readStream.schema(s.read.parquet(f"{d}/{name}.parquet").schema).parquet(f"{d}/{name}.parquet*").select(*columns)


@query("T1_streamed_landing", "SELECT source, sha256(text) AS hash FROM documents WHERE text IS NOT NULL GROUP BY 1, 2")
def t1(s, d):
    out, state = shared_path(s, "landed"), shared_path(s, "state")
    docs = _stream(s, d, "documents", ["source", F.sha2("text", 256).alias("hash"), F.concat(F.lit("https://x.example/"), "doc_id").alias("url")]).filter("hash is not null")
    jobs.land_documents(docs, out, state).awaitTermination()
    return s.read.parquet(out).select("source", "hash")


@query("T2_streamed_matching", sql("SELECT seq, min(seq) OVER (PARTITION BY i) AS canonical FROM (SELECT report_id AS seq, nullif(upper(regexp_replace(reference, '[^A-Za-z0-9]+', '', 'g')), '') AS i FROM rp) WHERE i IS NOT NULL", "rp"))
def t2(s, d):
    """Reports land in three folders, in order of their ids; each folder is one batch, of as many files as tasks wrote."""
    src, out, state = shared_path(s, "reports"), shared_path(s, "canonical"), shared_path(s, "state")
    r = fx.reports(s, d).select(F.col("report_id").alias("seq"), tx.identifier(F.col("reference")).alias("identifier")).filter("identifier is not null")
    r = stored(r)
    cuts = r.agg(F.percentile_approx("seq", F.array(F.lit(0.33), F.lit(0.66)))).first()[0]
    for k, part in enumerate((r.filter(F.col("seq") <= cuts[0]), r.filter((F.col("seq") > cuts[0]) & (F.col("seq") <= cuts[1])), r.filter(F.col("seq") > cuts[1]))):
        part.write.parquet(f"{src}/part{k}")
        stream = s.readStream.schema(r.schema).parquet(f"{src}/part*")
        jobs.match_by_identifier(stream, out, state).awaitTermination()
    return s.read.parquet(out).select("seq", "canonical")


@query("T4_change_stream", sql("SELECT lead_id, CASE WHEN score % 2 = 0 THEN 'changed' ELSE 'removed' END AS change FROM bl WHERE score % 2 = 0 OR (score % 5 = 0)", "ev", more=BOARD))
def t4_stream(s, d):
    """The board's rows as written on one day, then those written and deleted on the next: what the second day changed."""
    src, out, state = shared_path(s, "operations"), shared_path(s, "changes"), shared_path(s, "state")
    day = lambda n: F.to_timestamp(F.lit(f"2001-09-0{n}"))
    old = stored(board_leads(s, d)).withColumns({"at": day(1), "gone": F.lit(False)})
    goes = (F.col("score") % 2 != 0) & (F.col("score") % 5 == 0)
    new = old.withColumns({"gone": goes, "score": F.when(F.col("score") % 2 == 0, F.col("score") + 1).otherwise(F.col("score")), "at": day(2)})
    for k, part in enumerate((old, new)):
        part.write.parquet(f"{src}/part{k}")
        feed = jobs.change_feed(s.readStream.schema(old.schema).parquet(f"{src}/part*"), "lead_id", "at", "gone")
        jobs.write_changes(feed, out, state).awaitTermination()
    return s.read.parquet(out).filter(F.col("at") == day(2)).select("lead_id", "change")


@query("T3_streamed_feedback", sql(f"SELECT lead_id, arg_max(status, {{'t': occurred_at, 's': seq}}) AS status FROM (SELECT *, {case('event_type', v.FEEDBACK_STATUS)} AS status FROM fb) WHERE status IS NOT NULL GROUP BY lead_id", "fb"))
def t3(s, d):
    out, state = shared_path(s, "log"), shared_path(s, "state")
    e = _stream(s, d, "events", [F.col("event_id").alias("seq"), F.col("user_id").alias("lead_id"), fx.pick("event_type", fx._FEEDBACK).alias("event_type"), F.col("ts").alias("occurred_at")])
    jobs.feedback_log(e, out, state).awaitTermination()
    log = s.read.schema("seq bigint, lead_id bigint, event_type string, occurred_at timestamp, status string").parquet(out)
    return log.filter("status is not null").groupBy("lead_id").agg(F.max_by("status", F.struct("occurred_at", "seq")).alias("status"))


@query("T5_running_outcomes", sql(f"SELECT lead_id, count(*) AS events, count(*) FILTER (WHERE k = 'converted') AS conversions, count(*) FILTER (WHERE k = 'negative') AS negatives FROM (SELECT *, {case('event_type', v.FEEDBACK_CLASS)} AS k FROM fb) GROUP BY lead_id", "fb"))
def t5(s, d):
    out, state = shared_path(s, "outcomes"), shared_path(s, "state")
    e = _stream(s, d, "events", [F.col("user_id").alias("lead_id"), fx.pick("event_type", fx._FEEDBACK).alias("event_type")])
    jobs.snapshots(jobs.running_outcomes(e), out, state).awaitTermination()
    every = s.read.schema("lead_id bigint, events bigint, conversions bigint, negatives bigint, batch bigint").parquet(out)
    last = every.agg(F.max("batch")).first()[0]
    return every.filter(F.col("batch") == last).drop("batch")


# --- extension points ---


def extract_texts(files, extractors):
    """Text of files by document class: `extractors` maps a class to a column function of the bytes; a class without one
    gives an `unsupported` row."""
    kind = v.document_class(F.col("content"), F.lit(None).cast("string"), F.lit(None).cast("string"))["doc_class"]
    text = F.lit(None).cast("string")
    for k, f in extractors.items():
        text = F.when(F.col("doc_class") == k, f(F.col("content"))).otherwise(text)
    f = files.withColumn("doc_class", kind).withColumn("text", text)
    return f.withColumn("method", F.when(F.col("doc_class").isin(*extractors), F.col("doc_class")).otherwise("unsupported"))


_LOW = "substr(regexp_replace(substr(text, 1, 2048), '^\\s+', ''), 1, 512)"


@query("V2_text_extractors", f"SELECT page_id, 'html' AS doc_class, 'html' AS method, md5(html) AS text_md5 FROM pages UNION ALL SELECT doc_id + 1000000000, c, CASE WHEN c IN ('html', 'text') THEN c ELSE 'unsupported' END, CASE c WHEN 'html' THEN md5(text) WHEN 'text' THEN md5('text:' || text) END FROM (SELECT doc_id, text, CASE WHEN coalesce(text, '') = '' THEN 'unknown' WHEN starts_with(text, '%PDF') THEN 'pdf' WHEN regexp_matches({_LOW}, '^[{{\\[]') THEN 'json' WHEN contains(lower({_LOW}), '<html') THEN 'html' ELSE 'text' END AS c FROM (SELECT doc_id, CASE WHEN doc_id % 20 = 1 THEN '%PDF-1.4 ' || text ELSE text END AS text FROM documents))")
def v2(s, d):
    """Pages and whole documents, every twentieth as a PDF for which there is no extractor."""
    k = F.col("doc_id")
    docs = fx.table(s, d, "documents").select((k + 1000000000).alias("page_id"), F.when(k % 20 == 1, F.concat(F.lit("%PDF-1.4 "), "text")).otherwise(F.col("text")).cast("binary").alias("content"))
    files = fx.table(s, d, "pages").select("page_id", F.col("html").cast("binary").alias("content")).unionByName(docs)
    return extract_texts(files, {"html": lambda c: c.cast("string"), "text": lambda c: F.concat(F.lit("text:"), c.cast("string"))}).select("page_id", "doc_class", "method", F.md5("text").alias("text_md5"))


_OWN = {"sx": "SELECT *, " + f"{_pts('f5', 5)} AS q5, CASE WHEN value >= 500000000 THEN 5 ELSE 0 END AS q8 FROM st"}


@query("V3_custom_scorer", sql("SELECT event_id, product_id, p1 + p2 + p3 + p4 + q5 + p6 + p7 + q8 AS total, q8 AS own_points FROM sx", "ev", more=SCORED | _OWN))
def v3(s, d):
    """A supplied component beside the known ones: five points for large awards, taken from company fit."""
    rows = [*((v_, k, label, 5 if k == "company_fit" else most, p) for v_, k, label, most, p in sc.config("with-size")), ("with-size", "large_award", "Large award", 5, {"least": 5e8})]
    sc.check(rows)
    out = sc.score(score_inputs(s, d), rows, as_of(), {"large_award": lambda p, day: F.when(F.col("value") >= p["least"], 1.0).otherwise(0.0)})
    return out.select("event_id", "product_id", "total", F.filter("components", lambda c: c["key"] == "large_award")[0]["points"].alias("own_points"))


@query("V4_rules_from_json", sql("SELECT event_id, product_id, need_key, threshold FROM mt", "ev", more=MORE))
def v4(s, d):
    """Rules written as JSON lines and read back as a rule table."""
    path = shared_path(s, "rules")
    op.default_rules(s).write.json(path)
    return op.matches(fx.events(s, d), op.read_rules(s, path)).select("event_id", "product_id", "need_key", "threshold")


@query("V5_scoring_from_json", sql("SELECT event_id, product_id, 'recent-first' AS version, " + " + ".join(_pts(f"f{i}", m) for i, m in enumerate((15, 20, 20, 25, 10, 5, 5), 1)) + " AS total FROM pa", "ev", more=SCORED))
def v5(s, d):
    """A scoring configuration written as JSON lines and read back, with its own version."""
    path = shared_path(s, "scoring")
    s.createDataFrame(sc.config("recent-first", sector_relevance=15, recency=25), sc.CONFIG_SCHEMA).write.json(path)
    return sc.score(score_inputs(s, d), sc.read_config(s, path), as_of()).select("event_id", "product_id", "version", "total")


@query("V6_isolated_sources", sql("SELECT source, count(*) AS claims, false AS failed FROM (SELECT 'website' AS source FROM co WHERE website IS NOT NULL UNION ALL SELECT 'registry' FROM co JOIN supplier ON obs_id = s_suppkey) GROUP BY source UNION ALL SELECT unnest(['unplanned', 'unreachable']), 0, true", "co"))
def v6(s, d):
    """Four sources, of which one cannot be planned and one fails while it runs; the claims of the others stay."""
    def website(refs):
        return refs.filter("website is not null").select("obs_id", F.lit("website").alias("field"), F.col("website").alias("value"))

    def registry(refs):
        r = fx.table(s, d, "supplier").select(F.col("s_suppkey").alias("obs_id"), F.col("s_name").alias("value"))
        return refs.join(r, "obs_id").select("obs_id", F.lit("legal_name").alias("field"), "value")

    def unplanned(refs):
        return refs.select("obs_id", "no_such_column")

    def unreachable(refs):
        return refs.select("obs_id", F.lit("x").alias("field"), F.raise_error(F.lit("timed out")).cast("string").alias("value"))

    found, errors = en.collect(fx.companies(s, d), {"website": website, "unplanned": unplanned, "unreachable": unreachable, "registry": registry}, ("obs_id", "field", "value"))
    failed = s.createDataFrame([(k, 0, True) for k in errors], "source string, claims bigint, failed boolean")
    return found.groupBy("source").agg(F.count("*").alias("claims")).withColumn("failed", F.lit(False)).unionByName(failed)


@query("V1_custom_embedder", "SELECT doc_id, [" + ", ".join(f"(length(t) - length(replace(t, '{c}', ''))) / greatest(1, length(t))" for c in "aeiou") + "]::FLOAT[] AS embedding FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)")
def v1(s, d):
    """A supplied embedder as a pandas UDF over Arrow batches: here relative letter counts."""
    ship(s)

    @F.pandas_udf("array<float>")
    def letters(texts: pd.Series) -> pd.Series:
        return texts.fillna("").map(lambda t: [t.count(c) / max(1, len(t)) for c in "aeiou"])

    return fx.table(s, d, "documents").select("doc_id", letters("text").alias("embedding"))


@query("V8_events_of_documents", "SELECT doc_id, count(*) AS lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line) <> '' GROUP BY doc_id")
def v8(s, d):
    """One document to many rows."""
    rows = fx.table(s, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return rows.filter(F.trim("line") != "").groupBy("doc_id").agg(F.count("*").alias("lines"))
