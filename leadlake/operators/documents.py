"""Documents: landing without repeats, validation, duplicates, grounding of evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlake.functions import text as tx
from leadlake.functions.values import document_class, lookup

MOST_BYTES = 50 * 1024 * 1024


def land(target: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows of a batch (source, hash, …) whose content is new to its source, each content once (the least url)."""
    one = batch.groupBy("source", "hash").agg(F.min("url").alias("url"))
    return one.join(target.select("source", "hash").distinct(), ["source", "hash"], "left_anti")


def new_sources(known: DataFrame, documents: DataFrame) -> DataFrame:
    """Sources that are not known yet: slug, base URL of their first document, type (other unless given)."""
    seen = documents.groupBy(tx.source_slug(F.col("source")).alias("slug")).agg(F.min_by("url", "seq").alias("url"))
    return seen.join(known.select("slug"), "slug", "left_anti").select("slug", tx.base_url(F.col("url")).alias("base_url"), F.lit("other").alias("source_type"))


def validated(files: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """files (content, declared_mime, name, …) with doc_class, mime, reason (null if valid) and warnings."""
    size = F.coalesce(F.octet_length("content"), F.lit(0))
    f = files.withColumn("_s", document_class(F.col("content"), F.col("declared_mime"), F.col("name")))
    declared = F.trim(F.substring_index("declared_mime", ";", 1))
    reason = F.when(size == 0, "empty_file").when(size > most, "too_large").when(F.col("_s.doc_class") == "unknown", "unrecognized_format")
    warning = F.when(declared != F.col("_s.mime"), F.concat(F.lit("declared "), declared, F.lit(", detected "), F.col("_s.mime")))
    return f.select(*files.columns, F.col("_s.doc_class").alias("doc_class"), F.col("_s.mime").alias("mime"), reason.alias("reason"), F.filter(F.array(warning), lambda x: x.isNotNull()).alias("warnings"))


def html_text(html) -> F.Column:
    """Visible text of HTML: no script, style or noscript; non-blank lines."""
    body = F.regexp_replace(html, r"(?is)<(script|style|noscript)\b.*?</\1\s*>", " ")
    text = tx.unescaped(F.regexp_replace(F.regexp_replace(body, "(?s)<!--.*?-->", " "), "<[^>]+>", "\n"))
    return F.array_join(F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != ""), "\n")


def processed(files: DataFrame) -> DataFrame:
    """Every file with hash, validation, original of its content, text length and status; none is dropped. Contents do
    not leave their task: only ids and hashes are joined. Empty files are nobody's copy."""
    raw = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    text = F.when(F.col("doc_class") == "html", html_text(raw)).when(F.col("doc_class").isin("text", "json"), raw)
    v = validated(files).select("doc_id", F.sha2("content", 256).alias("sha256"), "doc_class", "mime", "reason", F.length(text).alias("chars"))
    hashes = v.filter(~F.coalesce(F.col("reason") == "empty_file", F.lit(False))).select("doc_id", "sha256")
    first = hashes.groupBy("sha256").agg(F.min("doc_id").alias("original"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    j = v.join(first, "sha256", "left").withColumn("original", F.when(F.col("reason") == "empty_file", F.col("doc_id")).otherwise(F.coalesce("original", "doc_id")))
    status = F.when(F.col("reason").isNotNull(), "failed").when(F.col("original") != F.col("doc_id"), "duplicate").when(F.col("chars").isNull(), F.when(F.col("doc_class") == "pdf", "needs_ocr").otherwise("unsupported")).otherwise("succeeded")
    return j.select("doc_id", "sha256", "doc_class", "mime", "reason", "original", "chars", status.alias("status"))


#: Status of a job and of a document after a processing outcome.
JOB_STATUS = {"succeeded": "succeeded", "duplicate": "succeeded", "failed": "failed", "unsupported": "failed", "needs_ocr": "retrying"}
PARSE_STATUS = {"succeeded": "parsed", "duplicate": "parsed", "failed": "failed", "unsupported": "failed", "needs_ocr": "skipped"}


def attempts(outcomes: DataFrame, earlier: DataFrame) -> DataFrame:
    """One log row per processed document: job status, attempts (one more than the largest number in earlier rows
    (doc_id, attempts)), error and what was found."""
    before = earlier.groupBy("doc_id").agg(F.max("attempts").alias("_n"))
    j = outcomes.join(before, "doc_id", "left")
    result = F.struct("sha256", "doc_class", "mime", F.when(F.col("original") != F.col("doc_id"), F.col("original")).alias("duplicate_of"), "chars")
    error = F.coalesce("reason", F.when(F.col("status") == "unsupported", "no_extractor"))
    return j.select("doc_id", lookup(F.col("status"), JOB_STATUS).alias("status"), (F.coalesce("_n", F.lit(0)) + 1).cast("int").alias("attempts"), error.alias("error"), result.alias("result"))


def outcome_columns(documents: DataFrame, outcomes: DataFrame, found_title: Column) -> DataFrame:
    """documents (doc_id, title, mime) with what an outcome sets: parse status, the detected type, and a title only where
    there is none. found_title: a column of documents."""
    o = outcomes.select("doc_id", "status", F.col("mime").alias("_mime"))
    j = documents.withColumn("_found", found_title).join(o, "doc_id", "left")
    return j.select("doc_id", F.coalesce(lookup(F.col("status"), PARSE_STATUS), F.lit("pending")).alias("parse_status"), F.coalesce("_mime", "mime").alias("mime"), F.coalesce(tx.empty_to_null(F.col("title")), tx.empty_to_null(F.col("_found"))).alias("title"))


def organisation(html: Column) -> Column:
    """struct<description, location> of a page: from its first JSON-LD organisation (alone or in a list; blocks that are
    no JSON are passed over), else the description from its meta tag."""
    item = "struct<`@type`: string, description: string, address: struct<addressLocality: string, addressRegion: string, addressCountry: string>>"
    blocks = F.regexp_extract_all(html, F.lit(r'(?is)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script\s*>'), F.lit(1))
    items = F.flatten(F.transform(blocks, lambda b: F.coalesce(F.from_json(b, f"array<{item}>"), F.array().cast(f"array<{item}>"))))
    org = F.get(F.filter(items, lambda x: F.coalesce(x["@type"].contains("Organization"), F.lit(False))), F.lit(0))
    place = F.concat_ws(" ", *(tx.empty_to_null(org["address"][k]) for k in ("addressLocality", "addressRegion", "addressCountry")))
    meta = tx.unescaped(F.trim(F.regexp_extract(html, r'(?is)<meta[^>]*name="description"[^>]*content="([^"]*)"', 1)))
    return F.struct(F.coalesce(tx.empty_to_null(org["description"]), tx.empty_to_null(meta)).alias("description"), tx.empty_to_null(place).alias("location"))


def grounded(snippets: DataFrame, documents: DataFrame) -> DataFrame:
    """snippets (doc_id, snippet, …) with found: whether the document holds it, in normal form."""
    docs = documents.select("doc_id", tx.grounded_form(F.col("text")).alias("_t"))
    form = tx.grounded_form(F.col("snippet"))
    j = snippets.join(docs, "doc_id", "left")
    return j.select(*snippets.columns, F.coalesce((form != "") & F.col("_t").contains(form), F.lit(False)).alias("found"))
