"""Money, dates, vocabularies and file types as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadlake.config import load

# fixed values of the lead schema, from config/vocabulary.json; the families are words that mark a headline as one kind of
# company signal
_WORDS = load("vocabulary")
EVENT_TYPES, EVENT_LABELS, TYPE_WEIGHTS = _WORDS["event_types"], _WORDS["event_labels"], _WORDS["type_weights"]
FEEDBACK_CLASS, FEEDBACK_OUTCOME, FEEDBACK_STATUS = _WORDS["feedback_class"], _WORDS["feedback_outcome"], _WORDS["feedback_status"]
SENIORITY_RANK, NEWS_FAMILIES = _WORDS["seniority_rank"], _WORDS["news_families"]
TIER_PROVIDER = {4: "web", 3: "registry", 2: "third_party", 1: "third_party", 0: "other"}
AUTHORITIES = (
    ("eprocure.gov.in", 1.00), ("gem.gov.in", 1.00), ("defprocurement", 1.00), ("api.data.gov.in", 0.95), ("data.gov.in", 0.95), ("pib.gov.in", 0.98),
    ("bseindia.com", 0.97), ("nseindia.com", 0.97), ("rbi.org.in", 0.98), ("sebi.gov.in", 0.98), ("economictimes", 0.85), ("business-standard", 0.85),
    ("livemint", 0.85), ("moneycontrol", 0.85), ("thehindubusinessline", 0.85), ("financialexpress", 0.85), ("reuters.com", 0.85),
)


def lookup(c: Column, values: dict, other=None) -> Column:
    """Constant lookup with a default."""
    m = F.create_map(*(F.lit(x) for kv in values.items() for x in kv))
    return F.coalesce(F.try_element_at(m, c), F.lit(other)) if other is not None else F.try_element_at(m, c)


def value_close(a: Column, b: Column, tolerance: float = 0.02) -> Column:
    """Within a share of the larger one; zero is close to zero only; null if either is null."""
    larger = F.greatest(F.abs(a), F.abs(b))
    return F.abs(a - b) <= larger * tolerance


def date_close(a: Column, b: Column, days: int = 3) -> Column:
    return F.abs(F.datediff(a, b)) <= days


def value_text(value: Column, currency: Column) -> Column:
    """Rupee amounts in crore from ten million on; empty for null and zero."""
    cur = F.upper(F.coalesce(currency, F.lit("INR")))
    plain = F.format_number(value.cast("decimal(20,0)"), 0)
    crore = F.concat(F.lit("₹"), F.format_string("%.1f", F.round(value.cast("decimal(20,2)") / 10000000, 1).cast("double")), F.lit(" cr"))
    return F.when(F.coalesce(value, F.lit(0)) == 0, "").when((cur == "INR") & (value >= 10000000), crore).when(cur == "INR", F.concat(F.lit("₹"), plain)).otherwise(F.concat(plain, F.lit(" "), cur))


def amount_inr(text: Column) -> Column:
    """First amount in rupees of a text, in rupees."""
    pattern = r"(?i)(?:₹|Rs\.?)\s?([\d,]+(?:\.\d+)?)\s*(crore|cr|billion)\b"
    number = F.regexp_replace(F.regexp_extract(text, pattern, 1), ",", "")
    unit = F.when(F.lower(F.regexp_extract(text, pattern, 2)) == "billion", 1e9).otherwise(1e7)
    return F.when(number != "", F.expr("0D") + number.try_cast("double") * unit)


def feed_date(text: Column) -> Column:
    """Date of an RFC 822 time such as `Fri, 07 Aug 2026 10:00:00 GMT`; null if it is none."""
    return F.when(F.trim(text).rlike(r"^[A-Z][a-z]{2}, \d{2} [A-Z][a-z]{2} \d{4}"), F.try_to_date(F.substring(F.trim(text), 6, 11), "dd MMM yyyy"))


def currency_code(c: Column) -> Column:
    v = F.upper(F.trim(c))
    return F.when(F.coalesce(c, F.lit("")) == "", None).when(v.contains("INR") | v.contains("RUPEE") | v.isin("RS", "RS.", "₹"), "INR").when(v.contains("USD") | (v == "$"), "USD").otherwise(F.substring(v, 1, 3))


def authority(url: Column) -> Column:
    """Weight of a source by its host: first entry that its host contains, government suffixes, other hosts, no URL."""
    host = F.lower(F.coalesce(F.nullif(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")), url))
    out = F.when(F.coalesce(url, F.lit("")) == "", 1.0)
    for needle, weight in AUTHORITIES:
        out = out.when(host.contains(needle), weight)
    return out.when(host.endswith(".gov.in") | host.endswith(".nic.in"), 0.96).otherwise(0.65)


def dedup_key(kind: Column, awardee: Column, value: Column, award_date: Column, buyer: Column, project: Column) -> Column:
    """SHA-1 over the six identifying parts of an event."""
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    amount = F.coalesce(F.format_string("%.2f", value.cast("double")), F.lit(""))
    amount = F.when(value.isNull(), "").otherwise(amount)
    return F.sha1(F.concat_ws("|", kind, low(awardee), amount, F.coalesce(award_date.cast("string"), F.lit("")), low(buyer), low(project)).cast("binary"))


def grade(total: Column) -> Column:
    return F.when(total >= 80, "A").when(total >= 65, "B").when(total >= 45, "C").when(total >= 25, "D").otherwise("F")


def once(value: Column, use) -> Column:
    """use(value), where a lambda that repeats the value evaluates it only once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def hashed_counts(text: Column, dim: int = 128) -> Column:
    """Token counts by bucket, the last byte of the token's MD5: a map of the buckets (at most 256) that occur."""
    tokens = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda t: t != "")
    bucket = F.array_sort(F.transform(tokens, lambda t: (F.conv(F.substring(F.md5(t.cast("binary")), 31, 2), 16, 10).cast("int") % dim)))
    first = lambda b: F.filter(F.transform(b, lambda x, i: F.when((i == 0) | (F.get(b, i - 1) != x), i)), lambda i: i.isNotNull())
    count = lambda b, s: F.transform(s, lambda p, k: F.struct(F.get(b, p), (F.coalesce(F.get(s, k + 1), F.size(b)) - p).cast("double")))
    return once(bucket, lambda b: F.map_from_entries(once(first(b), lambda s: count(b, s))))


def hashed_embedding(text: Column, dim: int = 128) -> Column:
    """Token counts in `dim` (at most 256) buckets by the last byte of the token's MD5, for token order see tokens."""
    return once(hashed_counts(text, dim), lambda m: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda k: F.coalesce(F.try_element_at(m, k), F.lit(0.0))))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, 0.0).otherwise(dot(a, b) / norms)


def document_class(content: Column, mime: Column, name: Column) -> Column:
    """struct<doc_class, mime, note> of bytes: signatures first, then what looks like text, with hints."""
    head = F.hex(F.substring(content, 1, 4))
    text = F.decode(F.substring(content, 1, 2048), "ISO-8859-1")
    low = F.lower(F.substring(F.regexp_replace(text, r"^\s+", ""), 1, 512))
    ext = F.when(name.contains("."), F.lower(F.substring_index(name, ".", -1))).otherwise("")
    declared = F.coalesce(mime, F.lit(""))
    control = F.length(text) - F.length(F.regexp_replace(text, r"[\x00-\x08\x0e-\x1f]", ""))
    textual = F.is_valid_utf8(content.cast("string")) & (control <= F.greatest(F.lit(1), F.floor(F.length(text) / 100)))
    made = lambda k, m, note=None: F.struct(F.lit(k).alias("doc_class"), (m if isinstance(m, Column) else F.lit(m)).cast("string").alias("mime"), F.lit(note).cast("string").alias("note"))
    return (
        F.when(F.coalesce(F.octet_length(content), F.lit(0)) == 0, made("unknown", None, "empty"))
        .when(head == "25504446", made("pdf", "application/pdf"))
        .when(head == "504B0304", made("zip", "application/zip", "zip"))
        .when((head == "D0CF11E0") & ((ext == "xls") | declared.endswith("ms-excel")), made("xls", "application/vnd.ms-excel", "legacy_ole"))
        .when(head == "D0CF11E0", made("doc", "application/msword", "legacy_ole"))
        .when(low.rlike(r"^[{\[]"), made("json", "application/json"))
        .when(low.startswith("<!doctype html") | F.substring(low, 1, 256).contains("<html"), made("html", "text/html"))
        .when(textual & ((ext == "json") | (declared == "application/json")), made("json", "application/json"))
        .when(textual & (ext.isin("html", "htm") | declared.startswith("text/html")), made("html", "text/html"))
        .when(textual, made("text", "text/plain"))
        .otherwise(made("unknown", mime, "unrecognized"))
    )


# fixed values: kinds by MIME type and by file extension
MIME_KIND = {
    "text/html": "html", "application/xhtml+xml": "html", "application/pdf": "pdf", "application/json": "json", "application/rss+xml": "rss", "application/atom+xml": "rss",
    "text/xml": "xml", "application/xml": "xml", "text/csv": "csv", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "xlsx", "application/vnd.ms-excel": "xlsx", "text/plain": "text",
}
EXTENSION_KIND = {"html": "html", "htm": "html", "pdf": "pdf", "json": "json", "rss": "rss", "atom": "rss", "xml": "xml", "csv": "csv", "xlsx": "xlsx", "xls": "xlsx", "txt": "text"}


def document_kind(hint: Column, mime: Column, url: Column, content: Column) -> Column:
    """Kind by hint, then MIME type, then extension, then first bytes."""
    path = F.substring_index(F.lower(url), "?", 1)
    ext = F.regexp_extract(path, r"\.([a-z]+)$", 1)
    head = F.regexp_replace(F.decode(F.substring(content, 1, 16), "ISO-8859-1"), r"^\s+", "")
    start = F.decode(F.substring(content, 1, 256), "ISO-8859-1")
    sniffed = (
        F.when(head.startswith("%PDF"), "pdf").when(F.hex(F.substring(content, 1, 4)) == "504B0304", "xlsx").when(head.rlike(r"^[{\[]"), "json")
        .when(head.rlike(r"^<(\?xml|rss|feed)"), F.when(start.rlike("<rss|<feed"), "rss").otherwise("xml")).when(head.startswith("<"), "html").otherwise("text")
    )
    return F.coalesce(F.nullif(hint, F.lit("")), lookup(F.lower(mime), MIME_KIND), lookup(ext, EXTENSION_KIND), sniffed)
