"""Leads from news headlines by rules: precision over recall."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlake.functions import text as tx
from leadlake.functions.values import amount_inr, feed_date, lookup
from leadlake.operators.history import first_by
from leadlake.operators.scoring import config, score

# fixed values: patterns and words of the headline rules
AMOUNT = r"(?i)(?:₹|Rs\.?)\s?[\d,]+(?:\.\d+)?\s*(?:crore|cr|billion)\b"
VERB = r"(?i)\b(?:wins?|secures?|bags?|gets?|awarded|receives?|clinches?|signs?)\b"
BUYER = r"\bfrom\s+([A-Z][\w&.\- ]+?)(?:\s+(?:for|to|under|worth|in)\b|[,.\-]|$)"
GOVERNMENT = (
    "government", "govt", "ministry", "psu", "public sector", "state bank", "central bank", "bank of india", "bank of baroda", "canara",
    "union bank", "punjab", "railway", "railtel", "nhai", "cbdt", "gst", "abdm", "samagra", "mahajyoti", "corporation", "municipal",
    "authority", "board", "council", "pli", "incentive", "department", "nagar", "welfare", "arunachal", "odisha", "tamil nadu",
    "uttar pradesh", "andhra", "karnataka", "goa",
)
NOISE = (
    "stocks to watch", "stock to watch", "market size", "market share", " ipo", "earnings", "opinion", "cagr", "drhp", "52-week", "drdo",
    "defence", "malawi", "nigeria", "bahrain", "uk-india", "pre-announcement", "backgrounder",
)
BAD_FIRST = (
    "we", "it", "they", "he", "she", "i", "you", "this", "that", "these", "those", "the", "a", "an", "its", "our", "their", "his", "her", "why",
    "how", "what", "when", "where", "who", "which", "after", "as", "amid", "with", "from", "in", "on", "at", "by", "now", "here", "breaking",
    "exclusive", "watch", "explained", "live", "update", "updates", "big", "top", "just", "meet", "india", "indian", "govt", "government", "stocks",
    "stock", "shares", "share", "sensex", "nifty", "market", "markets",
)
BAD_START = ("ministry", "government", "govt", "department", "state of", "national", "office of", "directorate")
QUOTES = "'\"“”‘’"


_AT_MOST = r"\s*(?:\S+\s+){0,%d}\S*\s*\z"  # so many words and one more


def plausible_company(name: Column) -> Column:
    """Shape of a company name: 3 to 80 characters, up to eight words, one capitalised, no clause or public body."""
    first = F.lower(F.btrim(F.regexp_extract(name, r"^\s*(\S*)", 1), F.lit(QUOTES)))
    words = r"(?s)^(?!(?i:" + "|".join(BAD_START) + r"))(?=(?:.*\s)?\p{Lu})" + _AT_MOST % 7  # one pattern: each sought costs a copy of the text
    shape = F.length(name).between(3, 80) & name.rlike(words) & ~first.isin(*BAD_FIRST)
    return F.coalesce(shape, F.lit(False))


def _any(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(w) for w in words))


def _once(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with more columns, each computed once for a row: what generates a row is not copied into the filters and
    projections that read it, as a plain column would be."""
    return rows.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def extract(headlines: DataFrame) -> DataFrame:
    """headlines (title, vertical, …) that say that a company won an amount from a public body, with company, buyer,
    amount and value. Cheap tests come first, and each pattern is sought once in a title. Patterns are those of functions
    that compile them once: split would do so for every row."""
    h = headlines.filter(F.col("title").contains("₹") | F.col("title").rlike("[Rr][Ss]"))  # every amount has one of them
    colon = F.instr("title", ": ")
    rest = F.substring("title", colon + 2, F.length("title"))
    label = (colon > 0) & F.substring_index("title", ": ", 1).rlike("^" + _AT_MOST % 3) & rest.rlike(AMOUNT) & rest.rlike(VERB)
    h = _once(h, _w=F.when(label, rest).otherwise(F.col("title")))
    h = _once(h, _l=F.lower("_w"), _m=F.regexp_extract("_w", AMOUNT, 0)).filter(F.col("_m") != "")
    h = h.filter(~_any(F.col("_l"), NOISE) & _any(F.col("_l"), GOVERNMENT))
    name = F.btrim(F.regexp_extract("_w", "(?s)^(.*?)" + VERB, 1), F.lit(" -–—:"))  # empty without a verb
    h = _once(h, _c=F.btrim(F.regexp_replace(name, r"(?s)\s[-–—]\s.*", ""), F.lit(QUOTES + " "))).filter(plausible_company(F.col("_c")))
    buyer = F.coalesce(tx.empty_to_null(F.trim(F.regexp_extract("title", BUYER, 1))), F.lit("Government (India)"))
    out = h.withColumns({"company": F.col("_c"), "government_buyer": buyer, "amount": F.col("_m"), "value": amount_inr(F.col("_m"))})
    return out.drop("_w", "_l", "_m", "_c")


def deduplicated(headlines: DataFrame, per_vertical: int | None = None) -> DataFrame:
    """The first headline of each title key across verticals; then the first ones of each vertical in feed order."""
    from pyspark.sql import Window as W

    keyed = _once(headlines, _k=tx.title_key(tx.without_tags(F.col("title")))).filter("_k <> ''")
    one = first_by(keyed, ["_k"], F.col("feed_ord"), F.col("supp")).drop("_k")
    if per_vertical is None:
        return one
    return one.withColumn("_r", F.row_number().over(W.partitionBy("vertical").orderBy("feed_ord", "supp"))).filter(F.col("_r") <= per_vertical).drop("_r")


def news_leads(extracted: DataFrame, known: DataFrame) -> DataFrame:
    """Lead rows of extracted headlines, one per company and vertical, without those known (company, vertical): an
    undated event (the news date is only when it was reported), grant for incentives, award otherwise."""
    one = first_by(extracted, ["company", "vertical"], F.col("feed_ord"), F.col("supp"))
    new = one.join(known, ["company", "vertical"], "left_anti")
    key = F.sha1(F.concat_ws("|", F.lit("org"), F.lower("company"), "vertical").cast("binary"))
    kind = F.when(F.col("title").rlike(r"(?i)\bpli\b|incentive"), "grant").otherwise("award")
    return new.select(F.concat(F.lit("news-"), F.substring(key, 1, 24)).alias("lead_id"), "company", "vertical", "government_buyer", "title", "amount", "value", kind.alias("event_type"), feed_date(F.col("date")).alias("reported_on"))


def attach(numbered: DataFrame, outside: DataFrame) -> DataFrame:
    """Rows that an outside extractor made for headlines, attached by index. numbered: (idx, title, vertical); outside:
    (ord, idx, company, government_buyer, amount). Rows without a headline or with an implausible company go; of a
    company, in any case of its letters, the first row stays."""
    name = F.trim("company")
    j = outside.join(numbered, "idx").withColumn("company", name).filter(plausible_company(F.col("company")))
    one = first_by(j.withColumn("_k", F.lower("company")), ["_k"], F.col("ord"), F.col("title")).drop("_k")
    buyer = F.coalesce(tx.empty_to_null(F.trim("government_buyer")), F.lit("Government (India)"))
    return one.select("ord", "idx", "company", "vertical", buyer.alias("government_buyer"), tx.empty_to_null(F.trim("amount")).alias("amount"), "title", F.lit(0.65).alias("confidence"))


#: Authority of a news report, and what a news lead is worth before anything else is known.
NEWS_AUTHORITY, NEWS_CONFIDENCE = 0.65, 0.5


def lead_rows(leads: DataFrame, as_of: Column, products: dict[str, str], targets: list[str]) -> DataFrame:
    """Event, opportunity, score, brief and evidence row of each news lead, as (lead_id, table_name, kind, title, party,
    amount, score, grade, confidence, text). The event is undated: a report's date is not the award's. products maps a
    vertical to its product; other verticals make no lead."""
    known = leads.filter(F.col("vertical").isin(*products))
    inputs = known.withColumns({
        "event_value": F.col("value"), "event_date": F.lit(None).cast("date"), "event_sector": F.col("vertical"), "company_industry": F.col("vertical"), "employee_range": F.lit(None).cast("string"),
        "target_sectors": F.array(*map(F.lit, targets)), "ideal_ranges": F.array().cast("array<string>"), "opportunity_confidence": F.lit(NEWS_CONFIDENCE),
        "evidence_confidences": F.array(F.lit(NEWS_CONFIDENCE * NEWS_AUTHORITY)), "num_contacts": F.lit(0), "best_seniority": F.lit(None).cast("string"),
    })
    x = score(inputs, config(), as_of)
    product = lookup(F.col("vertical"), products)
    won = F.concat(F.lit("won "), F.coalesce(tx.empty_to_null(F.col("amount")), F.lit("an award")), F.lit(" from "), "government_buyer")
    text = F.concat(
        F.lit("## Trigger\n"), "company", F.lit(" is reported to have "), won, F.lit(".\n\n## Reason to call\nOffer "), product, F.lit(" while the award is news.\n\n## Source\nNews"),
        F.coalesce(F.concat(F.lit(" of "), F.col("reported_on").cast("string")), F.lit("")), F.lit("; no award date is known. Check against the award itself.\n\n## Confidence\nLead score "),
        F.col("total").cast("string"), F.lit("/100 (grade "), "grade", F.lit(")."),
    )
    none = lambda t: F.lit(None).cast(t)

    def row(table: str, kind=None, title=None, party=None, amount=None, total=None, letter=None, confidence=None, body=None) -> Column:
        col = lambda c, t: (none(t) if c is None else c if isinstance(c, Column) else F.lit(c)).cast(t)
        return F.struct(
            F.lit(table).alias("table_name"), col(kind, "string").alias("kind"), col(title, "string").alias("title"), col(party, "string").alias("party"), col(amount, "double").alias("amount"),
            col(total, "int").alias("score"), col(letter, "string").alias("grade"), col(confidence, "double").alias("confidence"), col(body, "string").alias("text"),
        )

    c = F.col
    rows = F.array(
        row("event", c("event_type"), F.substring("title", 1, 300), c("government_buyer"), c("value"), confidence=NEWS_CONFIDENCE),
        row("opportunity", "sponsorship", product, c("company"), confidence=NEWS_CONFIDENCE), row("score", c("version"), total=c("total"), letter=c("grade")),
        row("brief", "draft", body=text), row("evidence", "external", c("title"), confidence=NEWS_AUTHORITY),
    )
    return x.select("lead_id", F.explode(rows).alias("x")).select("lead_id", "x.*")
