"""Text normal forms as column expressions; null in, null out unless stated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: legal-form and generic words that are no part of a company's identity
LEGAL_WORDS = (
    "private", "pvt", "limited", "ltd", "llp", "plc", "inc", "incorporated", "corporation", "corp", "company", "co",
    "and", "the", "llc", "gmbh", "enterprises", "enterprise",
)
# fixed values: free mail providers
FREE_MAIL = ("gmail.com", "yahoo.com", "yahoo.co.in", "hotmail.com", "outlook.com", "rediffmail.com", "icloud.com", "proton.me", "protonmail.com")
# fixed values: patterns of numbers with units and ISO dates, e-mail addresses and phone numbers
NUMBER = r"(?i)\d{4}-\d{2}-\d{2}|₹?\s?\d[\d,]*(?:\.\d+)?\s?(?:cr|crore|lakh|lakhs|million|billion|bn|mn)?"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"(?:\+?\d[\d\-\s]{7,}\d)"


def empty_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def collapsed(c: Column) -> Column:
    """White space runs as one blank, trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def identifier(c: Column) -> Column:
    """Letters and digits in upper case; null if none."""
    return empty_to_null(F.upper(F.regexp_replace(c, "[^A-Za-z0-9]+", "")))


def party_name(c: Column) -> Column:
    """Buyer or awardee: other characters as one blank, lower case; null if empty."""
    return empty_to_null(F.lower(F.trim(F.regexp_replace(c, "[^A-Za-z0-9]+", " "))))


def without_honorific(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(c), r"(?i)^(m\s*/\s*s\.?\s*|messrs[ .]+|ms[ .]+)", ""))


def company_display(c: Column) -> Column:
    return collapsed(without_honorific(c))


def company_full(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(without_honorific(c), "[^A-Za-z0-9]+", " ")))


def company_core(c: Column) -> Column:
    """Identity key: the full form without legal-form words; may be empty."""
    return F.array_join(F.filter(F.split(company_full(c), " "), lambda w: ~w.isin(*LEGAL_WORDS) & (w != "")), " ")


def domain(c: Column) -> Column:
    """Host of a URL or bare domain, without scheme, www and what follows."""
    v = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "^https?://", ""), r"^www\.", "")
    return empty_to_null(F.regexp_replace(v, "[/?].*$", ""))


def person_name(c: Column) -> Column:
    """Punctuation deleted, lower case, single blanks."""
    return collapsed(F.regexp_replace(F.lower(c), r"[^a-z0-9\s]", ""))


def slug(c: Column, joint: str = "_") -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", joint), f"^{joint}+|{joint}+$", "")


def source_slug(c: Column) -> Column:
    """Dash slug of at most 120 characters, `source` if empty."""
    return F.coalesce(empty_to_null(F.substring(slug(c, "-"), 1, 120)), F.lit("source"))


def title_key(c: Column) -> Column:
    return F.substring(F.regexp_replace(F.lower(c), r"(?U)\W+", ""), 1, 60)


def without_tags(c: Column) -> Column:
    text = F.coalesce(c, F.lit(""))
    return F.trim(F.when(F.contains(text, F.lit("<")), F.regexp_replace(text, "<[^>]+>", "")).otherwise(text))


def unescaped(c: Column) -> Column:
    """Text with HTML entities (HTML 4 names, `&apos;`, decimal and hexadecimal numbers) as characters, each once, and
    non-breaking blanks as blanks. The JVM library is one that Spark brings along."""
    text = F.reflect(F.lit("org.apache.commons.text.StringEscapeUtils"), F.lit("unescapeHtml4"), F.replace(c, F.lit("&apos;"), F.lit("&#39;")))
    return F.when(F.contains(c, F.lit("&")), F.replace(text, F.lit("\u00a0"), F.lit(" "))).otherwise(c)


def grounded_form(c: Column) -> Column:
    return F.lower(collapsed(c))


def number_form(c: Column) -> Column:
    """Normal form of one number token: no separators, short units, no trailing .0."""
    t = F.regexp_replace(F.lower(F.trim(c)), "[,₹ ]", "")
    for unit, short in (("crore", "cr"), ("lakhs", "lakh"), ("million", "mn"), ("billion", "bn")):
        t = F.replace(t, F.lit(unit), F.lit(short))
    return F.regexp_replace(t, r"\.0(?=cr|lakh|mn|bn|$)", "")


def number_tokens(c: Column) -> Column:
    """Sorted distinct normal forms of the numbers in a text."""
    found = F.transform(F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(NUMBER), 0)), number_form)
    return F.array_sort(F.array_distinct(F.filter(found, lambda t: t != "")))


def contact_tokens(c: Column) -> Column:
    """Sorted distinct e-mail addresses and phone numbers in a text."""
    text = F.coalesce(c, F.lit(""))
    phones = F.transform(F.regexp_extract_all(text, F.lit(PHONE), 0), lambda p: F.trim(p))
    return F.array_sort(F.array_distinct(F.concat(F.regexp_extract_all(text, F.lit(EMAIL), 0), phones)))


def is_free_mail(c: Column) -> Column:
    at = F.instr(c, "@")
    return F.coalesce((at > 0) & F.lower(F.substring(c, at + 1, F.length(c))).isin(*FREE_MAIL), F.lit(False))


def seniority(c: Column, word_boundary: bool = False) -> Column:
    """Seniority of a job title. By substring, as in the source system, `director` holds `cto` and counts as c_level;
    with word_boundary the words must stand alone."""
    t = F.lower(F.coalesce(c, F.lit("")))
    top = "chief|ceo|cio|ciso|cto|cfo|cmo|chro|founder|president"
    if word_boundary:
        vice = t.rlike(r"\bvice president\b|\bvp\b")
        return F.when(vice, "vp").when(t.rlike(rf"\b({top})\b"), "c_level").when(t.rlike(r"\bdirector\b"), "director").when(t.rlike(r"\bhead\b"), "head").when(t.rlike(r"\b(manager|lead)\b"), "manager").when(t != "", "staff").otherwise("unknown")
    return (
        F.when(t.rlike(top), "c_level").when(t.contains("vice president") | t.rlike(r"\bvp\b"), "vp").when(t.contains("director"), "director")
        .when(t.contains("head"), "head").when(t.rlike("manager|lead"), "manager").when(t != "", "staff").otherwise("unknown")
    )


def base_url(c: Column) -> Column:
    return empty_to_null(F.regexp_extract(c, "^([a-z]+://[^/?#]+)", 1))
