"""Contacts: one row per person, compliance, rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlake.functions import text as tx
from leadlake.functions.values import SENIORITY_RANK, lookup

BASIS = "legitimate interest in business outreach"


def merge(candidates: DataFrame) -> DataFrame:
    """One row per company and person: the first non-null of each field in source order, the largest confidence; two
    independent sources verify and add 0.1 (at most 0.95)."""
    c = candidates.withColumn("person", tx.person_name(F.col("name"))).withColumn("seniority", tx.seniority(F.col("title")))
    first = lambda f: F.min(F.when(F.col(f).isNotNull(), F.struct("seq", f)))[f].alias(f)
    rank = F.min(F.when(F.col("seniority") != "unknown", F.struct("seq", "seniority")))["seniority"]
    g = c.groupBy("company_id", "person").agg(
        F.min("seq").alias("seq"), first("title"), first("email"), first("phone"), F.coalesce(rank, F.lit("unknown")).alias("seniority"),
        F.max("confidence").alias("confidence"), F.max("verified").alias("verified"), F.count_distinct("source_name").alias("corroborations"),
    )
    two = F.col("corroborations") >= 2
    return g.withColumns({"verified": F.col("verified") | two, "confidence": F.when(two, F.least(F.lit(0.95), F.col("confidence") + 0.1)).otherwise(F.col("confidence"))})


def comply(contacts: DataFrame, emails: DataFrame | None = None, persons: DataFrame | None = None, allow_free_mail: bool = False) -> DataFrame:
    """Without those on the do-not-contact lists (email, person); free-mail addresses are suppressed."""
    out = contacts.withColumn("_e", F.lower("email"))
    if emails is not None:
        out = out.join(emails.select(F.lower("email").alias("_e")), "_e", "left_anti")
    if persons is not None:
        out = out.join(persons.select(tx.person_name(F.col("name")).alias("person")), "person", "left_anti")
    hide = F.lit(not allow_free_mail) & tx.is_free_mail(F.col("email"))
    basis = F.when(hide, F.lit(BASIS + "; personal address suppressed")).otherwise(BASIS)
    return out.drop("_e").withColumns({
        "lawful_basis": basis, "verified": F.col("verified") & ~hide, "confidence": F.when(hide, F.least("confidence", F.lit(0.5))).otherwise(F.col("confidence")),
        "email": F.when(~hide, F.col("email")),
    })


def rank(titles: list[str]) -> Column:
    """Seniority, a target title (5), an address (2), verification (2), further sources (1 each) and the confidence."""
    title = F.lower(F.coalesce("title", F.lit("")))
    hit = F.lit(False)
    for t in titles:
        hit = hit | title.contains(t.lower()) | F.lit(t.lower()).contains(title)
    score = lookup(F.col("seniority"), SENIORITY_RANK, 0) + F.when(hit, 5).otherwise(0) + F.when(F.coalesce("email", F.lit("")) != "", 2).otherwise(0) + F.when(F.col("verified"), 2).otherwise(0) + F.col("corroborations") - 1
    return (score + F.col("confidence")).cast("decimal(10,3)").cast("double")
