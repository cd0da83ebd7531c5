"""Opportunity rules: a theta join of events with product rules, corroborated by company signals.

Rules are a table of one row per product rule and need (see RULES). It is configuration: read from JSON or built from
the default, and broadcast only when it is counted to be small. Texts, sectors and types are compared in the join
condition, with the event type as an equi-join key so that Spark never has to form all pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadlake.config import load

RULE_SCHEMA = (
    "product_id string, name string, category string, triggers array<string>, keywords array<string>, min_value double, sectors array<string>,"
    "need_key string, need string, tier int, timing string, signals array<string>, w_value double, w_sector double, w_signal double,"
    "assumptions array<string>, alternatives array<string>, departments array<string>, job_titles array<string>"
)
MOST_RULES = 10_000
TIER_BASE = {3: 0.85, 2: 0.5, 1: 0.3}  # fact, inference, speculation
TIER_NAME = {3: "fact", 2: "inference", 1: "speculation"}

#: The product rules that ship with the lead schema, from config/rules.json, with the fields of RULE_SCHEMA in order.
RULES = [tuple(rule.values()) for rule in load("rules")]


def default_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, RULE_SCHEMA)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules from JSON lines with the fields of RULE_SCHEMA."""
    return spark.read.schema(RULE_SCHEMA).json(path)


def small(df: DataFrame, most: int = MOST_RULES) -> DataFrame:
    """Broadcast a configuration table after counting it."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def rule_for(products: DataFrame, rules: DataFrame) -> DataFrame:
    """Products (product_id, product_name, category) with their rule: by product id, else by category; has_rule tells
    whether there is one."""
    by_id = rules.select(F.col("product_id").alias("rule_id"), "need_key")
    by_category = rules.groupBy(F.col("category").alias("rule_category")).agg(F.min("product_id").alias("category_rule"))
    ids = by_id.select("rule_id").distinct()
    found = products.join(small(ids), products.product_id == F.col("rule_id"), "left").join(small(by_category), products.category == F.col("rule_category"), "left")
    return found.select(*products.columns, F.coalesce("rule_id", "category_rule").alias("rule_id")).withColumn("has_rule", F.col("rule_id").isNotNull())


def _text() -> F.Column:
    return F.lower(F.concat_ws(" ", "event_type", "awardee", "sector", "project"))


def related(a: F.Column, names: F.Column) -> F.Column:
    """Whether a name holds one of the names or is held by one, in lower case."""
    low = F.lower(a)
    return F.coalesce(F.exists(names, lambda x: low.contains(F.lower(x)) | F.lower(x).contains(low)), F.lit(False))


def matches(events: DataFrame, rules: DataFrame, min_value: float | None = None) -> DataFrame:
    """Events × rules that apply: the type is a trigger, a keyword or the sector fits, and the value is high enough."""
    # what needs one side only is computed there, once: in the condition it would be for every pair and every keyword
    keyed = rules.withColumns({"trigger": F.explode("triggers"), "_sectors": F.transform("sectors", F.lower)})
    own = events.withColumns({"_text": _text(), "_low": F.lower("sector")})
    threshold = F.greatest(F.coalesce("min_value", F.lit(0.0)), F.lit(float(min_value or 0)))
    joined = own.join(small(keyed), own.event_type == F.col("trigger")).drop("trigger")
    near = F.exists("_sectors", lambda x: F.col("_low").contains(x) | x.contains(F.col("_low")))
    joined = joined.withColumns({"threshold": threshold, "sector_ok": (F.size("sectors") == 0) | F.coalesce(near, F.lit(False))})
    keyword = F.exists("keywords", lambda k: F.col("_text").contains(k))
    worth = (F.col("threshold") == 0) | (F.coalesce("value", F.lit(0)) >= F.col("threshold"))
    return joined.filter(worth & (F.col("sector_ok") | keyword)).drop("_text", "_low", "_sectors")  # the keywords are searched last


def detect(events: DataFrame, rules: DataFrame, signals: DataFrame | None = None, min_value: float | None = None) -> DataFrame:
    """Opportunities with their confidence: tier base + value + sector + corroborating signals, at most 0.95.

    events: event_id, company_id, event_type, sector, value, awardee, project. signals: company_id, signal, confidence.
    A corroborated speculation becomes an inference."""
    if signals is not None:  # events, not their opportunities, meet the signals: they are fewer
        each = signals.filter("signal is not null").groupBy("company_id", "signal").agg(F.max("confidence").alias("confidence"))
        known = each.groupBy("company_id").agg(F.map_from_entries(F.collect_list(F.struct("signal", "confidence"))).alias("_known"))
        events = events.join(known, "company_id", "left")
    m = matches(events, rules, min_value)
    magnitude = F.least(F.lit(1.0), F.col("value") / (F.col("threshold") * 5))
    add_value = F.when((F.coalesce("value", F.lit(0)) != 0) & (F.col("threshold") != 0), F.round(F.col("w_value") * magnitude, 3)).otherwise(0.0)
    add_sector = F.when(F.col("sector_ok") & (F.size("sectors") > 0), F.round("w_sector", 3)).otherwise(0.0)
    base = F.when(F.col("tier") == 3, 0.85).when(F.col("tier") == 2, 0.5).otherwise(0.3)
    m = m.withColumns({"base": base, "add_value": add_value, "add_sector": add_sector})
    if signals is None:
        m = m.withColumns({"add_signals": F.lit(0.0), "corroborated_by": F.array().cast("array<string>")})
    else:
        have = F.filter("signals", lambda x: F.map_contains_key(F.col("_known"), x))
        m = m.withColumn("corroborated_by", F.coalesce(have, F.array().cast("array<string>")))
        each = F.aggregate("corroborated_by", F.lit(0.0), lambda a, x: a + F.round(F.col("w_signal") * F.coalesce(F.element_at(F.col("_known"), x), F.lit(0.6)), 3))
        m = m.withColumn("add_signals", each).drop("_known")
    tier = F.when((F.size("corroborated_by") > 0) & (F.col("tier") == 1), 2).otherwise(F.col("tier"))
    total = (F.col("base") + F.col("add_value") + F.col("add_sector") + F.col("add_signals")).cast("decimal(10,3)")
    return m.withColumn("tier", tier).withColumn("confidence", F.least(F.lit(0.95), total.cast("double")))


def explained(opportunities: DataFrame, value_text: F.Column) -> DataFrame:
    """Adds trigger and reasoning, the texts that explain an opportunity."""
    kind = F.replace("event_type", F.lit("_"), F.lit(" "))
    worth = F.when(F.coalesce("value", F.lit(0)) != 0, F.concat(F.lit(" worth "), value_text)).otherwise("")
    place = F.when(F.coalesce("sector", F.lit("")) != "", F.concat(F.lit(" in "), "sector")).otherwise("")
    tier = F.when(F.col("tier") == 3, "fact").when(F.col("tier") == 2, "inference").otherwise("speculation")
    support = F.when(F.size("corroborated_by") > 0, F.concat(F.lit("Supported by signals: "), F.array_join("corroborated_by", ", "))).otherwise(F.concat(F.lit("No company signal supports it yet; this is a "), tier))
    return opportunities.withColumns({"trigger": F.concat(kind, worth, place, F.lit(" — "), "awardee"), "reasoning": F.concat(F.col("awardee"), F.lit(": "), kind, worth, place, F.lit(". Rule "), "name", F.lit(" suggests: "), F.lower("need"), F.lit(". "), support)})
