"""Feedback analytics and scoring evaluation over append-only logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlake.functions.values import FEEDBACK_CLASS, FEEDBACK_STATUS, lookup

BUCKETS = ((0, 20), (20, 40), (40, 60), (60, 80), (80, 101))


def outcomes(log: DataFrame) -> DataFrame:
    """One row per lead of a log (lead_id, seq, event_type): label, converted, negative, events, data_errors and the
    first converting event. Converted beats negative, which beats engaged."""
    kind = lookup(F.col("event_type"), FEEDBACK_CLASS)
    is_ = lambda k: F.col("_k") == k
    g = log.withColumn("_k", kind).groupBy("lead_id").agg(
        F.max(is_("converted")).alias("converted"), F.max(is_("negative") | is_("data_error")).alias("_bad"), F.max(is_("engaged")).alias("_engaged"), F.count("*").alias("events"),
        F.count_if(is_("data_error")).alias("data_errors"), F.min(F.when(is_("converted"), F.struct("seq", "event_type"))).alias("_via"),
    )
    label = F.when(F.col("converted"), "converted").when(F.col("_bad"), "negative").when(F.col("_engaged"), "engaged").otherwise("view")
    return g.select("lead_id", label.alias("label"), "converted", (~F.col("converted") & F.col("_bad")).alias("negative"), "events", "data_errors", F.col("_via.event_type").alias("converted_via"))


def _rates() -> list[Column]:
    """leads, converted, negative, decided and the conversion rate (0 if none decided) of a group."""
    converted, negative = F.count_if("converted"), F.count_if("negative")
    decided = converted + negative
    return [F.count("converted").alias("leads"), converted.alias("converted"), negative.alias("negative"), decided.alias("decided"), F.when(decided > 0, F.round(converted / decided, 3)).otherwise(0.0).alias("conversion_rate")]


def with_outcome(meta: DataFrame, log: DataFrame) -> DataFrame:
    """Lead meta with outcomes; leads without feedback keep nulls, feedback without meta goes."""
    return meta.join(outcomes(log), "lead_id", "left")


def bucket_of(score: Column, buckets=BUCKETS) -> Column:
    out = F.lit(None).cast("string")
    for low, high in buckets:
        out = F.when((score >= low) & (score < high), f"{low}-{high - 1}").otherwise(out)
    return out


def by_bucket(joined: DataFrame, buckets=BUCKETS) -> DataFrame:
    """Conversion by score bucket; empty buckets stay."""
    spark = joined.sparkSession
    every = spark.createDataFrame([(f"{a}-{b - 1}",) for a, b in buckets], "bucket string")
    found = joined.withColumn("bucket", bucket_of(F.col("score"), buckets)).filter("bucket is not null").groupBy("bucket").agg(*_rates())
    return every.join(found, "bucket", "left").fillna(0)


def by_dimension(joined: DataFrame, *dimensions: str) -> DataFrame:
    """Conversion by each of several dimensions in one pass (grouping sets by exploding the dimension)."""
    pair = F.explode(F.array(*(F.struct(F.lit(c).alias("dimension"), F.coalesce(F.col(c), F.lit("unknown")).alias("key")) for c in dimensions)))
    return joined.select(pair.alias("x"), "converted", "negative").select("x.*", "converted", "negative").groupBy("dimension", "key").agg(*_rates())


def precision(joined: DataFrame, threshold: int = 80) -> DataFrame:
    """Converted among decided high-scoring leads; null if none is decided."""
    g = joined.filter(F.col("score") >= threshold).agg(F.count("converted").alias("high_leads"), F.count_if("converted").alias("converted"), F.count_if("negative").alias("_n"))
    decided = F.col("converted") + F.col("_n")
    return g.select("high_leads", decided.alias("decided"), "converted", F.round(F.try_divide(F.col("converted"), decided), 3).alias("precision"))


def false_positives(joined: DataFrame, *dimensions: str, threshold: int = 80) -> DataFrame:
    """High-scoring leads that ended negative, counted by dimension."""
    pair = F.explode(F.array(*(F.struct(F.lit(c).alias("dimension"), F.coalesce(F.col(c), F.lit("unknown")).alias("key")) for c in dimensions)))
    return joined.filter((F.col("score") >= threshold) & F.col("negative")).select(pair.alias("x")).groupBy("x.dimension", "x.key").agg(F.count("*").alias("n"))


def false_negatives(joined: DataFrame, threshold: int = 45) -> DataFrame:
    """Low-scoring leads that converted, lowest first."""
    return joined.filter((F.col("score") < threshold) & F.col("converted")).orderBy("score", "lead_id")


def lead_status(log: DataFrame) -> DataFrame:
    """Status after the last event that changes it, per lead."""
    moved = log.withColumn("status", lookup(F.col("event_type"), FEEDBACK_STATUS)).filter("status is not null")
    return moved.groupBy("lead_id").agg(F.max_by("status", F.struct("occurred_at", "seq")).alias("status"))


def evaluate(examples: DataFrame, threshold: int = 80) -> DataFrame:
    """Confusion matrix and metrics by version of decided examples (version, score, converted, decided)."""
    high, won = F.col("score") >= threshold, F.col("converted")
    g = examples.filter("decided").groupBy("version").agg(F.count_if(high & won).alias("tp"), F.count_if(high & ~won).alias("fp"), F.count_if(~high & won).alias("fn"), F.count_if(~high & ~won).alias("tn"))
    p, r = F.round(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), 3), F.round(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), 3)
    g = g.withColumns({"precision": p, "recall": r})
    f1 = F.when((F.col("precision") > 0) & (F.col("recall") > 0), F.round(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")), 3))
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return g.withColumns({"f1": f1, "accuracy": F.round(F.try_divide(F.col("tp") + F.col("tn"), n), 3)})


def compare(metrics: DataFrame, baseline: str, candidate: str) -> DataFrame:
    """Differences of the metrics of two versions; null only if both are."""
    a, b = metrics.filter(F.col("version") == baseline).alias("a"), metrics.filter(F.col("version") == candidate).alias("b")
    j = a.withColumn("_k", F.lit(1)).alias("a").join(b.withColumn("_k", F.lit(1)).alias("b"), "_k")
    delta = lambda m: F.when(F.col(f"a.{m}").isNotNull() | F.col(f"b.{m}").isNotNull(), F.round(F.coalesce(f"b.{m}", F.lit(0)) - F.coalesce(f"a.{m}", F.lit(0)), 3)).alias(f"delta_{m}")
    return j.select(*map(delta, ("precision", "recall", "f1", "accuracy")))


def audit(stored: DataFrame, again: DataFrame, key: str = "lead_id") -> DataFrame:
    """Stored totals that re-scoring under the stored version does not give, and versions that are unknown."""
    j = stored.join(again.select(key, "version", F.col("total").alias("_again")), [key, "version"], "left")
    return j.filter(F.col("_again").isNull() | (F.col("_again") != F.col("total"))).select(key, "version", "total", F.when(F.col("_again").isNull(), "missing_config").otherwise("mismatch").alias("problem"))
