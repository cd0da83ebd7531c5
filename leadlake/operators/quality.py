"""Data quality, due work and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(df: DataFrame, key: str, **rules: Column) -> DataFrame:
    """(key, rule) for every rule that does not hold in a row; one pass."""
    found = F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(True)), F.lit(name)) for name, ok in rules.items())), lambda x: x.isNotNull())
    return df.select(F.col(key).cast("string").alias("row_key"), F.explode(found).alias("rule"))


def repeated_keys(df: DataFrame, *columns: str) -> DataFrame:
    """Keys that are not unique; rows with a null in the key do not count."""
    present = df.filter(" and ".join(f"{c} is not null" for c in columns))
    return present.groupBy(*columns).agg(F.count("*").alias("n")).filter("n > 1")


def retry_queue(jobs: DataFrame, attempts: int = 3, most: int = 100) -> DataFrame:
    """Failed or retrying jobs with attempts left, oldest first; the limit is the feature."""
    return jobs.filter(F.col("status").isin("failed", "retrying") & (F.col("attempts") < attempts)).orderBy("job_id").limit(most)


def due(sources: DataFrame, crawls: DataFrame, as_of: Column) -> DataFrame:
    """Sources never crawled or not for their interval in minutes."""
    last = crawls.groupBy("source").agg(F.max("crawled_at").alias("last_crawl"))
    j = sources.join(last, "source", "left")
    return j.filter(F.col("last_crawl").isNull() | (F.unix_timestamp(as_of) - F.unix_timestamp("last_crawl") >= F.col("minutes") * 60))


def expired(df: DataFrame, column: str, days: int, as_of: Column) -> DataFrame:
    """Rows beyond retention."""
    return df.filter(F.col(column) < F.date_sub(as_of, days))
