"""Current rows, supersession and idempotent appends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in an order; the order should be total."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")


def supersede(current: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """History with new rows: per key the row with the highest version is current, all others stay as history."""
    both = current.unionByName(new, allowMissingColumns=True)
    return both.withColumn("is_current", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(version))) == 1)


def upsert(current: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Whole rows by key: the highest version wins, new rows win ties."""
    both = current.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return first_by(both, keys, F.desc(version), F.desc("_new")).drop("_new")


def append_new(target: DataFrame, batch: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Rows of a batch whose key the target lacks, the first of each key in the batch."""
    return first_by(batch, keys, *order).join(target.select(*keys).distinct(), keys, "left_anti")


def numbered(df: DataFrame, keys: list[str], prefix: str, *order: Column) -> DataFrame:
    """Adds label: prefix and the place within the key, from 1."""
    return df.withColumn("label", F.concat(F.lit(prefix), F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("string")))
