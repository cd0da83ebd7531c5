"""Sinks: exports and idempotent reference data."""

from __future__ import annotations

from pyspark.sql import DataFrame


def export_leads(details: DataFrame, path: str) -> None:
    """Nested lead documents as JSON, one folder per organisation."""
    details.write.mode("overwrite").partitionBy("organization_id").json(path)


def whole_files(texts: DataFrame, path: str, *folders: str) -> None:
    """One text file for each row's `value`, in one folder for each value of `folders`, which should be few: a folder for
    each file is made, moved and listed by itself. On local disks files go without checksum files, as setting the rights
    of a file takes a process there."""
    local = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
    texts.select("value", *folders).write.options(maxRecordsPerFile=1, **local).partitionBy(*folders).text(path)


def seed(existing: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Reference rows that are not there yet, by natural key; seeding twice adds nothing."""
    return wanted.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")


def links(products: DataFrame, sectors: DataFrame, wanted: DataFrame) -> DataFrame:
    """Product-sector links of (product, sector) names as ids."""
    return wanted.join(products, "product").join(sectors, "sector").select("product_id", "sector_id").distinct()


def bucket_by(df: DataFrame, name: str, n: int, *keys: str) -> None:
    """A table bucketed and sorted by keys, so that later joins on them need no shuffle."""
    df.write.mode("overwrite").bucketBy(n, *keys).sortBy(*keys).saveAsTable(name)


