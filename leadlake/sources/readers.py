"""Landed files as tables. All readers are Spark sources with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def feed_entries(spark: SparkSession, path: str, feed_url: str = "", tag: str = "item") -> DataFrame:
    """Entries of RSS (tag item) or Atom (tag entry) files: title, link, summary, published, id. A missing link becomes
    the feed's URL, a missing id the link."""
    schema = "title string, link string, description string, summary string, pubDate string, published string, guid string, id string"
    e = spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    link = F.coalesce("link", F.lit(feed_url))
    return e.select("title", link.alias("link"), F.coalesce("description", "summary").alias("summary"), F.coalesce("pubDate", "published").alias("published"), F.coalesce("guid", "id", link).alias("entry_id"))


def json_records(spark: SparkSession, path: str, record: str, records_path: str = "records", offset: str = "offset", keys: tuple[str, ...] = ("id", "_id", "uid", "reference", "ref")) -> DataFrame:
    """Records of paged API dumps, one JSON document per file: row (offset + index), ref (the first key that the record
    has, else the row) and the record. `record` is the record's DDL schema."""
    pages = spark.read.option("multiLine", True).schema(f"{offset} bigint, {records_path} array<struct<{record}>>").json(path)
    rows = pages.select(F.col(offset).alias("_o"), F.posexplode(records_path).alias("_p", "record"))
    row = (F.coalesce("_o", F.lit(0)) + F.col("_p")).alias("row")
    have = [f.split(":")[0].split()[0] for f in record.split(",")]
    return rows.select(row, F.coalesce(*(F.col(f"record.{k}").cast("string") for k in keys if k in [h.strip() for h in have]), (F.coalesce("_o", F.lit(0)) + F.col("_p")).cast("string")).alias("ref"), "record")


def csv_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def file_bytes(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Whole files as bytes with where they come from."""
    f = spark.read.format("binaryFile").load(path)
    return f.select(F.col("path").alias("url"), F.lit(source).alias("source"), F.col("modificationTime").alias("fetched_at"), F.col("length").alias("bytes"), "content")


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as one text each, with where they come from; bytes that are no UTF-8 become U+FFFD."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("url"), F.make_valid_utf8("value").alias("text"))


def json_documents(documents: DataFrame, column: str) -> DataFrame:
    """Adds canonical (keys sorted, no blanks; null if invalid) and status; invalid documents stay as failed rows."""
    j = F.try_parse_json(F.col(column))
    return documents.withColumn("canonical", F.to_json(j)).withColumn("status", F.when(F.col("canonical").isNull(), "failed").otherwise("succeeded"))


def candidates_by_sector(spark: SparkSession, path: str) -> DataFrame:
    """Rows of {"bySector": {vertical: [{title, source, date}]}} files."""
    c = spark.read.option("multiLine", True).schema("bySector map<string, array<struct<title: string, source: string, date: string>>>").json(path)
    return c.select(F.explode("bySector").alias("vertical", "_l")).select("vertical", F.posexplode("_l").alias("ord", "x")).select("vertical", "ord", "x.*")
