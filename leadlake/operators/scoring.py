"""Explainable lead scores: component fractions as columns, points by a versioned configuration.

A configuration is a table (version, key, label, max_points, params map); a version's points must sum to 100. Inputs
hold event_type, value, event_date, event_sector, company_industry, employee_range, target_sectors, ideal_ranges,
opportunity_confidence, evidence_confidences, num_contacts, best_seniority. All versions are scored in one pass.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadlake.functions.values import TYPE_WEIGHTS, grade, lookup
from leadlake.operators.opportunities import related

CONFIG_SCHEMA = "version string, key string, label string, max_points int, params map<string, double>"
# fixed values: the default configuration
DEFAULT = [
    ("sector_relevance", "Sector relevance", 25, {}), ("event_significance", "Event significance", 20, {"value_full": 1e9}), ("product_fit", "Product fit", 20, {"full_at": 0.85}),
    ("recency", "Recency", 15, {"full_days": 30.0, "zero_days": 365.0}), ("company_fit", "Company fit", 10, {}),
    ("contact_availability", "Decision-maker availability", 5, {}), ("evidence_confidence", "Evidence confidence", 5, {}),
]
SENIORITY_WEIGHT = {"c_level": 1.0, "vp": 0.85, "director": 0.8, "head": 0.8, "manager": 0.6}


def config(version: str = "lead-score-v1", **points: int) -> list[tuple]:
    """Rows of a configuration: the default with other maxima for some components."""
    rows = [(version, k, label, points.get(k, most), params) for k, label, most, params in DEFAULT]
    check(rows)
    return rows


def check(rows: list[tuple]) -> None:
    """A configuration must be worth 100 points."""
    if (total := sum(r[3] for r in rows)) != 100:
        raise ValueError(f"the components of {rows[0][0]} are worth {total} points, not 100")


def read_config(spark: SparkSession, path: str) -> list[tuple]:
    """A configuration from JSON lines with the fields of CONFIG_SCHEMA; at most one row per component comes back."""
    rows = [tuple(r) for r in spark.read.schema(CONFIG_SCHEMA).json(path).limit(1000).collect()]
    check(rows)
    return rows


def _sector_relevance(p: dict, as_of: Column) -> Column:
    targets = F.col("target_sectors")
    hit = related(F.col("event_sector"), targets) | related(F.col("company_industry"), targets)
    return F.when(F.coalesce(F.size(targets), F.lit(0)) <= 0, 0.5).when(hit, 1.0).otherwise(0.0)


def _event_significance(p: dict, as_of: Column) -> Column:
    value = F.when(F.coalesce("value", F.lit(0)) != 0, F.least(F.lit(1.0), F.col("value") / p.get("value_full", 1e9))).otherwise(0.3)
    return 0.7 * value + 0.3 * lookup(F.col("event_type"), TYPE_WEIGHTS, 0.6)


def _product_fit(p: dict, as_of: Column) -> Column:
    return F.coalesce("opportunity_confidence", F.lit(0.0)) / (p.get("full_at", 0.85) or 1.0)


def _recency(p: dict, as_of: Column) -> Column:
    full, zero = p.get("full_days", 30.0), p.get("zero_days", 365.0)
    age = F.datediff(as_of, "event_date")
    return F.when(F.col("event_date").isNull(), 0.3).when(age <= full, 1.0).when(age >= zero, 0.0).otherwise(1.0 - (age - full) / (zero - full))


def _company_fit(p: dict, as_of: Column) -> Column:
    known = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    size = F.when(known("employee_range") & F.coalesce(F.array_contains("ideal_ranges", F.col("employee_range")), F.lit(False)), 0.6).when(known("employee_range"), 0.3).otherwise(0.0)
    return F.when(known("company_industry"), 0.4).otherwise(0.0) + size


def _contact_availability(p: dict, as_of: Column) -> Column:
    return F.when(F.coalesce("num_contacts", F.lit(0)) <= 0, 0.0).otherwise(lookup(F.col("best_seniority"), SENIORITY_WEIGHT, 0.5))


def _evidence_confidence(p: dict, as_of: Column) -> Column:
    given = F.filter("evidence_confidences", lambda x: x.isNotNull())
    mean = F.aggregate(given, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(given), F.lit(0))
    return F.coalesce(mean, F.nullif("opportunity_confidence", F.lit(0.0)), F.lit(0.3))


SCORERS: dict[str, Callable[[dict, Column], Column]] = {
    "sector_relevance": _sector_relevance, "event_significance": _event_significance, "product_fit": _product_fit, "recency": _recency,
    "company_fit": _company_fit, "contact_availability": _contact_availability, "evidence_confidence": _evidence_confidence,
}


def points(fraction: Column, most: int) -> Column:
    """Half-even whole points of a fraction held between 0 and 1; rounded at nine digits first so that sums like
    0.7 * 0.5 + 0.15 do not fall off a half."""
    held = F.least(F.lit(1.0), F.greatest(F.lit(0.0), fraction))
    return F.bround((held * most).cast("decimal(18,9)"), 0).cast("int")


def score(inputs: DataFrame, rows: list[tuple], as_of: Column, scorers: dict[str, Callable[[dict, Column], Column]] | None = None) -> DataFrame:
    """inputs × versions of the configuration rows: version, total, grade and the array of components. scorers: further
    components by key, or others for known keys; each gives a fraction as a column of the inputs."""
    known = SCORERS | (scorers or {})
    versions: dict[str, list[tuple]] = {}
    for r in rows:
        versions.setdefault(r[0], []).append(r)
    fractions: dict[tuple, tuple[str, Column]] = {}
    worth: dict[tuple, tuple[str, Column]] = {}
    scored = []
    for version, parts in versions.items():
        made, total = [], F.lit(0)
        for _, key, label, most, params in parts:
            got = F.lit(0)
            if scorer := known.get(key):
                same = (key, tuple(sorted((params or {}).items())))
                if same not in fractions:
                    fractions[same] = (f"_fraction{len(fractions)}", scorer(dict(params or {}), as_of))
                if (*same, most) not in worth:
                    worth[(*same, most)] = (f"_points{len(worth)}", points(F.col(fractions[same][0]), most))
                got = F.col(worth[(*same, most)][0])
            total = total + got
            made.append(F.struct(F.lit(key).alias("key"), F.lit(label).alias("label"), got.alias("points"), F.lit(most).alias("max_points"), F.lit("" if scorer else "no scorer").alias("note")))
        scored.append(F.struct(F.lit(version).alias("version"), F.array(*made).alias("components"), total.alias("total")))
    # fractions and points are columns, so that versions share them and components and total do
    ready = inputs.withColumns(dict(fractions.values())).withColumns(dict(worth.values()))
    out = ready.withColumn("_v", F.explode(F.array(*scored))).select(*inputs.columns, "_v.version", "_v.components", "_v")
    return out.withColumn("total", F.col("_v.total")).drop("_v").withColumn("grade", grade(F.col("total")))


def explanation() -> Column:
    """One line of text per component of a scored row."""
    return F.array_join(F.transform("components", lambda c: F.concat(c["label"], F.lit(": "), c["points"].cast("string"), F.lit("/"), c["max_points"].cast("string"))), "\n")
