"""Removal of later repeated runs of lines, found by winnowing over line hashes, in DataFrame functions only.

Lines with a word are compared whole; a run is a stretch of them (blank lines between them belong to it). A run of at
least LEAST words that also stands earlier, by (document id, place), is removed; the first one stays.

* Windows. From every line, the shortest stretch of at least LEAST words forwards, and the shortest one backwards.
* Fingerprints. The smallest line hash of each window. Two places that share a run of LEAST words share a window of it,
  and so a fingerprint: none is missed.
* Positions. Fingerprints are counted before any row is joined; windows whose fingerprint stands in one place only go.
  The others meet the first place of their window, one aggregation and one equi-join, with no pairs within a group.
  Fingerprints and windows that a large share of all rows have are few, so they are joined by broadcast instead of
  filling one task.
* Extension. Each line of a shared run is in a window of that run that starts, or ends, further left or right; so the
  union of the repeated windows is the match extended both ways to its ends.

A passage is found by its whole lines: of one that starts or ends inside a line, only the lines within it count.

Null texts stay null and empty ones empty. Rows that repeat a document (same id and text) are the same place and get
the same result; different texts under one id are different places, by the hash of the text. Null ids come first. An
empty table gives an empty result; other columns stay and may have any name not starting with "_ld_".
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlake.llm.common import checkpoint, joined_by_key, store, table, unstore

#: Words of a run that is removed, at least.
LEAST = 50
_WORD = "[^\\x20\\x09-\\x0D]+"


def _lines() -> F.Column:
    return F.split("text", "\n", -1)


def _windows(docs: DataFrame, least: int) -> DataFrame:
    """One row for each window of each document: (id, th, a, z, print, k1, k2); a and z are its first and last line,
    print its fingerprint, k1 and k2 two hashes of its lines."""
    unit = lambda x, k: F.struct(k.alias("at"), F.xxhash64(x).alias("h"), F.xxhash64(F.lit(1), x).alias("g"), F.regexp_count(x, F.lit(_WORD)).alias("n"))
    rows = docs.filter("text is not null").select("id", "th", F.filter(F.transform(_lines(), unit), lambda u: u["n"] > 0).alias("u"))
    u = F.col("u")

    def reach(part: F.Column) -> F.Column:
        """Number of lines of the shortest beginning of `part` with enough words; 0 if there is none."""
        start = F.struct(F.lit(0).alias("w"), F.lit(0).alias("n"))
        step = lambda a, x: F.when(a["w"] >= least, a).otherwise(F.struct((a["w"] + x["n"]).alias("w"), (a["n"] + 1).alias("n")))
        return F.aggregate(part, start, step, lambda a: F.when(a["w"] >= least, a["n"]).otherwise(0))

    places = F.when(F.size(u) > 0, F.sequence(F.lit(1), F.size(u)))
    ahead = F.transform(places, lambda i: F.struct(i.alias("a"), (i + reach(F.slice(u, i, F.lit(least))) - 1).alias("z")))
    back = F.transform(places, lambda i: F.struct((i - reach(F.reverse(F.slice(u, F.greatest(i - least + 1, F.lit(1)), F.least(i, F.lit(least))))) + 1).alias("a"), i.alias("z")))
    total = F.aggregate(u, F.lit(0), lambda a, x: a + x["n"])
    spans = F.array_distinct(F.concat(F.filter(ahead, lambda s: s["z"] >= s["a"]), F.filter(back, lambda s: s["z"] >= s["a"])))
    one = rows.filter(total >= least).select("id", "th", "u", F.explode(spans).alias("s"))
    part = F.slice(u, F.col("s.a"), F.col("s.z") - F.col("s.a") + 1)
    return one.select(
        "id", "th", u[F.col("s.a") - 1]["at"].alias("a"), u[F.col("s.z") - 1]["at"].alias("z"), F.array_min(F.transform(part, lambda x: x["h"])).alias("print"),
        F.xxhash64(F.transform(part, lambda x: x["h"])).alias("k1"), F.xxhash64(F.transform(part, lambda x: x["g"])).alias("k2"),
    )


def repeated_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """docs: (id, th, text). (id, th, runs): the line ranges {a, z} of each document that stand earlier elsewhere."""
    windows = store(_windows(docs, least))  # read twice
    total = windows.count()
    place = F.struct("id", "th", "a")
    prints = windows.groupBy("print").agg(F.min(place).alias("lo"), F.max(place).alias("hi"), F.count("*").alias("_rows"))
    prints = store(prints.filter("lo <> hi").select("print", "_rows"))
    found = store(joined_by_key(windows, prints, ["print"], total).drop("print"))
    first = found.groupBy("k1", "k2").agg(F.min(place).alias("lo"), F.max(place).alias("hi"), F.count("*").alias("_rows"))
    first = store(first.filter("lo <> hi").select("k1", "k2", "lo", "_rows"))
    later = joined_by_key(found, first, ["k1", "k2"], total).filter(place > F.col("lo"))
    runs = checkpoint(later.groupBy("id", "th").agg(F.collect_list(F.struct("a", "z")).alias("runs")))  # one document's own runs
    unstore(windows, prints, found, first)
    return runs


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """docs with repeated runs removed from the text, plus _ld_lines and _ld_removed, the lines before and removed."""
    keyed = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    runs = repeated_runs(keyed, least).select(F.col("id").alias("_ld_id"), F.col("th").alias("_ld_th"), F.col("runs").alias("_ld_runs"))
    joined = docs.join(runs, docs[id_col].eqNullSafe(F.col("_ld_id")) & (F.xxhash64(docs[text_col]) == F.col("_ld_th")), "left")
    lines = F.split(F.col(text_col), "\n", -1)
    gone = F.flatten(F.transform("_ld_runs", lambda r: F.sequence(r["a"], r["z"])))
    split = joined.withColumn("_ld_all", F.when(F.col("_ld_runs").isNotNull(), lines))
    split = split.withColumn("_ld_kept", F.array_except(F.sequence(F.lit(0), F.size("_ld_all") - 1), gone))
    left = F.array_join(F.transform("_ld_kept", lambda k: F.col("_ld_all")[k]), "\n")
    return split.select(
        *(F.when(F.col("_ld_runs").isNotNull(), left).otherwise(docs[c]).alias(c) if c == text_col else docs[c] for c in docs.columns),
        F.coalesce(F.size(lines), F.lit(0)).alias("_ld_lines"),
        F.when(F.col("_ld_runs").isNotNull(), F.size("_ld_all") - F.size("_ld_kept")).otherwise(0).alias("_ld_removed"),
    )


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("_ld_lines").cast("long").alias("n_lines"), F.col("_ld_removed").cast("long").alias("n_removed"), F.md5("text").alias("text_md5"))


def without_repeats(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: repeated runs removed; a document of which nothing but blank lines is left goes."""
    out = remove_repeats(docs)
    whole = F.col("_ld_removed") > 0
    kept = out.filter(~whole | F.col("text").rlike(_WORD))
    return kept.select(*(F.when(whole, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col(c)).alias(c) if c == "n_chars" else c for c in docs.columns))


OP3_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
  FROM documents WHERE text IS NOT NULL),
units AS (
  SELECT doc_id, pos, line, n, row_number() OVER w AS i, sum(n) OVER w AS upto
  FROM (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM lines) WHERE n > 0
  WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
spans AS (
  SELECT a.doc_id, a.i AS a, min(b.i) AS z FROM units a JOIN units b ON a.doc_id = b.doc_id AND b.i BETWEEN a.i AND a.i + 49
   AND b.upto >= a.upto - a.n + 50 GROUP BY ALL
  UNION
  SELECT b.doc_id, max(a.i) AS a, b.i AS z FROM units b JOIN units a ON a.doc_id = b.doc_id AND a.i BETWEEN b.i - 49 AND b.i
   AND b.upto >= a.upto - a.n + 50 GROUP BY ALL),
windows AS (
  SELECT s.doc_id, s.a, s.z, min(u.pos) AS p, max(u.pos) AS q, string_agg(u.line, chr(10) ORDER BY u.i) AS content
  FROM spans s JOIN units u ON s.doc_id = u.doc_id AND u.i BETWEEN s.a AND s.z GROUP BY ALL),
later AS (
  SELECT doc_id, p, q FROM (SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id, p) AS k FROM windows) WHERE k > 1),
marked AS (
  SELECT l.doc_id, l.pos, l.line, EXISTS (SELECT 1 FROM later x WHERE x.doc_id = l.doc_id AND l.pos BETWEEN x.p AND x.q) AS gone FROM lines l)
SELECT d.doc_id, coalesce(m.n_lines, 0) AS n_lines, coalesce(m.n_removed, 0) AS n_removed,
       CASE WHEN d.text IS NOT NULL THEN md5(coalesce(m.rest, '')) END AS text_md5
FROM documents d LEFT JOIN (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone) AS rest
  FROM marked GROUP BY doc_id) m ON m.doc_id = d.doc_id
"""

QUERIES = {"op3_line_dedup": op3_line_dedup}
ORACLES = {"op3_line_dedup": OP3_SQL}
