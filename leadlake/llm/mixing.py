"""Mixing sources to target weights, in DataFrame functions only.

* Shares. Tokens (words) per source; a null source is a source.
* Temperature. Weights are shares raised to an exponent between 0 and 1 and normalised. The exponent is found by
  bisection on a grid of 1 / GRID, sixteen places at a time, each step one aggregation over the sources: the least one
  for which no source is repeated more than `repeats` times, or the largest one whose weights have the wanted entropy.
* Realisation. A source gets weight * budget tokens: full passes over all its documents and a part of one more.
  Documents belong to 4096 blocks of 4096 sub-blocks by the MD5 of their id; a pass permutes blocks, sub-blocks and
  documents by MD5s that hold the number of the pass. The part is a beginning of the permuted order, found level by
  level: sums by block, then by sub-block of the one cut block, then the documents of the one cut sub-block, so that no
  group holds more than 4096 sums or one sub-block.

Without a budget, the budget is the least one that gives every source a full pass. Null ids hash as the empty string;
rows that repeat an id are taken or left together; null and empty texts have no tokens. A source without tokens gets
one pass. An empty table gives an empty result. Other columns stay and may have any name not starting with "_mx_".
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leadlake.llm.common import checkpoint, table

GRID = 1 << 16
#: Sources up to which the table of sources is broadcast; beyond, it is joined by a shuffle.
BROADCAST_SOURCES = 10_000
_WORD = "[^\\x20\\x09-\\x0D]+"


def _key(id_col: str) -> F.Column:
    return F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))


def _orders(key: F.Column, turn: F.Column) -> tuple[F.Column, F.Column, F.Column]:
    """Order keys of a document's block, sub-block and itself in the pass numbered `turn`."""
    salted = lambda x: F.md5(F.concat(x, F.lit(":"), turn.cast("string")).cast("binary"))
    return salted(F.substring(key, 1, 3)), salted(F.substring(key, 1, 6)), salted(key)


def exponent(sources: DataFrame, budget: float | None, repeats: float | None, entropy: float | None) -> float:
    """sources: (tokens) per source, above 0. The exponent of the mixture as described above."""
    least, most, total, number = sources.agg(F.min("tokens"), F.max("tokens"), F.sum("tokens"), F.count("*")).first()
    if not number:
        return 1.0

    def fits(sums: list[tuple[float, float]], at: list[float]) -> list[bool]:
        out = []
        for (z, zl), a in zip(sums, at):
            if repeats is not None:
                size = z * most ** (1 - a) if budget is None else budget
                out.append(size * least ** (a - 1) / z <= repeats)
            else:
                out.append(math.log(z) - a * zl / z < entropy)
        return out

    low, high = -1, GRID  # fits is false at low (or low is off the grid) and taken as true at high
    while high - low > 1:
        at = sorted({low + (high - low) * k // 17 for k in range(1, 17)} - {low, high} or {(low + high) // 2})
        sums = sources.agg(*(x for k in at for x in (F.sum(F.pow("tokens", F.lit(k / GRID))), F.sum(F.pow("tokens", F.lit(k / GRID)) * F.log("tokens"))))).first()
        ok = fits([(sums[2 * i], sums[2 * i + 1]) for i in range(len(at))], [k / GRID for k in at])
        for k, good in zip(at, ok):
            if good:
                high = k
                break
            low = k
    return high / GRID if repeats is not None else max(high - 1, 0) / GRID


def plan(docs: DataFrame, budget: float | None = None, repeats: float | None = 2.0, entropy: float | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per source: (source, tokens, weight, passes, c1, c2, c3). A document is in the partial pass if its order
    keys are at most (c1, c2, c3)."""
    slim = checkpoint(
        docs.select(F.col(source_col).alias("source"), _key(id_col).alias("key"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(_WORD)), F.lit(0)).cast("long").alias("n"))
    )  # small: no texts
    sources = checkpoint(slim.groupBy("source").agg(F.sum("n").alias("tokens")))
    some = sources.filter("tokens > 0")
    a = exponent(some, budget, repeats, entropy)
    z, most = some.agg(F.sum(F.pow("tokens", F.lit(a))), F.max("tokens")).first()
    size = 0.0 if z is None else z * most ** (1 - a) if budget is None else budget
    weight = F.when(F.col("tokens") > 0, F.pow("tokens", F.lit(a)) / F.lit(z or 1.0)).otherwise(0.0)
    quota = F.floor(F.col("weight") * F.lit(size) + F.lit(1e-6))
    sources = sources.withColumn("weight", weight).withColumn("passes", F.when(F.col("tokens") > 0, F.floor(quota / F.col("tokens"))).otherwise(1))
    sources = checkpoint(sources.withColumn("rest", F.when(F.col("tokens") > 0, quota - F.col("passes") * F.col("tokens")).otherwise(0)))

    def cut(rows: DataFrame, order: str, rest: DataFrame) -> DataFrame:
        """rows: (source, order, n) sums; the first order key per source that goes beyond what is left, and the rest."""
        mine = rows.join(small(rest), rows.source.eqNullSafe(rest._s)).withColumn("upto", F.sum("n").over(W.partitionBy("source").orderBy(order)))
        over = mine.filter(F.col("upto") > F.col("_rest")).groupBy("source").agg(F.min(F.struct("upto", order, "n")).alias("x"), F.first("_rest").alias("_rest"))
        return over.select(F.col("source").alias("_s"), F.col(f"x.{order}").alias(order), (F.col("_rest") - F.col("x.upto") + F.col("x.n")).alias("_rest"))

    o1, o2, o3 = _orders(F.col("key"), F.col("passes"))
    start = sources.select(F.col("source").alias("_s"), "passes", F.col("rest").alias("_rest"))
    keyed = slim.join(small(start.select("_s", "passes")), slim.source.eqNullSafe(F.col("_s"))).select("source", "n", o1.alias("o1"), o2.alias("o2"), o3.alias("o3"))
    first = checkpoint(cut(keyed.groupBy("source", "o1").agg(F.sum("n").alias("n")), "o1", start))
    f = first.select("_s", F.col("o1").alias("_o1"))
    in_block = keyed.join(small(f), keyed.source.eqNullSafe(f._s) & (F.col("o1") == F.col("_o1"))).select("source", "o2", "o3", "n")
    second = checkpoint(cut(in_block.groupBy("source", "o2").agg(F.sum("n").alias("n")), "o2", first.select("_s", "_rest")))
    g = second.select("_s", F.col("o2").alias("_o2"))
    in_part = in_block.join(small(g), in_block.source.eqNullSafe(g._s) & (F.col("o2") == F.col("_o2"))).select("source", "o3", "n")
    third = checkpoint(cut(in_part.groupBy("source", "o3").agg(F.sum("n").alias("n")), "o3", second.select("_s", "_rest")))
    ends = first.select("_s", F.col("o1").alias("c1")).join(second.select(F.col("_s").alias("_s2"), F.col("o2").alias("c2")), F.col("_s").eqNullSafe(F.col("_s2")))
    ends = ends.join(third.select(F.col("_s").alias("_s3"), F.col("o3").alias("c3")), F.col("_s").eqNullSafe(F.col("_s3"))).select("_s", "c1", "c2", "c3")
    return checkpoint(sources.join(ends, sources.source.eqNullSafe(ends._s), "left").select("source", "tokens", "weight", "passes", "rest", "c1", "c2", "c3"))


def small(sources: DataFrame) -> DataFrame:
    """Broadcast a table of one row per source, if it is counted to be small."""
    return F.broadcast(sources) if sources.count() <= BROADCAST_SOURCES else sources


def copies(docs: DataFrame, sources: DataFrame, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """docs with _mx_copies, how often each row is used, _mx_weight of its source, and its block's place in the last pass."""
    side = small(sources.select(F.col("source").alias("_mx_source"), F.col("weight").alias("_mx_weight"), F.col("passes").alias("_mx_passes"), F.struct("c1", "c2", "c3").alias("_mx_end"), (F.col("rest") > 0).alias("_mx_part")))
    joined = docs.join(side, docs[source_col].eqNullSafe(F.col("_mx_source")))
    o = F.struct(*(x.alias(f"c{k}") for k, x in enumerate(_orders(_key(id_col), F.col("_mx_passes")), 1)))
    in_part = F.col("_mx_part") & F.coalesce(o < F.col("_mx_end"), F.lit(False))
    return joined.select(*(docs[c] for c in docs.columns), "_mx_weight", (F.col("_mx_passes") + F.when(in_part, 1).otherwise(0)).cast("long").alias("_mx_copies"), o["c1"].alias("_mx_block"))


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    total = docs.agg(F.sum(F.regexp_count("text", F.lit(_WORD)))).first()[0] or 0
    out = copies(docs.select("doc_id", "source"), plan(docs, budget=float(total), repeats=3.0))
    return out.select("doc_id", "source", F.round("_mx_weight", 6).alias("weight"), F.col("_mx_copies").alias("copies"), F.col("_mx_block").alias("block_order"))


def mixed(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every row at least once; rows of small sources up to twice in all."""
    out = copies(docs, plan(docs, budget=None, repeats=2.0))
    return out.withColumn("_mx_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_mx_copies"))).select(docs.columns)


OP2_SQL = r"""
WITH slim AS (SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '')) AS key, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS n FROM documents),
src AS (SELECT source, sum(n)::DOUBLE AS tokens FROM slim GROUP BY source),
tot AS (SELECT sum(tokens) AS budget, min(tokens) FILTER (WHERE tokens > 0) AS least FROM src),
grid AS (SELECT k / 65536.0::DOUBLE AS a FROM range(0, 65537) r(k)),
zs AS (SELECT a, sum(pow(tokens, a)) AS z FROM grid, src WHERE tokens > 0 GROUP BY a),
best AS (SELECT coalesce(min(a), 1) AS a FROM zs, tot WHERE budget * pow(least, a - 1) / z <= 3.0),
w AS (SELECT source, tokens, CASE WHEN tokens > 0 THEN pow(tokens, best.a) / zs.z ELSE 0 END AS weight, budget
      FROM src, tot, best JOIN zs ON zs.a = best.a),
q AS (SELECT *, CASE WHEN tokens > 0 THEN floor(floor(weight * budget + 1e-6) / tokens) ELSE 1 END AS passes,
      CASE WHEN tokens > 0 THEN floor(weight * budget + 1e-6) ELSE 0 END AS quota FROM w),
o AS (SELECT s.doc_id, s.source, s.n, q.weight, q.passes, q.tokens, q.quota - q.passes * q.tokens AS rest,
      md5(concat(substr(key, 1, 3), ':', passes::BIGINT::VARCHAR)) AS o1, md5(concat(substr(key, 1, 6), ':', passes::BIGINT::VARCHAR)) AS o2,
      md5(concat(key, ':', passes::BIGINT::VARCHAR)) AS o3 FROM slim s JOIN q ON s.source IS NOT DISTINCT FROM q.source),
c AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY o1, o2, o3) AS upto FROM o)
SELECT doc_id, source, round(weight, 6) AS weight, (passes + CASE WHEN tokens > 0 AND rest > 0 AND upto <= rest THEN 1 ELSE 0 END)::BIGINT AS copies, o1 AS block_order FROM c
"""

QUERIES = {"op2_mixing": op2_mixing}
ORACLES = {"op2_mixing": OP2_SQL}
