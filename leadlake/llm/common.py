"""Shared helpers: text passes over Arrow batches, checkpoints, connected components."""

from __future__ import annotations

import bisect
import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadlake.session import checkpointed, passing_shuffles, shared_path, ship

#: Groups up to which their table is broadcast.
MOST_GROUPS = 10_000
#: Words are split at these six ASCII characters only.
SPACE = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: F.Column) -> F.Column:
    """Words of a text column; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE, -1))


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the session's shared folder (spark.checkpoint.dir)."""
    done = checkpointed(df)
    release(df.sparkSession)
    return done


def store(df: DataFrame) -> DataFrame:
    """Write a table of one run into the shared checkpoint folder and read it back; compressed, unlike a checkpoint."""
    path = shared_path(df.sparkSession, "table")
    with passing_shuffles(df.sparkSession):
        df.write.parquet(path)
    release(df.sparkSession)
    back = df.sparkSession.read.parquet(path)
    back.__dict__["stored_at"] = path
    return back


def unstore(*tables: DataFrame) -> None:
    """Delete tables that `store` wrote, when nothing reads them any more; others are left alone."""
    for df in tables:
        if path := df.__dict__.get("stored_at"):
            target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> None:
    """Collect the driver's garbage between steps: Spark then drops the shuffle files of finished steps, and the plans
    of finished jobs leave the driver's memory."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Tables that a Python worker keeps from task to task, by the module that fills them.
TABLES: dict[str, dict] = {}


def release_tables(but: str | None = None) -> None:
    """Empty the worker's tables but one, and give their memory back: a worker outlives the stage that filled them."""
    filled = [t for name, t in TABLES.items() if name != but and t]
    for t in filled:
        t.clear()
    if filled:
        gc.collect()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)


#: Shares of the bound at which a sample's hash can be cut.
_CUTS = (0.25, 0.5, 0.7, 0.8, 0.85, 0.9, 0.92, 0.94, 0.96, 0.98, 1.0, 1.02, 1.04)


def bounded_sample(rows: DataFrame, most: int, group: str | None = None, seed: int = 0) -> DataFrame:
    """At most `most` rows of each group (of all rows, without one) by hashed id: columns (id, group).

    Groups up to the bound stay whole. Of a larger one, the rows with a hash below a cut stay: the highest of a few cuts
    around the bound that lets through no more than `most` rows. Counts come from partial aggregations, the groups'
    cuts are broadcast when they are counted to be few, and no row is shuffled or ranked.
    """
    space = 1 << 40
    hashed = rows.select("id", *[group] * bool(group), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(space)).alias("_u"))
    by = lambda df: df.groupBy(group) if group else df.groupBy()
    size = by(rows).agg(F.count("*").alias("_n"))
    counted = checkpoint(size.select(*[group] * bool(group), (F.lit(float(most) * space) / F.greatest("_n", F.lit(1))).alias("_one"), (F.col("_n") <= most).alias("_all")))
    few = counted.limit(MOST_GROUPS + 1).count() <= MOST_GROUPS

    def joined(df: DataFrame, groups: DataFrame) -> DataFrame:
        if not group:  # one row of figures, as constants
            return df.withColumns({c: F.lit(v) for c, v in groups.first().asDict().items()})
        return df.join(F.broadcast(groups) if few else groups, group)

    near = joined(hashed, counted).filter(~F.col("_all") & (F.col("_u") < F.col("_one") * _CUTS[-1]))
    below = by(near).agg(*(F.count_if(F.col("_u") < F.col("_one") * c).alias(f"_c{k}") for k, c in enumerate(_CUTS)))
    cut = F.greatest(*(F.when(F.col(f"_c{k}") <= most, c).otherwise(0.0) for k, c in enumerate(_CUTS)))
    cuts = below.select(*[group] * bool(group), cut.alias("_cut"))
    if not group:
        counted = counted.withColumn("_cut", F.lit(cuts.first()[0]))
    else:
        counted = counted.join(cuts, group, "left")
    counted = checkpoint(counted.select(*[group] * bool(group), F.when(F.col("_all"), F.lit(float(space))).otherwise(F.col("_one") * F.coalesce("_cut", F.lit(0.0))).alias("_below")))
    return joined(hashed, counted).filter(F.col("_u") < F.col("_below")).select("id", *[group] * bool(group))


def text_pass(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    make: Callable[[], Callable[[list], tuple]],
    fields: list[tuple[str, T.DataType, pa.DataType]],
    keep: tuple[str, ...] = (),
    tables: str | None = None,
) -> DataFrame:
    """One pass over whole texts in Arrow batches: `make()` runs once in each task and returns a function from a
    list of texts (None for null) to one list per field. Rows keep their number; of the other columns, `keep` stays.
    tables: the worker's tables that the pass uses itself."""
    ship(docs.sparkSession)
    kept = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"), *keep)
    schema = T.StructType([docs.schema[id_col], *(docs.schema[c] for c in keep), *(T.StructField(n, t) for n, t, _ in fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_tables(tables)
        work = make()
        for batch in batches:
            for part in slices(batch):
                found = work(part.column(1).to_pylist())
                columns = [pa.array(v, t) for v, (_, _, t) in zip(found, fields)]
                yield pa.RecordBatch.from_arrays([part.column(0), *part.columns[2:], *columns], names=schema.names)

    return kept.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about `most` bytes, so that what a pass makes of a batch of long texts stays small."""
    n = max(1, -(-batch.nbytes // most))
    step = max(1, -(-batch.num_rows // n))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def joined_by_key(rows: DataFrame, keys: DataFrame, on: list[str], total: int) -> DataFrame:
    """rows inner-joined to keys, which hold each key once and in `_rows` the number of rows that have it, `total` in
    all. A key of at least one row in MOST_GROUPS is hot: there are at most MOST_GROUPS of them, so they are broadcast;
    the other keys meet by a shuffle, in which none of them holds more than that share. keys is read three times."""
    hot = F.col("_rows") * MOST_GROUPS >= total
    few = F.broadcast(keys.filter(hot).drop("_rows"))
    return rows.join(few, on).unionByName(rows.join(F.broadcast(keys.filter(hot).select(*on)), on, "left_anti").join(keys.filter(~hot).drop("_rows"), on))


class Covered:
    """Spans of one text, merged, to tell whether another span meets one of them in logarithmic time."""

    def __init__(self, spans: Iterable[tuple[int, int]]):
        self.starts, self.ends = [], []
        for a, b in sorted(spans):
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meets(self, a: int, b: int) -> bool:
        k = bisect.bisect_right(self.ends, a)
        return k < len(self.starts) and self.starts[k] < b


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components by alternating large-star and small-star steps (Kiveris et al., SoCC 2014).

    edges: two id columns, in any direction. Returns (id, component_id), the smallest id of each component, for
    every id that has an edge to another one. Each round is two aggregations and two joins, and its result is
    checkpointed; the number of rounds grows with the logarithm of the longest chain.
    """
    spark = edges.sparkSession
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    e = checkpoint(e)
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: neighbours above u hang on u's smallest neighbour
        e = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: neighbours below u, and u itself, hang on the smallest of them
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        e = e.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        e = checkpoint(e)
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        release(spark)
        if state == before:
            ends = e.unionByName(e.select(F.col("v").alias("u"), "v").distinct())  # the smallest ids themselves
            return ends.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
        before = state
