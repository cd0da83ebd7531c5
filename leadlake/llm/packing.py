"""Best-fit packing of documents into sequences of a fixed number of tokens.

* Pieces. A document is its token ids and an end id. One that is longer than a sequence is cut into full pieces from
  its end, so that only the first piece may be shorter.
* Range sort. Pieces are sorted by length, longest first, over range partitions; ties are dealt by place, so a length
  that a third of all pieces have is spread over partitions. Pieces of one length in one partition are a run of
  consecutive places, of which there are at most as many as partitions and lengths together. Gaps are runs, too:
  consecutive sequences with the same room left.
* Supersteps. All pieces of one length are matched in one superstep: their successor among the gaps is the run with the
  least room that holds one. Conflicts are resolved by rank: a sequence of that run takes the next pieces in order, as
  many as it holds, then the next sequence. The gaps are updated and the step is repeated with what is left, the next
  larger gaps, and in the end new sequences. That is what best fit does piece by piece, since a sequence that has just
  taken a piece has the least room of all that still hold one. A gap falls to under half each time it is matched, so the
  matches of runs are at most a few tens of thousands at 2048 lengths, however many pieces there are.
* Sweep. The matches of runs, sorted by place and broadcast, are swept by every partition of the sorted pieces: a piece's
  match is the one with the last beginning up to its place, and its rank there tells its sequence and offset.

Nulls and empty texts are documents of the end id alone. Repeated rows are packed once each. An empty table gives an
empty result. Other columns stay and may have any name that the operator does not add or begins with "_pk_".
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadlake.llm.common import slices, store, table
from leadlake.llm.tokenizing import Definition, Ids, kept_by_worker
from leadlake.session import ship

#: Tokens of a sequence.
CAPACITY = 2048
#: Id after each document.
END = 0


def pieces(docs: DataFrame, definition: Definition, pattern: str, capacity: int = CAPACITY, end: int = END, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(columns `keep`, piece int, start long, length long, ids binary): the pieces of every whole text, as little-endian
    unsigned 32-bit ids."""
    ship(docs.sparkSession)
    kept = docs.select(*keep, F.col(text_col).cast("string").alias("_pk_text"))
    added = [("piece", T.IntegerType(), pa.int32()), ("start", T.LongType(), pa.int64()), ("length", T.LongType(), pa.int64()), ("ids", T.BinaryType(), pa.binary())]
    schema = T.StructType([*(docs.schema[c] for c in keep), *(T.StructField(n, t) for n, t, _ in added)])
    data, key, last = definition.data, ("ids", definition.id, pattern), np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = kept_by_worker(key, lambda: Ids(data.value, pattern))
        for batch in batches:
            for part in slices(batch, 4 << 20):
                row, found = [], []
                for r, text in enumerate(part.column(part.num_columns - 1).to_pylist()):
                    ids = (known.of(text) if text else b"") + last
                    n = len(ids) // 4
                    ends = range(n - (n - 1) // capacity * capacity, n + 1, capacity)
                    for k, to in enumerate(ends):
                        at = max(to - capacity, 0) if k else 0
                        row.append(r)
                        found.append((k, at, to - at, ids[4 * at : 4 * to]))
                columns = [pa.array(x, t) for x, (_, _, t) in zip(zip(*found) if found else [[]] * 4, added)]
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(row, pa.int64())) for c in part.columns[:-1]), *columns], names=schema.names)

    return kept.mapInArrow(run, schema)


def matched_runs(counts: list[tuple[int, int]], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Supersteps of best fit over runs: counts are (length, pieces), longest first. Returns the matches (length, first
    rank within the length, first sequence, pieces in each sequence, tokens used before) and the number of sequences."""
    room: dict[int, list[tuple[int, int]]] = {}  # room left -> runs of (first sequence, sequences)
    sizes: list[int] = []  # the rooms that some sequence has, in order
    out, opened = [], 0

    def put(gap: int, first: int, many: int) -> None:
        if many and gap:
            if gap not in room:
                bisect.insort(sizes, gap)
                room[gap] = []
            room[gap].append((first, many))

    for length, left in counts:
        rank = 0
        while left:
            k = bisect.bisect_left(sizes, length)  # the successor of this length among the gaps
            if k < len(sizes):
                gap = sizes[k]
                first, many = room[gap].pop()
                if not room[gap]:
                    del room[gap], sizes[k]
            else:
                gap, first, many = capacity, opened, -(-left // (capacity // length))
                opened += many
            each = gap // length
            full = min(many, left // each)
            rest = 0 if full == many else left - full * each  # fewer than a sequence holds
            if full:
                out.append((length, rank, first, each, capacity - gap))
                put(gap - each * length, first, full)
            if rest:
                out.append((length, rank + full * each, first + full, rest, capacity - gap))
                put(gap - rest * length, first + full, 1)
            taken = full + (rest > 0)
            put(gap, first + taken, many - taken)
            rank, left = rank + full * each + rest, left - full * each - rest
    return out, opened


def _sweep(runs: list[tuple[int, int, int]], capacity: int) -> np.ndarray:
    """Matches by place: columns (first place, rank there within the match, first sequence, pieces in each sequence,
    tokens used before). runs: (length, first place, pieces) in order of places, longest first."""
    counts: dict[int, int] = {}
    for length, _, n in runs:
        counts[length] = counts.get(length, 0) + n
    matches, _ = matched_runs(list(counts.items()), capacity)
    begins: dict[int, list] = {}
    for length, rank, first, each, used in matches:
        begins.setdefault(length, []).append((rank, first, each, used))
    out, done = [], dict.fromkeys(counts, 0)
    for length, place, n in runs:
        low, high = done[length], done[length] + n
        own = begins[length]
        for k in range(bisect.bisect_right(own, low, key=lambda m: m[0]) - 1, len(own)):
            rank, first, each, used = own[k]
            if rank >= high:
                break
            out.append((place + max(rank, low) - low, max(rank, low) - rank, first, each, used))
        done[length] = high
    return np.array(out, np.int64).reshape(-1, 5)


def packed(rows: DataFrame, capacity: int = CAPACITY, length_col: str = "length") -> DataFrame:
    """rows, of 1 to `capacity` tokens each, with sequence_id long and offset long: their places in as few sequences as
    best fit needs, longest first. rows are read twice, so store them first if they are costly."""
    spark = rows.sparkSession
    ship(spark)
    dealt = rows.withColumn("_pk_tie", F.monotonically_increasing_id())
    keys = [F.col(length_col).desc(), F.col("_pk_tie")]
    placed = store(dealt.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_pk_tie").withColumn("_pk_at", F.monotonically_increasing_id()))
    part = F.shiftright("_pk_at", 33).alias("p")
    runs = placed.groupBy(part, F.col(length_col).cast("long").alias("n")).agg(F.min("_pk_at").alias("at"), F.count("*").alias("many"))
    found = _sweep(sorted(((r["n"], r["at"], r["many"]) for r in runs.collect()), key=lambda r: r[1]), capacity)
    matches = spark.sparkContext.broadcast(found)
    schema = T.StructType([*rows.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    n_col, at_col, names = rows.columns.index(length_col), len(rows.columns), schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, skip, first, each, used = matches.value.T
        for batch in batches:
            at, n = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (at_col, n_col))
            k = np.searchsorted(place, at, "right") - 1
            rank = at - place[k] + skip[k]
            columns = [pa.array(first[k] + rank // each[k]), pa.array(used[k] + rank % each[k] * n)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at_col], *columns], names=names)

    return placed.mapInArrow(run, schema)


def sequences(rows: DataFrame) -> DataFrame:
    """(sequence_id, ids binary, doc_ids): packed pieces with their ids put together; a group is one sequence."""
    each = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id")))
    joined = F.aggregate("x", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return rows.groupBy("sequence_id").agg(each.alias("x")).select("sequence_id", joined.alias("ids"), F.col("x.doc_id").alias("doc_ids"))


def production_definition(spark) -> tuple[Definition, str]:
    import public_tokenizers

    return Definition(spark, public_tokenizers.path("byte_bpe_50k.json")), public_tokenizers.PATTERN


def op13_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    made = pieces(table(spark, sf_dir, "documents"), *production_definition(spark))
    stored = store(made.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
    return packed(stored)


QUERIES = {"op13_best_fit_packing": op13_best_fit_packing}
ORACLES: dict[str, str] = {}
