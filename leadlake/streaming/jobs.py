"""Structured Streaming jobs: landing, incremental matching, change feed, feedback, running outcomes.

Each job takes a streaming DataFrame, a table path and a checkpoint path. Landing, matching by one identifier and the change
feed keep the state of each key in a state store, so a batch costs what its own keys cost, however long the history is, and
the file sink's log makes them exactly-once. Where Python keeps the state, keys share STATES states by hash: it is called once
for a state of a batch, not once for a key, and reads what the keys of that state have. The others are exactly-once by the batch id: a batch that is run again
overwrites its own part of the output.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from leadlake.functions.values import FEEDBACK_CLASS, FEEDBACK_STATUS, lookup
from leadlake.operators import matching
from leadlake.session import ship


def _start(stream: DataFrame, checkpoint: str, work: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    return stream.writeStream.outputMode(mode).foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _earlier(spark: SparkSession, path: str, schema: str, batch: int) -> DataFrame:
    """What batches before this one have written; parts are folders batch=<id>."""
    try:
        return spark.read.schema(schema + ", batch bigint").parquet(path).filter(F.col("batch") < batch)
    except Exception as e:  # nothing written yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema + ", batch bigint")


#: State in RocksDB: what a batch does not touch stays on disk and is not written again.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def _append(rows: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Rows of a stream with keyed state, appended to a table of files. A batch that is run again gives the same files."""
    for key, value in STATE_STORE.items():
        rows.sparkSession.conf.set(key, value)
    return rows.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def land_documents(documents: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Landing of (source, hash, url): content that its source already has is not stored again. State: the keys."""
    return _append(documents.select("source", "hash", "url").dropDuplicates(["source", "hash"]), path, checkpoint)


def land_within(documents: DataFrame, delay: str = "1 day") -> DataFrame:
    """The same with bounded state: repeats within the delay of fetched_at are dropped."""
    return documents.withWatermark("fetched_at", delay).dropDuplicatesWithinWatermark(["source", "hash"])


def match_reports(prints: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Incremental leader clustering of fingerprints with several identifiers (seq, identifiers): each batch meets the
    canonical reports of earlier ones, which it reads. Exact, since a canonical report never changes; batches must come in
    order of seq. Where reports have one identifier, match_by_identifier costs no more with a longer history."""
    schema = "seq bigint, canonical bigint, identifiers array<string>"

    def work(batch: DataFrame, n: int) -> None:
        old = _earlier(batch.sparkSession, path, schema, n).filter("seq = canonical").select("seq", "identifiers")
        every = old.unionByName(batch.select("seq", "identifiers"))
        found = matching.leaders(batch, None, old, ((matching.identifier_keys(every), None, 0.98),)).select("seq", "canonical")
        found.join(batch.select("seq", "identifiers"), "seq").select("seq", "canonical", "identifiers").write.mode("overwrite").parquet(f"{path}/batch={n}")

    return _start(prints, checkpoint, work)


#: States that the keys of a stream share. A call of Python costs about a millisecond, a key in it some microseconds.
STATES = 4096


def _shared_state(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(STATES)).cast("int")


def _first_holders(_: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    known = pickle.loads(bytes(state.get[0])) if state.exists else {}
    found = lambda part: pd.DataFrame({"seq": part["seq"], "canonical": [known[i] for i in part["identifier"].tolist()]})
    new, held = {}, []
    for part in rows:
        ids = part["identifier"].tolist()
        if all(i in known for i in ids):
            yield found(part)
            continue
        held.append(part)  # some are new in this batch: the least of their ids comes later, perhaps
        for i, seq in zip(ids, part["seq"].tolist()):
            if i not in known and seq < new.get(i, seq + 1):
                new[i] = seq
    if new:
        known |= new
        state.update((pickle.dumps(known),))
    yield from map(found, held)


def match_by_identifier(reports: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Incremental matching of reports (seq, identifier) by one identifier each: the canonical report of an identifier is
    its first one, and later batches find it in the identifier's state. Batches must come in order of seq."""
    ship(reports.sparkSession)
    named = reports.select("seq", F.col("identifier").cast("string").alias("identifier")).withColumn("state", _shared_state("identifier"))
    found = named.groupBy("state").applyInPandasWithState(_first_holders, "seq long, canonical long", "known binary", "append", GroupStateTimeout.NoTimeout)
    return _append(found, path, checkpoint)


def _changed(_: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last = pickle.loads(bytes(state.get[0])) if state.exists else {}
    operations: dict = {}
    for part in rows:
        for key, *x in zip(*(part[c].tolist() for c in ("key", "at", "sign", "gone"))):
            operations.setdefault(key, set()).add(tuple(x))
    out = []
    for key, those in operations.items():
        known = last.get(key)  # (at, sign, gone) of the last operation
        for at, sign, gone in sorted(those):
            if known is not None and at < known[0]:
                continue  # older than what is known
            there = known is not None and not known[2]
            change = ("removed" if there else None) if gone else "added" if not there else "changed" if sign != known[1] else None
            if change:
                out.append((key, at, change))
            known = (at, sign, gone)
        last[key] = known
    state.update((pickle.dumps(last),))
    if out:
        yield pd.DataFrame(out, columns=["key", "at", "change"])


def change_feed(operations: DataFrame, key: str, at: str, gone: str) -> DataFrame:
    """(key, at, change): added, changed or removed, for each operation of a stream that changes a row. operations: whole
    rows as written, with their time `at`, and `gone` for those deleted; keys are kept as text and cast back. State: time and hash of each row's last operation;
    operations older than that, and repeated ones, change nothing. The change feed of a stream in update mode."""
    ship(operations.sparkSession)
    fields = sorted(c for c in operations.columns if c not in (at, gone))
    kind = operations.schema[key].dataType.simpleString()
    rows = operations.select(F.col(key).cast("string").alias("key"), F.unix_micros(F.col(at).cast("timestamp")).alias("at"), F.xxhash64(*fields).alias("sign"), F.coalesce(F.col(gone), F.lit(False)).alias("gone"))
    found = rows.withColumn("state", _shared_state("key")).groupBy("state").applyInPandasWithState(_changed, "key string, at long, change string", "last binary", "update", GroupStateTimeout.NoTimeout)
    return found.select(F.col("key").cast(kind).alias(key), F.timestamp_micros("at").alias("at"), "change")


def write_changes(changes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """The change feed as parts by batch."""
    for key, value in STATE_STORE.items():
        changes.sparkSession.conf.set(key, value)
    return _start(changes, checkpoint, lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/batch={n}"), "update")


def feedback_log(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append-only feedback log with the status that each event gives its lead (null if none)."""

    def work(batch: DataFrame, n: int) -> None:
        batch.withColumn("status", lookup(F.col("event_type"), FEEDBACK_STATUS)).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return _start(events, checkpoint, work)


def running_outcomes(events: DataFrame) -> DataFrame:
    """Events, conversions and negatives per lead as a streaming aggregation."""
    kind = lookup(F.col("event_type"), FEEDBACK_CLASS)
    return events.groupBy("lead_id").agg(F.count("*").alias("events"), F.count_if(kind == "converted").alias("conversions"), F.count_if(kind == "negative").alias("negatives"))


def daily_outcomes(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The same by day with a watermark, so that state stays bounded."""
    kind = lookup(F.col("event_type"), FEEDBACK_CLASS)
    return events.withWatermark("occurred_at", delay).groupBy(F.window("occurred_at", "1 day").alias("day"), "event_type").agg(F.count("*").alias("events"), F.count_if(kind == "converted").alias("conversions"))


def snapshots(aggregated: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """The whole result of a streaming aggregation after each batch; the last part is the current one."""
    return _start(aggregated, checkpoint, lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/batch={n}"), "complete")
