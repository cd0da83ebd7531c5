"""Streams with keyed state: what a stream gives batch by batch is what its whole input gives, and a restart adds nothing."""

import datetime
import random

import pandas as pd

from leadlake.streaming import jobs


def feed(spark, at, schema, k, rows):
    """Write a batch of rows and give the stream over all batches."""
    spark.createDataFrame(rows, schema).write.parquet(f"{at}/in/part{k}")
    return spark.readStream.schema(schema).parquet(f"{at}/in/part*")


def test_landing_keeps_each_content_of_a_source_once(spark, tmp_path):
    rng = random.Random(1)
    seen, schema = set(), "source string, hash string, url string"
    for k in range(3):
        rows = [(rng.choice(["a", "b", None]), "h%d" % rng.randrange(30), "u%d" % i) for i in range(60)]
        before = len(seen)
        seen |= {r[:2] for r in rows}
        for _ in range(2):  # the second run has nothing new to read
            stream = feed(spark, tmp_path, schema, k, rows) if _ == 0 else spark.readStream.schema(schema).parquet(f"{tmp_path}/in/part*")
            jobs.land_documents(stream, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
        got = [(r.source, r.hash) for r in spark.read.parquet(f"{tmp_path}/out").collect()]
        assert len(got) == len(set(got)) and set(got) == seen and len(seen) > before


def test_matching_finds_the_first_holder_of_any_earlier_batch(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, "id%d" % rng.randrange(25) if i % 3 else "hot") for i in range(180)]
    first = {}
    for seq, k in rows:
        first.setdefault(k, seq)
    for k in range(3):
        part = rows[60 * k : 60 * k + 60]
        rng.shuffle(part)
        jobs.match_by_identifier(feed(spark, tmp_path, "seq long, identifier string", k, part), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert {r.seq: r.canonical for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {seq: first[k] for seq, k in rows}


def test_change_feed_equals_the_diff_of_snapshots(spark, tmp_path):
    rng = random.Random(3)
    schema = "lead_id long, score int, note string, at timestamp, gone boolean"
    day = lambda n: datetime.datetime(2026, 1, 1) + datetime.timedelta(n)
    now, want = {}, {}
    for k in range(4):
        rows, before = [], dict(now)
        for i in range(40):
            what = rng.random()
            if what < 0.2:
                now.pop(i, None)
                rows.append((i, None, None, day(k), True))
            elif what < 0.7:
                now[i] = (rng.randrange(3), rng.choice(["x", None]))
                rows.append((i, *now[i], day(k), None if what < 0.4 else False))
                if what < 0.3:
                    rows.append(rows[-1])
        rows += [(i, 99, "late", day(-9), False) for i in before if rng.random() < 0.3]  # older than what is known
        want[k] = {(i, "added" if i not in before else "removed" if i not in now else "changed") for i in set(before) | set(now) if before.get(i) != now.get(i)}
        stream = jobs.change_feed(feed(spark, tmp_path, schema, k, rows), "lead_id", "at", "gone")
        jobs.write_changes(stream, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = {}
    for r in spark.read.parquet(f"{tmp_path}/out").collect():
        got.setdefault((r["at"] - day(0)).days, set()).add((r.lead_id, r.change))
    assert got == {k: x for k, x in want.items() if x}


class Held:
    """A state as Spark gives it to a function."""

    exists, get = False, None

    def update(self, value):
        self.exists, self.get = True, value


def test_keys_share_a_state_and_keep_their_own_history():
    state = Held()
    feed = lambda *rows: [tuple(x) for part in jobs._changed((0,), iter([pd.DataFrame(rows, columns=["key", "at", "sign", "gone"])]), state) for x in part.itertuples(index=False)]
    assert sorted(feed(("a", 1, 5, False), ("b", 1, 5, False), ("c", 1, 5, True))) == [("a", 1, "added"), ("b", 1, "added")]
    assert sorted(feed(("a", 2, 6, False), ("b", 2, 5, True), ("c", 0, 7, False))) == [("a", 2, "changed"), ("b", 2, "removed")]
    state = Held()
    meet = lambda *parts: {r.seq: r.canonical for part in jobs._first_holders((0,), iter([pd.DataFrame(x, columns=["seq", "identifier"]) for x in parts]), state) for r in part.itertuples()}
    assert meet([(4, "x"), (3, "y"), (9, None)], [(2, "x"), (5, "y"), (8, None)]) == {4: 2, 2: 2, 3: 3, 5: 3, 9: 8, 8: 8}
    assert meet([(11, "y"), (12, "x")], [(14, "z"), (13, "z"), (15, "x")]) == {11: 3, 12: 2, 14: 13, 13: 13, 15: 2}
