"""Conversation structure repair: the cheapest edits that make a conversation (system) (user assistant)*.

* Rows in order. Rows are sorted by conversation, turn (nulls first), role and text over range partitions, so a long
  conversation is spread over them, and get their places there. A row's fault is the first that holds: blank, duplicate
  (role and text seen earlier in the conversation), truncated.
* Segments. A segment is a conversation's rows within SEGMENT consecutive places, as one code for each row: the role's
  initial and what the fault forbids or costs.
* Edit lattice. A node is (rows consumed, roles so far: none, s, u or a); edges keep, rerole or delete the next row or
  insert a turn. A bidirectional Dijkstra search goes over it: a heap from the start and one from the ends, always the
  cheaper one; from when they meet, all nodes up to the meeting cost are finished, and among the crossings of least cost
  the least concatenated audit is taken. Two audits of equal cost to one node are never one the beginning of the other,
  so the least audits of both halves make the least whole.
* Long conversations. The least cost and audit from every entry to every exit of a segment (at most 16) are found in that
  way, and chained from segment to segment by the same order; what a task holds of a conversation is a few times its
  audit, one letter a row, which is a value of the result, and never its texts.
* Repair. Edits go back to their rows by place. The digest of the repaired text is a serial function of it, so the kept
  lines of a conversation pass through one task, as a stream.

Nulls of role and text are one space, and null ids and turns are one in the key that damage hashes; null ids are a
conversation of their own. Repeated rows are rows. A conversation of which damage leaves nothing gives zeros and empty
values. An empty table gives an empty result. Other columns may have any name.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlake.llm.common import joined_by_key, store, table
from leadlake.session import ship

#: Consecutive places that a segment may hold.
SEGMENT = 512
#: Costs of edits, and of leaving a truncated row.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
_SEEN = "[^\\x20\\x09-\\x0D]"
#: Nodes: nothing so far, a system turn, a user turn, an assistant turn. What may follow each one, but for a system turn at the start.
_NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
_STATES = ("", "s", "u", "a")
_ENDS = ("", "a")


@lru_cache(None)
def _steps(code: str) -> tuple[tuple[str, str, int, str], ...]:
    """Edges over a row: (before, after, cost, edit). A code is the role's initial (s, u, a or ?) as it is, in capitals
    if the row is truncated, and x if it must be deleted."""
    out = [(s, s, DELETE, "D") for s in _STATES]
    if code != "x":
        more, role = (TRUNCATED if code.isupper() or code == "!" else 0), code.lower()
        for s in _STATES:
            if role == "s" and s == "":
                out.append((s, "s", more, "K"))
            out.append((s, _NEXT[s], more, "K") if role == _NEXT[s] else (s, _NEXT[s], more + REROLE, "R"))
    return tuple(out)


def cheapest(codes: str, start: str = "", ends: tuple[str, ...] = _ENDS) -> tuple[int, str] | None:
    """Least cost and, among equals, ASCII-least audit of the edits that lead from `start` before the rows to one of
    `ends` after them; None if there are none."""
    n = len(codes)
    # least (cost, audit) of the nodes finished from either side. Heaps hold (cost, rows still to come, audit, state): the
    # one edge without a cost, keep, leads over a row, so all ways of one cost to a node are there when it is finished.
    done: tuple[dict, dict] = ({}, {})
    heaps = ([(0, 0, "", start)], [(0, 0, "", s) for s in ends])
    least: tuple[int, str] | None = None
    while heaps[0] and heaps[1]:
        if least is not None and heaps[0][0][0] + heaps[1][0][0] > least[0]:
            break  # all crossings of least cost are known
        side = int(heaps[1][0][0] < heaps[0][0][0])
        cost, rows, audit, state = heapq.heappop(heaps[side])
        i = n - rows if side else rows
        if (i, state) in done[side]:
            continue
        done[side][i, state] = cost, audit
        if side:
            near = [(INSERT, "I", i, s) for s in _STATES if _NEXT[s] == state] + [(w, e, i - 1, s) for s, t, w, e in (_steps(codes[i - 1]) if i else ()) if t == state]
        else:
            near = [(INSERT, "I", i, _NEXT[state])] + [(w, e, i + 1, t) for s, t, w, e in (_steps(codes[i]) if i < n else ()) if s == state]
        near.append((0, "", i, state))  # a crossing at the node itself
        for w, e, j, t in near:
            so_far = e + audit if side else audit + e
            if (other := done[1 - side].get((j, t))) is not None:
                whole = cost + w + other[0], other[1] + so_far if side else so_far + other[1]
                least = whole if least is None else min(least, whole)
            if (j, t) not in done[side]:
                heapq.heappush(heaps[side], (cost + w, n - j if side else j, so_far, t))
    return least


def chained(segments: list[str]) -> tuple[int, str]:
    """`cheapest` over all rows of the segments' codes."""
    if len(segments) == 1:
        return cheapest(segments[0])
    at = {"": (0, "")}
    for k, codes in enumerate(segments):
        last, new = k == len(segments) - 1, {}
        for s, (cost, audit) in at.items():
            for t in _ENDS if last else _STATES:
                if (step := cheapest(codes, s, (t,))) is not None:
                    found = (cost + step[0], audit + step[1])
                    new[t] = min(new.get(t, found), found)
        at = new
    return min(at.values())


_ROLES = {"u": "user", "a": "assistant"}


def edited(audit: str, codes: list[tuple[str, int]]) -> Iterator[tuple[int, int, str | None]]:
    """Lines of the repaired conversation: (place, number of the line, role). Role None keeps the row at that place as it
    is, `=role` gives it that role, and `+role` is an inserted line. codes: (codes, first place) of each segment."""
    rows = ((c, first + k) for text, first in codes for k, c in enumerate(text))
    state, line = "", 0
    place = codes[0][1] if codes else 0
    for edit in audit:
        if edit == "I":
            state = _NEXT[state]
            yield place, line, "+" + _ROLES[state]
        else:
            code, place = next(rows)
            if edit == "D":
                continue
            state = "s" if edit == "K" and code in "sS" else _NEXT[state]
            yield place, line, None if edit == "K" else "=" + _ROLES[state]
        line += 1


def damaged(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) after damage by crc32 of `conv_id:turn` modulo 20: 0 drops a row, 1 empties its
    text, 2 removes `.!?` from it, 3 repeats it, 4 makes its role user. Nulls of role and text become one space."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    dealt = rows.select("conv_id", "turn", word("role").alias("role"), word("text").alias("text"), (F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn")).cast("binary")) % 20).alias("_h"))
    text = F.when(F.col("_h") == 1, "").when(F.col("_h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("_h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    kept = dealt.filter("_h <> 0").withColumns({"role": F.when(F.col("_h") == 4, "user").otherwise(F.col("role")), "text": text})
    return kept.withColumn("_copy", F.explode(times)).drop("_h", "_copy")


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows: (conv_id, turn, role, text), role and text not null. Two tables: one row per conversation that has rows (key,
    gaps, blank, duplicate, truncated, illegal, cost, audit), and the repaired conversations (key, line, role, text).
    key is a conversation's id as a string (see conversation_key)."""
    spark = rows.sparkSession
    ship(spark)
    own = rows.select(conversation_key(), "turn", "role", "text", F.md5(F.concat_ws("\u0000", "role", "text").cast("binary")).alias("same"))
    order = ["key", F.col("turn").asc_nulls_first(), "role", "text"]
    # equal rows are equal in everything, so ties are dealt by place: no group of them has to stay together
    dealt = store(own).withColumn("_tie", F.monotonically_increasing_id())
    placed = store(dealt.repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie").drop("_tie").withColumn("at", F.monotonically_increasing_id()))

    repeats = store(placed.groupBy("key", "same").agg(F.min("at").alias("first"), F.count("*").alias("_rows")).filter("_rows > 1"))
    held = repeats.agg(F.sum("_rows")).first()[0] or 0
    again = joined_by_key(placed.select("key", "same", "at"), repeats, ["key", "same"], held).filter("at > first").select("at", F.lit(True).alias("again"))
    blank = ~F.col("text").rlike(_SEEN)
    fault = F.when(blank, "blank").when(F.col("again"), "duplicate").when(~F.col("text").rlike(f"[.!?][\\x20\\x09-\\x0D]*\\z"), "truncated").otherwise("")
    initial = F.substring("role", 1, 1)
    marked = placed.join(again, "at", "left").select("key", "turn", "at", initial.alias("i"), fault.alias("fault"))
    known = F.when(F.col("i").isin("s", "u", "a"), F.col("i")).otherwise("?")
    code = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.when(known == "?", "!").otherwise(F.upper(known))).otherwise(known)
    marked = store(marked.select("key", "turn", "at", "fault", known.alias("i"), code.alias("code")))

    number = lambda name: F.count_if(F.col("fault") == name).alias(name)
    none = F.lit(0).cast("long")
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), none).cast("long").alias("gaps")
    sums = marked.groupBy("key").agg(gaps, number("blank"), number("duplicate"), number("truncated"))
    # at most SEGMENT rows in each of these groups
    segments = marked.groupBy("key", F.shiftright("at", SEGMENT.bit_length() - 1).alias("part")).agg(F.array_sort(F.collect_list(F.struct("at", "code", "i"))).alias("x"))
    letters = lambda c: F.concat_ws("", F.transform("x", lambda r: r[c]))
    short = segments.select("key", F.struct(F.element_at("x", 1)["at"].alias("first"), letters("code").alias("codes"), letters("i").alias("initials")).alias("s"))
    whole = short.groupBy("key").agg(F.array_sort(F.collect_list("s")).alias("s"))  # a few letters for each row

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for name, parts in zip(*(c.to_pylist() for c in batch.columns)):
                cost, audit = chained([p["codes"] for p in parts])
                initials = "".join(p["initials"] for p in parts)
                illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
                lines = [{"at": a, "line": k, "role": r} for a, k, r in edited(audit, [(p["codes"], p["first"]) for p in parts])]
                for column, value in zip(out, (name, illegal, cost, audit, lines)):
                    column.append(value)
            line = pa.list_(pa.struct([("at", pa.int64()), ("line", pa.int64()), ("role", pa.string())]))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.string(), pa.int64(), pa.int64(), pa.string(), line))], names=["key", "illegal", "cost", "audit", "lines"])

    solved = store(whole.mapInArrow(solve, "key string, illegal long, cost long, audit string, lines array<struct<at:long,line:long,role:string>>"))
    lines = solved.select("key", F.inline("lines"))
    kept = lines.filter("role is null or role like '=%'").join(placed.select("at", F.col("role").alias("own"), "text"), "at")
    kept = kept.select("key", "line", F.coalesce(F.substring("role", 2, 20), "own").alias("role"), "text")
    added = lines.filter("role like '+%'").select("key", "line", F.substring("role", 2, 20).alias("role"), F.lit("").alias("text"))
    return sums.join(solved.drop("lines"), "key"), kept.unionByName(added)


def digests(lines: DataFrame) -> DataFrame:
    """(key, sha): SHA-256 of each conversation's `role:text`, newline-joined, as streams in the order of lines."""
    ship(lines.sparkSession)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, sha, done = None, None, ([], [])
        for batch in batches:
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k == name:
                    sha.update(b"\n")
                else:
                    if name is not None:
                        done[0].append(name)
                        done[1].append(sha.hexdigest())
                    name, sha = k, hashlib.sha256()
                sha.update(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in done], names=["key", "sha"])
            done = ([], [])
        if name is not None:
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([sha.hexdigest()])], names=["key", "sha"])

    ordered = lines.repartition("key").sortWithinPartitions("key", "line").select("key", F.concat_ws(":", "role", "text").alias("text"))
    return ordered.mapInArrow(digest, "key string, sha string")


def conversation_key() -> F.Column:
    """A conversation's id as a string that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("-")).alias("key")


def op11_conversation_repair(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found, lines = repair(damaged(rows))
    every = rows.groupBy("conv_id").agg(F.lit(1).alias("_one")).select(conversation_key(), "conv_id")
    numbers, empty = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), hashlib.sha256(b"").hexdigest()
    whole = every.join(found, "key", "left").join(digests(lines), "key", "left")
    return whole.select("conv_id", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in numbers), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.lit(empty)).alias("repaired_sha256"))


# --- the same as SQL: a row of states for each conversation, extended turn by turn ---


def _add(x: str, cost: str | int, edit: str, line: str | None = None) -> str:
    """A state after one more edit; line is the SQL of the turn that it leaves, if any."""
    r = f"{x}.r" if line is None else f"{x}.r || CASE WHEN {x}.r = '' THEN '' ELSE chr(10) END || {line}"
    return f"CASE WHEN {x} IS NOT NULL THEN {{'c': {x}.c + {cost}, 't': {x}.t || '{edit}', 'r': {r}}} END"


def _best(*ways: str) -> str:
    """The cheapest of some states, then the one with the least audit; null ones do not count."""
    return f"list_sort(list_filter([{', '.join(ways)}], lambda w: w IS NOT NULL))[1]"


_PUT = {k: f"'{r}:'" for k, r in _ROLES.items()}


def _over(x: str, to: str) -> str:
    """The row kept or given the role that state `to` wants."""
    own, keep = f"role || ':' || text", f"i = '{to}'"
    turned = f"{_PUT[to]} || text"
    return f"CASE WHEN NOT gone THEN CASE WHEN {keep} THEN {_add(x, 'more', 'K', own)} ELSE {_add(x, 'more + 1', 'R', turned)} END END"


OP11_SQL = rf"""
WITH RECURSIVE bits AS (SELECT n, list_reduce(list_prepend(n, range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS v FROM range(256) b(n)),
tab AS (SELECT list(v ORDER BY n) AS crc FROM bits),
h AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
m AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(k) + 1), lambda j: ascii(substr(k, j, 1))::BIGINT)), lambda x, b: xor(x >> 8, crc[(xor(x, b) & 255) + 1])), 4294967295) % 20 AS m FROM h, tab),
d AS (SELECT conv_id, turn, CASE WHEN m = 4 THEN 'user' ELSE role END AS role, CASE m WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM m, range(2) c(j) WHERE m <> 0 AND (j = 0 OR m = 3)),
o AS (SELECT *, coalesce('=' || conv_id, '-') AS key, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place FROM d),
f AS (SELECT *, substr(role, 1, 1) AS i, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault FROM o),
g AS (SELECT *, fault IN ('blank', 'duplicate') AS gone, CASE fault WHEN 'truncated' THEN 5 ELSE 0 END AS more, coalesce(lag(i) OVER (PARTITION BY conv_id ORDER BY place) || i NOT IN ('su', 'ua', 'au'), false) AS odd FROM f),
n AS (SELECT key, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) AS n, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (odd) AS illegal FROM g GROUP BY key),
s AS (SELECT key, 0::BIGINT AS pos, {{'c': 0::BIGINT, 't': '', 'r': ''}} AS z, NULL::STRUCT(c BIGINT, t VARCHAR, r VARCHAR) AS s, NULL::STRUCT(c BIGINT, t VARCHAR, r VARCHAR) AS u, NULL::STRUCT(c BIGINT, t VARCHAR, r VARCHAR) AS a FROM n
 UNION ALL SELECT key, pos + 1, {_add('z', 2, 'D')}, {_best(_add('s', 2, 'D'), "CASE WHEN NOT gone AND i = 's' THEN " + _add('z', 'more', 'K', "role || ':' || text") + ' END')}, {_best(_add('v', 2, 'D'), _over('z', 'u'), _over('s', 'u'), _over('b', 'u'))}, {_best(_add('b', 2, 'D'), _over('v', 'a'))}
  FROM (SELECT *, {_best('a', _add('v', 5, 'I', _PUT['a']))} AS b FROM (SELECT s.*, {_best('u', *(_add(x, 5, 'I', _PUT['u']) for x in 'zsa'))} AS v, g.role, g.text, g.i, g.gone, g.more FROM s JOIN g ON g.key = s.key AND g.place = s.pos + 1))),
e AS (SELECT key, {_best('z', 'b')} AS w FROM (SELECT *, {_best('a', _add('v', 5, 'I', _PUT['a']))} AS b FROM (SELECT s.*, {_best('u', *(_add(x, 5, 'I', _PUT['u']) for x in 'zsa'))} AS v FROM s JOIN n ON n.key = s.key AND n.n = s.pos)))
SELECT c.conv_id, coalesce(n.gaps, 0) AS gaps, coalesce(n.blank, 0) AS blank, coalesce(n.duplicate, 0) AS duplicate, coalesce(n.truncated, 0) AS truncated, coalesce(n.illegal, 0) AS illegal, coalesce(e.w.c, 0) AS cost, coalesce(e.w.t, '') AS audit, sha256(coalesce(e.w.r, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN n ON n.key = coalesce('=' || c.conv_id, '-') LEFT JOIN e ON e.key = n.key
"""

QUERIES = {"op11_conversation_repair": op11_conversation_repair}
ORACLES = {"op11_conversation_repair": OP11_SQL}
