"""Conversation repair against exhaustive search, a plain layered search and a plain reading of the rules."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from leadlake.llm import conversations as c

LEGAL = re.compile("(s?(ua)+)?")


def every_audit(codes, inserts):
    """Cheapest (cost, audit) by trying all edits with up to so many inserted turns."""
    best = None
    for edits in itertools.product(*(["D"] if x == "x" else ["D", "K", "Ru", "Ra"] for x in codes)):
        for n in range(inserts + 1):
            for places in itertools.combinations_with_replacement(range(len(codes) + 1), n):
                for roles in itertools.product("ua", repeat=n):
                    seq, cost, audit = "", 0, ""
                    for i in range(len(codes) + 1):
                        for p, r in zip(places, roles):
                            if p == i:
                                seq, cost, audit = seq + r, cost + 5, audit + "I"
                        if i < len(codes):
                            e, x = edits[i], codes[i]
                            audit += e[0]
                            if e == "D":
                                cost += 2
                                continue
                            cost += (e != "K") + 5 * (x.isupper() or x == "!")
                            seq += x.lower() if e == "K" else e[1]
                    if LEGAL.fullmatch(seq) and (best is None or (cost, audit) < best):
                        best = (cost, audit)
    return best


def layered(codes):
    """Cheapest (cost, audit) row by row."""
    nxt = {"": "u", "s": "u", "u": "a", "a": "u"}
    at = {"": (0, "")}

    def with_inserts(at):
        for _ in range(3):
            for s, (w, x) in list(at.items()):
                new = (w + 5, x + "I")
                at[nxt[s]] = min(at.get(nxt[s], new), new)
        return at

    for x in codes:
        new = {}

        def put(s, w, audit):
            new[s] = min(new.get(s, (w, audit)), (w, audit))

        for s, (w, audit) in with_inserts(at).items():
            put(s, w + 2, audit + "D")
            if x != "x":
                more = 5 * (x.isupper() or x == "!")
                if x.lower() == "s" and s == "":
                    put("s", w + more, audit + "K")
                if x.lower() == nxt[s]:
                    put(nxt[s], w + more, audit + "K")
                else:
                    put(nxt[s], w + more + 1, audit + "R")
        at = new
    return min(with_inserts(at)[s] for s in ("", "a") if s in at)


def test_cheapest_edits_equal_exhaustive_search():
    rng = random.Random(1)
    for _ in range(150):
        codes = "".join(rng.choices("suaSUA?!x", k=rng.randint(0, 3)))
        assert c.cheapest(codes) == every_audit(codes, 2), codes
    for codes in ("uuuu", "aaaa", "sssa", "auau", "uaua", "suau"):
        assert c.cheapest(codes) == every_audit(codes, 2), codes


def test_search_and_segments_equal_a_layered_search():
    rng = random.Random(2)
    for k in range(800):
        letters = rng.choice(["suaSUA?!x", "ua", "uaUA", "uax", "uauauauas"])
        codes = "".join(rng.choices(letters, k=rng.choice([5, 9, 40, 120])))
        want = layered(codes)
        assert c.cheapest(codes) == want, codes
        size = rng.choice([1, 2, 7, 30])
        assert c.chained([codes[i : i + size] for i in range(0, len(codes), size)]) == want, codes


def plain(rows):
    """conv_id -> the query's other columns, by the rules row by row."""
    blank, last = re.compile(r"[^\x20\x09-\x0D]"), re.compile(r"[.!?][\x20\x09-\x0D]*\Z")
    text_of = lambda v: " " if v is None else str(v)
    convs = {r[0]: [] for r in rows}
    for conv, turn, role, text in rows:
        h = zlib.crc32(f"{text_of(conv)}:{text_of(turn)}".encode()) % 20
        role, text = text_of(role), text_of(text)
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        convs[conv] += [(turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    out = {}
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, codes, faults = set(), "", Counter()
        for _, role, text in own:
            fault = "blank" if not blank.search(text) else "duplicate" if (role, text) in seen else "" if last.search(text) else "truncated"
            seen.add((role, text))
            faults[fault] += 1
            i = role[:1] if role[:1] in ("s", "u", "a") else "?"
            codes += "x" if fault in ("blank", "duplicate") else ("!" if i == "?" else i.upper()) if fault else i
        initials = [r[1][:1] for r in own]
        turns = [r[0] for r in own if r[0] is not None]
        cost, audit = layered(codes)
        state, lines, at = "", [], iter(own)
        for e in audit:
            if e == "D":
                next(at)
                continue
            turn_of = {"": "user", "s": "user", "u": "assistant", "a": "user"}[state]
            role, text = (turn_of, "") if e == "I" else next(at)[1:]
            role = turn_of if e == "R" else role
            lines.append(f"{role}:{text}")
            state = role[0]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out[conv] = (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


@pytest.mark.parametrize("segment", [512, 4])
def test_query_equals_the_rules(spark, tmp_path, monkeypatch, segment):
    monkeypatch.setattr(c, "SEGMENT", segment)
    rng = random.Random(5)
    texts = ["A b.", "What?", "no end", " ", "", None, "x!\n ", "same text.", "y. z", "tab\t.", "é…", "long " * 300 + "."]
    rows = []
    for conv in [*range(60), None, 900, 901]:
        for turn in range(rng.choice([1, 2, 3, 6, 9]) if conv not in (900, 901) else 230):
            t = None if rng.random() < 0.05 else turn + (rng.random() < 0.1) * 5
            role = rng.choice(["user", "assistant"] * 6 + ["system", "tool", None, "", "User"]) if rng.random() < 0.3 else ["user", "assistant"][turn % 2]
            rows.append((conv, t, role, "hot text." if conv == 901 else rng.choice(texts) if rng.random() < 0.4 else f"turn {conv} {turn}{rng.choice(['.', '!', ''])}"))
    rows += [(1000 + k, 0, "user", "only.") for k in range(60)] + rows[:3]
    schema = "conv_id long, turn long, role string, text string"
    spark.createDataFrame(rows, schema).withColumns({"key": F.lit(1), "at": F.lit("x"), "line": F.lit(2)}).repartition(3).write.parquet(f"{tmp_path}/a/conversations.parquet")
    out = c.op11_conversation_repair(spark, f"{tmp_path}/a")
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = out.collect()
    assert len(got) == len({r.conv_id for r in got})
    assert {r.conv_id: tuple(r)[1:] for r in got} == plain(rows)


def test_repaired_lines_are_legal_and_empty_tables(spark, tmp_path):
    rows = [(1, 0, "assistant", "hello."), (1, 1, "assistant", "again."), (2, 0, "system", "s."), (2, 1, "user", "u?")]
    found, lines = c.repair(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"))
    got = defaultdict(list)
    for r in lines.orderBy("key", "line").collect():
        got[r.key].append((r.role, r.text))
    assert {r.key: (r.cost, r.audit) for r in found.collect()} == {"=1": (1, "RK"), "=2": (2, "RR")}
    assert got == {"=1": [("user", "hello."), ("assistant", "again.")], "=2": [("user", "s."), ("assistant", "u?")]}
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/b/conversations.parquet")
    assert c.op11_conversation_repair(spark, f"{tmp_path}/b").count() == 0
