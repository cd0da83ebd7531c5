"""Matching against sequential versions and known cases."""

import collections
import datetime
import hashlib
import itertools
import math
import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from leadlake.functions import text as tx
from leadlake.functions import values as v
from leadlake.operators import joins
from leadlake.operators import matching as m
from leadlake.session import checkpointed


def fold(edges, n):
    """The sequential loop: link to the best earlier canonical item, or become one."""
    near = {}
    for a, b, c in edges:
        near.setdefault(b, []).append((c, -a))
    canonical, out = set(), {}
    for i in range(n):
        best = max(((c, a) for c, a in near.get(i, []) if -a in canonical), default=None)
        if best is None:
            canonical.add(i)
        out[i] = i if best is None else -best[1]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_leaders_equal_the_sequential_loop(spark, seed):
    rng = random.Random(seed)
    n = 80
    edges = {(min(p), max(p)): rng.choice([0.9, 0.98]) for p in (rng.sample(range(n), 2) for _ in range(110))}
    edges = [(a, b, c) for (a, b), c in edges.items()]
    got = m.leaders(spark.range(n).withColumnRenamed("id", "seq"), spark.createDataFrame(edges, "a long, b long, confidence double"))
    assert {r.seq: r.canonical for r in got.collect()} == fold(edges, n)


def test_leaders_with_earlier_canonicals(spark):
    edges = spark.createDataFrame([(1, 10, 0.98), (10, 11, 0.9)], "a long, b long, confidence double")
    old = spark.createDataFrame([(1,)], "seq long")
    got = m.leaders(spark.createDataFrame([(10,), (11,)], "seq long"), edges, old)
    assert {r.seq: r.canonical for r in got.collect()} == {10: 1, 11: 11}


REPORTS = [
    (1, "GEM/2026/B/123", "Ministry of X", "Acme Ltd", 1_000_000, "2026-08-01"), (2, "gem 2026 b 123", "Other", "Else", 5, "2020-01-01"),
    (3, None, "Ministry of Y", "Beta Ltd", 1_000_000, "2026-08-01"), (4, None, "ministry of y", "BETA LTD", 1_000_005, "2026-08-02"),
    (5, None, "Ministry of Y", "Beta Ltd", 5_000_000, "2026-08-01"), (6, None, "Ministry of Z", "Gamma", None, None), (7, None, "Ministry of Z", "Gamma", None, None),
]


def test_event_matches(spark):
    r = spark.createDataFrame(REPORTS, "report_id long, reference string, buyer string, company string, value long, event_date string").withColumn("event_date", F.to_date("event_date"))
    p = m.fingerprints(r)
    assert [(x.a, x.b) for x in m.identifier_edges(p).collect()] == [(1, 2)]
    assert [(x.a, x.b) for x in m.composite_edges(p).collect()] == [(3, 4)]
    links = m.canonicalise(p)
    assert sum(x.sources for x in m.canonical_events(r, links).collect()) == len(REPORTS)


COMPANIES = [
    (1, "M/s Bharat Electronics Pvt Ltd", None, None, None, "https://www.bel.example/x", None, "KA"), (2, "BHARAT ELECTRONICS LIMITED", None, None, None, None, None, "KA"),
    (3, "Bharat Electronics", "C9", None, None, None, None, "KA"), (4, "Bharat Electronics", "C8", None, None, None, None, "KA"), (5, "Bharath Electronics", None, None, None, None, None, None),
    (6, "Limited", None, None, None, None, None, None), (7, "Pvt Ltd", None, None, None, None, None, None),
]


def test_companies(spark):
    f = m.company_forms(spark.createDataFrame(COMPANIES, "obs_id long, raw_name string, cin string, gstin string, pan string, website string, city string, state string"))
    got = {r.obs_id: r.company_id for r in m.resolve(f).collect()}
    assert got[1] == got[2] == got[3] == 1 and got[4] == 4 and got[5] == 5 and got[6] != got[7]
    assert {(r.a, r.b) for r in m.conflicts(f).collect()} == {(3, 4), (4, 3)}


def plain_resolve(rows):
    """The fold over all companies made so far, one by one."""
    made, out = [], {}
    for r in rows:
        best, how = None, 0.0
        for c in made:
            if any(r[k] and c[k] and r[k] != c[k] for k in ("cin", "gstin", "pan")):
                continue
            conf = max((w for k, w in m.KEYS if r[k] and r[k] == c[k]), default=0.0)
            if not conf and r["core"] and (r["core"] == c["core"] or r["full"] in c["aliases"]):
                near = any(r[k] and r[k] == c[k] for k in ("city", "state"))
                conf = 0.92 if near else 0.85
            if conf > how:
                best, how = c, conf
        if best is None:
            best = dict(r, aliases=set(), id=r["obs_id"])
            made.append(best)
        best["aliases"].add(r["full"])
        for k in ("cin", "gstin", "pan", "domain", "city", "state"):
            best[k] = best[k] or r[k]
        out[r["obs_id"]] = (best["id"], how or None)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_company_fold_equals_the_plain_loop(seed):
    rng = random.Random(seed)
    pick = lambda x, share: rng.choice(x) if rng.random() < share else None
    rows = [
        {"obs_id": i, "core": (core := pick(["a", "b", "c", "d"], 0.9)), "full": f"{core} {rng.choice(['ltd', 'pvt', 'a'])}", "cin": pick("123", 0.3), "gstin": pick("45", 0.2), "pan": pick("67", 0.2),
         "domain": pick(["x.example", "portal.example"], 0.5), "city": pick(["p", "q"], 0.5), "state": pick(["s", "t"], 0.6)}
        for i in range(250)
    ]
    made = m._Companies()
    assert {r["obs_id"]: m._fold(made, r) for r in rows} == plain_resolve(rows)


def test_a_portal_that_all_share_is_folded_whole(spark):
    """A third of all rows under one domain: no row is paired with another, none is refused."""
    rows = spark.range(3000).selectExpr("id AS obs_id", "concat('Firm ', id) AS raw_name", "concat('C', id) AS cin", "CAST(NULL AS string) AS gstin", "CAST(NULL AS string) AS pan", "'portal.example' AS website", "CAST(NULL AS string) AS city", "'KA' AS state")
    f = m.company_forms(rows)
    assert m.resolve(f).filter("obs_id <> company_id").count() == 0
    assert {(r.kind, r.block, r.holders) for r in m.candidates(f).collect()} == {("domain", 0, 3000)} and m.key_matches(f).count() == 0


def pairs_of(rows):
    """Every earlier a of every b that conflicts in no registration id."""
    for b in rows:
        for a in rows:
            if a["obs_id"] < b["obs_id"] and not any(a[k] and b[k] and a[k] != b[k] for k in m.IDS):
                yield a, b


def best_of(found):
    """b -> (confidence, earliest a) of (a, b, confidence)."""
    out = {}
    for a, b, c in found:
        out[b] = max(out.get(b, (0, 0)), (c, -a))
    return {b: (c, -a) for b, (c, a) in out.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_company_matches_equal_all_pairs(spark, seed):
    """Best matches, conflicts and candidate blocks against every pair, over rows whose compatibility is not transitive."""
    rng = random.Random(seed)
    pick = lambda x, share: rng.choice(x) if rng.random() < share else None
    rows = [
        {"obs_id": i, "core": pick(["a", "b", "c", "hot"], 0.9), "full": pick(["f", "g"], 0.5), "cin": pick("123", 0.4), "gstin": pick("45", 0.3), "pan": pick("67", 0.2), "domain": pick(["x.example", "portal.example"], 0.5),
         "city": pick(["p", "q", "r"], 0.5), "state": pick(["s", "t"], 0.5)}
        for i in range(150)
    ]
    f = spark.createDataFrame(rows, "obs_id long, core string, full string, cin string, gstin string, pan string, domain string, city string, state string")
    keys = best_of((a["obs_id"], b["obs_id"], c) for a, b in pairs_of(rows) for k, c in m.KEYS if a[k] and a[k] == b[k])
    assert {r.b: (r.confidence, r.a) for r in m.key_matches(f).collect()} == keys
    names = best_of((a["obs_id"], b["obs_id"], 0.92 if any(a[k] and a[k] == b[k] for k in ("city", "state")) else 0.85) for a, b in pairs_of(rows) if a["core"] and a["core"] == b["core"])
    assert {r.b: (r.confidence, r.a) for r in m.name_matches(f).collect()} == names and {c for c, _ in names.values()} == {0.85, 0.92}
    differ = {(min(x for x in own), b["obs_id"]) for b in rows for k in m.IDS if (own := [a["obs_id"] for a in rows if a["core"] and a["core"] == b["core"] and a[k] and b[k] and a[k] != b[k]])}
    assert {(r.a, r.b) for r in m.conflicts(f).collect()} == differ
    blocks = collections.defaultdict(set)
    for r in m.candidates(f).collect():
        blocks[r.kind, r.block].add(r.obs_id)
        assert r.holders == sum(x[r.kind] is not None and x[r.kind] == rows[r.block][r.kind] for x in rows)
    shared = {(a, b) for x in blocks.values() for a in x for b in x if a < b}
    assert shared == {(a["obs_id"], b["obs_id"]) for a in rows for b in rows if a["obs_id"] < b["obs_id"] and any(a[k] is not None and a[k] == b[k] for k in m.BLOCKS)}


def test_rows_that_only_later_holders_match(spark):
    """Four rows of one core name: the third conflicts with the first holder of the domain, the second is its match."""
    rows = [(1, "Acme Infra", "CINA", "a.example", "Pune", "MH"), (2, "Acme Infra", None, "a.example", "Delhi", None), (3, "Acme Infra", "CINB", "a.example", "Delhi", None), (4, "Acme Infra", "CINA", None, "Delhi", None)]
    cols = "obs_id long, raw_name string, cin string, website string, city string, state string"
    f = m.company_forms(spark.createDataFrame(rows, cols).withColumns({"gstin": F.lit(None).cast("string"), "pan": F.lit(None).cast("string")}))
    assert {(r.a, r.b, r.kind) for r in m.key_matches(f).collect()} == {(1, 2, "domain"), (2, 3, "domain"), (1, 4, "cin")}
    assert {(r.a, r.b, r.confidence) for r in m.name_matches(f).collect()} == {(1, 2, 0.85), (2, 3, 0.92), (2, 4, 0.92)}
    assert {(r.a, r.b) for r in m.conflicts(f).collect()} == {(3, 1), (1, 3), (3, 4)}


def test_two_cities_in_one_state_are_one_place(spark):
    rows = [(1, "Acme Infra", "Pune", " MH "), (2, "Acme Infra", "Nagpur", "mh"), (3, "Beta", "", ""), (4, "Beta", "", "")]
    f = m.company_forms(spark.createDataFrame(rows, "obs_id long, raw_name string, city string, state string").withColumns({k: F.lit(None).cast("string") for k in ("cin", "gstin", "pan", "website")}))
    assert {(r.a, r.b, r.confidence) for r in m.name_matches(f).collect()} == {(1, 2, 0.92), (3, 4, 0.85)}
    assert {r.obs_id: (r.company_id, r.confidence) for r in m.resolve(f).collect()} == {1: (1, None), 2: (1, 0.92), 3: (3, None), 4: (3, 0.85)}


def test_components_of_chains_and_stars(spark):
    rng = random.Random(7)
    ties = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 160)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    root = {x: x for t in ties for x in t}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in ties:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.id: r.component for r in joins.components(spark.createDataFrame(ties, "a long, b long")).collect()}
    assert got == {x: find(x) for t in ties for x in t if t[0] != t[1]}


def plain_events(reports, texts):
    """The sequential pass over all canonical reports so far."""
    def cosine(a, b):
        va, vb = (collections.Counter(int(hashlib.md5(t.encode()).hexdigest()[-2:], 16) % 128 for t in re.split("[^a-z0-9]+", x.lower()) if t) for x in (a or "", b or ""))
        size = math.sqrt(sum(x * x for x in va.values())) * math.sqrt(sum(x * x for x in vb.values()))
        return sum(va[k] * vb[k] for k in va) / size if size else 0.0

    ratio = lambda a, b: SequenceMatcher(None, a, b).ratio() if a and b else 0.0
    norm = lambda x: re.sub("[^a-z0-9]+", " ", x.lower()).strip() or None if x else None
    ident = lambda x: re.sub("[^A-Za-z0-9]", "", x).upper() if x else None
    seen, out = [], {}
    for seq, ref, buyer, company, value, day in reports:
        me = (seq, ident(ref), norm(buyer), norm(company), value, day)
        best = (0.0, None)
        for other in seen:
            conf = 0.0
            if me[1] and me[1] == other[1]:
                conf = 0.98
            elif me[2] and me[3] and me[2:4] == other[2:4] and (None not in (me[4], other[4]) or None not in (me[5], other[5])) and (None in (me[4], other[4]) or abs(me[4] - other[4]) <= 0.02 * max(abs(me[4]), abs(other[4]))) and (None in (me[5], other[5]) or abs((me[5] - other[5]).days) <= 3):
                conf = 0.9
            elif texts[seq] and texts[other[0]] and cosine(texts[seq], texts[other[0]]) >= 0.86 and max(ratio(me[3], other[3]), ratio(me[2], other[2])) >= 0.6:
                conf = 0.85
            if conf > best[0]:
                best = (conf, other[0])
        if best[1] is None:
            seen.append(me)
        out[seq] = (best[1] or seq, best[0] or None)
    return out


def random_reports(seed, n=120):
    rng = random.Random(seed)
    day = datetime.date(2026, 1, 1)
    buyers, names = ["Ministry of X", "Ministry of Y", "Rail Board", None], ["Acme Ltd", "Acme Limited", "Beta", "Zeta Infra", None]
    words = "road bridge water supply metro rail phase one two three digital".split()
    reports = [(i, rng.choice([None, None, "A/1", "a 1", "B-2", f"R{i}"]), rng.choice(buyers), rng.choice(names), rng.choice([None, 0, 100, 101, 102, 103, 5000]), rng.choice([None, day + datetime.timedelta(rng.randrange(20))])) for i in range(1, n)]
    base = [" ".join(rng.choices(words, k=9)) for _ in range(12)]
    return reports, {i: rng.choice([None, "", rng.choice(base), rng.choice(base) + " " + rng.choice(words), " ".join(rng.choices(words, k=6))]) for i in range(1, n)}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_canonical_events_equal_the_sequential_pass(spark, seed):
    reports, texts = random_reports(seed)
    r = spark.createDataFrame(reports, "report_id long, reference string, buyer string, company string, value long, event_date date")
    p = m.fingerprints(r)
    t = spark.createDataFrame(list(texts.items()), "seq long, text string")
    want = plain_events(reports, texts)
    got = m.canonicalise(p, t)
    assert {x.seq: (x.canonical, x.confidence) for x in got.collect()} == want
    companies = spark.createDataFrame([(i, 10 * i) for i in range(3, 120)], "seq long, company_id long")
    events = m.canonical_events(r, got, companies).collect()
    assert sum(x.sources for x in events) == len(reports) and {x.canonical for x in events} == {c for c, _ in want.values()}
    assert all(x.company_id == min(10 * i for i, (c, _) in want.items() if c == x.canonical and i >= 3) for x in events if any(c == x.canonical and i >= 3 for i, (c, _) in want.items()))


def test_pair_counts_and_stars_of_events(spark):
    reports, _ = random_reports(4)
    r = spark.createDataFrame(reports, "report_id long, reference string, buyer string, company string, value long, event_date date")
    p = checkpointed(m.fingerprints(r))
    rows = {x.seq: x for x in p.collect()}
    same = lambda a, b: any(x is not None and x == y for x, y in ((a.event_date, b.event_date), (a.company, b.company), ((a.identifiers or [None])[0], (b.identifiers or [None])[0])))
    for x in m.candidate_counts(p).collect():
        near = [s for s, y in rows.items() if s != x.seq and same(rows[x.seq], y)]
        assert (x.candidates, x.first) == (len(near), min([*near, x.seq]))
    want = set()
    for a in rows.values():
        for b in rows.values():
            if a.seq < b.seq and a.buyer and a.company and (a.buyer, a.company) == (b.buyer, b.company):
                v_, d_ = None not in (a.value, b.value), None not in (a.event_date, b.event_date)
                if (v_ or d_) and (not v_ or abs(a.value - b.value) <= 0.02 * max(a.value, b.value)) and (not d_ or abs((a.event_date - b.event_date).days) <= 3):
                    want.add((a.seq, b.seq))
    # representatives and their classes stand for all pairs
    shape = lambda r: (r.buyer, r.company, r.value, r.event_date)
    first = {}
    for r in sorted(rows.values(), key=lambda r: r.seq):
        first.setdefault(shape(r), r.seq)
    links = {(x.a, x.b) for x in m.composite_edges(p).collect()}
    near = lambda a, b: first[shape(rows[a])] == first[shape(rows[b])] or tuple(sorted((first[shape(rows[a])], first[shape(rows[b])]))) in links
    assert {(a, b) for a, b in want if not near(a, b)} == set() and links <= want
    assert {(a, b) for a in rows for b in rows if a < b and rows[a].buyer and rows[a].company and (rows[a].value is not None or rows[a].event_date is not None) and near(a, b)} == want
    best = {x.b: (x.confidence, -x.a) for x in sorted(m.identifier_edges(p).collect(), key=lambda x: -x.a)}
    for a, b in want:
        best[b] = max(best.get(b, (0, 0)), (0.9, -a))
    assert {x.seq: (x.confidence, -x.best) for x in m.best_matches(p).collect()} == best


def test_equal_reports_give_linear_output(spark):
    r = spark.range(30_000).selectExpr("id AS report_id", "CAST(NULL AS string) AS reference", "'Rail Board' AS buyer", "'Acme' AS company", "CAST(100 AS long) AS value", "DATE'2026-01-01' AS event_date")
    p = m.fingerprints(r)
    assert m.composite_edges(p).count() == 29_999
    assert m.canonicalise(p).filter("canonical <> 0").count() == 0


def test_alike_texts_equal_brute_force(spark):
    """Candidates by two rare buckets against every pair, with texts of one token and of tokens repeated very often."""
    rng = random.Random(11)
    words = ["w%d" % k for k in range(25)]
    texts = list(dict.fromkeys(" ".join(rng.choices(words, k=rng.choice([1, 2, 3, 6, 12]))) for _ in range(120)))
    texts += [t + " " + rng.choice(words) for t in texts[:60]] + ["w1 " * 9 + "w2", "w1 " * 9 + "w3", "w1 w1", "w1 " * 5]
    texts = list(dict.fromkeys(texts))
    classes = spark.createDataFrame([("%04d" % k, k, "Acme", None, t) for k, t in enumerate(texts)], "k string, seq long, company string, buyer string, text string")
    got = {(r.k, r.k2) for r in m.semantic_links(classes).collect()}
    vec = [collections.Counter(int(hashlib.md5(w.encode()).hexdigest()[-2:], 16) % 128 for w in t.split()) for t in texts]
    size = [math.sqrt(sum(x * x for x in a.values())) for a in vec]
    cos = lambda i, j: sum(vec[i][b] * vec[j][b] for b in vec[i]) / (size[i] * size[j])
    assert got == {("%04d" % i, "%04d" % j) for i in range(len(texts)) for j in range(len(texts)) if i != j and cos(i, j) >= 0.86} and len(got) > 40


def test_similar_names_with_frequent_trigrams(spark):
    """The shared trigrams are the most frequent ones, so only a long enough prefix holds them."""
    rows = [(1, "abcdefghi"), (2, "abcxdefyghi")] + [(10 + k, x + "%05d" % k) for k, x in enumerate(["abcq", "defq", "ghiq"] * 40)]
    got = {(r.a, r.b) for r in m.fuzzy_pairs(spark.createDataFrame(rows, "id long, name string")).collect()}
    assert (1, 2) in got


def test_fuzzy_pairs_equal_brute_force(spark):
    rng = random.Random(3)
    names = ["".join(rng.choices("abcdefgh ", k=rng.randrange(3, 22))).strip() or "abc" for _ in range(60)]
    for x in names[:40]:
        k = rng.randrange(len(x))
        names.append(x[:k] + rng.choice("xyz") + x[k + rng.randrange(2) :])
    rows = list(enumerate(dict.fromkeys(names)))
    got = {(r.a, r.b) for r in m.fuzzy_pairs(spark.createDataFrame(rows, "id long, name string")).collect()}
    want = {(i, j) for i, a in rows for j, b in rows if i < j and SequenceMatcher(None, b, a).ratio() >= 0.9 and 2 * min(len(a), len(b)) >= 0.9 * (len(a) + len(b))}
    assert got == want


def test_text_forms(spark):
    row = spark.range(1).select(
        tx.company_core(F.lit("M/s. The Acme  Infra Pvt. Ltd.")).alias("core"), tx.domain(F.lit("WWW.Acme.example/x?y")).alias("domain"), tx.identifier(F.lit(" ab-1/2 ")).alias("id"),
        tx.seniority(F.lit("Director")).alias("s1"), tx.seniority(F.lit("Director"), word_boundary=True).alias("s2"), tx.number_tokens(F.lit("₹50.0 crore on 2026-08-01 and 1,200")).alias("n"),
        v.value_text(F.lit(25_000_000), F.lit("INR")).alias("v1"), v.value_text(F.lit(1500), F.lit("usd")).alias("v2"), v.feed_date(F.lit("Fri, 07 Aug 2026 10:00:00 GMT")).cast("string").alias("d"),
        v.authority(F.lit("https://user@x.gem.gov.in:8443/a")).alias("a1"), v.authority(F.lit(None).cast("string")).alias("a2"), v.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("c"),
    ).first()
    assert (row.core, row.domain, row.id, row.s1, row.s2) == ("acme infra", "acme.example", "AB12", "c_level", "director")
    assert "1200" in row.n and "50cr" in row.n
    assert (row.v1, row.v2, row.d, row.a1, row.a2, row.c) == ("₹2.5 cr", "1,500 USD", "2026-08-07", 1.0, 1.0, 0.0)


def test_name_ratio_is_that_of_whole_names(spark):
    rows = [("acme infra ltd", "acme infra limited"), ("a", None), (None, "a"), ("", ""), ("bharat", "bharath")]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", m.name_ratio(F.col("a"), F.col("b")).alias("r")).collect()
    assert all(x.r == (None if None in (x.a, x.b) else SequenceMatcher(None, x.a, x.b).ratio()) for x in got)


def test_composite_cells_repeat_few_rows_and_lose_no_pair(spark):
    """Values and days on both sides of the edges of cells; the rows that enter the join grow by less than half."""
    rng = random.Random(3)
    day = datetime.date(2026, 1, 1)
    rows = [(i, "R", "B", "Acme", rng.choice([None, 0, *(int(1000 * 1.004**k) for k in range(120))]), rng.choice([None, *(day + datetime.timedelta(k) for k in range(100))])) for i in range(400)]
    r = spark.createDataFrame(rows, "report_id long, reference string, buyer string, company string, value long, event_date date")
    _, first = m.composite_classes(m.fingerprints(r))
    x = first.collect()
    close = lambda p, q: p is None or q is None or abs(p - q) <= 0.02 * max(p, q)
    near = lambda p, q: p is None or q is None or abs((p - q).days) <= 3
    some = lambda p, q: None not in (p.value, q.value) or None not in (p.event_date, q.event_date)
    want = sorted((p.a, q.a) for p in x for q in x if p.a < q.a and some(p, q) and close(p.value, q.value) and near(p.event_date, q.event_date))
    assert sorted((t.a, t.b) for t in m.composite_links(first).collect()) == want and len(want) > 500
    assert (1 + 3 / m.DAYS) * (1 + 2 / m.BANDS) < 1.5  # each row stood in nine bands before


def test_texts_of_one_embedding_are_linked_without_comparing_names_that_are_equal(spark, monkeypatch):
    """Twenty-four orders of the same words are one embedding; they have one buyer, so no name is compared."""
    names = [" ".join(x) for x in itertools.permutations(("alpha", "beta", "gamma", "delta"))]
    rows = [(k, n, n, "one buyer") for k, n in enumerate(names)] + [(99, "other words", "other words here", "one buyer")]
    classes = spark.createDataFrame(rows, "k long, company string, text string, buyer string")
    monkeypatch.setattr(m, "name_ratio", lambda a, b: F.when(a.isNotNull(), F.raise_error(F.lit("compared")).cast("double")))
    got = {(r.k, r.k2) for r in m.semantic_pairs(classes).collect()}
    assert got == {(a, b) for a in range(len(names)) for b in range(a + 1, len(names))}


def test_equal_names_are_not_compared(spark, monkeypatch):
    """Pairs with an equal company or buyer link by that; only the others are handed to the comparison of names."""
    handed = lambda a, b: F.when(a.isNull() | b.isNull() | (a == b), F.raise_error(F.lit("an equal name was handed over")).cast("double")).otherwise(F.lit(0.7) * (F.left(a, F.lit(1)) == F.left(b, F.lit(1))).cast("double"))
    monkeypatch.setattr(m, "name_ratio", handed)
    rows = [("k1", "acme", "north", "road works alpha"), ("k2", "acme", "south", "road works alpha"), ("k3", "beta", "north", "road works alpha"), ("k4", "axis", "east", "works road alpha"), ("k5", "zeta", "west", "alpha works road"), ("k6", "acme", "north", "ships")]
    classes = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "seq long, k string, company string, buyer string, text string")
    got = sorted((r.k, r.k2) for r in m.semantic_pairs(classes).collect())
    first = {r[0]: (r[1][0], r[2][0]) for r in rows}
    names = {r[0]: r[1:3] for r in rows}
    alike = [(a, b) for a in first for b in first if a < b < "k6"]
    linked = lambda a, b: any(x == y for x, y in zip(names[a], names[b])) or any(x == y for x, y in zip(first[a], first[b]))
    assert got == sorted(p for p in alike if linked(*p)) and 0 < len(got) < len(alike)
