"""Corpus operators against plain versions, with nulls, empty tables, repeated rows and clashing columns."""

import collections
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from leadlake.llm import embedding_dedup, jaccard_join, langid, line_dedup, mixing, quality, toxicity
from leadlake.llm.common import bounded_sample, components

SPLIT = re.compile(r"[\x20\x09-\x0D]+")


def plain_words(t):
    return [w for w in SPLIT.split(t or "") if w]


def odd_docs(spark, texts):
    """Documents with repeated rows and columns whose names the operators use inside."""
    rows = [(i, t, "src%d" % (i % 3)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows + rows[:2], "doc_id long, text string, source string")
    return df.withColumns({"id": F.lit(7), "n": F.lit("x"), "c": F.lit(1), "w": F.lit(2), "th": F.lit(3), "label": F.lit(4)})


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    vocab = ["w%d" % k for k in range(400)]
    texts = [None, "", " \n\t ", "one two", "one  two", "a b c d e f", "A B c d e f g"]
    texts += [" ".join(rng.choices(vocab, k=rng.choice([3, 20, 60, 200]))) for _ in range(n)]
    for t in [x for x in texts if x and len(x) > 300][:15]:  # near copies, and copies of copies
        w = t.split()
        for _ in range(3):
            w = list(w)
            w[rng.randrange(len(w))] = rng.choice(vocab)
            texts.append(" ".join(w))
    texts += [texts[10]] * 5 + ["x " * 30_000 + "end"]
    return texts


def reach(n, pairs):
    root = list(range(n))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def shingles(t):
    w = plain_words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_jaccard(texts):
    s = [shingles(t) for t in texts]
    pairs = [(i, j) for i in range(len(s)) for j in range(i) if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 75 * len(s[i] | s[j])]
    return {i: (len(s[i]), c) for i, c in enumerate(reach(len(s), pairs))}


@pytest.mark.parametrize("short, block", [(64, 512), (1, 3)])
def test_jaccard_join_equals_all_pairs(spark, monkeypatch, short, block):
    monkeypatch.setattr(jaccard_join, "SHORT", short)  # 1: all lists take the way of long ones, in many blocks
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    texts = corpus()
    out = jaccard_join.join(odd_docs(spark, texts)).collect()
    assert len(out) == len(texts) + 2
    want = plain_jaccard(texts)
    assert all(want[r.doc_id] == (r.n_shingles, r.component_id) for r in out)


@pytest.mark.parametrize("short, seed", [(64, 1), (2, 2), (2, 3)])
def test_jaccard_join_of_templates_of_many_lengths(spark, monkeypatch, short, seed):
    """Parts of one template with own words on either side: similarities all around 0.75, between sets of all sizes."""
    monkeypatch.setattr(jaccard_join, "SHORT", short)
    rng = random.Random(seed)
    template = ["t%d" % k for k in range(120)]
    texts = []
    for k in range(140):
        a, b = rng.choice([0, 0, rng.randrange(20)]), rng.choice([0, 0, rng.randrange(25)])
        own = ["o%d_%d" % (k if rng.random() < 0.8 else k // 5, j) for j in range(rng.choice([0, 1, 5, 10, 14, 15, 16, 17, 25, 40]))]
        words = template[a : 120 - b]
        texts.append(" ".join(own + words if rng.random() < 0.5 else words + own))
    out = jaccard_join.join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    want = plain_jaccard(texts)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == want and 5 < len({c for _, c in want.values()}) < 135


def test_templates_that_do_not_link_make_no_blocks(spark, monkeypatch):
    """160 words of a template and 40 own ones: every pair is at 0.66, and no list of the template's shingles is left."""
    template = " ".join("t%d" % k for k in range(160))
    texts = [template + " " + " ".join("o%d_%d" % (k, j) for j in range(40)) for k in range(600)]
    texts += [" ".join(texts[k].split()[:-2]) for k in range(20)]
    made, blocks, checked = [], jaccard_join._blocks, jaccard_join._checked
    monkeypatch.setattr(jaccard_join, "_blocks", lambda groups, sets: made.append(groups.count()) or blocks(groups, sets))
    monkeypatch.setattr(jaccard_join, "_checked", lambda pairs, sets: made.append(pairs.count()) or checked(pairs, sets))
    out = jaccard_join.join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert made[0] == 0 and sum(made) <= 40
    assert all(r.component_id == (r.doc_id - 600 if r.doc_id >= 600 else r.doc_id) for r in out)


def test_quality_counts_every_trusted_row(spark):
    """Where all of 10,400 rows are trusted, the target is the raw corpus and no word weighs anything."""
    docs = spark.range(10_400).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.col("id") % 997, F.lit(" x")).alias("text"))
    assert set(quality.learn(docs, docs.select("doc_id")).weights) == {0.0}
    scores = np.random.default_rng(1).normal(size=30_000).round(3)
    got = quality.quantiles(spark.createDataFrame([(float(x),) for x in scores], "s double"), (0.001, 0.5, 1.0))
    assert np.allclose(got, np.quantile(scores, [0.001, 0.5, 1.0]), atol=1e-12)


def shuffled(spark, work):
    """Bytes that the stages of some work shuffle."""
    j = spark._jvm.java.util.ArrayList
    none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    listed = lambda: spark.sparkContext._jsc.sc().statusStore().stageList(j(), False, False, none, j())
    every = lambda q: {(q.apply(i).stageId(), q.apply(i).attemptId()): q.apply(i).shuffleWriteBytes() for i in range(q.size())}
    before = every(listed())
    work()
    return sum(n for k, n in every(listed()).items() if k not in before)


def test_quality_finds_trusted_texts_without_shuffling_them(spark, monkeypatch):
    """Even where Spark would not broadcast, in several bands, for numbers below zero and for ids that are no numbers."""
    docs = spark.range(-700, 700).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *(F.sha2(F.concat("id", F.lit(f"-{k}")), 512) for k in range(40))).alias("text")).localCheckpoint()
    good = docs.filter("doc_id % 3 = 0").select("doc_id")
    want = quality.learn(docs, good)
    monkeypatch.setattr(quality, "BAND", 12, raising=False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = []
        assert shuffled(spark, lambda: got.append(quality.learn(docs, good))) < 2_000_000  # the texts take 2.9 MB in a shuffle; counts of buckets move
        named = lambda df: df.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
        monkeypatch.setattr(quality, "BAND", 240, raising=False)
        got.append(quality.learn(named(docs), named(good)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert all(r.weights == want.weights and abs(r.least - want.least) < 1e-12 for r in got) and any(want.weights)


def test_shingles_are_shuffled_a_band_at_a_time(spark):
    """The bands share the prefix shingles out, none of them holds half, and together they give the lists of all at once; the
    checks get texts, not sets."""
    rng = random.Random(7)
    texts = [" ".join(rng.choice(["a", "b", "c", "d", "e"]) for _ in range(60)) for _ in range(60)]
    texts += [t + " e" for t in texts[:30]] + [texts[0], None, " "]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    counts = spark.sparkContext.broadcast(np.zeros(jaccard_join.BUCKETS, np.int64))
    whole = [tuple(r) for r in jaccard_join.prefixes(docs, counts).collect()]
    parts = [[tuple(r) for r in jaccard_join.prefixes(docs, counts, k, jaccard_join.BANDS).collect()] for k in range(jaccard_join.BANDS)]
    assert jaccard_join.BANDS > 1 and sorted(sum(parts, [])) == sorted(whole) and all(0 < len(x) < len(whole) / 2 for x in parts)
    lists = sorted(tuple(r) for r in jaccard_join.prefix_lists(docs, counts).collect())
    assert lists and sorted(tuple(r) for k in range(jaccard_join.BANDS) for r in jaccard_join.prefix_lists(docs, counts, k, jaccard_join.BANDS).collect()) == lists
    assert sorted(r.text for r in jaccard_join.set_rows(docs).select("text").collect()) == sorted(t for t in texts if t and t.strip())


def test_vectors_of_any_magnitude_and_many_lengths(spark, monkeypatch):
    """Squares of these components over- or underflow; only zero and non-finite vectors link with nothing."""
    rows = [(0, [1e200, 0.0]), (1, [1e200, 1.0]), (2, [-1e-200, 0.0]), (3, [-2e-200, -1e-203]), (4, [1.7e308, 1.7e308]), (5, [5e-324, 5e-324]), (6, [0.0, 0.0]), (7, [float("inf"), 1.0]), (8, [1e308, -1e308]), (9, [3.0, -3.0])]
    for indexed in (64, 1):  # with one index, all other lengths are compared in blocks
        monkeypatch.setattr(embedding_dedup, "INDEXED", indexed)
        more = [(100 + 2 * k + j, [float(k), 1.0] + [0.5 * j * 1e-3] * k) for k in range(1, 70) for j in range(2)]
        df = spark.createDataFrame(rows + more, "vec_id long, embedding array<double>").withColumn("label", F.lit(1))
        got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.link(df).collect()}
        assert {k: got[k] for k in range(10)} == {0: (1, 0), 1: (1, 0), 2: (1, 2), 3: (1, 2), 4: (1, 4), 5: (1, 4), 6: (0, 6), 7: (0, 7), 8: (1, 8), 9: (1, 8)}
        assert all(got[100 + 2 * k + j] == (1, 100 + 2 * k) for k in range(1, 70) for j in range(2))


def test_jaccard_join_of_nothing(spark):
    assert jaccard_join.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_of_each_keeps_the_smallest_once(spark):
    texts = corpus(2)
    docs = odd_docs(spark, texts)
    kept = sorted(r.doc_id for r in jaccard_join.one_of_each(spark, docs, "").collect())
    assert kept == sorted({i for i, (_, c) in plain_jaccard(texts).items() if i == c})


def test_components_of_chains_and_stars(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + k) for k in range(1, 30)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    got = {r.id: r.component_id for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = reach(300, edges)
    assert all(got[i] == want[i] if want.count(want[i]) > 1 else i not in got for i in range(300))


def plain_line_dedup(texts, least):
    rows = {i: [(k, x, len(plain_words(x))) for k, x in enumerate(t.split("\n"))] for i, t in enumerate(texts) if t is not None}
    seen, windows = {}, []
    for i, lines in rows.items():
        units = [u for u in lines if u[2]]
        for a in range(len(units)):
            for step in (1, -1):
                b, n = a, 0
                while 0 <= b < len(units) and n < least:
                    n += units[b][2]
                    b += step
                if n >= least:
                    lo, hi = (a, b - 1) if step == 1 else (b + 1, a)
                    windows.append((i, units[lo][0], units[hi][0], tuple(u[1] for u in units[lo : hi + 1])))
    windows = sorted(set(windows), key=lambda w: (w[0], w[1]))
    for i, a, _, content in windows:
        seen.setdefault(content, (i, a))
    gone = collections.defaultdict(set)
    for i, a, z, content in windows:
        if seen[content] != (i, a):
            gone[i] |= set(range(a, z + 1))
    return {i: "\n".join(x for k, x, _ in lines if k not in gone[i]) for i, lines in rows.items()}


def test_line_dedup_equals_the_plain_version(spark):
    rng = random.Random(4)
    lines = [" ".join(rng.choices("abcdefgh", k=rng.choice([1, 3, 8, 15]))) for _ in range(25)]
    texts = [None, "", "\n\n", "x"] + ["\n".join(rng.choices(lines + [""], k=rng.randrange(1, 14))) for _ in range(50)] + ["\n".join(["same line here"] * 40)]
    out = line_dedup.remove_repeats(odd_docs(spark, texts), least=12).collect()
    want = plain_line_dedup(texts, 12)
    assert len(out) == len(texts) + 2
    assert all(r.text == want.get(r.doc_id) for r in out)


def test_line_dedup_stage_drops_what_is_wholly_repeated(spark):
    long = " ".join("word%d" % k for k in range(60))
    docs = spark.createDataFrame([(1, long, 0), (2, long, 0), (3, f"own words\n{long}", 0), (4, "", 0)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in line_dedup.without_repeats(spark, docs, "").collect()}
    assert got == {1: (long, 0), 3: ("own words", 9), 4: ("", 0)}


def test_mixing_meets_the_repetition_limit_and_the_budget(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 40)), s) for i, s in enumerate(["a"] * 300 + ["b"] * 60 + ["c"] * 20 + [None] * 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    total = sum(len(plain_words(t)) for _, t, _ in rows)
    plan = mixing.plan(docs, budget=float(total), repeats=3.0)
    out = mixing.copies(docs, plan).collect()
    assert len(out) == len(rows)
    tokens = {p.source: p.tokens for p in plan.collect()}
    weights = {p.source: p.weight for p in plan.collect()}
    assert abs(sum(weights.values()) - 1) < 1e-9
    assert max(weights[s] * total / tokens[s] for s in tokens) <= 3.0 + 1e-9
    used = collections.Counter()
    for r in out:
        used[r.source] += r._mx_copies * len(plain_words(r.text))
    assert all(abs(used[s] - weights[s] * total) <= 40 for s in tokens)
    whole = mixing.copies(docs, mixing.plan(docs, budget=None, repeats=2.0)).collect()
    assert min(r._mx_copies for r in whole) >= 1 and max(r._mx_copies for r in whole) <= 2
    assert mixing.copies(docs.limit(0), mixing.plan(docs.limit(0))).count() == 0


def test_mixing_to_an_entropy(spark):
    docs = spark.createDataFrame([(i, "w w w", s) for i, s in enumerate(["a"] * 90 + ["b"] * 9 + ["c"])], "doc_id long, text string, source string")
    p = [r.weight for r in mixing.plan(docs, budget=300.0, repeats=None, entropy=0.9).collect()]
    assert abs(-sum(x * math.log(x) for x in p) - 0.9) < 1e-3


def plain_quality(t):
    w = plain_words(t)
    c = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in (t or "").split("\n") if plain_words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_and_verdicts(spark):
    texts = corpus(6) + ["a b a b a b\na b\n\na b #*", "é è\x0bü\x0cß ñ"] + ["zz || ** zz%d || **" % k * 40 for k in range(5)]
    docs = odd_docs(spark, texts)
    good = docs.filter("doc_id >= 7 and doc_id < 60").select("doc_id").distinct()
    ratio = quality.learn(docs, good)
    for r in quality.judge(docs, ratio).collect():
        n, chars, symbols, dups, repeats = plain_quality(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dups, repeats)
        assert r.base_failed == (n < 50 or 100 * repeats > 50 * n)
        assert not (r.base_failed and r.kept)
    assert quality.judge(docs.limit(0), quality.learn(docs.limit(0), good.limit(0))).count() == 0


def test_quality_counts_are_exact_where_hashes_clash(spark, monkeypatch):
    whole = quality._window
    monkeypatch.setattr(quality, "_window", lambda i: F.pmod(whole(i), F.lit(3)))  # three hashes for all windows
    texts = corpus(7, 20) + ["a b c a b c d", "a b a b a b", "x y z"]
    for r in quality.judge(odd_docs(spark, texts), quality.Ratio(None, 0.0)).collect():
        assert r.n_repeat_words == plain_quality(texts[r.doc_id])[4]


def test_quality_verdict_equals_a_plain_ratio(spark):
    def bucket(*parts):
        h = 42
        for x in parts:
            h = xxhash.xxh64(x.encode(), seed=h).intdigest()
        return (h - (1 << 64) * (h >> 63)) % quality.BUCKETS

    def grams(t):
        w = plain_words(t)
        return [bucket(x) for x in w] + [bucket(x, y) for x, y in zip(w, w[1:])]

    rng = random.Random(15)
    texts = corpus(6) + [" ".join(rng.choices(["zz%d" % k for k in range(50)], k=120)) for _ in range(12)]
    docs = odd_docs(spark, texts)  # the first two rows stand twice
    good = set(range(0, 60))
    ratio = quality.learn(docs, spark.createDataFrame([(i,) for i in [*good, 3, 3, 10_000]] + [(None,)], "doc_id long"))
    rows = [*range(len(texts)), 0, 1]
    raw, target = collections.Counter(), collections.Counter()
    for i in rows:
        raw.update(grams(texts[i]))
        if i in good:
            target.update(grams(texts[i]))
    st, sr = sum(target.values()) + quality.BUCKETS, sum(raw.values()) + quality.BUCKETS
    score = lambda t: sum(round(math.log((target[b] + 1) / st) - math.log((raw[b] + 1) / sr), 6) for b in grams(t)) / max(1, 2 * len(plain_words(t)) - 1)
    low, mid = np.quantile([score(texts[i]) for i in rows if i in good and plain_words(texts[i])], [quality.LOW, 0.5])
    least = low - (mid - low) / 2
    assert ratio.least == pytest.approx(least, abs=1e-6)
    verdicts = collections.Counter()
    for r in quality.judge(docs, ratio).collect():
        s = score(texts[r.doc_id])
        assert r.score == pytest.approx(s, abs=1e-6) and r.kept == (not r.base_failed and s >= least)
        verdicts[r.kept, r.base_failed] += 1
    assert all(verdicts[x] for x in ((True, False), (False, False), (False, True)))


def test_embedding_links_equal_brute_force(spark):
    rng = np.random.default_rng(7)
    base = rng.standard_normal((40, 16))
    near = np.concatenate([base + rng.standard_normal(base.shape) * s for s in (0.05, 0.12, 0.2)])
    rows = [(i, [float(x) for x in np.float32(v)], int(i % 2)) for i, v in enumerate(np.concatenate([base, near, base[:5], base[:5] * 3]))]
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, [float("nan")] + [1.0] * 15, 1), (n + 3, rows[0][1], None), (n + 4, [None] + [1.0] * 15, 0), (n + 5, [], 0), (n + 6, [1.0], 0), (n + 7, [2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"id": F.lit(1), "v": F.lit(2), "cell": F.lit(3)})
    got = {r.vec_id: r for r in embedding_dedup.link(df).collect()}
    usable = {i: np.array(v, float) for i, v, label in rows if v and label is not None and None not in v and np.isfinite(v).all() and np.linalg.norm(v)}
    label = {i: x for i, _, x in rows}
    cos = lambda a, b: float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))
    pairs = [(i, j) for i in usable for j in usable if j < i and label[i] == label[j] and len(usable[i]) == len(usable[j]) and cos(usable[i], usable[j]) >= 0.98]
    links = collections.Counter(x for p in pairs for x in p)
    found = sum(got[i].n_links for i in got) / max(1, sum(links.values()))
    assert found >= 0.9 and all(got[i].n_links <= links[i] for i in got)
    want = reach(len(rows), pairs)
    assert all(got[i].component_id == want[i] and got[i].kept == (i == want[i]) for i in got)
    assert embedding_dedup.link(df.limit(0)).count() == 0


LANGS = {"en": "the quick brown fox jumps over the lazy dog and runs away with this", "de": "der schnelle braune fuchs springt über den faulen hund und läuft weg", "fr": "le renard brun rapide saute par dessus le chien paresseux et s'enfuit"}


def test_language_models_tell_held_out_texts(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices(LANGS[x].split(), k=12)), x) for i, x in enumerate(rng.choices(list(LANGS), k=240))]
    rows += [(1000, None, "en"), (1001, "", "en"), (1002, "123 !?", "de"), (1003, "le chien", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("id", F.lit("x"))
    one = langid.learn(docs, F.col("doc_id") % 4 != 2)
    got = {r.doc_id: r for r in langid.identify(docs, one).collect()}
    held = [r for r in rows[:240] if r[0] % 4 == 2]
    assert sum(got[i].lang_pred == x for i, _, x in held) / len(held) > 0.95
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1000, 1001, 1002)) and got[1003].lang_pred == "fr"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.learn(docs.limit(0), F.lit(True)) is None


def test_kneser_ney_probabilities_sum_to_one():
    alphabet = langid.Alphabet(np.array([ord(c) for c in "abc"], np.uint32))
    points, _ = langid.characters(["abcabcaab cab abba"])
    keys, number = np.unique(langid.packed(alphabet.codes(points), langid.ORDER)[1:], return_counts=True)
    m = langid.Models(["x"], [(keys, number)], alphabet)
    head = int(keys[3]) >> langid._BITS
    total = sum(math.exp(m._scores(np.array([head << langid._BITS | c], np.uint64), langid.ORDER)[0, 0]) for c in (0, 1, 2, 3, langid.LETTERS + 1))
    assert abs(total - 1) < 1e-4


def test_toxicity_learns_words_and_scores_every_row(spark):
    rng = random.Random(9)
    plain = ["alpha beta gamma delta omega sigma you the and of".split()[rng.randrange(10)] for _ in range(4000)]
    rows = []
    for i in range(300):
        w = rng.sample(plain, 12)
        if i % 3 == 0:
            w[rng.randrange(12)] = "vileword%d" % rng.randrange(4)
        rows.append((i, " ".join(w), int(i % 3 == 0)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, ""), (902, "?!")], "doc_id long, text string").withColumn("toxic", F.lit(1))
    labels = spark.createDataFrame([(i, x) for i, _, x in rows] + [(5000, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    known = labels.filter("doc_id is null or doc_id % 5 <> 0")
    got = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.learn(docs, known)).collect()}
    held = [(i, x) for i, _, x in rows if i % 5 == 0]
    assert sum((got[i] >= 0.5) == bool(x) for i, x in held) / len(held) > 0.9
    assert len(got) == 303 and all(0 <= s <= 1 for s in got.values())
    none = toxicity.learn(docs, labels.limit(0))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.0}


def test_bounded_sample_holds_its_bound(spark):
    rows = spark.range(5000).select("id", F.when(F.col("id") % 10 < 9, "big").when(F.col("id") % 100 == 9, None).otherwise("small").alias("g"))
    got = collections.Counter(r.g for r in bounded_sample(rows.fillna("tiny"), 100, "g").collect())
    assert 80 <= got["big"] <= 100 and 80 <= got["small"] <= 100 and got["tiny"] == 50
    assert 80 <= bounded_sample(rows, 100).count() <= 100 and bounded_sample(rows.limit(0), 100).count() == bounded_sample(rows.limit(0), 100, "g").count() == 0


def plain_features(text, lexicon):
    """The features of toxicity.FEATURES, word by word over the whole text."""
    t = toxicity
    if not text or not text.split():
        return [0.0] * len(t.FEATURES)
    words, original = t._WORDS.findall(text.lower()), t._WORDS.findall(text)
    a = [lexicon.get(w, 0.0) for w in words]
    b = [next((lexicon[p] for p in (w[:5] + "*", w[:4] + "*") if lexicon.get(p)), 0.0) for w in words]
    hits = [k for k in range(len(words)) if a[k] or b[k]]
    yous = [k for k, w in enumerate(words) if w in t._YOU]
    near = [max(a[i], b[i]) / (1 + abs(i - j)) for i in hits for j in yous if abs(i - j) <= t._NEAR]
    mixed = t._MIXED.findall(text.lower())
    opened = [t._INNER.sub("", m).translate(t._LEET).strip("?,;:") for m in mixed]
    opened = [x for x in opened if any(lexicon.get(y) for y in (x, x[:5] + "*", x[:4] + "*"))]
    n, letters = max(1, len(words)), max(1, sum(map(len, words)))
    return [
        sum(a) / n, sum(b) / n, max([a[k] for k in hits] + [b[k] for k in hits] + [0.0]), math.log(1 + len(hits)), max(near + [0.0]), len(yous) / n,
        sum(c.isupper() for c in text) / letters, sum(len(w) > 1 and w.isupper() for w in original) / n, sum(c in ".,;:?!" for c in text) / len(text),
        sum(c == "!" for c in text) / len(text), len(mixed) / n, len(opened) / n, math.log(1 + len(words)),
    ]


def test_toxicity_features_equal_plain_ones(monkeypatch):
    monkeypatch.setattr(toxicity, "REMEMBERED", 20)  # the table of pieces starts anew between texts
    rng = random.Random(12)
    lexicon = {"vile": 3.0, "viler": 2.5, "nasty": 4.0, "nast*": 2.0, "rotte*": 3.5}
    parts = ["you", "YOU", "Vile", "v1le", "na$ty,", "nastier", "rotten-egg", "v.i.l.e", "word!", "don't", "(du)", "ΣΑΣ", "A1b", "plain", "x", "...", "n-a-s-t-y?", "you're-vile"]
    pieces = toxicity._Pieces(lexicon)
    texts = [None, "", " \n", "...", "vile" * 3, "you vile " + "word " * 40_000 + "nasty you"]
    texts += ["".join(rng.choice(parts) + rng.choice([" ", "\n", "  ", "\u00a0"]) for _ in range(rng.randrange(1, 40))) for _ in range(300)]
    for t in texts:
        assert toxicity.features(t, pieces) == pytest.approx(plain_features(t, lexicon), abs=1e-9)


def test_toxicity_trees_and_calibration_by_hand(spark):
    """Scores are the trees' votes summed up node by node, then read off the isotonic steps."""
    rng = random.Random(13)
    rows = [(i, " ".join(rng.choices(["calm", "kind", "warm", "you"], k=15) + (["vile%d" % rng.randrange(3)] if i % 4 == 0 or rng.random() < 0.1 else [])), int(i % 4 == 0)) for i in range(400)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    one = toxicity.learn(docs, spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id long, toxic int"))
    pieces = toxicity._Pieces(one.lexicon)

    def vote(node, x):
        if node.subtreeDepth() == 0:
            return node.prediction()
        split = node.split()
        return vote(node.leftChild() if x[split.featureIndex()] <= split.threshold() else node.rightChild(), x)

    steps = list(zip(one.calibration.boundaries.toArray(), one.calibration.predictions.toArray()))
    assert all(p <= q for (_, p), (_, q) in zip(steps, steps[1:]))
    got = {r.doc_id: r.score for r in toxicity.score(docs, one).collect()}
    for i, t, _ in rows[:60]:
        x = toxicity.features(t, pieces)
        margin = sum(w * vote(tree._java_obj.rootNode(), x) for w, tree in zip(one.trees.treeWeights, one.trees.trees))
        assert got[i] == pytest.approx(float(np.interp(margin, *zip(*steps))), abs=1e-6)
    assert toxicity.score(docs.limit(0), one).count() == 0 and toxicity.learn(docs.limit(0), docs.limit(0).select("doc_id", F.lit(1).alias("toxic"))).trees is None


def plain_kneser_ney(counts, discounts, uniform, gram, n):
    """Interpolated Kneser-Ney probability of the last letter of gram after those before it."""
    if n == 0:
        return uniform
    level = counts[n]
    gram = gram[-n:]
    same = {g: c for g, c in level.items() if g[:-1] == gram[:-1]}
    lower = plain_kneser_ney(counts, discounts, uniform, gram, n - 1)
    if not same:
        return lower
    total = sum(same.values())
    return max(same.get(gram, 0) - discounts[n], 0) / total + discounts[n] * len(same) / total * lower


def test_language_model_equals_a_plain_kneser_ney():
    rng = random.Random(14)
    text = " ".join("".join(rng.choices("abcde\U00030001", [5, 4, 3, 2, 1, 1], k=rng.randrange(1, 7))) for _ in range(60))
    alphabet = langid.Alphabet(np.unique(np.array([ord(c) for c in text if c != " "], np.uint32)))
    points, _ = langid.characters([text])
    codes = alphabet.codes(points)
    keys, number = np.unique(langid.packed(codes, langid.ORDER)[1:], return_counts=True)
    m = langid.Models(["x"], [(keys, number)], alphabet)
    padded = (0,) * (langid.ORDER - 1) + tuple(int(c) for c in codes)
    of = {langid.ORDER: collections.Counter(padded[k - langid.ORDER + 1 : k + 1] for k in range(langid.ORDER, len(padded)))}
    for n in range(langid.ORDER - 1, 0, -1):
        of[n] = collections.Counter(g[1:] for g in of[n + 1])  # distinct left neighbours
    once = {n: (sum(c == 1 for c in x.values()), sum(c == 2 for c in x.values())) for n, x in of.items()}
    discounts = {n: a / (a + 2 * b) if a and b else 0.5 for n, (a, b) in once.items()}
    for _ in range(300):
        gram = tuple(rng.choices([0, 1, 2, 3, 4, 5, 6, langid.LETTERS + 1], k=langid.ORDER))
        want = plain_kneser_ney(of, discounts, m.uniform, gram, langid.ORDER)
        key = sum(c << langid._BITS * k for k, c in enumerate(reversed(gram)))
        assert math.exp(m._scores(np.array([key], np.uint64), langid.ORDER)[0, 0]) == pytest.approx(want, rel=1e-4)


def test_language_of_rare_letters_and_of_nothing(spark):
    docs = spark.createDataFrame([(k, "abc abd", "en") for k in range(40)] + [(k, "\U00030001\U00030002 \U00030001", "xx") for k in range(40, 80)] + [(90, "word " * 60_000, None)], "doc_id long, text string, lang string")
    one = langid.learn(docs, F.lit(True))
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs, one).collect()}
    assert got[0] == "en" and got[50] == "xx" and got[90] == "en"
    assert langid.identify(docs.limit(0), one).count() == 0
    points, _ = langid.characters(["abc abd"])
    same = np.unique(langid.packed(one.models.alphabet.codes(points), langid.ORDER)[1:], return_counts=True)
    tied = langid.Identifier(langid.Models(["a", "b"], [same, same], one.models.alphabet), 1.0, 9.0)
    assert {r.lang_pred for r in langid.identify(docs, tied).collect()} == {"a"}


def test_bins_tell_large_sets_apart(spark):
    rng = np.random.default_rng(3)

    def draw(n):
        return np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))

    x, y, small = draw(3000), draw(3000), draw(90)
    sets = [x, y, np.union1d(x[:2600], y[:400]), np.union1d(x, y[:700]), small, np.union1d(small[:80], y[:30])]
    pairs = [(i, j) for i in range(len(sets)) for j in range(len(sets)) if i != j]
    column = lambda k: pa.array([jaccard_join._bins(sets[p[k]]) for p in pairs])
    apart = jaccard_join._apart(column(0), column(1))
    assert all(d <= len(np.setxor1d(sets[i], sets[j])) for d, (i, j) in zip(apart, pairs))
    full = pa.array([bytes([255] * 64), bytes([255] * 128)])
    assert jaccard_join._apart(full, full.take(pa.array([1, 0]))).tolist() == [0, 0]  # full bins tell nothing
    # sets of one length that share nothing are no candidates, whatever their length; those that link are
    classes = spark.createDataFrame([(k, len(s), bytearray(jaccard_join._bins(s))) for k, s in enumerate(sets)], "c long, n long, bins binary")
    left = jaccard_join._close(spark.createDataFrame(pairs, "a long, b long"), classes)
    kept = {(r.a, r.b) for r in left.collect()}
    linked = {(i, j) for i, j in pairs if 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))}
    assert linked and linked <= kept and (0, 1) not in kept
