"""Quality rules and a hashed n-gram likelihood ratio, in DataFrame functions only.

The counts behind the base rules and the ratio are computed in the row: no text is shuffled, as the trusted ids, packed
as bits, go to the texts in bands of bounded size. Words and word pairs are hashed to BUCKETS. Their counts in the raw
corpus (all rows) and in a trusted target (all rows that are labelled good) are smoothed into two multinomials; the sum
of log(p_target / p_raw) over a text's n-grams, divided by their number, is its score. The score below which a text is rejected comes from all the target's own scores: the
LOW quantile, less half its distance to the median. It is applied to every row alike.

Repeated windows are found by sorting, in the row, one integer per window: a hash in the high bits and the place in the
low bits, so that equal windows stand together. Where hashes are equal the three words are compared; in the rare text in
which different windows share a hash (long ones, as the hash is cut by the bits of the place) the windows themselves are
sorted instead, so the count is exact at every length.

Null texts have no words; texts without words score 0 and fail the base rules. Repeated rows repeat their results, an
empty table gives an empty result, and other columns may have any name. Without trusted rows every score is 0.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadlake.llm.common import store, table, unstore, words

BUCKETS = 1 << 14
#: Scores that the driver sorts at most to find one of a given rank, and parts in which they are counted before.
FEW, PARTS = 10_000, 4096
#: Rows of packed trusted ids that are broadcast at a time.
BAND = 1_000_000
LOW = 0.001


def _tokens(docs: DataFrame, id_col: str, text_col: str, *keep: str) -> DataFrame:
    """(id, text, w): ids, texts and their words, with the columns in keep."""
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *keep).withColumn("w", words(F.col("text")))


def _bucket(*parts) -> F.Column:
    return F.pmod(F.xxhash64(*parts), F.lit(BUCKETS)).cast("int")


def _grams() -> F.Column:
    """Buckets of the words and word pairs of column w."""
    n = F.size("w")
    pairs = F.when(n >= 2, F.transform(F.sequence(F.lit(0), n - 2), lambda i: _bucket(F.col("w")[i], F.col("w")[i + 1])))
    return F.concat(F.transform("w", lambda x: _bucket(x)), F.coalesce(pairs, F.array().cast("array<int>")))


def _window(i: F.Column) -> F.Column:
    """A hash of the three words from place i on."""
    return F.xxhash64(F.col("w")[i], F.col("w")[i + 1], F.col("w")[i + 2])


def base_counts(tokens: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words to (id, text, w)."""
    n = F.size("w")
    bits = F.length(F.bin(n))
    starts = F.when(n >= 3, F.sequence(F.lit(0), n - 3))
    window = lambda i: F.call_function("shiftleft", _window(i), F.col("_bits")).bitwiseOR(i.cast("long"))
    head = lambda x: F.call_function("shiftright", x, F.col("_bits"))
    place = lambda x: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_bits")) - 1).cast("int")
    # get() is null beyond the ends
    again = F.filter("_windows", lambda x, k: (head(x) == head(F.get("_windows", k + 1))) | (head(x) == head(F.get("_windows", k - 1))))
    unlike = lambda x, y: reduce(lambda p, q: p | q, (F.get("w", place(x) + k) != F.get("w", place(y) + k) for k in range(3)))
    clash = F.exists(F.transform("_again", lambda x, k: F.struct(x.alias("x"), F.get("_again", k + 1).alias("y"))), lambda z: F.coalesce((head(z["x"]) == head(z["y"])) & unlike(z["x"], z["y"]), F.lit(False)))
    # the exact way: windows as texts (a word holds no blank), equal ones side by side
    whole = lambda i: F.struct(F.concat_ws(" ", F.col("w")[i], F.col("w")[i + 1], F.col("w")[i + 2]).alias("t"), i.cast("long").alias("i"))
    same = lambda x, k: F.coalesce(x["t"] == F.get("_whole", k)["t"], F.lit(False))
    exact = F.transform(F.filter("_whole", lambda x, k: same(x, k + 1) | same(x, k - 1)), lambda x: x["i"])
    covered = F.aggregate(
        "_places",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda a, p: F.struct((a["n"] + p + 3 - F.greatest(a["end"], p)).alias("n"), (p + 3).alias("end")),
        lambda a: a["n"],
    )
    return (
        tokens.withColumn("_bits", bits)
        .withColumn("_windows", F.sort_array(F.transform(starts, window)))
        .withColumn("_again", again)
        .withColumn("_whole", F.when(clash, F.sort_array(F.transform(starts, whole))))
        .withColumn("_places", F.sort_array(F.when(F.col("_whole").isNull(), F.transform("_again", lambda x: place(x).cast("long"))).otherwise(exact)))
        .withColumn("_lines", F.filter(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(" \t\x0b\f\r")) != ""))
        .withColumn("n_words", n.cast("long"))
        .withColumn("word_chars", F.length(F.array_join("w", "")).cast("long"))
        .withColumn("n_symbols", F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long")))
        .drop("_bits", "_windows", "_again", "_whole", "_places", "_lines")
    )


class Ratio:
    """log(p_target / p_raw) by bucket, as text for a constant array, and the least score that is kept."""

    def __init__(self, weights: list[float] | None, least: float):
        self.weights, self.least = weights, least

    def score(self) -> F.Column:
        """Length-normalised ratio of column w."""
        if self.weights is None:
            return F.lit(0.0)
        weight = F.split(F.lit(",".join(f"{x:.6f}" for x in self.weights)), ",").cast("array<double>")
        total = F.aggregate(_grams(), F.lit(0.0), lambda a, x: a + F.get(weight, x))
        return F.when(F.size("w") > 0, total / F.greatest(2 * F.size("w") - 1, F.lit(1))).otherwise(0.0)


def learn(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Ratio:
    """trusted: one id column of rows that are good. docs: the raw corpus. All rows of both are counted."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    ids, bands = packed(texts, trusted)
    target, raw = [1] * BUCKETS, [1] * BUCKETS
    for k in range(bands):  # the first band's pass counts the raw corpus too
        rows = marked(texts, ids, bands, k)
        grams = _tokens(rows if k == 0 else rows.filter("good"), "id", "text", "good").select("good", F.explode(_grams()).alias("bucket"))
        for r in grams.groupBy("bucket").agg(F.count("*").alias("n"), F.count_if("good").alias("good")).collect():  # at most BUCKETS rows
            target[r.bucket] += r.good
            if k == 0:
                raw[r.bucket] += r.n
    st, sr = sum(target), sum(raw)
    if st == BUCKETS:
        unstore(ids)
        return Ratio(None, 0.0)
    ratio = Ratio([math.log(t / st) - math.log(r / sr) for t, r in zip(target, raw)], 0.0)
    parts = [store(_tokens(marked(texts, ids, bands, k).filter("good"), "id", "text").filter(F.size("w") > 0).select(ratio.score().alias("s"))) for k in range(bands)]
    low, mid = quantiles(reduce(DataFrame.unionByName, parts), (LOW, 0.5))
    unstore(ids, *parts)
    ratio.least = low - (mid - low) / 2
    return ratio


def packed(texts: DataFrame, trusted: DataFrame) -> tuple[DataFrame, int]:
    """(key, bits, hash) of the trusted ids, and the number of bands. Whole numbers are packed 64 to a row, one bit each;
    other ids are rows of their own. A band has about BAND rows, so that it can be broadcast."""
    given, own = F.col(trusted.columns[0]), texts.schema["id"].dataType
    ids = trusted.select(given.alias("given"), given.try_cast(own).alias("id")).filter("id = given")
    rows = ids.groupBy(_key(own).alias("key")).agg(F.bit_or(_bit(own)).alias("bits"))
    found = store(rows.select("key", "bits", F.xxhash64("key").alias("hash")))
    return found, max(1, -(-found.count() // BAND))


def marked(texts: DataFrame, ids: DataFrame, bands: int, k: int) -> DataFrame:
    """texts with good: whether the id is one of band k of the packed ids, which go to every task; no text is shuffled."""
    own = texts.schema["id"].dataType
    band = ids.filter(F.pmod("hash", F.lit(bands)) == k).select("key", "bits")
    j = texts.withColumn("key", _key(own)).join(F.broadcast(band), "key", "left")
    return j.select("id", "text", F.coalesce(F.col("bits").bitwiseAND(_bit(own)) != 0, F.lit(False)).alias("good"))


_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _key(own: T.DataType) -> F.Column:
    return F.shiftright(F.col("id").cast("long"), 6) if isinstance(own, _WHOLE) else F.col("id")


def _bit(own: T.DataType) -> F.Column:
    one = F.lit(1).cast("long")
    return F.call_function("shiftleft", one, F.pmod(F.col("id").cast("long"), F.lit(64)).cast("int")) if isinstance(own, _WHOLE) else one


def quantiles(scores: DataFrame, at: tuple[float, ...]) -> list[float]:
    """Exact quantiles, linear between ranks, of the column s (no nulls, at least one row). A rank is found by counting
    the scores in PARTS equal parts of a range that shrinks, until a part has FEW rows or one value."""

    def ranked(rank: int) -> float:
        inside, before = scores, 0
        while True:
            n, lo, hi = inside.agg(F.count("*"), F.min("s"), F.max("s")).first()
            if lo == hi:
                return lo
            if n <= FEW:
                return sorted(r.s for r in inside.collect())[rank - before]
            part = F.least(F.floor((F.col("s") - lo) / (hi - lo) * PARTS), F.lit(PARTS - 1))
            for k, rows in sorted(tuple(r) for r in inside.groupBy(part.alias("k")).count().collect()):
                if before + rows > rank:
                    break
                before += rows
            inside = inside.filter(part == k)

    total = scores.count()
    found = []
    for q in at:
        place = q * (total - 1)
        below = ranked(math.floor(place))
        found.append(below + (place % 1) * (ranked(math.ceil(place)) - below) if place % 1 else below)
    return found


def judge(docs: DataFrame, ratio: Ratio, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept) of every row."""
    counted = base_counts(_tokens(docs, id_col, text_col)).withColumn("score", ratio.score())
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counted.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), "score", (~failed & (F.col("score") >= ratio.least)).alias("kept"),
    )


def op4_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trusted = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return judge(docs, learn(docs, trusted))


QUERIES = {"op4_quality": op4_quality}
ORACLES: dict[str, str] = {}
