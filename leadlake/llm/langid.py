"""Language identification by interpolated Kneser-Ney character models, one per language.

A text becomes a run of lower-case letters in which everything else is one blank. Letters are those of the learning
sample, the LETTERS most frequent of them if it holds more; all others share one code. Per language, n-grams of up to ORDER
characters are counted on a bounded sample of labelled texts; the interpolated Kneser-Ney probabilities of all n-grams
seen in any language, and the back-off weights of their contexts, stand in arrays sorted by the packed n-gram (a
perfect hash), with one column per language. The language with the lowest cross-entropy per character wins.

Rejection is calibrated on further labelled texts that the models have not seen: a text whose lowest cross-entropy is
above REJECT_QUANTILE of theirs is marked `rejected`; the score is the winner's posterior, with the temperature of
least log loss on those texts.

Null texts and texts without a letter are `und` with score 0. Ties go to the language that sorts first. Repeated rows
repeat their results; an empty table gives an empty result; other columns may have any name. If no labelled text can
be learned from, every text is `und`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadlake.llm.common import bounded_sample, checkpoint, table, text_pass

ORDER = 4
#: A sample of LEARN + CALIBRATE labelled texts per language at most; a hash deals it between models and calibration.
LEARN, CALIBRATE = 1500, 300
REJECT_QUANTILE = 0.999
_CHUNK = 1 << 20  # characters that are scored at once
_BITS = 16
LETTERS = (1 << _BITS - 1) - 2  # codes below 2^15, so that a packed n-gram is a non-negative 64-bit integer


def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


_WORKER: dict = {}


def characters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, blanks for runs of non-letters, each text between blanks; the text of each one."""
    if "letters" not in _WORKER:
        _WORKER["letters"] = _letters()
    letters = _WORKER["letters"]
    raw = [np.frombuffer(f" {t.lower()} ".encode("utf-32-le", "surrogatepass") if t else b"", "<u4") for t in texts]
    points = np.concatenate(raw) if raw else np.zeros(0, "<u4")
    of = np.repeat(np.arange(len(texts)), [len(x) for x in raw])
    points = np.where(letters[points], points, 32)
    keep = np.ones(len(points), bool)
    if len(points) > 1:
        keep[1:] = (points[1:] != 32) | (points[:-1] != 32) | (of[1:] != of[:-1])
    return points[keep], of[keep]


class Alphabet:
    def __init__(self, points: np.ndarray):
        self.points = np.sort(points[points != 32])[:LETTERS]

    def codes(self, points: np.ndarray) -> np.ndarray:
        """0 for the blank, 1... for known letters, the last code for others."""
        at = np.searchsorted(self.points, points)
        known = (at < len(self.points)) & (self.points[np.minimum(at, len(self.points) - 1)] == points) if len(self.points) else np.zeros(len(points), bool)
        return np.where(points == 32, 0, np.where(known, at + 1, LETTERS + 1)).astype(np.uint64)


def packed(codes: np.ndarray, order: int) -> np.ndarray:
    """The n-gram that ends at each place, as one integer; the first ones have blanks before them."""
    out = np.zeros(len(codes), np.uint64)
    for k in range(order):
        out[k:] |= codes[: len(codes) - k] << np.uint64(_BITS * k)
    return out


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    return at, (keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool))


class Models:
    """Log probabilities and back-off weights of all languages in sorted n-gram arrays."""

    def __init__(self, langs: list[str], counts: list[tuple[np.ndarray, np.ndarray]], alphabet: Alphabet):
        """counts: per language, the distinct packed n-grams of ORDER and how often each occurs."""
        self.langs, self.alphabet = langs, alphabet
        self.keys, self.logp, self.contexts, self.back = {}, {}, {}, {}
        self.uniform = 1.0 / (len(alphabet.points) + 2)
        levels = []  # per language: order -> (keys, counts); below ORDER the number of distinct left neighbours
        for keys, number in counts:
            of = {ORDER: (keys, number.astype(float))}
            for n in range(ORDER - 1, 0, -1):
                of[n] = tuple(np.unique(of[n + 1][0] & np.uint64((1 << _BITS * n) - 1), return_counts=True))
            levels.append(of)
        lower = None
        for n in range(1, ORDER + 1):
            every = np.unique(np.concatenate([of[n][0] for of in levels]))
            heads = np.unique(every >> np.uint64(_BITS))
            p, back = np.empty((len(every), len(langs))), np.zeros((len(heads), len(langs)))
            for k, of in enumerate(levels):
                keys, number = of[n]
                once, twice = (number == 1).sum(), (number == 2).sum()
                discount = once / (once + 2 * twice) if once and twice else 0.5
                head, inverse = np.unique(keys >> np.uint64(_BITS), return_inverse=True)
                total, kinds = np.bincount(inverse, number), np.bincount(inverse)
                at, there = _find(head, heads)
                weight = np.where(there, discount * kinds[at] / total[at], 1.0)
                back[:, k] = np.log(weight)
                mass = np.where(there, total[at], 1.0)
                at, there = _find(keys, every)
                own = np.where(there, np.maximum(number[at] - discount, 0), 0)
                h, _ = _find(heads, every >> np.uint64(_BITS))
                below = self.uniform if lower is None else lower[1][_find(lower[0], every & np.uint64((1 << _BITS * (n - 1)) - 1))[0], k]
                p[:, k] = own / mass[h] + weight[h] * below
            lower = (every, p)
            self.keys[n], self.logp[n] = every, np.log(p).astype(np.float32)
            self.contexts[n], self.back[n] = heads, back.astype(np.float32)

    def _scores(self, grams: np.ndarray, n: int) -> np.ndarray:
        if not n:
            return np.full((len(grams), len(self.langs)), np.log(self.uniform), np.float32)
        at, there = _find(self.keys[n], grams)
        out = self.logp[n][at]
        if not there.all():
            rest = grams[~there]
            h, known = _find(self.contexts[n], rest >> np.uint64(_BITS))
            weight = np.where(known[:, None], self.back[n][h], 0)
            out[~there] = weight + self._scores(rest & np.uint64((1 << _BITS * (n - 1)) - 1), n - 1)
        return out

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character (nats) of each text under each language; the number of its characters."""
        points, of = characters(texts)
        grams = packed(self.alphabet.codes(points), ORDER)
        first = np.ones(len(of), bool)
        first[1:] = of[1:] != of[:-1]
        place = np.arange(len(of)) - np.maximum.accumulate(np.where(first, np.arange(len(of)), 0))
        for k in range(1, ORDER):  # what stands before a text's first blank is blank
            early = place < k
            grams[early] &= np.uint64((1 << _BITS * k) - 1)
        total, n = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts))
        letters = np.bincount(of[points != 32], minlength=len(texts))
        for a in range(0, len(of), _CHUNK):
            use = place[a : a + _CHUNK] > 0
            o = of[a : a + _CHUNK][use]
            if len(o):
                s = self._scores(grams[a : a + _CHUNK][use], ORDER)
                low, size = o[0], o[-1] - o[0] + 1
                for k in range(len(self.langs)):
                    total[low : low + size, k] -= np.bincount(o - low, s[:, k], size)
                n[low : low + size] += np.bincount(o - low, minlength=size)
        return total / np.maximum(n, 1)[:, None], np.where(letters > 0, n, 0)


def posterior(entropy: np.ndarray, heat: float) -> np.ndarray:
    z = -(entropy - entropy.min(axis=1, keepdims=True)) * heat
    p = np.exp(z)
    return p / p.sum(axis=1, keepdims=True)


class Identifier:
    def __init__(self, models: Models, heat: float, limit: float):
        self.models, self.heat, self.limit = models, heat, limit


def learn(docs: DataFrame, usable: F.Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Identifier | None:
    """Models and calibration from labelled rows for which `usable` holds (at most LEARN + CALIBRATE a language)."""
    rows = docs.filter(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    chosen = bounded_sample(rows.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang")), LEARN + CALIBRATE, "lang")
    chosen = F.broadcast(checkpoint(chosen).dropDuplicates(["id"]))  # bounded: LEARN + CALIBRATE ids a language
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(chosen, "id")
    texts = checkpoint(texts.withColumn("learn", F.pmod(F.xxhash64("id", F.lit(9)), F.lit(LEARN + CALIBRATE)) < LEARN))
    alphabet_rows = (
        texts.filter("learn").select(F.explode(F.split(F.lower("text"), "")).alias("c"))
        .groupBy("c").count().orderBy(F.desc("count"), "c").limit(LETTERS).collect()
    )
    points = np.array([ord(r.c) for r in alphabet_rows if len(r.c) == 1 and r.c.isalpha()], np.uint32)
    if not len(points):
        return None
    alphabet = Alphabet(points)

    def grams():
        def work(batch):
            points, of = characters(batch)
            codes, out = alphabet.codes(points), []
            for k in range(len(batch)):
                lo, hi = np.searchsorted(of, [k, k + 1])
                keys, number = np.unique(packed(codes[lo:hi], ORDER)[1:], return_counts=True)
                out.append([{"g": int(a), "n": int(b)} for a, b in zip(keys, number)])
            return (out,)

        return work

    pair = T.ArrayType(T.StructType([T.StructField("g", T.LongType()), T.StructField("n", T.LongType())]))
    arrow = pa.list_(pa.struct([("g", pa.int64()), ("n", pa.int64())]))
    counted = (
        text_pass(texts.filter("learn"), "id", "text", grams, [("grams", pair, arrow)], keep=("lang",))
        .select("lang", F.explode("grams").alias("x")).groupBy("lang", "x.g").agg(F.sum("x.n").alias("n")).orderBy("lang", "g").toPandas()
    )
    langs = sorted(counted["lang"].unique())
    models = Models(langs, [(x["g"].to_numpy(np.uint64), x["n"].to_numpy(float)) for x in (counted[counted["lang"] == k] for k in langs)], alphabet)
    held = texts.filter("not learn").select("text", "lang").toPandas()  # bounded by the sample
    if not len(held):
        held = texts.select("text", "lang").toPandas()
    entropy, n = models.entropies(list(held["text"]))
    right = np.array([langs.index(x) for x in held["lang"]])
    ok = n > 0
    if not ok.any():
        return Identifier(models, 1.0, float("inf"))
    loss = lambda heat: -np.log(np.maximum(posterior(entropy[ok], heat)[np.arange(ok.sum()), right[ok]], 1e-9)).mean()
    heat = min((2.0**k for k in range(-2, 9)), key=loss)
    return Identifier(models, heat, float(np.quantile(entropy[ok].min(axis=1), REJECT_QUANTILE)))


def identify(docs: DataFrame, identifier: Identifier | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, cross_entropy, rejected) of every whole text."""
    fields = [("lang_pred", T.StringType(), pa.string()), ("score", T.DoubleType(), pa.float64()), ("cross_entropy", T.DoubleType(), pa.float64()), ("rejected", T.BooleanType(), pa.bool_())]
    broadcast = docs.sparkSession.sparkContext.broadcast(identifier)  # bounded by the learning sample

    def make():
        one = broadcast.value

        def work(texts):
            if one is None:
                return ["und"] * len(texts), [0.0] * len(texts), [None] * len(texts), [True] * len(texts)
            entropy, n = one.models.entropies(texts)
            p, best, lowest = posterior(entropy, one.heat), entropy.argmin(axis=1), entropy.min(axis=1)
            some = n > 0
            return (
                [one.models.langs[k] if ok else "und" for k, ok in zip(best, some)],
                np.where(some, p[np.arange(len(texts)), best], 0.0),
                [float(x) if ok else None for x, ok in zip(lowest, some)],
                ~some | (lowest > one.limit),
            )

        return work

    return text_pass(docs, id_col, text_col, make, fields)


def op8_langid(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = lambda: F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4, F.lit(0))
    found = identify(docs, learn(docs, fold() != 2))
    return found.select("doc_id", (fold() == 2).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


QUERIES = {"op8_langid": op8_langid}
ORACLES: dict[str, str] = {}
