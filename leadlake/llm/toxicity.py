"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

1. A bounded sample of labelled rows is drawn (SAMPLE of each label, by hashed id) and split in three by the hash.
2. The lexicon is learned on the first part: words, and word beginnings of 4 and 5 letters, that are far likelier in
   toxic texts, with their log odds as weights.
3. Boosted trees (Spark ML) are trained on the second part over lexicon densities, closeness of lexicon words to
   second-person words, capitals, punctuation and obfuscation rates.
4. An isotonic regression on the third part turns the trees' margin into a probability, the score.

Features are computed for every whole text in Arrow batches; trees and calibration are applied by Spark ML. Null,
empty and word-less texts have all-zero features and get the score of such texts. Repeated rows repeat their results;
an empty table gives an empty result; other columns may have any name. Without labelled rows of both kinds the score
is the share of label 1 (0 if there are none at all).
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadlake.llm.common import bounded_sample, checkpoint, table, text_pass

#: Labelled rows of each label that are used at most.
SAMPLE = 6000
#: Lexicon: entries at most, toxic sample texts that must hold one, and least log odds.
ENTRIES, SUPPORT, LOG_ODDS = 3000, 4, 2.5
TREES, DEPTH = 20, 4
_NEAR = 8  # words between a lexicon word and a second-person word

_WORDS = re.compile(r"[^\W_]+")
_MIXED = re.compile(r"[^\W\d_]+[0-9@$!*#.\-_]+(?=[^\W\d_])[^\s]*")
_INNER = re.compile(r"[.*\-_#]+")
_LEET = str.maketrans("013457@$!", "oieastasi")
# fixed values: second-person words of the four languages
_YOU = frozenset("you your yours yourself u ur du dich dir dein deine deiner ihr euch sie tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros tus".split())
FEATURES = (
    "density", "prefix_density", "strongest", "log_hits", "second_person", "you_rate", "capital_rate", "capital_words",
    "punctuation_rate", "shout_rate", "obfuscation_rate", "obfuscated_hits", "log_words",
)


def keys_of(text: str) -> set[str]:
    """Lexicon keys of a text: its lower-case words and their beginnings."""
    words = set(_WORDS.findall(text.lower()))
    return words | {w[:k] + "*" for w in words for k in (4, 5) if len(w) > k}


#: Pieces between blanks whose figures a task remembers; it starts anew when there are more.
REMEMBERED = 100_000
_PLAIN = ".,;:?!"
_FIGURES = ("words", "letters", "upper", "capital_words", "mixed", "opened", "weight", "prefix_weight", "hits", "yous", "strongest")


class _Pieces(dict):
    """Piece of text between blanks -> its row in a table of figures; no feature looks beyond a piece, but closeness,
    for which the places of lexicon and second-person words are kept. Most pieces of a text occur again, so their
    figures are computed once."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.table = np.zeros((1 << 12, len(_FIGURES)))  # twice as long whenever it is full
        self.places: dict[int, tuple[list, list]] = {}

    def __missing__(self, piece: str) -> int:
        get = self.lexicon.get
        at = len(self)
        if at == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self[piece] = at
        word = piece.strip(_PLAIN)
        if word.isalpha():  # one word and nothing mixed, as most pieces are
            low = word.lower()
            upper = 0 if word == low else 1 if word[1:] == low[1:] else sum(map(str.isupper, word))
            self.table[at, :4] = 1, len(low), upper, upper > 1 and word.isupper()
            a, b, you = get(low, 0.0), get(low[:5] + "*", 0.0) or get(low[:4] + "*", 0.0), low in _YOU
            if a or b or you:
                self.table[at, 6:] = a, b, bool(a or b), you, max(a, b)
                self.places[at] = [(0, a, b)] if a or b else [], [0] * you
            return at
        low = piece.lower()
        words = _WORDS.findall(low)
        hits = [(k, get(w, 0.0), get(w[:5] + "*", 0.0) or get(w[:4] + "*", 0.0)) for k, w in enumerate(words)]
        hits = [h for h in hits if h[1] or h[2]]
        yous = [k for k, w in enumerate(words) if w in _YOU]
        mixed = _MIXED.findall(low)
        opened = sum(bool(get(x) or get(x[:5] + "*") or get(x[:4] + "*")) for x in (_INNER.sub("", m).translate(_LEET).strip("?,;:") for m in mixed))
        upper = sum(map(str.isupper, piece)) if piece != low else 0
        capital = sum(1 for w in _WORDS.findall(piece) if len(w) > 1 and w.isupper()) if upper else 0
        self.table[at] = (len(words), sum(map(len, words)), upper, capital, len(mixed), opened, sum(h[1] for h in hits), sum(h[2] for h in hits), len(hits), len(yous), max((max(h[1:]) for h in hits), default=0.0))
        if hits or yous:
            self.places[at] = hits, yous
        return at

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The pieces of a text, as rows of the table, and those rows."""
        if len(self) > REMEMBERED:
            self.forget()
        ids = np.array([self[x] for x in text.split()], np.int64)
        return ids, self.table[ids]


def _closeness(ids: np.ndarray, rows: np.ndarray, pieces: _Pieces) -> float:
    """Strongest lexicon word near a second-person word, divided by one more than their distance."""
    first = np.cumsum(rows[:, 0]) - rows[:, 0]
    hits, yous = [], []
    for k in np.flatnonzero(rows[:, 8] + rows[:, 9]):
        h, y = pieces.places[int(ids[k])]
        hits += [(first[k] + i, max(a, b)) for i, a, b in h]
        yous += [first[k] + i for i in y]
    place, weight = np.array(hits).T
    yous = np.array(yous)
    at = np.searchsorted(yous, place)
    gap = np.minimum(np.abs(yous[np.maximum(at - 1, 0)] - place), np.abs(yous[np.minimum(at, len(yous) - 1)] - place))
    return float(np.max(np.where(gap <= _NEAR, weight / (1 + gap), 0.0)))


def features(text: str | None, pieces: _Pieces) -> list[float]:
    """The dense features of one whole text, in the order of FEATURES."""
    if not text:
        return [0.0] * len(FEATURES)
    ids, rows = pieces.of(text)
    if not len(ids):
        return [0.0] * len(FEATURES)
    n, letters, upper, capital, mixed, opened, weight, prefix, hits, yous, _ = rows.sum(0).tolist()
    per, size = 1.0 / max(n, 1), len(text)
    return [
        weight * per,
        prefix * per,
        float(rows[:, -1].max()),
        math.log1p(hits),
        _closeness(ids, rows, pieces) if hits and yous else 0.0,
        yous * per,
        upper / (letters or 1),
        capital * per,
        sum(map(text.count, ".,;:?!")) / size,
        text.count("!") / size,
        mixed * per,
        opened * per,
        math.log1p(n),
    ]


def featured(docs: DataFrame, lexicon: dict[str, float], id_col: str, text_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, *keep, features vector) of every whole text. The lexicon is broadcast: at most ENTRIES entries."""
    broadcast = docs.sparkSession.sparkContext.broadcast(lexicon)

    def make():
        pieces = _Pieces(broadcast.value)
        return lambda texts: ([features(t, pieces) for t in texts],)

    raw = text_pass(docs, id_col, text_col, make, [("_features", T.ArrayType(T.DoubleType()), pa.list_(pa.float64()))], keep)
    return raw.withColumn("_features", array_to_vector("_features"))


def learn_lexicon(texts: DataFrame) -> dict[str, float]:
    """Log odds of the keys that are far likelier in texts with toxic = 1; columns text and toxic, each text counts a
    key once. At most ENTRIES keys come to the driver."""

    def make():
        return lambda batch: ([sorted(keys_of(t)) if t else [] for t in batch],)

    total = texts.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first()
    keyed = text_pass(texts, "id", "text", make, [("keys", T.ArrayType(T.StringType()), pa.list_(pa.string()))], keep=("toxic",))
    counts = keyed.select("toxic", F.explode("keys").alias("key")).groupBy("key").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("fine"))
    odds = F.log((F.col("bad") + 0.5) / (total[0] + 1.0)) - F.log((F.col("fine") + 0.5) / (total[1] + 1.0))
    kept = counts.filter(F.col("bad") >= SUPPORT).withColumn("odds", odds).filter(F.col("odds") >= LOG_ODDS)
    return {r.key: r.odds for r in kept.orderBy(F.desc(F.col("odds") * F.sqrt("bad")), "key").limit(ENTRIES).collect()}


class Classifier:
    def __init__(self, lexicon, trees, calibration, constant: float = 0.0):
        self.lexicon, self.trees, self.calibration, self.constant = lexicon, trees, calibration, constant


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Classifier:
    """docs joined to labels (id, toxic 0/1) on the id; null ids, texts and labels are not used."""
    rows = labels.select(F.col(id_col).alias("id"), F.col("toxic").cast("int").alias("toxic")).filter("id is not null and toxic in (0, 1)")
    chosen = F.broadcast(checkpoint(bounded_sample(rows, SAMPLE, "toxic")).dropDuplicates(["id"]))  # bounded: 2 * SAMPLE ids
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter("text is not null").join(chosen, "id")
    texts = checkpoint(texts.dropDuplicates(["id"]).repartition("id"))
    part = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(3))
    mean = texts.agg(F.avg("toxic")).first()[0]
    if mean in (None, 0.0, 1.0):
        return Classifier({}, None, None, float(mean or 0.0))
    lexicon = learn_lexicon(texts.filter(part == 0))
    known = checkpoint(featured(texts, lexicon, "id", "text", keep=("toxic",)).withColumn("part", part))
    trees = GBTClassifier(featuresCol="_features", labelCol="toxic", predictionCol="_hard", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=1)
    trees = trees.setRawPredictionCol("_raw").setProbabilityCol("_p")
    fitted = trees.fit(known.filter("part <> 0" if known.filter("part = 1").agg(F.countDistinct("toxic")).first()[0] < 2 else "part = 1"))
    held = fitted.transform(known.filter("part = 2")).select("toxic", vector_to_array("_raw")[1].alias("_margin"))
    calibration = IsotonicRegression(featuresCol="_margin", labelCol="toxic", predictionCol="score").fit(held) if held.head(1) else None
    return Classifier(lexicon, fitted, calibration)


def score(docs: DataFrame, classifier: Classifier, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, *keep, score) of every row."""
    if classifier.trees is None:
        return docs.select(id_col, *keep, F.lit(classifier.constant).alias("score"))
    raw = classifier.trees.transform(featured(docs, classifier.lexicon, id_col, text_col, keep)).withColumn("_margin", vector_to_array("_raw")[1])
    if classifier.calibration is None:
        return raw.select(id_col, *keep, vector_to_array("_p")[1].alias("score"))
    return classifier.calibration.transform(raw).select(id_col, *keep, F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)).alias("score"))


def _held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def trained(spark, docs: DataFrame, sf_dir: str) -> Classifier:
    """The classifier of documents, learned from the labels that are not held out."""
    return learn(docs, table(spark, sf_dir, "labels").filter(~_held_out()))


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score(docs, trained(spark, docs, sf_dir))
    return found.select("doc_id", _held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the rows of docs whose score is below one half."""
    kept = tuple(c for c in docs.columns if c != "doc_id")
    found = score(docs, trained(spark, docs, sf_dir), keep=kept)
    return found.filter("score < 0.5").select(docs.columns)


QUERIES = {"op10_toxicity": op10_toxicity}
ORACLES: dict[str, str] = {}
