"""Secrets in whole texts, with a guess-cost test for values in a credential context.

The base patterns find assignments, access keys and long hex strings. Beside them, the value after a credential word
(`passphrase: …`, `pwd is …`) is cut into words, dates, repeats, keyboard walks and brute-force spans by a dynamic
programme that minimises the decimal logarithm of the guesses an attacker needs; a value of at least GUESSES is added
as a span of kind `guess`. Segments of every length are tried, so the cost is the least over all segmentations. Costs
add up along the value, so the programme stops as soon as every way to go on costs enough, and a value of any length is
judged whole.

Offsets are code points, end exclusive. Null and empty texts have no spans, repeated rows repeat their results, an
empty table gives an empty result, and other columns may have any name.
"""

from __future__ import annotations

import heapq
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadlake.llm.byte_bpe import read_ranks
from leadlake.llm.common import Covered, table, text_pass
from leadlake.llm.pii import in_order, joined_spans

KINDS = ("assign", "access", "hex")
#: Decimal logarithm of the guesses from which a value counts as a secret.
GUESSES = 10.0

_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_CONTEXT = re.compile(
    r"(?:password|passwd|passphrase|passcode|pwd|secret|token|api[_ -]?key|access[_ -]?key|private[_ -]?key|credentials?"
    r"|passwort|kennwort|zugangscode|geheimnis|schl(?:[üÜ]|ue)ssel|mots?[ _-]de[ _-]passe|code[ _-]secret|cl(?:[éÉ]|e)[ _-]secr(?:[èÈ]|e)te"
    r"|contrase(?:[ñÑ]|n)a|clave(?:[ _-](?:secreta|de[ _-]acceso))?)"
    r"[\"']?[\x20\xa0]?(?:=>|->|:=|[:=]|\x20(?:is|ist|lautet|est|es)\x20)[\x20\xa0]?[\"'`]?([^\s\"'`<>]+)",
    re.I | re.A,
)
_HEAD = re.compile("pass|pwd|secret|token|key|credential|kennwort|zugangscode|geheimnis|schl(?:[üÜ]|ue)ssel|contrase|clave", re.I | re.A)


def patterns(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, leftmost and non-overlapping within a kind."""
    found = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return found + [("hex", m.start(), m.end()) for m in _HEX.finditer(text) if m.end() - m.start() >= 24]


# fixed values: rows of the common keyboard layouts
_ROWS = ("1234567890", "qwertyuiop", "qwertzuiop", "azertyuiop", "asdfghjkl", "zxcvbnm", "yxcvbnm", "abcdefghijklmnopqrstuvwxyz")
_NEXT = {(r[k], r[k + 1]) for r in _ROWS for k in range(len(r) - 1)}
_NEXT |= {(b, a) for a, b in _NEXT}
_LEET = str.maketrans("@4301!5$7", "aaeoiisst")
_DATES = (
    re.compile(r"(?:19|20)[0-9]{2}[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12][0-9]|3[01])"),
    re.compile(r"(?:0[1-9]|[12][0-9]|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)[0-9]{2}"),
)
_SEGMENT = math.log10(2)  # each further segment
_UNIT = 8  # characters of a repeated unit at most


def _alphabet(c: str) -> float:
    return 1.0 if c.isdigit() else math.log10(26) if c.isascii() and c.isalpha() else math.log10(33)


def _lower(value: str) -> str:
    """Lower case, place by place."""
    low = value.lower()
    return low if len(low) == len(value) else "".join(x if len(x := c.lower()) == 1 else c for c in value)


def guess_cost(value: str, words: dict[str, float], enough: float = math.inf, longest: int | None = None) -> float:
    """Least log10 of guesses over all segmentations of the whole value, or `enough` if that is no more.

    The programme fixes the places of the value in the order of their least cost, so it ends when the end of the value
    is fixed or when all that is left costs enough. A repeat is offered one more time whenever its cost so far is
    reached, so a long run of one character does not offer all its parts at once; a place reached by a repeat starts no
    other one of the same run, which would cost more than going on. longest: length of the longest word.
    """
    low, n = _lower(value), len(value)
    plain = low.translate(_LEET)
    longest = max(map(len, words), default=0) if longest is None else longest
    best, fixed = {0: 0.0}, set()
    heap = [(0.0, 0, 0, 0, 0.0)]  # cost, place; of a repeat also the length of its unit, how many times, cost of one

    def reach(j: int, cost: float) -> None:
        if cost < best.get(j, math.inf):
            best[j] = cost
            heapq.heappush(heap, (cost, j, 0, 0, 0.0))

    while heap:
        here, i, via, times, one = heapq.heappop(heap)
        if here >= enough:
            return enough
        if via:
            if value.startswith(value[i - via : i], i):
                heapq.heappush(heap, (one + math.log10(times + 1), i + via, via, times + 1, one))
            if via * times < 3:
                continue
        if i in fixed:
            continue
        fixed.add(i)
        if i == n:
            return here
        step = here + _SEGMENT * bool(i)
        reach(i + 1, here + _alphabet(value[i]))  # brute force, one more character
        for j in range(i + 3, min(n, i + longest) + 1):
            capital = 0.3 * (value[i:j] != low[i:j])
            for text, more in ((low[i:j], 0.0), (plain[i:j], 0.5)):
                if (rank := words.get(text)) is not None:
                    reach(j, step + rank + more + capital)
        if value[i].isdigit():
            for m in filter(None, (d.match(value, i) for d in _DATES)):
                reach(m.end(), step + math.log10(365.25 * 200))
        k = i + 1
        while k < n and (low[k - 1], low[k]) in _NEXT and step + 0.3 * (k - i) < enough:
            k += 1
            if k >= i + 4:
                reach(k, step + math.log10(94) + 0.3 * (k - i))
        one = step
        for unit in range(1, min(_UNIT, (n - i) // 2) + 1):
            one += _alphabet(value[i + unit - 1])
            if value.startswith(value[i : i + unit], i + unit) and not (via and unit % via == 0 and value.startswith(value[i - via : i] * (unit // via), i)):
                heapq.heappush(heap, (one + math.log10(2), i + 2 * unit, unit, 2, one))
    return best[n]


def repeat_cost(value: str) -> float:
    """log10 of the guesses of a value that is one short unit over and over, in one step; infinite for others."""
    n = len(value)
    for unit in range(1, min(_UNIT, n // 2) + 1):
        if n >= 3 and value[unit:] == value[: n - unit]:
            times, rest = divmod(n, unit)
            return sum(map(_alphabet, value[:unit])) + math.log10(times) + _SEGMENT * bool(rest) + sum(map(_alphabet, value[n - rest :] if rest else ""))
    return math.inf


def costs(value: str, words: dict[str, float], longest: int | None = None) -> bool:
    """Whether guessing the value costs at least GUESSES. Long repeats are told at once: their cost bounds the least."""
    return repeat_cost(value) >= GUESSES and guess_cost(value, words, GUESSES, longest) >= GUESSES


def dictionary(path: str) -> dict[str, float]:
    """Words of a public vocabulary file with the logarithm of their rank; the file bounds its size."""
    found: dict[str, float] = {}
    for piece, rank in sorted(read_ranks(path).items(), key=lambda x: x[1]):
        word = piece.decode("utf-8", "ignore").strip().lower()
        if len(word) >= 3 and word.isalpha():
            found.setdefault(word, math.log10(rank + 1))
    return found


def guessed(text: str, base: list[tuple[str, int, int]], words: dict[str, float], longest: int | None = None) -> list[tuple[str, int, int]]:
    """Values in a credential context that cost at least GUESSES and overlap no base span."""
    if not _HEAD.search(text):
        return []
    taken = Covered((a, b) for _, a, b in base)
    return [
        ("guess", m.start(1), m.end(1))
        for m in _CONTEXT.finditer(text)
        if m.end(1) - m.start(1) >= 6 and not taken.meets(*m.span(1)) and costs(m[1].rstrip(".,;:!?)"), words, longest)
    ]


def find_secrets(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, added): arrays of spans {kind, start, end} in code points. vocabulary: path of the word file, read
    on the driver and broadcast (about 50,000 entries)."""
    span = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    broadcast = docs.sparkSession.sparkContext.broadcast(dictionary(vocabulary))

    def make():
        words = broadcast.value
        longest = max(map(len, words), default=0)

        def work(texts):
            base = [patterns(t) if t else [] for t in texts]
            added = [guessed(t, x, words, longest) if t else [] for t, x in zip(texts, base)]
            rows = lambda found: [[{"kind": k, "start": a, "end": b} for k, a, b in x] for x in found]
            return rows(base), rows(added)

        return work

    return text_pass(docs, id_col, text_col, make, [("base", span, arrow), ("added", span, arrow)])


def op6_secrets(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = find_secrets(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    ordered = lambda spans: joined_spans(in_order(spans, (*KINDS, "guess"), by_kind=False))
    return found.select("doc_id", *map(count, KINDS), F.sha2(ordered(F.col("base")), 256).alias("base_sha256"), ordered(F.concat("base", "added")).alias("spans"))


QUERIES = {"op6_secrets": op6_secrets}
ORACLES: dict[str, str] = {}
