"""Personal data in whole texts, also behind homoglyphs, spelled digits and at/dot disguises.

A text is rewritten by small transducers (confusable characters to ASCII, invisible characters to nothing, digits
spelled in English, German, French or Spanish to digits, at and dot to their signs). Each keeps the source place of what
it writes, so identifiers found in the rewritten text are mapped back to spans of the source. Base spans come from the
source itself and always stay; a rewritten span is added if it rests on a rewriting and overlaps no base span of its
kind.

At and dot are read apart from each other, bracketed (`[at]`, `(punkt)`) or bare (` at `, ` dot `), and mix with real
signs, in the local part too. Bare words are common in prose: a bare dot counts only in an address with an at, and a
bare at needs a dot of the domain to be disguised too, or, before a real domain, a local part with a digit or sign in it
or a word such as `mail` close before.

Offsets are code points, end exclusive. Null and empty texts have no spans, repeated rows repeat their results, an
empty table gives an empty result, and other columns may have any name. Each scan reads the text once.
"""

from __future__ import annotations

import bisect
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadlake.llm.common import Covered, table, text_pass

KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")


def _emails(text: str) -> list[tuple[int, int]]:
    """Matches of local part, @ and dotted domain, found from each @ so that long runs are read once."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            found.append((start, end))
        at = text.find("@", max(at + 1, end))
        end = max(end, 0)
    return found


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if k % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def _ip_ok(s: str) -> bool:
    return all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in s.split("."))


def identifiers(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, leftmost and non-overlapping within a kind."""
    found = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if "." in text:
        found += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if _ip_ok(m[0])]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(digits := _NOT_DIGIT.sub("", m[0])) <= 19 and _luhn(digits):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return found


# --- transducers -----------------------------------------------------------------------------------------------------


def _confusables() -> dict[int, str]:
    """One-to-one: full-width ASCII, mathematical and other digit blocks, and letters of other alphabets that look
    like Latin ones."""
    # fixed values: look-alikes of Latin letters, by code point
    pairs = {
        0x0430: "a", 0x0435: "e", 0x043E: "o", 0x0440: "p", 0x0441: "c", 0x0443: "y", 0x0445: "x", 0x0456: "i",
        0x0458: "j", 0x0455: "s", 0x0501: "d", 0x051B: "q", 0x051D: "w", 0x0410: "A", 0x0412: "B", 0x0415: "E",
        0x041A: "K", 0x041C: "M", 0x041D: "H", 0x041E: "O", 0x0420: "P", 0x0421: "C", 0x0422: "T", 0x0425: "X",
        0x0406: "I", 0x0408: "J", 0x0405: "S", 0x03BF: "o", 0x03B1: "a", 0x03C1: "p", 0x03BD: "v", 0x039F: "O",
        0x0391: "A", 0x0392: "B", 0x0395: "E", 0x0396: "Z", 0x0397: "H", 0x0399: "I", 0x039A: "K", 0x039C: "M",
        0x039D: "N", 0x03A1: "P", 0x03A4: "T", 0x03A5: "Y", 0x03A7: "X", 0x03BA: "k", 0x03C5: "u", 0x03C7: "x",
        0x0432: "b", 0x043A: "k", 0x043C: "m", 0x043D: "h", 0x0442: "t", 0x04BB: "h", 0x04CF: "l", 0x2024: ".", 0x3002: ".", 0xFE52: ".", 0xFE6B: "@", 0xFE62: "+", 0x2010: "-",
        0x2011: "-", 0x2012: "-", 0x2013: "-", 0x2212: "-", 0x00A0: " ", 0x2009: " ", 0x202F: " ",
    }
    pairs |= {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
    pairs |= {0x1D7CE + k: str(k % 10) for k in range(50)}  # mathematical digits
    for zero in (0x0660, 0x06F0, 0x0966, 0x09E6):  # Arabic-Indic, Persian, Devanagari, Bengali
        pairs |= {zero + k: str(k) for k in range(10)}
    pairs |= {0x2460 + k: str(k + 1) for k in range(9)}  # circled
    return pairs


_SAME = _confusables()
_ODD = re.compile("[" + "".join(map(chr, sorted(_SAME))) + "]")
_UNSEEN = re.compile("[­​-‍⁠﻿]+")
# fixed values: digits in words, zero to nine
_SPELLINGS = (
    "zero one two three four five six seven eight nine", "oh", "null eins zwei drei vier fünf sechs sieben acht neun", "null ein zwo drei vier fuenf",
    "zéro un deux trois quatre cinq six sept huit neuf", "zero une", "cero uno dos tres cuatro cinco seis siete ocho nueve",
)
_DIGITS = {w: str(k) for line in _SPELLINGS for k, w in enumerate(line.split())}
_SPELLED = "(?:" + "|".join(sorted(_DIGITS, key=lambda w: (-len(w), w))) + ")"
_POINT = "(?:dot|punkt|punto|point)"
_RUN = re.compile(rf"(?<![^\W_])(?:(?:plus|más)[ -])?(?:{_SPELLED}|[0-9]+)(?:(?:[ -]|[ -]?(?:{_POINT}|\.|,)[ -]?)(?:{_SPELLED}|[0-9]+))+(?![^\W\d_])", re.I)
_TOKEN = re.compile(rf"{_SPELLED}|[0-9]+|plus|más|{_POINT}|\.", re.I)
_SIGN = {"plus": "+", "más": "+", "dot": ".", "punkt": ".", "punto": ".", "point": ".", ".": "."}
_WORD = re.compile(_SPELLED, re.I)
_POINTS = re.compile(_POINT, re.I)
_AT = re.compile(r"\x20{0,4}[\[({<]\x20?(?:at|@|arroba|arobase)\x20?[\])}>]\x20{0,4}|(?P<bare>\x20{1,4}(?:at|arroba|arobase|@)\x20{1,4})|@", re.I)
_BRACKETED = re.compile(rf"\x20{{0,4}}[\[({{<]\x20?(?:{_POINT}|\.)\x20?[\])}}>]\x20{{0,4}}", re.I)
_DOT = re.compile(rf"{_BRACKETED.pattern}|\x20{{1,4}}{_POINT}\x20{{1,4}}", re.I)
_LABEL = re.compile(r"[A-Za-z0-9-]+")
_MAIL = re.compile("mail|contact|kontakt|contacto|correo|reach|write|schreib|écri|escrib", re.I)
_SIGNED = re.compile(r"[0-9._%+-]")


class Rewritten:
    """A rewritten text and, for every rewriting, its place there and in the source."""

    def __init__(self, text: str, edits: list[tuple[int, int, str]]):
        parts, self.at, self.source = [], [0], [(0, 0, False)]  # starts of pieces; (source start, source end, rewritten)
        self.source[0] = (0, edits[0][0] if edits else len(text), False)
        parts.append(text[: edits[0][0]] if edits else text)
        n = len(parts[0])
        for k, (a, b, to) in enumerate(edits):
            stop = edits[k + 1][0] if k + 1 < len(edits) else len(text)
            for piece, span in ((to, (a, b, True)), (text[b:stop], (b, stop, False))):
                if piece:
                    parts.append(piece)
                    self.at.append(n)
                    self.source.append(span)
                    n += len(piece)
        self.text = "".join(parts)

    def back(self, start: int, end: int) -> tuple[int, int, bool]:
        """Source span of a rewritten span, and whether a rewriting lies inside."""
        first, last = bisect.bisect_right(self.at, start) - 1, bisect.bisect_right(self.at, end - 1) - 1
        a, _, changed = self.source[first]
        a = a if changed else a + start - self.at[first]
        b0, b1, changed = self.source[last]
        b = b1 if changed else b0 + end - self.at[last]
        return a, b, b - a != end - start or any(x[2] for x in self.source[first : last + 1])


def _addresses(text: str, source: str) -> list[tuple[int, int, str]]:
    """Rewritings of the disguised signs of e-mail addresses, found from each at. Words and signs between blanks count
    where something else tells an address; a sign that only looks like @ in the source does so itself."""
    dots = [m.span() for m in _DOT.finditer(text)]
    by_start, by_end = {a: b for a, b in dots}, {b: a for a, b in dots}
    found, done = [], 0
    for m in _AT.finditer(text):
        edits, a, z = [], m.start(), m.end()
        if (a == z - 1) and not dots:  # a real at among real dots is a base span
            continue
        while True:  # the local part, backwards
            start = a
            while a > done and text[a - 1] in _LOCAL:
                a -= 1
            if a == start or a not in by_end or by_end[a] <= done:
                break
            edits.append((by_end[a], a, "."))
            a = by_end[a]
        if a == start and edits:  # a dot with nothing before it
            a = edits.pop()[1]
        if a == m.start():
            continue
        labels, hard = 0, False
        while label := _LABEL.match(text, z):
            labels, z = labels + 1, label.end()
            if text.startswith(".", z) and _LABEL.match(text, z + 1):
                z += 1
            elif z in by_start and _LABEL.match(text, by_start[z]):
                hard = True
                edits.append((z, by_start[z], "."))
                z = by_start[z]
            else:
                break
        if labels < 2:
            continue
        disguised = "@" in m[0] and "@" not in source[m.start() : m.end()]
        if m["bare"] and not hard and not edits and not disguised:
            if not _SIGNED.search(text, a, m.start()) and not _MAIL.search(text, max(done, a - 30), a):
                continue
        if m.end() - m.start() > 1:
            edits.append((m.start(), m.end(), "@"))
        found += edits
        done = z
    return found


def _edits(text: str, source: str) -> list[tuple[int, int, str]]:
    """Non-overlapping rewritings by place: invisible characters, disguised signs, digits and points in words. source is
    the text before its look-alikes were replaced, place by place."""
    found = [] if text.isascii() else [(m.start(), m.end(), "") for m in _UNSEEN.finditer(text)]
    if any(c in text for c in "[({<"):
        found += [(m.start(), m.end(), ".") for m in _BRACKETED.finditer(text)]
    if _AT.search(text):
        found += _addresses(text, source)
    for m in _RUN.finditer(text):
        if _WORD.search(m[0]) or _POINTS.search(m[0]):
            found.append((m.start(), m.end(), "".join(_SIGN.get(w := t.lower()) or _DIGITS.get(w, w) for t in _TOKEN.findall(m[0]))))
    found.sort()
    kept, end = [], 0
    for a, b, to in found:
        if a >= end:
            kept.append((a, b, to))
            end = b
    return kept


def hidden(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans that show only after rewriting; none overlaps a base span of its kind."""
    odd = not text.isascii() and bool(_ODD.search(text))
    plain = text.translate(_SAME) if odd else text
    edits = _edits(plain, text)
    if not odd and not edits:
        return []
    new = Rewritten(plain, edits)
    taken = {k: Covered((a, b) for kind, a, b in base if kind == k) for k in KINDS}
    found = []
    for kind, a, b in identifiers(new.text):
        a, b, changed = new.back(a, b)
        if (changed or text[a:b] != plain[a:b]) and not taken[kind].meets(a, b):
            found.append((kind, a, b))
    return found


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, added): arrays of spans {kind, start, end} in source code points, by kind as in KINDS, then start."""
    span = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def make():
        order = {k: i for i, k in enumerate(KINDS)}

        def work(texts):
            base = [identifiers(t) if t else [] for t in texts]
            added = [hidden(t, x) if t else [] for t, x in zip(texts, base)]
            rows = lambda found: [[{"kind": k, "start": a, "end": b} for k, a, b in sorted(x, key=lambda s: (order[s[0]], s[1]))] for x in found]
            return rows(base), rows(added)

        return work

    return text_pass(docs, id_col, text_col, make, [("base", span, arrow), ("added", span, arrow)])


def joined_spans(spans: F.Column) -> F.Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def in_order(spans: F.Column, kinds: tuple[str, ...], by_kind: bool) -> F.Column:
    """Spans sorted by (kind, start) or by (start, kind), kinds as listed."""
    listed = F.array(*map(F.lit, kinds))
    place = lambda s: F.array_position(listed, s["kind"])
    key = lambda s: F.struct(place(s).alias("k"), s["start"].alias("a")) if by_kind else F.struct(s["start"].alias("a"), place(s).alias("k"))
    keyed = F.transform(spans, lambda s: F.struct(key(s).alias("by"), s["end"].alias("e"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda x: x["s"])


def op1_pii(spark, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    every = in_order(F.concat("base", "added"), KINDS, by_kind=True)
    return found.select("doc_id", *map(count, KINDS), F.sha2(joined_spans(F.col("base")), 256).alias("base_sha256"), joined_spans(every).alias("spans"))


QUERIES = {"op1_pii": op1_pii}
ORACLES: dict[str, str] = {}
