"""Encoding of whole texts by public tokenizers, chunk by chunk.

A text is cut at every single blank that follows a character other than a blank and stands before one that is not white
space. No match of the byte-level pattern goes over such a place, and no piece of the other vocabulary has a blank after
another character, so what lies between two cuts is encoded as it would be within the whole text (the tests compare both
with the libraries on whole texts). Chunks repeat, so a worker remembers what it has made of them in a bounded table, and
a very long text needs no more memory than its longest chunk.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np

from leadlake.llm.common import TABLES, release_tables

#: Encodings of chunks that a Python worker remembers; it starts anew when there are more.
REMEMBERED = 300_000
#: Characters of the longest chunk that is remembered.
LONGEST = 64
_ODD = re.compile(r" (?:\s|\Z)")
_CUT = re.compile(r"(?<! ) (?=\S)")


def chunks(text: str) -> list[str]:
    """What lies between the cuts of a text; the blanks at the cuts are left out. The first chunk may be empty."""
    return _CUT.split(text) if _ODD.search(text) else text.split(" ")


def byte_ranks(definition: bytes) -> dict[bytes, int]:
    """Token bytes -> id of a byte-level BPE from its JSON definition, whose ids must be in the order of the merges."""
    model = json.loads(definition)["model"]
    vocabulary = model["vocab"]
    made = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if made != sorted(made):
        raise ValueError("the ids of this vocabulary are not in the order of its merges")
    # printable Latin-1 characters stand for themselves, those from U+0100 on for the other bytes in order
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(sorted({*range(256)} - {*printable}))}
    return {bytes(map(byte.__getitem__, t)): i for t, i in vocabulary.items()}


def byte_encoding(definition: bytes, pattern: str):
    """The encoder of a byte-level BPE; strings of special tokens are ordinary text to it."""
    import tiktoken

    ranks = byte_ranks(definition)
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), ranks


class Definition:
    """A tokenizer's file, broadcast to the executors (its size is that of the file)."""

    def __init__(self, spark, path: str):
        with open(path, "rb") as f:
            data = f.read()
        self.id, self.data = hashlib.sha256(data).hexdigest(), spark.sparkContext.broadcast(data)


_WORKER = TABLES.setdefault("tokenizing", {})  # what was made last, and the definitions that it was made of


def kept_by_worker(key: tuple, make):
    """make() once in a Python worker; only what was made last is kept."""
    release_tables("tokenizing")
    if _WORKER.get("key") != key:
        _WORKER.clear()
        _WORKER.update(key=key, made=make())
    return _WORKER["made"]


class Ids(dict):
    """Chunk, without the blank before it -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, definition: bytes, pattern: str):
        self.encode = byte_encoding(definition, pattern)[0].encode_ordinary

    def __missing__(self, chunk: str) -> bytes:
        found = np.array(self.encode(" " + chunk), "<u4").tobytes()
        if len(self) >= REMEMBERED:
            self.clear()
        if len(chunk) <= LONGEST:
            self[chunk] = found
        return found

    def of(self, text: str) -> bytes:
        """Ids of a whole text."""
        first, *more = chunks(text)
        return b"".join((np.array(self.encode(first), "<u4").tobytes(), *map(self.__getitem__, more)))
