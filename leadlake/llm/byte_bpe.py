"""Byte-level BPE encoding and decoding of whole texts.

Each pattern match is encoded separately. A segment tree over its byte positions stores, at every node, the lowest
pair rank below it and the leftmost position that has it; the root names the next merge, and a merge rewrites the
leaves of the merged pair and its left neighbour only, each in a logarithmic number of steps. A match of n bytes takes
O(n log n), so one of a million bytes is no problem. A task remembers the encodings of frequent matches in a bounded
table.

Nulls and empty texts have no tokens. Repeated rows give repeated results. An empty table gives an empty result. Only
the id and the text are read, so other columns may have any name.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadlake.llm.common import TABLES, release_tables, slices, table, text_pass
from leadlake.session import ship

#: Encodings of matches that a Python worker remembers; it starts anew when there are more.
REMEMBERED = 400_000
#: Children of a segment tree node. Most matches have at most this many bytes, and then the root is above the leaves.
FAN = 16
_NONE = 1 << 62


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, map(bytes.strip, f)))}


def encode_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pattern match: repeatedly merge the leftmost of the adjacent pairs with the lowest rank."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n, get = len(piece), ranks.get
    # rank << 32 | position, so that the smallest is the leftmost of the lowest rank
    leaves = [_NONE if (r := get(piece[i : i + 2])) is None else r << 32 | i for i in range(n)]
    leaves[n - 1] = _NONE
    tree = [leaves]
    while len(tree[-1]) > FAN:
        below = tree[-1]
        tree.append([min(below[k : k + FAN]) for k in range(0, len(below), FAN)])
    root, high = tree[-1], len(tree) > 1
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # neighbours among the live positions
    while (low := min(root)) != _NONE:
        i = low & 0xFFFFFFFF
        j = after[i]
        after[i] = end = after[j]
        leaves[j] = _NONE
        if end < n:
            before[end] = i
            r = get(piece[i : after[end]])
            leaves[i] = _NONE if r is None else r << 32 | i
        else:
            leaves[i] = _NONE
        if (p := before[i]) >= 0:
            r = get(piece[p:end])
            leaves[p] = _NONE if r is None else r << 32 | p
        if high:
            for leaf in {max(p, 0), i, j}:
                below = leaves
                for level in tree[1:]:
                    at = leaf // FAN
                    low = min(below[at * FAN : at * FAN + FAN])
                    if level[at] == low:
                        break
                    level[at] = low
                    below, leaf = level, at
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


class _Pieces(dict):
    """Match -> its ids as little-endian unsigned 32-bit integers, encoded when first asked for."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks

    def __missing__(self, piece: str) -> bytes:
        found = np.array(encode_piece(piece.encode(), self.ranks), "<u4").tobytes()
        if len(self) >= REMEMBERED:
            self.clear()
        if len(piece) <= 64:
            self[piece] = found
        return found


_WORKER = TABLES.setdefault("byte_bpe", {})  # the vocabulary last used and its pieces


def _pieces(vocabulary_id: str, ranks) -> _Pieces:
    if _WORKER.get("of") != vocabulary_id:
        _WORKER.update(of=vocabulary_id, pieces=_Pieces(ranks.value))
    return _WORKER["pieces"]


class Vocabulary:
    """Ranks and pattern of a byte-level BPE, broadcast to the executors (its size is that of the file)."""

    def __init__(self, spark, path: str, pattern: str):
        ranks = read_ranks(path)
        self.pattern, self.id = pattern, hashlib.sha256(repr(sorted(ranks.items())).encode()).hexdigest()
        self.ranks = spark.sparkContext.broadcast(ranks)


def _encoder(vocabulary_id: str, ranks, pattern: str):
    """Function from texts to their numbers of tokens and their packed ids."""
    pieces, find = _pieces(vocabulary_id, ranks), regex.compile(pattern).findall

    def work(texts):
        ids = [b"".join(map(pieces.__getitem__, find(t))) if t else b"" for t in texts]
        return [len(x) // 4 for x in ids], ids

    return work


def encode(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens long, ids binary): the ids of every whole text, as little-endian unsigned 32-bit integers."""
    broadcast, vocabulary_id, pattern = vocabulary.ranks, vocabulary.id, vocabulary.pattern

    def make():
        return _encoder(vocabulary_id, broadcast, pattern)

    fields = [("n_tokens", T.LongType(), pa.int64()), ("ids", T.BinaryType(), pa.binary())]
    return text_pass(docs, id_col, text_col, make, fields, tables="byte_bpe")


def _decoded(batches: Iterator[pa.RecordBatch], at: int, ranks: dict[bytes, int], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches with one more column, the bytes of the ids in column `at`."""
    pieces: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
    for piece, i in ranks.items():
        pieces[i] = piece
    for batch in batches:
        for part in slices(batch, 4 << 20):
            found = [b"".join(map(pieces.__getitem__, np.frombuffer(x or b"", "<u4").tolist())) for x in part.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.binary())], names=names)


def decode(tokens: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids") -> DataFrame:
    """The rows of `encode` with `decoded` binary, the bytes that the ids stand for (empty for null)."""
    ship(tokens.sparkSession)
    broadcast = vocabulary.ranks
    schema = T.StructType([*tokens.schema.fields, T.StructField("decoded", T.BinaryType())])
    at = tokens.columns.index(ids_col)
    return tokens.mapInArrow(lambda batches: _decoded(batches, at, broadcast.value, schema.names), schema)


def round_trip(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`decode(encode(docs))` in one Python worker per task instead of two: (id, n_tokens, ids, decoded)."""
    ship(docs.sparkSession)
    broadcast, vocabulary_id, pattern = vocabulary.ranks, vocabulary.id, vocabulary.pattern
    kept = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    binary = T.BinaryType()
    schema = T.StructType([docs.schema[id_col], T.StructField("n_tokens", T.LongType()), T.StructField("ids", binary), T.StructField("decoded", binary)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_tables("byte_bpe")
        work = _encoder(vocabulary_id, broadcast, pattern)

        def encoded() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, 4 << 20):
                    n, ids = work(part.column(1).to_pylist())
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], names=schema.names[:3])

        yield from _decoded(encoded(), 2, broadcast.value, schema.names)

    return kept.mapInArrow(run, schema)


def production_vocabulary(spark) -> Vocabulary:
    import public_tokenizers

    return Vocabulary(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_byte_bpe(spark, sf_dir: str) -> DataFrame:
    vocabulary = production_vocabulary(spark)
    both = round_trip(table(spark, sf_dir, "documents"), vocabulary)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op5_byte_bpe": op5_byte_bpe}
ORACLES: dict[str, str] = {}
