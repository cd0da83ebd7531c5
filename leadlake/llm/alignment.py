"""Alignment of two tokenizers over all texts, with corpus-wide link counts from inverted pair bitmaps.

* Texts. A encodes a blank and the text, B the text, to which it adds the blank itself. Both are encoded and aligned chunk
  by chunk (see tokenizing), as a cut is a place where tokens of both end. A link is an overlap of an A and a B token, so
  there is one for each piece between two neighbouring token ends of either kind.
* Inverted pair bitmaps. Documents belong to blocks of a few MB of text. A posting is a pair of ids in a block: a bitmap of
  the block's documents that hold the pair, compressed to the 64-bit words that are not zero, and planes of the same
  form for the multiplicities, of which plane k has bit k - 1 of (links - 1). Bits of a block are OR-merged in its task, and
  as blocks do not meet, the corpus-wide bitmap of a pair is the sequence of its blocks' words.
* Counts. The popcount of a pair's bitmap is its number of documents, that of the planes, weighted, its number of links.
  The highest count of every B id is one more aggregation.
* Scores. Counts go back to the postings (pairs of many blocks by broadcast, others by a shuffle, see joined_by_key), and
  the postings of a block, which are bounded by its text, add them up for its documents.

Null, empty and other texts that one of the tokenizers does not give back byte by byte have no tokens: zeros and an empty
string. Repeated rows count each for itself. An empty table gives an empty result. Only the id and the text are read, so
other columns may have any name.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadlake.llm.common import joined_by_key, slices, store, table
from leadlake.llm.tokenizing import REMEMBERED, Definition, byte_encoding, chunks, kept_by_worker
from leadlake.session import ship

#: Bytes of text in a block.
BLOCK = 4 << 20
#: Links and bytes of group texts that a worker remembers for its chunks.
MOST_LINKS, MOST_BYTES = 8_000_000, 64 << 20


def piece_bytes(model) -> list[bytes]:
    """Bytes of each piece of a SentencePiece model."""
    return [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(model.id_to_piece, range(model.vocab_size())))]


class Chunks(dict):
    """Chunk, without the blank before it -> its number in arrays that hold what aligning it gave."""

    def __init__(self, a: bytes, pattern: str, b: bytes):
        import sentencepiece

        encoding, ranks = byte_encoding(a, pattern)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=b)
        self.encode_a, self.encode_b = encoding.encode_ordinary, self.model.encode
        self.bytes_a, self.bytes_b = [b""] * (max(ranks.values()) + 1), piece_bytes(self.model)
        for token, i in ranks.items():
            self.bytes_a[i] = token
        self.width = len(self.bytes_b)
        self.length_a, self.length_b = (np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b))
        # ids as text with what may follow them, by separator and id
        self.texts, self.spread = [b"%d%s" % (i, end) for end in (b",", b"|", b";") for i in range(len(self.bytes_a))], len(self.bytes_a)
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.sizes = array("q")  # A tokens, B tokens, groups and links of each chunk; -1s if a tokenizer changes it
        self.pairs, self.starts = array("q"), array("q", [0])
        self.groups: list[bytes] = []
        self.bytes = 0

    def trim(self) -> None:
        if len(self) > REMEMBERED or len(self.pairs) > MOST_LINKS or self.bytes > MOST_BYTES:
            self.forget()

    def learn(self, new: list[str]) -> None:
        """Align chunks. Those without white space at their ends are put together again, many to a text, as a cut may be
        taken back as well; others, and all if a tokenizer changes one of them, are aligned one by one."""
        whole = [c for c in new if c == c.strip() and "▁" not in c]
        if whole and not self.aligned(whole, [" ".join(whole[i : i + 500]) for i in range(0, len(whole), 500)]):
            whole = []
        for c in new if not whole else (c for c in new if c not in self):
            if not self.aligned([c], [c]):
                self.put([c], np.full((4, 1), -1), np.zeros(0, np.int64), np.zeros(1, np.int64), [b""])

    def aligned(self, new: list[str], texts: list[str]) -> bool:
        """Align chunks that make up the texts; false if a tokenizer does not give them back."""
        a, b = [i for t in texts for i in self.encode_a(" " + t)], [i for t in self.encode_b(texts) for i in t]
        known = "".join(f" {t}" for t in texts).encode()
        if b"".join(map(self.bytes_a.__getitem__, a)) != known or b"".join(map(self.bytes_b.__getitem__, b)) != known:
            return False
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        end_a, end_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        ends = np.cumsum(np.fromiter((len(c.encode()) + 1 for c in new), np.int64, len(new)))
        every, both = np.union1d(end_a, end_b), np.intersect1d(end_a, end_b, assume_unique=True)
        pairs = a[np.searchsorted(end_a, every)] * self.width + b[np.searchsorted(end_b, every)]
        count = lambda at: np.bincount(np.searchsorted(ends, at), minlength=len(ends))
        sizes = np.stack([count(x) for x in (end_a, end_b, both, every)])
        # tokens by group, A before B; the last of each kind in a group is followed by | or ;
        order = np.concatenate([np.searchsorted(both, end_a) * 2, np.searchsorted(both, end_b) * 2 + 1])
        at = np.argsort(order, kind="stable")
        order = order[at]
        last = np.diff(order, append=-1) != 0
        text = list(map(self.texts.__getitem__, (np.concatenate([a, b])[at] + np.where(last, 1 + order % 2, 0) * self.spread).tolist()))
        cut = [0, *np.cumsum(sizes[0] + sizes[1]).tolist()]
        self.put(new, sizes, pairs, np.cumsum(sizes[3]), [b"".join(text[x:y])[:-1] for x, y in zip(cut, cut[1:])])
        return True

    def put(self, new: list[str], sizes: np.ndarray, pairs: np.ndarray, ends: np.ndarray, groups: list[bytes]) -> None:
        n = len(self.groups)
        self.update(zip(new, range(n, n + len(new))))
        self.starts.frombytes((ends + len(self.pairs)).astype(np.int64).tobytes())
        self.pairs.frombytes(pairs.tobytes())
        self.sizes.frombytes(np.ascontiguousarray(sizes.T, np.int64).tobytes())
        self.groups += groups
        self.bytes += sum(map(len, groups)) + sum(map(len, new))

    def of(self, texts: list[str | None]) -> list[list[int]]:
        """Numbers of the chunks of whole texts; null and empty texts have none."""
        cut = []
        for t in texts:
            first, *more = chunks(" " + t) if t else ("",)
            cut.append([first[1:], *more] if first else more)
        self.learn(list(dict.fromkeys(c for d in cut for c in d if c not in self)))
        return [list(map(self.__getitem__, d)) for d in cut]


def postings(pair: np.ndarray, doc: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs, offsets, places and words of the bitmaps of a block. Rows are (pair, document, links), sorted and distinct
    by pair and document. A place is plane << 16 | word; plane 0 is the bitmap of documents."""
    if not len(pair):
        return np.zeros(0, np.int64), np.zeros(1, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int64)
    more, found = times - 1, []
    for plane in range(int(more.max()).bit_length() + 1):
        at = np.flatnonzero(more >> (plane - 1) & 1) if plane else np.arange(len(pair))
        if len(at):
            key = pair[at] << 10 | doc[at] >> 6
            cut = np.flatnonzero(np.diff(key, prepend=-1))
            bit = np.left_shift(np.uint64(1), (doc[at] & 63).astype(np.uint64))
            found.append((key[cut] >> 10, plane << 16 | key[cut] & 1023, np.bitwise_or.reduceat(bit, cut)))
    key, place, word = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(key, kind="stable")
    key = key[order]
    cut = np.flatnonzero(np.diff(key, prepend=-1))
    return key[cut], np.append(cut, len(key)).astype(np.int32), place[order].astype(np.int32), word[order].view(np.int64)


def _expanded(starts: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the entries of each number in a flat array, and how many each has."""
    many = starts[number + 1] - starts[number]
    return np.repeat(starts[number] - (np.cumsum(many) - many), many) + np.arange(many.sum()), many


def align(docs: DataFrame, a: Definition, pattern: str, b: Definition, id_col: str = "doc_id", text_col: str = "text", groups: bool = False) -> DataFrame:
    """Rows of two kinds. Documents: (id, block, doc, n_a, n_b, n_groups, n_links, groups_sha256, and groups if wanted).
    Postings: (block, pair, at array<int>, bits array<long>); pair is A's id times B's number of ids plus B's id.
    It is read more than once, so store it."""
    ship(docs.sparkSession)
    kept = docs.select(id_col, F.col(text_col).cast("string").alias("_text"))
    longs = ("block", "doc", "n_a", "n_b", "n_groups", "n_links")
    schema = T.StructType(
        [docs.schema[id_col], *(T.StructField(c, T.LongType()) for c in longs), T.StructField("groups_sha256", T.StringType()), *[T.StructField("groups", T.StringType())] * groups]
        + [T.StructField("pair", T.LongType()), T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("bits", T.ArrayType(T.LongType()))]
    )
    key, data_a, data_b, names = ("pair", a.id, pattern, b.id), a.data, b.data, schema.names

    def block_of(known: Chunks, part: pa.RecordBatch, block: int) -> Iterator[pa.RecordBatch]:
        texts = part.column(1).to_pylist()
        n = len(texts)
        numbers = known.of(texts)
        sizes = np.frombuffer(known.sizes, np.int64).reshape(-1, 4)
        many = np.fromiter(map(len, numbers), np.int64, n)
        doc, number = np.repeat(np.arange(n), many), np.fromiter((x for d in numbers for x in d), np.int64, many.sum())
        lost = np.zeros(n, bool)
        lost[doc[sizes[number, 0] < 0]] = True
        total = np.stack([np.bincount(doc, sizes[number, c], n).astype(np.int64) for c in range(4)])
        total[:, lost] = 0
        text = [b"" if gone else b";".join(map(known.groups.__getitem__, d)) for d, gone in zip(numbers, lost)]
        sha = [hashlib.sha256(t).hexdigest() if t else "" for t in text]
        own = [pa.array(total[c]) for c in range(4)] + [pa.array(sha, pa.string())] + [pa.array([t.decode() for t in text], pa.string())] * groups
        own += [pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int32())), pa.nulls(n, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.full(n, block)), pa.array(np.arange(n)), *own], names=names)
        # links of every chunk of a document, then of every pair
        good = ~lost[doc]
        each, times = np.unique(doc[good] << 32 | number[good], return_counts=True)
        at, many = _expanded(np.frombuffer(known.starts, np.int64), each & 0xFFFFFFFF)
        if not len(at):
            return
        pair = np.frombuffer(known.pairs, np.int64)[at] << 16 | np.repeat(each >> 32, many)
        times = np.repeat(times, many)
        order = np.argsort(pair)
        pair, times = pair[order], times[order]
        cut = np.flatnonzero(np.diff(pair, prepend=-1))
        pairs, offsets, places, words = postings(pair[cut] >> 16, pair[cut] & 0xFFFF, np.add.reduceat(times, cut))
        m = len(pairs)
        own = [pa.nulls(m, part.column(0).type), pa.array(np.full(m, block)), *[pa.nulls(m, pa.int64())] * 5, *[pa.nulls(m, pa.string())] * (1 + groups), pa.array(pairs)]
        own += [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x)) for x in (places, words)]
        yield pa.RecordBatch.from_arrays(own, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = kept_by_worker(key, lambda: Chunks(data_a.value, pattern, data_b.value))
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, BLOCK):
                for at in range(0, part.num_rows, 1 << 16):
                    yield from block_of(known, part.slice(at, 1 << 16), block)
                    known.trim()
                    block += 1

    return kept.mapInArrow(run, schema)


def pair_counts(aligned: DataFrame, width: int) -> DataFrame:
    """(pair, links, documents, best, _rows) for every pair of the corpus: popcounts of its planes and of its bitmap,
    whether no other pair of its B id has more links, and its number of postings."""
    zero, bitmap, weight = F.lit(0).cast("long"), lambda p: p < 1 << 16, lambda p: F.pow(F.lit(2), F.shiftright(p, 16) - 1).cast("long")
    total = lambda f: F.aggregate(F.zip_with("at", "bits", lambda p, w: F.bit_count(w) * f(p)), zero, lambda n, x: n + x)
    documents = total(lambda p: F.when(bitmap(p), 1).otherwise(zero))
    links = total(lambda p: F.when(bitmap(p), 1).otherwise(weight(p)))
    each = aligned.filter("pair is not null").groupBy("pair").agg(F.sum(links).alias("links"), F.sum(documents).alias("documents"), F.count("*").alias("_rows"))
    each = store(each)
    top = each.groupBy((F.col("pair") % width).alias("b")).agg(F.max("links").alias("top"))
    return each.join(top, each.pair % width == top.b).select("pair", "links", "documents", (F.col("links") == F.col("top")).alias("best"), "_rows")


def scores(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """(block, doc, n_best, count_sum): for every document with links, how many of them have the highest count of their
    B id, and the sum of their counts. counts is read three times."""
    held = aligned.filter("pair is not null").select("block", "pair", "at", "bits")
    joined = joined_by_key(held, counts.select("pair", "links", "best", "_rows"), ["pair"], held.count())
    ordered = joined.select("block", "links", "best", "at", "bits").repartition("block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}  # of every block of the partition: two numbers for each of its documents
        for batch in batches:
            block, links = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            best = batch.column(2).to_numpy(zero_copy_only=False)
            at, bits = batch.column(3), batch.column(4)
            many = np.diff(at.offsets.to_numpy())
            row = np.repeat(np.arange(batch.num_rows), many)
            place, word = at.flatten().to_numpy(), np.ascontiguousarray(bits.flatten().to_numpy())
            # the documents of every word: words with one bit at once, the others bit by bit
            k, bit = np.nonzero(np.unpackbits(word.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            row, doc, plane = row[k], (place[k] & 0xFFFF) << 6 | bit, place[k] >> 16
            times = np.where(plane > 0, np.left_shift(1, np.maximum(plane - 1, 0).astype(np.int64)), 1)
            order = np.argsort(block[row], kind="stable")
            doc, row, times = doc[order], row[order], times[order]
            cut = np.flatnonzero(np.diff(block[row], prepend=-1))
            for b, x, y in zip(block[row[cut]].tolist(), cut, [*cut[1:], len(row)]):
                had, n = sums.get(b, np.zeros((2, 0), np.int64)), int(doc[x:y].max()) + 1
                if had.shape[1] < n:
                    sums[b] = had = np.pad(had, ((0, 0), (0, n - had.shape[1])))
                np.add.at(had[0], doc[x:y], times[x:y] * best[row[x:y]])
                np.add.at(had[1], doc[x:y], times[x:y] * links[row[x:y]])
        for b, had in sums.items():
            n = had.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, b)), pa.array(np.arange(n)), pa.array(had[0]), pa.array(had[1])], names=["block", "doc", "n_best", "count_sum"])

    return ordered.mapInArrow(run, "block long, doc long, n_best long, count_sum long")


def production(spark) -> tuple[Definition, str, Definition, int]:
    """A, its pattern, B and B's number of ids."""
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    width = sentencepiece.SentencePieceProcessor(model_file=path).vocab_size()
    return Definition(spark, public_tokenizers.path("byte_bpe_50k.json")), public_tokenizers.PATTERN, Definition(spark, path), width


def aligned_documents(docs: DataFrame, a: Definition, pattern: str, b: Definition, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every document."""
    aligned = store(align(docs, a, pattern, b, id_col, text_col))
    found = scores(aligned, store(pair_counts(aligned, width)))
    own = aligned.filter("pair is null").join(found, ["block", "doc"], "left")
    return own.select(id_col, "n_a", "n_b", "n_groups", "n_links", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_best", "count_sum")), "groups_sha256")


def op12_token_alignment(spark, sf_dir: str) -> DataFrame:
    return aligned_documents(table(spark, sf_dir, "documents"), *production(spark))


QUERIES = {"op12_token_alignment": op12_token_alignment}
ORACLES: dict[str, str] = {}
