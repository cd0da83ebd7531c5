"""Best-fit packing against a plain loop, the tokenizer's own library and whole sequences."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from leadlake.llm import packing, tokenizing
from tests.llm.test_operators import odd_docs

ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "a   b", "a\n b", "a\n\n b", "a \nb", "\n\n x", "it's  we'll ' s", "x\x1c y", "a　 b", "  b   c", "naïve café 12345 6,7", "<|endoftext|> a", "👍🏽 a 漢字 か", "a\x00 b", "\t a\t\tb \r\n c", "...  ,,, !!", "x" * 3000]


def library():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def plain_best_fit(lengths, capacity):
    room = []
    for n in sorted(lengths, reverse=True):
        fit = min((k for k in range(len(room)) if room[k] >= n), key=lambda k: room[k], default=None)
        if fit is None:
            room.append(capacity - n)
        else:
            room[fit] -= n
    return sorted(room)


def test_runs_equal_best_fit_piece_by_piece():
    rng = random.Random(4)
    for trial in range(300):
        capacity = rng.choice([7, 10, 64, 2048])
        lengths = [rng.randint(1, rng.choice([capacity, max(1, capacity // 5)])) for _ in range(rng.choice([0, 1, 5, 60, 150]))] + [rng.randint(1, capacity)] * rng.choice([0, 3, 40])
        counts = sorted({n: lengths.count(n) for n in lengths}.items(), reverse=True)
        matches, opened = packing.matched_runs(counts, capacity)
        assert opened == len(plain_best_fit(lengths, capacity))
        used = defaultdict(list)
        for (length, rank, first, each, before), to in zip(matches, [*matches[1:], (0, 0)]):
            n = (to[1] if to[0] == length else dict(counts)[length]) - rank
            for j in range(n):
                used[first + j // each].append((before + j % each * length, length))
        assert sum(map(len, used.values())) == len(lengths)
        for spans in used.values():
            spans.sort()
            assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and sum(spans[-1]) <= capacity
        assert sorted(capacity - sum(n for _, n in x) for x in used.values()) == plain_best_fit(lengths, capacity)


def test_chunks_encode_as_whole_texts():
    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as f:
        known = tokenizing.Ids(f.read(), public_tokenizers.PATTERN)
    want, rng = library(), random.Random(3)
    alphabet = [" ", " ", "  ", "\n", "\t", "a", "the", "ing", "é", "7", "42", ".", "'s", "'ll", "-", "漢", "​", " ", " ", "\x1c", "\x85", "👍🏽", "A", "<|endoftext|>", "́"]
    for text in ODD + ["".join(rng.choices(alphabet, k=rng.randint(1, 40))) for _ in range(4000)]:
        assert np.frombuffer(known.of(text), "<u4").tolist() == want(text), text


def test_documents_are_packed_whole(spark):
    rng = random.Random(5)
    vocab = ["word%d" % k for k in range(500)]
    texts = [None, *ODD] + [" ".join(rng.choices(vocab, k=rng.choice([1, 1, 5, 40, 400, 1500, 4000]))) for _ in range(80)] + ["same text"] * 60
    docs, want = odd_docs(spark, texts), library()
    definition, pattern = packing.production_definition(spark)
    out = packing.packed(packing.pieces(docs, definition, pattern)).collect()
    ids = defaultdict(list)
    for r in out:
        ids[r.doc_id].append((r.piece, r.start, r.length, np.frombuffer(r.ids, "<u4").tolist()))
    for i, t in enumerate(texts):
        times = 2 if i < 2 else 1
        whole = want(t or "") + [0]
        got = sorted(ids.pop(i))
        assert len(got) % times == 0
        got = got[::times]
        assert sum((x[3] for x in got), []) == whole and [x[0] for x in got] == list(range(len(got)))
        at = 0
        for _, start, length, part in got:
            assert start == at and length == len(part) and (length == 2048 or not at)
            at += length
    assert not ids
    spans = defaultdict(list)
    for r in out:
        spans[r.sequence_id].append((r.offset, r.length))
    for x in spans.values():
        x.sort()
        assert x[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(x, x[1:])) and sum(x[-1]) <= 2048
    assert len(spans) == len(plain_best_fit([r.length for r in out], 2048))
    whole = {r.sequence_id: (r.ids, r.doc_ids) for r in packing.sequences(spark.createDataFrame(out)).collect()}
    for r in out:
        data, doc_ids = whole[r.sequence_id]
        assert bytes(data[4 * r.offset : 4 * (r.offset + r.length)]) == bytes(r.ids) and r.doc_id in doc_ids


def test_packing_query_and_empty_table(spark, tmp_path):
    texts = ["alpha beta", None, "", "gamma " * 5000]
    docs = odd_docs(spark, texts)
    docs.write.parquet(f"{tmp_path}/a/documents.parquet")
    out = packing.op13_best_fit_packing(spark, f"{tmp_path}/a")
    assert dict(out.dtypes) == {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"}
    want = library()
    for r in out.collect():
        ids = (want(texts[r.doc_id] or "") + [0])[r.start : r.start + r.length]
        assert len(ids) == r.length and zlib.crc32(np.array(ids, "<u4").tobytes()) == r.ids_crc32
    docs.filter(F.lit(False)).write.parquet(f"{tmp_path}/b/documents.parquet")
    assert packing.op13_best_fit_packing(spark, f"{tmp_path}/b").count() == 0
