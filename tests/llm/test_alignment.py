"""Alignment of two tokenizers against a plain loop over whole texts, with the tokenizers' own libraries."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

from leadlake.llm import alignment
from tests.llm.test_operators import odd_docs
from tests.llm.test_packing import ODD, library

WIDTH = 32_000


def plain(texts):
    """The columns of every text by token ends alone, and (links, documents) of every pair."""
    sp, encode = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model")), library()
    bytes_a = {i: t for t, i in alignment.byte_encoding(open(public_tokenizers.path("byte_bpe_50k.json"), "rb").read(), public_tokenizers.PATTERN)[1].items()}
    bytes_b = alignment.piece_bytes(sp)
    found, counts, documents = [], Counter(), Counter()
    for t in texts:
        a, b = (encode(" " + t), sp.encode(t)) if t else ([], [])
        whole = (" " + t).encode() if t else b""
        if b"".join(map(bytes_a.get, a)) != whole or b"".join(bytes_b[i] for i in b) != whole:
            a = b = []
        spans = []
        for ids, table in ((a, bytes_a), (b, bytes_b)):
            at, out = 0, []
            for i in ids:
                out.append((at, at + len(table[i]), i))
                at += len(table[i])
            spans.append(out)
        links = [(x[2], y[2]) for x in spans[0] for y in spans[1] if max(x[0], y[0]) < min(x[1], y[1])] if len(a) < 3000 else [(x[2], y[2]) for x in spans[0] for y in spans[1][: len(b)] if x[0] < y[1] and y[0] < x[1]]
        both = sorted({x[1] for x in spans[0]} & {x[1] for x in spans[1]})
        groups = [",".join(str(x[2]) for x in spans[0] if low < x[1] <= high) + "|" + ",".join(str(x[2]) for x in spans[1] if low < x[1] <= high) for low, high in zip([0, *both], both)]
        found.append((len(a), len(b), len(groups), links, ";".join(groups)))
        counts.update(links)
        documents.update(set(links))
    top = defaultdict(int)
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    rows = [(na, nb, ng, len(x), sum(counts[p] == top[p[1]] for p in x), sum(counts[p] for p in x), hashlib.sha256(g.encode()).hexdigest() if g else "") for na, nb, ng, x, g in found]
    return rows, counts, documents


def texts_of(seed, n):
    rng = random.Random(seed)
    vocab = ["word%d" % k for k in range(60)] + ["naïve", "über", "漢字", "👍🏽", "antidis", "x▁y"[:1], "it's", "3.14", "…"]
    alphabet = [" ", " ", "  ", "\n", "\t", "a", "the", "ing", "é", "7", "'s", "漢", " ", "​", "👍", "▁", "\x00", "\x85"]
    return [None, *ODD, "x▁y z", "a ▁ b"] + [" ".join(rng.choices(vocab, k=rng.choice([1, 4, 30, 80]))) for _ in range(n)] + ["".join(rng.choices(alphabet, k=rng.randint(1, 25))) for _ in range(n)] + ["same text again"] * 70 + ["of of of of " * 40]


def test_alignment_equals_a_plain_loop(spark, monkeypatch):
    texts = texts_of(7, 60)
    docs = odd_docs(spark, texts)
    for parts in (1, 3):
        out = alignment.aligned_documents(docs.repartition(parts), *alignment.production(spark)).collect()
        want, _, _ = plain(texts + texts[:2])
        got = defaultdict(list)
        for r in out:
            got[r.doc_id].append((r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256))
        for i, w in enumerate(want[: len(texts)]):
            assert set(got[i]) == {w} and len(got[i]) == (2 if i < 2 else 1), (i, texts[i])


def test_pair_bitmaps_count_links_and_documents(spark):
    texts = texts_of(9, 40)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    a, pattern, b, width = alignment.production(spark)
    aligned = alignment.align(docs.repartition(2), a, pattern, b, groups=True).cache()
    got = {(r.pair // width, r.pair % width): (r.links, r.documents) for r in alignment.pair_counts(aligned, width).collect()}
    rows, counts, documents = plain(texts)
    assert width == WIDTH and got == {p: (n, documents[p]) for p, n in counts.items()}
    text = {r.doc_id: (r.groups, r.groups_sha256) for r in aligned.filter("pair is null").collect()}
    for i, w in enumerate(rows):
        assert text[i][1] == w[6] and (hashlib.sha256(text[i][0].encode()).hexdigest() if text[i][0] else "") == w[6]
    aligned.unpersist()


def test_alignment_query_and_empty_table(spark, tmp_path):
    docs = odd_docs(spark, ["alpha beta", None, "", "x▁y"])
    docs.write.parquet(f"{tmp_path}/a/documents.parquet")
    out = alignment.op12_token_alignment(spark, f"{tmp_path}/a")
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert {tuple(r)[1:] for r in out.collect() if r.doc_id} == {(0, 0, 0, 0, 0, 0, "")}
    docs.filter(F.lit(False)).write.parquet(f"{tmp_path}/b/documents.parquet")
    assert alignment.op12_token_alignment(spark, f"{tmp_path}/b").count() == 0
