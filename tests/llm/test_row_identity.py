"""Near duplicates, of texts and of vectors, among rows whose ids are null or repeated."""

import collections
import random

import numpy as np

from leadlake.llm import embedding_dedup, jaccard_join


def texts_and_copies(n, seed=5):
    """n unlike texts, and for each a copy with one word changed."""
    rng = random.Random(seed)
    own = [[f"t{k}w{i}" for i in rng.sample(range(900), 60)] for k in range(n)]
    return [" ".join(w) for w in own], [" ".join(w[:-1] + ["other"]) for w in own]


def kept(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(((r.doc_id, r.text) for r in jaccard_join.one_of_each(spark, docs, "").collect()), key=repr)


def test_unlike_documents_without_ids_stay(spark):
    a, b = texts_and_copies(4)
    rows = [(None, a[0]), (None, a[1]), (None, a[1]), (7, a[2]), (None, b[2]), (None, None), (None, " ")]
    want = [(None, a[0]), (None, a[1]), (7, a[2]), (None, None), (None, " ")]
    assert kept(spark, rows) == sorted(want, key=repr)


def test_documents_without_ids_link(spark):
    a, b = texts_and_copies(3)
    got = kept(spark, [(None, t) for t in a + b])
    assert len(got) == 3 and {t.split("w")[0] for _, t in got} == {"t0", "t1", "t2"}


def test_unlike_texts_under_one_id_link_by_their_own_text(spark):
    a, b = texts_and_copies(6)
    rows = [(1, t) for t in a] + [(10 + k, t) for k, t in enumerate(b)] + [(1, a[0]), (2, ""), (2, ""), (2, None)]
    assert kept(spark, rows) == sorted([(1, t) for t in a] + [(2, ""), (2, None)], key=repr)
    out = jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.component_id == 1 for r in out if r.doc_id >= 10) and len(out) == len(rows)


def test_vectors_under_one_id_link_each_for_itself(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (3, [0.0, 1.0, 0.01]), (None, [0.0, 0.0, 1.0]), (None, [0.0, 0.0, 1.0]), (4, [0.01, 0.0, 1.0]), (None, [-1.0, 0.0, 0.0]), (4, [0.01, 0.0, 1.0])]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, label int")
    got = collections.Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.link(df).collect())
    want = [(1, 0, 1, True), (1, 1, 1, True), (3, 1, 1, False), (None, 2, 4, False), (None, 2, 4, False), (4, 2, 4, True), (None, 0, None, True), (4, 2, 4, True)]
    assert got == collections.Counter(want)


def test_planted_neighbours_are_found_by_real_codebooks(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CELL", 32)  # 3,000 vectors: ten centroids a half
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rng = np.random.default_rng(11)
    base = rng.standard_normal((1000, 24))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    noise = rng.standard_normal((2000, 24))
    near = np.repeat(base, 2, axis=0)
    noise -= (noise * near).sum(1)[:, None] * near
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    cosine = rng.uniform(0.97, 0.99, (2000, 1))
    x = np.concatenate([base, near * cosine + noise * np.sqrt(1 - cosine**2)])
    df = spark.createDataFrame([(i, [float(c) for c in v], 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in embedding_dedup.link(df).collect()}
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = (x @ x.T >= 0.98).sum(1) - 1
    assert want.sum() > 1000
    assert all(got[i] <= n for i, n in enumerate(want)) and sum(got.values()) >= 0.99 * want.sum()
