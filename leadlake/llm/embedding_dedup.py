"""Near-duplicate vectors by an inverted multi-index with multi-sequence traversal and exact verification.

* Copies. Rows with the same label and vector are one class, named by a 128-bit hash of both; classes are compared,
  members follow.
* Codebooks. Each half of the unit vector has its own codebook of K centroids, fitted on a sample of SAMPLE vectors, or
  of 4 K if that is more; K grows with the square root of the number of vectors, so that a cell of the K x K grid holds
  about CELL of them at every size.
* Index. Every vector is native to the cell of its nearest centroids.
* Traversal. A vector visits other cells in the order of a lower bound on its distance to them (its distances to the
  bisecting planes of both halves), merged from the two sorted lists by a heap, and stops at the bound that reaches
  RECALL of the simulated neighbours at the threshold (and of the neighbours found in the sample). Of two cells, the
  one with the larger number visits, so each pair of vectors meets once.
* Verification. Cells are cut into blocks of BLOCK natives and BLOCK visitors. In a block, cosines in double precision
  are one matrix product; out come the number of links and the local component of each vector, never the pairs. Blocks
  are dealt over the tasks by their own number, so the blocks of one cell run side by side.

Nothing is capped: a crowded cell only has more blocks. Vectors that are null, empty or zero, hold null or non-finite
components, or have a null label link with nothing; vectors of different lengths do not link. A vector is an id with
its label and components: rows that repeat all three are one vector, different vectors under one id link each for
itself, and every row without an id is a vector. Null ids are never the smallest id of a component; one without any
other id has component_id null, and its rows are kept; other rows without an id are not, when their component has
one. An empty table gives an empty result; other columns may have
any name.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlake.llm.common import checkpoint, components, release, table
from leadlake.session import ship

COSINE = 0.98
SAMPLE, CELL, BLOCK, RECALL = 20_000, 256, 1024, 0.9995
#: Vector lengths that get an index, the most frequent ones; vectors of other lengths are compared in blocks.
INDEXED = 64


def _bounds(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each row, and squared lower bounds of its distance to every centroid's cell."""
    d = (x**2).sum(1)[:, None] - 2 * x @ book.T + (book**2).sum(1)[None]
    near = d.argmin(1)
    gap = np.sqrt(np.maximum((book[near] ** 2).sum(1)[:, None] - 2 * book[near] @ book.T + (book**2).sum(1)[None], 1e-300))
    return near, (np.maximum(d - d.min(1, keepdims=True), 0) / (2 * gap)) ** 2


def visits(a: np.ndarray, b: np.ndarray, limit: float) -> list[tuple[int, int]]:
    """Cells (i, j) with a[i] + b[j] <= limit, nearest first: multi-sequence traversal of two bound lists."""
    i_order, j_order = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    heap, seen, out = [(a[i_order[0]] + b[j_order[0]], 0, 0)], {(0, 0)}, []
    while heap and heap[0][0] <= limit:
        _, i, j = heapq.heappop(heap)
        out.append((int(i_order[i]), int(j_order[j])))
        for p, q in ((i + 1, j), (i, j + 1)):
            if p < len(a) and q < len(b) and (p, q) not in seen:
                seen.add((p, q))
                heapq.heappush(heap, (a[i_order[p]] + b[j_order[q]], p, q))
    return out


def _book(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Lloyd's algorithm on the sample."""
    rng = np.random.default_rng(seed)
    book = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(12):
        near = ((book**2).sum(1)[None] - 2 * x @ book.T).argmin(1)
        for c in range(len(book)):
            if (near == c).any():
                book[c] = x[near == c].mean(0)
    return np.unique(book, axis=0)


def _k(number: int) -> int:
    """Centroids of a half for a number of vectors."""
    return int(max(2, np.ceil(np.sqrt(number / CELL))))


class MultiIndex:
    """Codebooks of both halves and the bound at which a traversal stops."""

    def __init__(self, sample: np.ndarray, number: int, cosine: float, seed: int = 5):
        self.half = sample.shape[1] // 2
        k = _k(number)
        self.books = (_book(sample[:, : self.half], k, seed), _book(sample[:, self.half :], k, seed + 1))
        x = sample[:4000]
        rng = np.random.default_rng(seed + 2)
        noise = rng.standard_normal(x.shape)
        noise -= (noise * x).sum(1)[:, None] * x
        noise /= np.maximum(np.linalg.norm(noise, axis=1), 1e-300)[:, None]
        pairs = [(x, cosine * x + np.sqrt(1 - cosine**2) * noise)]  # neighbours right at the threshold
        near = np.argwhere(np.triu(x @ x.T >= cosine, 1))[:50_000]
        pairs.append((x[near[:, 0]], x[near[:, 1]]))
        needed = [self._needed(p, q) for p, q in pairs if len(p)]
        exact = 2 - 2 * cosine  # no neighbour is farther: with this bound nothing is missed
        self.limit = float(min(exact, max(np.quantile(n, RECALL) for n in needed)))

    def _needed(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The bound at which the one of x and y that must visit reaches the other's cell (0 in one cell)."""
        (cx, bx), (cy, by) = self.locate(x), self.locate(y)
        r = np.arange(len(x))
        width = len(self.books[1])
        there = bx[0][r, cy // width] + bx[1][r, cy % width]
        back = by[0][r, cx // width] + by[1][r, cx % width]
        return np.where(cx == cy, 0.0, np.where(cx > cy, there, back))

    def locate(self, x: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
        i, a = _bounds(x[:, : self.half], self.books[0])
        j, b = _bounds(x[:, self.half :], self.books[1])
        return i * len(self.books[1]) + j, (a, b)


def _local(linked: np.ndarray) -> np.ndarray:
    """The first row that each row reaches in a symmetric boolean matrix."""
    root = np.arange(len(linked))
    while True:
        low = np.minimum(root, np.where(linked, root[None, :], len(root)).min(1))
        low = low[low]
        if (low == root).all():
            return root
        root = low


def link(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept) of every row: how many other vectors its vector links with directly, the
    smallest id that it reaches by links, and whether that is its own."""
    spark = vectors.sparkSession
    ship(spark)
    v = F.col("v")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).alias("label"))
    most = F.array_max(F.transform("v", F.abs))
    fine = F.col("label").isNotNull() & v.isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & (most > 0)
    key = F.format_string("%016x%016x", F.xxhash64("label", "v"), F.xxhash64(F.lit(1), "label", "v"))
    rows = rows.withColumn("c", F.when(F.coalesce(fine, F.lit(False)), key))
    own = checkpoint(rows.select("id", "c"))  # no vectors
    units = own.filter("c is not null").groupBy("c", "id").agg(F.when(F.col("id").isNull(), F.count("*")).otherwise(1).alias("n"))
    sizes = units.groupBy("c").agg(F.min("id").alias("low"), F.sum("n").alias("size"))
    # a power of two near the largest magnitude: dividing by it is exact, and no square over- or underflows then
    scaled = F.transform("v", lambda x: x / F.pow(F.lit(2.0), F.floor(F.log2(most))))
    values = rows.filter("c is not null").groupBy("c").agg(F.any_value("label").alias("label"), F.any_value("v").alias("v")).withColumn("v", scaled)
    classes = checkpoint(values.join(sizes, "c").select("label", "c", "low", "size", "v", F.size("v").alias("dim")))
    number = classes.count()
    if number:
        partial = _partial(classes, number, cosine)
        counts = partial.groupBy("c").agg(F.sum("links").alias("links"))
        roots = components(partial.filter("c <> root").select(F.col("c").alias("a"), F.col("root").alias("b"))).select(F.col("id").alias("c"), F.col("component_id").alias("of"))
        done = classes.select("c", "low", "size").join(counts, "c", "left").join(roots, "c", "left").withColumn("of", F.coalesce("of", "c"))
        named = checkpoint(done.groupBy("of").agg(F.min("low").alias("component_id")))
        done = done.join(named, "of").select("c", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), "component_id")
        linked = own.filter("c is not null").join(done, "c").select("id", "n_links", "component_id")
    else:
        linked = own.filter("c is not null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    alone = own.filter("c is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(alone).select(F.col("id").alias(id_col), F.col("n_links").cast("long").alias("n_links"), "component_id")
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.col("component_id").isNull()))


def _partial(classes: DataFrame, number: int, cosine: float) -> DataFrame:
    """(c, links, root): what single blocks know of the links and of the component of a class."""
    spark = classes.sparkSession
    indexes = {}
    lengths = classes.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(INDEXED)
    for dim, _ in lengths.collect():
        taken = classes.filter(F.col("dim") == dim).orderBy(F.xxhash64("c")).limit(max(SAMPLE, 4 * _k(number))).select("v").toPandas()["v"]  # bounded
        x = np.array(taken.tolist(), float).reshape(len(taken), dim)
        if dim >= 2:
            indexes[dim] = MultiIndex(x / np.linalg.norm(x, axis=1, keepdims=True), number, cosine)
    broadcast = spark.sparkContext.broadcast(indexes)

    def place(batches):
        known = broadcast.value
        for pdf in batches:
            for dim, part in pdf.groupby("dim", sort=False):
                x = np.array(part["v"].tolist(), float).reshape(len(part), dim)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                if dim in known:
                    index = known[dim]
                    cell, (a, b) = index.locate(x)
                    width = len(index.books[1])
                    others = [[c for i, j in visits(p, q, index.limit) if (c := i * width + j) < own] for p, q, own in zip(a, b, cell)]
                else:  # one component, or a rare length: all in one cell, cut into blocks
                    cell, others = np.zeros(len(x), int), [[]] * len(x)
                yield pd.DataFrame({"label": part["label"], "dim": dim, "c": part["c"], "size": part["size"], "u": [r.tobytes() for r in x], "cell": cell.astype("int64"), "others": others})

    label = classes.schema["label"].dataType.simpleString()
    placed = classes.select("label", "dim", "c", "size", "v").mapInPandas(place, f"label {label}, dim int, c string, size long, u binary, cell long, others array<long>")
    placed = checkpoint(placed)
    key = ["label", "dim", "cell"]
    native = placed.drop("others")
    visitor = placed.select("label", "dim", "c", "size", "u", F.explode("others").alias("cell"))
    n = native.groupBy(key).agg(F.ceil(F.count("*") / BLOCK).alias("nn"))
    m = visitor.groupBy(key).agg(F.ceil(F.count("*") / BLOCK).alias("nv"))
    sizes = checkpoint(n.join(m, key, "left").fillna(0, ["nv"]))
    chunk = lambda c: F.pmod(F.xxhash64("c"), F.col(c)).alias("own")
    mine = native.join(sizes, key).select("*", chunk("nn"))
    to = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    body = ["label", "dim", "cell", "c", "size", "u"]
    both = mine.select(*body, "own", to("nn").alias("other")).select(*body, F.lit(0).alias("kind"), F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), (F.col("own") > F.col("other")).alias("right"))
    left = mine.filter("nv > 0").select(*body, "own", to("nv").alias("y")).select(*body, F.lit(1).alias("kind"), F.col("own").alias("x"), "y", F.lit(False).alias("right"))
    come = visitor.join(sizes, key).select("*", F.pmod(F.xxhash64("c"), F.col("nv")).alias("y"))
    right = come.select(*body, "y", to("nn").alias("x")).select(*body, F.lit(1).alias("kind"), "x", "y", F.lit(True).alias("right"))
    blocks = both.unionByName(left).unionByName(right)

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("c", ignore_index=True)
        names, size = pdf["c"].to_numpy(), pdf["size"].to_numpy()
        x = np.frombuffer(b"".join(pdf["u"]), float).reshape(len(pdf), -1)
        linked = x @ x.T >= cosine
        np.fill_diagonal(linked, False)
        side = pdf["right"].to_numpy()
        if pdf["kind"].iat[0] or pdf["x"].iat[0] != pdf["y"].iat[0]:
            linked &= side[:, None] != side[None, :]
        links = linked @ size
        some = links > 0
        return pd.DataFrame({"c": names[some], "links": links[some], "root": names[_local(linked)][some]})

    block = ["label", "dim", "cell", "kind", "x", "y"]
    # rows lie by cell after the joins; dealing them anew keeps the blocks of a crowded cell out of one task
    found = blocks.repartition(*block).groupBy(*block).applyInPandas(verify, "c string, links long, root string")
    found = checkpoint(found)
    release(spark)
    return found


def op7_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "embeddings"))


OP7_SQL = """
WITH RECURSIVE ok AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND list_max(list_transform(embedding::DOUBLE[], lambda x: abs(x))) > 0),
two AS (SELECT vec_id, label, v, pow(2, floor(log2(nullif(list_max(list_transform(v, lambda x: abs(x))), 0)))) AS p FROM ok),
fit AS (SELECT vec_id, label, list_transform(v, lambda x: x / p) AS v FROM two),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM fit a JOIN fit b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
          WHERE list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v)) / sqrt(list_dot_product(b.v, b.v)) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, r.c AS component_id, e.vec_id = r.c AS kept
FROM embeddings e JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON r.a = e.vec_id
LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) n ON n.a = e.vec_id
"""

QUERIES = {"op7_embedding_dedup": op7_embedding_dedup}
ORACLES = {"op7_embedding_dedup": OP7_SQL}
