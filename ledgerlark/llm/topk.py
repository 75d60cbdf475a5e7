"""Exact top-k inner-product search with a KD-tree for each shard of the vectors.

Method. Vectors are scaled to integers, floor(scale * x). Each shard builds a KD-tree: median splits on the widest
dimension down to leaves of LEAF vectors, every node with the tight bounding box of its vectors. A query's score in a box
is at most sum(max(q * low, q * high)). Traversal is best-first by that bound; it ends when the best bound is below the
query's k-th score so far. That k-th score starts not at minus infinity but at what a first pass over one shard has given
(a lower bound of the final one), and is carried from one tree of a task to the next.

Scale. Shards of at most SHARD_ROWS vectors on average are dealt by a hash of vec_id; their trees are built once and stored as
a table in the shared folder. The stated queries are taken in blocks of QUERY_BLOCK (bounded, so they can be sent to every
task); each block meets the stored trees, and a shard returns k rows a query, which are merged per query by rank.

Defined cases. Vectors that are null, empty or hold a null or non-finite component take no part. Rows that repeat a vec_id are
vectors of their own: a query leaves out its own row only, and of queries that repeat a vec_id each has its ranks. Ties go to
the smaller vec_id. A query meets only vectors of its own length. A null vec_id takes no part. Fewer than k candidates give
fewer rows; an empty table an empty result. Extra columns are ignored. Where sums can exceed 2^53 they are computed, and
vectors ranked, in Python integers; a score of over 64 bits is cut to them in the result.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import materialise, shuffle_partitions

LEAF = 128
MOST = 10**38 - 1
SHARD_ROWS = 8192
QUERY_BLOCK = 8192
HITS = "query_id long, query_row long, vec_id long, score decimal(38,0)"
TREES = "dim int, shard int, tree binary"
#: Vectors a shard has at least, if there are several.
LEAST_SHARD = 1024


class KDTree:
    """Median splits with tight boxes, in arrays: node i has children 2i+1, 2i+2 until its rows fit a leaf."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.order = np.arange(len(x))
        self.span: list[tuple[int, int]] = []
        self.child: list[tuple[int, int] | None] = []
        low, high = [], []
        todo = [(0, len(x), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            rows = x[self.order[a:b]]
            node = len(self.span)
            lo, hi = rows.min(axis=0), rows.max(axis=0)
            low.append(lo)
            high.append(hi)
            self.span.append((a, b))
            self.child.append(None)
            if parent >= 0:
                pair = list(self.child[parent] or (0, 0))
                pair[side] = node
                self.child[parent] = tuple(pair)
            wide = hi - lo
            dim = int(wide.argmax())
            if b - a > LEAF and wide[dim] > 0:
                mid = (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(rows[:, dim], mid)]
                todo += [(a, a + mid, node, 0), (a + mid, b, node, 1)]
        self.low, self.high = np.array(low), np.array(high)

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """The most that any vector of each node can score."""
        return self.high @ np.maximum(q, 0) + self.low @ np.minimum(q, 0)


def search(tree: KDTree, ids: np.ndarray, own_rows: np.ndarray, q: np.ndarray, own: int, k: int, kth: float) -> list[tuple[float, int]]:
    """The k best (score, vec_id) of a tree, of those that score at least ``kth``; the query's own row (of own_rows) is left out."""
    best: list[tuple[float, int]] = []  # a heap of (score, -vec_id), the worst first
    bounds = tree.bounds(q)
    heap = [(-bounds[0], 0)]
    while heap and -heap[0][0] >= kth:
        _, node = heapq.heappop(heap)
        if tree.child[node]:
            for c in tree.child[node]:
                if bounds[c] >= kth:
                    heapq.heappush(heap, (-bounds[c], c))
            continue
        a, b = tree.span[node]
        rows = tree.order[a:b]
        scores = tree.x[rows] @ q
        for j in np.flatnonzero(scores >= kth):
            if own_rows[rows[j]] == own:
                continue
            item = (scores[j], -int(ids[rows[j]]))
            if len(best) < k:
                heapq.heappush(best, item)
            elif item > best[0]:
                heapq.heapreplace(best, item)
        if len(best) == k:
            kth = max(kth, best[0][0])
    return sorted(((s, -i) for s, i in best), key=lambda x: (-x[0], x[1]))


def is_sound(embedding: Column) -> Column:
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return embedding.isNotNull() & (F.size(embedding) > 0) & finite


def scaled(embedding: Column, scale: int) -> Column:
    """floor(scale * x) of each component, as a double; from 2^62 on doubles are whole."""
    whole = lambda y: F.when(F.abs(y) < 2.0**62, F.floor(y).cast("double")).otherwise(y)
    return F.transform(embedding, lambda x: whole(x.cast("double") * scale))


def _matrix(vectors: pd.Series, other: float) -> np.ndarray:
    """Vectors as doubles, or as Python integers if a product with components up to ``other`` can be inexact."""
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    most = float(np.abs(x).max(initial=0))
    return x if most * max(most, other) * x.shape[1] < 2**53 else np.vectorize(int, otypes=[object])(x)


def _plant(most: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = _matrix(pdf["x"], most)
        tree = pickle.dumps((KDTree(x), pdf["vec_id"].to_numpy(), pdf["row"].to_numpy()))
        return pd.DataFrame({"dim": pdf["dim"].iloc[:1], "shard": pdf["shard"].iloc[:1], "tree": [tree]})

    return run


def _search_trees(queries: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, list]], k: int):
    """queries: by length, their ids, rows, vectors and lower bounds of the k-th score."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = {dim: list(q[3]) for dim, q in queries.items()}
        for pdf in batches:
            for dim, blob in zip(pdf["dim"], pdf["tree"], strict=True):
                if dim not in queries:
                    continue
                tree, ids, own_rows = pickle.loads(blob)  # written by _plant
                qids, qrows, q, _ = queries[dim]
                if tree.x.dtype == object:
                    q = np.vectorize(int, otypes=[object])(q)
                out = []
                for n, (qid, row, v) in enumerate(zip(qids, qrows, q, strict=True)):
                    got = search(tree, ids, own_rows, v, row, k, known[dim][n])
                    if len(got) == k:
                        known[dim][n] = max(known[dim][n], got[-1][0])
                    out += [(qid, row, vec_id, Decimal(max(min(int(score), MOST), -MOST))) for score, vec_id in got]
                yield pd.DataFrame(out, columns=["query_id", "query_row", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, k: int = 5, scale: int = 256, is_query: Column | None = None, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of every query; is_query: default vec_id divisible by 50."""
    spark = vectors.sparkSession
    own = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("e"))
    rows = own.where(is_sound(F.col("e")) & F.col("vec_id").isNotNull())
    asked = is_query if is_query is not None else F.col("vec_id") % 50 == 0
    rows = rows.select("vec_id", scaled(F.col("e"), scale).alias("x"), F.size("e").alias("dim"), asked.alias("asked"))
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    total = rows.count()
    most = rows.agg(F.max(F.array_max(F.transform("x", F.abs)))).collect()[0][0] or 0.0
    shards = max(-(-total // SHARD_ROWS), min(shuffle_partitions(spark), -(-total // LEAST_SHARD)), 1)
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    trees = materialise(dealt.groupBy("shard", "dim").applyInPandas(_plant(most), TREES).repartition(shards, "shard"), "trees", "uncompressed")
    blocks = max(1, -(-rows.where("asked").count() // (QUERY_BLOCK // 2)))
    result = None
    for block in range(blocks):
        mine = rows.where("asked").where(F.pmod(F.xxhash64("row", F.lit(7)), F.lit(blocks)) == block)
        got = mine.select("vec_id", "row", "x", "dim").toPandas()
        queries = {
            int(dim): (g["vec_id"].to_numpy(), g["row"].to_numpy(), np.stack(g["x"].to_numpy()).astype(np.float64), [-np.inf] * len(g)) for dim, g in got.groupby("dim")
        }
        if shards > 1:
            first = trees.where("shard = 0").mapInPandas(_search_trees(queries, k), HITS)
            worst = first.groupBy("query_row").agg(F.min("score").alias("kth"), F.count(F.lit(1)).alias("n")).where(F.col("n") == k)
            known = {r["query_row"]: int(r["kth"]) for r in worst.collect()}  # at most a block
            for dim, (ids, own_rows, q, _) in queries.items():
                queries[dim] = (ids, own_rows, q, [known.get(int(i), -np.inf) for i in own_rows])
        hits = materialise(trees.mapInPandas(_search_trees(queries, k), HITS), "hits")
        result = hits if result is None else result.unionByName(hits)
    ranked = result.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id")))
    cut = F.greatest(F.least(F.col("score"), F.lit(2**63 - 1)), F.lit(-(2**63))).cast("long").alias("score")
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", cut)
