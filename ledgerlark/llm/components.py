"""Connected components of a link table that is never gathered in one place."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Up to so many contracted links (16 bytes each) are finished in one task; beyond, stars are merged round by round.
ONE_TASK = 500_000


class Forest:
    """Union-find over any hashable nodes; the root of a tree is its least node."""

    def __init__(self):
        self.parent: dict = {}

    def find(self, x):
        root = x
        while (up := self.parent.get(root, root)) != root:
            root = up
        while self.parent.get(x, x) != root:
            self.parent[x], x = root, self.parent[x]
        return root

    def union(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            self.parent.setdefault(a, a)
            return False
        a, b = min(a, b), max(a, b)
        self.parent[b] = a
        self.parent.setdefault(a, a)
        return True


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The links of a partition replaced by stars around its local roots: fewer links, the same components."""
    forest = Forest()
    for pdf in batches:
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True):
            forest.union(a, b)
    rows = [(forest.find(x), x) for x in forest.parent]
    yield pd.DataFrame([r for r in rows if r[0] != r[1]], columns=["a", "b"]).astype("int64")


def connected_components(links: DataFrame) -> DataFrame:
    """node, label (the least node of its component) of every node of ``links`` (a, b: longs).

    Links are contracted in each partition, then large-star and small-star steps alternate until nothing changes, which takes
    a number of rounds that grows with the logarithm of the longest path. Nodes of very high degree are aggregated before
    the shuffle.
    """
    edges = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    edges = materialise(edges.repartition("a").mapInPandas(_contract, "a long, b long").distinct(), "links")
    mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).collect()[0]
    if mark[0] <= ONE_TASK:
        edges = materialise(edges.coalesce(1).mapInPandas(_contract, "a long, b long"), "links")
    while mark[0] > ONE_TASK:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(F.explode(F.array(F.struct(F.col("m").alias("a"), "b"), F.struct(F.col("m").alias("a"), F.col("a").alias("b")))).alias("e"))
        edges = materialise(small.select("e.a", "e.b").where("a < b").distinct(), "links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).collect()[0]
        if now == mark:
            break
        mark = now
    stars = edges.select(F.col("b").alias("node"), F.col("a").alias("label"))
    return stars.unionByName(stars.select(F.col("label").alias("node"), "label").distinct())
