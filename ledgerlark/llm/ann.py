"""Approximate nearest neighbours by balanced posting lists.

Method. A sample is halved again and again at the median along the line between two means, so its parts, the lists, are of one size;
a list's centroid is their mean. A graph of the centroids, with each one's nearest and, of those, only such as no other lies before,
is held in memory and searched best-first. A vector goes to its nearest list and, where it lies near a boundary (others at most
BOUNDARY times as far, whose centroid isn't nearer to a list already taken than to the vector), to further ones, REPLICAS in all.
A query takes the lists whose centroids are at most ``ratio`` times as far as the nearest one. That ratio is learned from sample queries: with it,
RECALL of their true neighbours within the sample lie in lists taken. In a larger table neighbours are nearer, so it errs on the safe side.

Scale. Of equal vectors the k + 1 least ids are kept, all that any query can return (window group limits do so before the shuffle),
so a vector that a third of all rows repeat is k + 1 rows. Neighbouring lists form cells of about CELL_ROWS rows; a larger list is
dealt to several cells, and so are the queries of a cell beyond CELL_QUERIES. A cell's rows and queries meet in one task, which
returns k rows a query. Only the centroids and the graph, at most MOST_LISTS of them, are broadcast; they come from at most about
SAMPLE vectors. Every row is indexed.

Defined cases. Vectors that are null, empty, zero or hold a null or non-finite component take no part, nor do null ids. Rows that
repeat an id are vectors of their own: a query leaves out its own row only, and each of the repeated queries has its ranks. A
query meets only vectors of its own length. Ties go to the smaller vec_id. Fewer than k candidates give fewer rows, an empty table none. Extra
columns are ignored. Scores are computed from the original vectors in doubles; distances beyond a double are infinite.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise
from .topk import is_sound

SAMPLE, MOST_LISTS, LIST_ROWS = 40_000, 4_096, 128
REPLICAS, BOUNDARY, NEAREST = 3, 1.1, 8
DEGREE, ENTRIES = 24, 64
RECALL, CALIBRATE = 0.985, 256
CELL_ROWS, CELL_QUERIES, CHUNK = 16_384, 2_048, 128
OUT = "query_id long, rank int, vec_id long, score double"
HITS = "query_id long, qh long, many long, vec_id long, h long, rn int, score double"


def matrix(vectors, dim: int) -> np.ndarray:
    """Vectors as rows of doubles, filled with zeros up to ``dim`` and cut there."""
    rows = [np.asarray(v, dtype=np.float64)[:dim] for v in vectors]
    if all(len(v) == dim for v in rows):
        return np.stack(rows) if rows else np.zeros((0, dim))
    return np.stack([np.pad(v, (0, dim - len(v))) for v in rows])


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` to those of ``b``, up to rounding; infinite where they leave the doubles."""
    with np.errstate(over="ignore", invalid="ignore"):
        out = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T)
    return np.maximum(np.nan_to_num(out, nan=np.inf, posinf=np.inf, neginf=0), 0)


@dataclass
class Lists:
    """Centroids with their graph; ``members`` counts the sample's vectors a list."""

    centroids: np.ndarray
    edges: list[np.ndarray]
    entries: np.ndarray
    ratio: float = 1.0
    members: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def near(self, q: np.ndarray, least: int, ratio: float) -> tuple[np.ndarray, np.ndarray]:
        """The ``least`` nearest lists found and all found within ``ratio`` times the nearest distance, nearest first, with distances."""
        known, todo, best = {}, [], []
        fresh = self.entries
        while True:
            if len(fresh):
                for d, c in zip(np.sqrt(((self.centroids[fresh] - q) ** 2).sum(1)).tolist(), fresh.tolist(), strict=True):
                    known[c] = d
                    heapq.heappush(todo, (d, c))
                    heapq.heappush(best, -d)
                    if len(best) > least:
                        heapq.heappop(best)
                nearest = min(known.values()) if fresh is self.entries else min(nearest, min(known[c] for c in fresh.tolist()))
            if not todo or (todo[0][0] > ratio * nearest and len(best) == least and todo[0][0] > -best[0]):
                break
            _, c = heapq.heappop(todo)
            fresh = np.array([e for e in self.edges[c].tolist() if e not in known], dtype=np.int64)
        order = sorted((d, c) for c, d in known.items())
        take = [(d, c) for n, (d, c) in enumerate(order) if n < least or d <= ratio * nearest]
        return np.array([c for _, c in take]), np.array([d for d, _ in take])

    def home(self, v: np.ndarray) -> list[int]:
        """The lists that hold a vector."""
        found, d = self.near(v, NEAREST, 1.0)
        taken = [int(found[0])]
        for c, far in zip(found[1:].tolist(), d[1:].tolist(), strict=True):
            if len(taken) == REPLICAS or far > BOUNDARY * d[0]:
                break
            if (np.sqrt(((self.centroids[taken] - self.centroids[c]) ** 2).sum(1)) >= far).all():
                taken.append(c)
        return taken


def graph(centroids: np.ndarray) -> list[np.ndarray]:
    """Each centroid's neighbours, without those that lie nearer to a neighbour already taken; every edge leads both ways."""
    n = len(centroids)
    edges: list[set[int]] = [set() for _ in range(n)]
    for a in range(0, n, 512):
        far = squares(centroids[a : a + 512], centroids)
        for i, row in enumerate(far, a):
            near = np.argsort(row, kind="stable")[: 2 * DEGREE + 1]
            near = near[near != i]
            among = squares(centroids[near], centroids[near])
            taken: list[int] = []
            for j, c in enumerate(near):
                if len(taken) < DEGREE and all(among[j, t] > row[c] for t in taken):
                    taken.append(j)
            for c in near[taken].tolist():
                edges[i].add(c)
                edges[c].add(i)
    return [np.array(sorted(e), dtype=np.int64) for e in edges]


def fit(sample: np.ndarray, size: int, k: int) -> Lists:
    """Balanced lists of at most ``size`` vectors of the sample each, their graph and the ratio of distances that queries need."""
    rng = np.random.default_rng(0)
    parts, todo = [], [np.arange(len(sample))]
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            parts.append(rows)
            continue
        ends = sample[rng.choice(rows, 2, replace=False)]
        half = len(rows) // 2
        for _ in range(5):
            rows = rows[np.argsort(sample[rows] @ (ends[1] - ends[0]), kind="stable")]
            ends = np.stack([sample[rows[:half]].mean(0), sample[rows[half:]].mean(0)])
        todo += [rows[half:], rows[:half]]
    centroids = np.stack([sample[p].mean(0) for p in parts])
    edges = graph(centroids)
    entries = np.unique(np.linspace(0, len(parts) - 1, min(ENTRIES, len(parts))).astype(np.int64))
    reached, todo_ = set(entries.tolist()), entries.tolist()
    for start in range(len(parts)):  # a part of the graph that no entry leads to gets one
        if start not in reached and not todo_:
            entries = np.append(entries, start)
            reached.add(start)
            todo_ = [start]
        while todo_:
            fresh = [c for c in edges[todo_.pop()].tolist() if c not in reached]
            reached.update(fresh)
            todo_ += fresh
    lists = Lists(centroids, edges, entries)
    homes = [lists.home(v) for v in sample]
    lists.members = np.bincount(np.concatenate([np.array(h) for h in homes]), minlength=len(parts))
    asked = rng.choice(len(sample), min(CALIBRATE, len(sample)), replace=False)
    need = []
    for a in asked:
        far = squares(sample[[a]], sample)[0]
        far[a] = np.inf
        d = np.sqrt(((centroids - sample[a]) ** 2).sum(1))
        for n in np.argsort(far, kind="stable")[: min(k, len(sample) - 1)]:
            need.append(d[homes[n]].min() / max(d.min(), 1e-300))
    need = [r for r in need if np.isfinite(r)]
    lists.ratio = float(np.quantile(need, RECALL)) if need else 1.0
    return lists


def cells(lists: Lists, rows: float) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each list, and the parts each cell is dealt to, by the rows that the sample makes expect."""
    expected = np.maximum(lists.members, 1) * rows / max(lists.members.sum(), 1)
    cell, n, held = np.zeros(len(expected), dtype=np.int64), 0, 0.0
    for c, rows_here in enumerate(expected.tolist()):
        if held and held + rows_here > CELL_ROWS:
            n, held = n + 1, 0.0
        held += rows_here
        cell[c] = n
    return cell, np.maximum(1, np.ceil(np.bincount(cell, weights=expected) / CELL_ROWS)).astype(np.int64)


def _nearest(k: int, dim: int):
    """The k nearest of a cell's rows for each of its queries, of the lists that the query takes."""

    def run(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(asked):
            return pd.DataFrame({c.split()[0]: [] for c in HITS.split(", ")})
        x, own = matrix(rows["x"], dim), rows[["vec_id", "h", "rn"]]
        size = rows["x"].map(len).to_numpy()
        place = {c: n for n, c in enumerate(rows["list"].unique())}
        at = rows["list"].map(place).to_numpy()
        ids, hs, rn, first = own["vec_id"].to_numpy(), own["h"].to_numpy(), own["rn"].to_numpy(), rows["first"].to_numpy(bool)
        most, out = float((x * x).sum(1).max()), []
        for a in range(0, len(asked), CHUNK):
            part = asked.iloc[a : a + CHUNK]
            q = matrix(part["x"], dim)
            far = squares(q, x)
            slack = 1e-11 * ((q * q).sum(1) + most)
            for n, (qid, qh, many, wanted, v) in enumerate(zip(part["query_id"], part["qh"], part["many"], part["lists"], part["x"], strict=True)):
                takes = np.zeros(len(place), dtype=bool)
                takes[[place[c] for c in wanted if c in place]] = True
                may = np.flatnonzero(takes[at] & (size == len(v)) & ~((ids == qid) & (hs == qh) & first))
                if not len(may):
                    continue
                d, wide = far[n, may], REPLICAS * k
                if len(may) > wide:
                    may = may[d <= np.partition(d, wide - 1)[wide - 1] + slack[n]]
                with np.errstate(over="ignore"):
                    exact = np.sqrt(((x[may] - q[n]) ** 2).sum(1))
                order = np.lexsort((rn[may], hs[may], ids[may], exact))
                seen, best = set(), []
                for j in order.tolist():
                    key = (ids[may[j]], hs[may[j]], rn[may[j]])
                    if key not in seen:
                        seen.add(key)
                        best.append(j)
                        if len(best) == k:
                            break
                may = may[best]
                out.append(pd.DataFrame({"query_id": qid, "qh": qh, "many": many, "vec_id": ids[may], "h": hs[may], "rn": rn[may], "score": exact[best]}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({c.split()[0]: [] for c in HITS.split(", ")})

    return run


def nearest(vectors: DataFrame, k: int = 10, is_query: Column | None = None, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest other rows found for every query; is_query: default vec_id divisible by 100."""
    spark = vectors.sparkSession
    asked = is_query if is_query is not None else F.col("vec_id") % 100 == 0
    kind = dict(vectors.dtypes)[column]
    own = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(column).cast(kind if kind == "array<float>" else "array<double>").alias("x"))
    sound = is_sound(F.col("x")) & F.exists("x", lambda c: c != 0) & F.col("vec_id").isNotNull()
    rows = own.where(sound).withColumn("h", F.xxhash64("x"))
    alike = Window.partitionBy("h", "x").orderBy("vec_id")
    kept = rows.withColumn("rn", F.row_number().over(alike)).where(F.col("rn") <= k + 1)
    kept = kept.withColumn("first", F.coalesce(F.lag("vec_id").over(alike) != F.col("vec_id"), F.lit(True)))
    kept = materialise(kept, "ann-vectors", "uncompressed")
    total, dim = kept.agg(F.count(F.lit(1)), F.max(F.size("x"))).collect()[0]
    if not total:
        return spark.createDataFrame([], OUT)
    share = F.pmod(F.xxhash64("vec_id", "h", "rn", F.lit(1)), F.lit(1_000_000)) < int(1_000_000 * SAMPLE / total) + 1
    sample = matrix(kept.where(share).select("x").toPandas()["x"], dim)  # about SAMPLE rows at most
    if not len(sample):
        sample = matrix(kept.select("x").limit(1).toPandas()["x"], dim)
    lists = fit(sample, max(2, -(-len(sample) // max(1, min(MOST_LISTS, total // LIST_ROWS)))), k)
    cell, deal = cells(lists, float(total) * lists.members.sum() / len(sample))
    sent = spark.sparkContext.broadcast((lists, cell, deal))
    kind = dict(kept.dtypes)["x"]

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, cell_of, _ = sent.value
        for pdf in batches:
            taken = [index.near(v, 1, index.ratio)[0] for v in matrix(pdf["x"], dim)]
            by_cell = [pd.Series(t).groupby(cell_of[t]).agg(list).to_dict() for t in taken]
            yield pdf.assign(takes=[[{"cell": int(c), "lists": t} for c, t in b.items()] for b in by_cell])

    queries = rows.where(asked).groupBy(F.col("vec_id").alias("query_id"), F.col("h").alias("qh"), "x").agg(F.count(F.lit(1)).alias("many"))
    queries = queries.select("query_id", "qh", "x", "many")
    queries = queries.mapInPandas(choose, f"query_id long, qh long, x {kind}, many long, takes array<struct<cell: long, lists: array<long>>>")
    queries = materialise(queries, "ann-queries").select("query_id", "qh", "x", "many", F.inline("takes"))
    met = {r["cell"]: -(-r["n"] // CELL_QUERIES) for r in queries.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most one a list
    sets = spark.sparkContext.broadcast(met)

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, cell_of, parts = sent.value
        for pdf in batches:
            homes = [index.home(v) for v in matrix(pdf["x"], dim)]
            out = pdf.loc[np.repeat(np.arange(len(pdf)), [len(h) for h in homes])].assign(list=[c for h in homes for c in h])
            out["cell"] = cell_of[out["list"].to_numpy(np.int64)]
            out["part"] = ((out["vec_id"].to_numpy(np.int64) ^ out["h"].to_numpy(np.int64)) + out["rn"].to_numpy(np.int64)) % parts[out["cell"].to_numpy(np.int64)]
            out["sets"] = out["cell"].map(sets.value).fillna(0).astype(np.int64)
            yield out[out["sets"] > 0]

    posted = kept.select("vec_id", "x", "h", "rn", "first").mapInPandas(post, f"vec_id long, x {kind}, h long, rn int, first boolean, list long, cell long, part long, sets long")
    posted = posted.withColumn("set", F.explode(F.sequence(F.lit(0), F.col("sets") - 1))).drop("sets")
    sized = spark.createDataFrame([(int(c), int(deal[c]), int(n)) for c, n in met.items()], "cell long, parts long, sets long")
    dealt = queries.join(F.broadcast(sized), "cell").withColumn("set", F.pmod(F.xxhash64("query_id", "qh"), F.col("sets")))
    dealt = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("cell", "part", "set", "query_id", "qh", "many", "lists", "x")
    on = ["cell", "part", "set"]
    hits = posted.groupBy(*on).cogroup(dealt.groupBy(*on)).applyInPandas(_nearest(k, dim), HITS)
    order = Window.partitionBy("query_id", "qh").orderBy("score", "vec_id", "h", "rn")
    best = hits.withColumn("n", F.dense_rank().over(order)).where(F.col("n") <= k).dropDuplicates(["query_id", "qh", "n"])
    copies = best.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("many"))))
    return copies.select("query_id", F.col("n").cast("int").alias("rank"), "vec_id", "score")
