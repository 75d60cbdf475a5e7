"""Mixing sources to target weights with the cube method of balanced sampling.

Method. A source with target t and total size S is taken at the rate t / S: every document floor(rate) times, and once more
with the fractional inclusion probability that is left. The cube method draws those last copies. Its flight phase walks
through the probabilities of a source with a window of three documents: it moves them along the null-space of the two
balancing constraints (token total and document total), up or down with the odds that keep every expectation, until one
reaches 0 or 1 and the next document takes its place. So both totals are kept exactly during flight. At most two documents
of a block stay fractional. One block of a source waits until the others have flown and is flown last, with what these left, in
tiers from long documents to short ones: the last one or two of a tier are drawn with their probabilities, and the words
this puts the source over or under its target are taken off or added to the probabilities of all shorter ones. So every
document keeps its expectation. Only LANDING documents of the shorter half don't fly; the outcome of these that is nearest the
expected totals is taken.

Scale. Only (doc_id, source, size) rows move. Blocks of about BLOCK documents are dealt by a hash of doc_id, so a source with a
third of all rows is many blocks; each round leaves two documents of a block, and rounds go on until one block is left.
Per-source totals are collected to the driver, at most MAX_SOURCES of them (a ValueError beyond).

Defined cases. Null text has size 0, and so has text without words; such documents take part in the document total and
take nothing. A null source is a source, the last in order. Rows that repeat are separate units. Documents of one size are ordered
by a hash of doc_id, then doc_id. An empty table gives an empty result. Reruns agree: the draws are seeded by ``seed``,
the source and the block, and neither depends on partitioning.
"""

from __future__ import annotations

import uuid
import zlib
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

BLOCK = 8192
MAX_SOURCES = 200_000
#: Documents of a source that landing decides on, by looking at every outcome.
LANDING = 14
EPS = 1e-9

WORD = r"[^\x20\x09-\x0D]+"
UNITS = "doc_id long, src int, size long, pi double, copies int"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def share_out(totals: list[int], weights: list[int], cap: int = 3) -> list[Fraction]:
    """Targets by weight of the sum of ``totals``; those above cap times their total stop there, the excess is reshared."""
    left, free, out = Fraction(sum(totals)), set(range(len(totals))), [Fraction(0)] * len(totals)
    while free:
        weight = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] > cap * totals[i] * weight]
        if not over:
            for i in free:
                out[i] = left * weights[i] / weight
            break
        for i in over:
            out[i] = Fraction(cap * totals[i])
        free -= set(over)
        left -= sum(out[i] for i in over)
    return out


def fly(size: np.ndarray, pi: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Flight over one block: probabilities moved to 0 or 1 but for at most two, both totals kept. draws: uniform, one a step."""
    pi, sizes = pi.astype(float).tolist(), size.tolist()
    window: list[int] = []
    step = 0
    waiting = iter(np.flatnonzero((size >= 0) & (np.abs(np.asarray(pi) - 0.5) < 0.5 - EPS)).tolist())
    for k in waiting:
        window.append(k)
        while len(window) == 3 or (len(window) == 2 and sizes[window[0]] == sizes[window[1]]):
            if len(window) == 3:
                a, b, c = (sizes[i] for i in window)
                u = [b - c, c - a, a - b]
            else:
                u = [0, 0]
            if not any(u):
                u = [1, -1, 0][: len(window)]
            scale = max(map(abs, u))
            u = [x / scale for x in u]
            up = min((1 - pi[i]) / x if x > 0 else pi[i] / -x for i, x in zip(window, u, strict=True) if x)
            down = min(pi[i] / x if x > 0 else (1 - pi[i]) / -x for i, x in zip(window, u, strict=True) if x)
            move = up if draws[step] * (up + down) < down else -down
            step += 1
            for i, x in zip(window, u, strict=True):
                pi[i] += move * x
            for i in window:
                if pi[i] < EPS:
                    pi[i] = 0.0
                elif pi[i] > 1 - EPS:
                    pi[i] = 1.0
            window = [i for i in window if 0 < pi[i] < 1]
    return np.array(pi)


def land(size: np.ndarray, pi: np.ndarray, want: float) -> np.ndarray:
    """The outcome of the last (at most LANDING) fractional documents that is nearest ``want`` tokens, then the document total."""
    open_ = np.flatnonzero((pi > 0) & (pi < 1))
    closed = float((size * np.where((pi > 0) & (pi < 1), 0, pi)).sum())
    outcomes = np.arange(1 << len(open_))[:, None] >> np.arange(len(open_)) & 1
    missed = np.abs(closed + outcomes @ size[open_].astype(float) - want).round(6)
    documents = np.abs(outcomes.sum(axis=1) - pi[open_].sum()).round(6)
    out = pi.copy()
    out[open_] = outcomes[np.lexsort((documents, missed))[0]]
    return out


def fly_down(size: np.ndarray, pi: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Flight of a source's last block and its landing. size falls."""
    pi = pi.astype(float)
    want = float((size * pi).sum())
    half = size <= np.median(size[size > 0]) if (size > 0).any() else np.ones(len(size), dtype=bool)
    tier = np.where(half, -1, np.floor(np.log2(np.maximum(size, 1))).astype(int))
    short = np.flatnonzero(half & (size > 0) & (pi > 0) & (pi < 1))
    pool = np.zeros(len(size), dtype=bool)
    pool[short[np.unique(np.linspace(0, len(short) - 1, min(LANDING, len(short))).astype(int))]] = True
    over = 0.0
    for t in sorted(set(tier.tolist()), reverse=True):
        rest = (tier <= t) & (pi > 0) & (pi < 1)
        words = float(size[rest].sum())
        if words and over:
            moved = np.clip(pi[rest] - over / words, 0.0, 1.0)
            over += float((size[rest] * (moved - pi[rest])).sum())
            pi[rest] = moved
        own = (tier == t) & ~pool
        pi[own] = fly(size[own], pi[own], rng.random(2 * int(own.sum()) + 8))
        left = own & (pi > 0) & (pi < 1)
        if left.any():
            p, u = pi[left], rng.random()
            # of two, the second comes in where the first stays out, as far as their probabilities let it
            drawn = np.array([u < p[0], u > 1 - p[-1]])[: len(p)]
            over += float((size[left] * (drawn - pi[left])).sum())
            pi[left] = drawn
    return land(size, pi, want)


def _flight(seed: int, names: list[str], last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "h", "doc_id"], ascending=[False, True, True], kind="stable", ignore_index=True)
        src, block = int(pdf["src"].iloc[0]), int(pdf["block"].iloc[0])
        rng = np.random.Generator(np.random.PCG64([seed, zlib.crc32(names[src].encode()), block, int(pdf["round"].iloc[0])]))
        size, before = pdf["size"].to_numpy(), pdf["pi"].to_numpy()
        pi = fly_down(size, before, rng) if last else fly(size, before, rng.random(2 * len(pdf) + 8))
        return pdf[["doc_id", "src", "size", "copies"]].assign(pi=pi)[["doc_id", "src", "size", "pi", "copies"]]

    return run


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, seed: int = 1) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies of every row of ``docs`` (doc_id, text, source).

    Sources in code-point order (null last) weigh ``weights`` in turn and share all sizes; no source takes more than ``cap``
    times its size. copies is how often the mix takes the document, taken the words that makes.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"))
    rows = materialise(rows, "sizes")
    found = rows.groupBy("source").agg(F.sum("size").alias("total"), F.count(F.lit(1)).alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    totals = [r["total"] for r in found]
    targets = share_out(totals, [weights[i % len(weights)] for i in range(len(found))], cap)
    rates = [t / s if s else Fraction(0) for t, s in zip(targets, totals, strict=True)]
    plan = [
        (i, r["source"], r["total"], float(t), int(rate), float(rate - int(rate)), max(1, -(-r["n"] // BLOCK)))
        for i, (r, t, rate) in enumerate(zip(found, targets, rates, strict=True))
    ]
    kind = "src int, source string, source_size long, target double, copies int, pi double, blocks int"
    sources = F.broadcast(spark.createDataFrame(plan, kind))  # at most MAX_SOURCES rows
    units = rows.withColumnRenamed("source", "own").join(sources, F.col("own").eqNullSafe(F.col("source"))).drop("own")
    done = units.where("pi = 0").select("doc_id", "src", "size", "pi", "copies")
    names = ["" if r["source"] is None else "=" + r["source"] for r in found]
    turn = 0

    def flight(rows: DataFrame, blocks: dict[int, int], last: bool) -> DataFrame:
        table = F.broadcast(spark.createDataFrame([*blocks.items()], "src int, blocks int"))
        keyed = rows.join(table, "src").withColumn("h", F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.lit(seed + turn)))
        keyed = keyed.withColumn("block", F.pmod("h", F.col("blocks"))).withColumn("round", F.lit(turn)).drop("blocks")
        return materialise(keyed.groupBy("src", "block").applyInPandas(_flight(seed, names, last), UNITS), "flight")

    fractional = units.where("pi > 0").withColumn("waits", F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.lit(seed - 1)), F.col("blocks")) == 0)
    waiting = fractional.where("waits").select("doc_id", "src", "size", "pi", "copies")
    flying = fractional.where("NOT waits").select("doc_id", "src", "size", "pi", "copies")
    blocks = {p[0]: p[6] - 1 for p in plan if p[5] > 0 and p[6] > 1}
    while blocks:
        turn += 1
        flown = flight(flying, blocks, False)
        done = done.unionByName(flown.where("pi = 0 OR pi = 1"))
        flying = flown.where("pi > 0 AND pi < 1")
        over = [s for s, b in blocks.items() if b == 1]
        waiting = waiting.unionByName(flying.where(F.col("src").isin(over)))
        flying = flying.where(~F.col("src").isin(over))
        blocks = {s: -(-2 * b // BLOCK) for s, b in blocks.items() if b > 1}
    turn += 1
    ends = {p[0]: 1 for p in plan if p[5] > 0}
    if ends:
        done = done.unionByName(flight(waiting, ends, True))
    copies = (F.col("copies") + F.col("pi").cast("int")).alias("copies")
    out = done.select("doc_id", "src", "size", copies).join(sources.select("src", "source_size", "target"), "src")
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as :func:`mix_sources` takes it; columns as they were.

    doc_id must tell documents apart here; rows that repeat one are taken as often as the first of them in order of copies.
    """
    times, doc, turn = (f"{n}_{uuid.uuid4().hex}" for n in ("times", "doc", "turn"))  # no column of docs has these names
    mix = mix_sources(docs, **options).groupBy(F.col("doc_id").alias(doc)).agg(F.max("copies").alias(times)).where(f"{times} > 0")
    kept = docs.join(mix, docs["doc_id"].cast("long").eqNullSafe(F.col(doc))).withColumn(turn, F.explode(F.sequence(F.lit(1), times)))
    return kept.drop(times, doc, turn)
