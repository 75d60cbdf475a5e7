"""Exact substring deduplication: repeats of LENGTH bytes and more, by suffix arrays built in two stages.

Method. Every string of LENGTH bytes names an anchor inside itself, the leftmost of the least hashed GRAM-byte strings it holds,
so equal strings have anchors with equal hashes at the same place. Only strings whose anchor's hash occurs twice can
repeat. For these, the bytes their strings span are the anchor's context. Contexts are dealt to blocks by the hash of their
anchor, so equal strings meet in one block, and each block's suffixes are sorted in two stages: directly only those
smaller than their successors; the rest are induced by scanning the buckets of first bytes from the least on. Common
prefixes of neighbours in that order, compared byte for byte, say which strings repeat. A repeat covers its LENGTH bytes; the
union of covered bytes is removed, all judged on the input.

Hot anchors. The contexts of a hash that more than HOT places have (a passage in a third of all documents) are unbounded, so they
aren't gathered. Their strings are compared by a 128-bit hash instead: each chunk of contexts sends every distinct one
once with its count to a range of hashes, and gets back which occur again.

Scale. Documents with equal text are one to all of this (all of them are removed whole, if long enough). Anchors are one in about
170 bytes. Texts move only for documents with an anchor that occurs twice, and again only for those with a repeat.

Defined cases. Null text is empty. Texts shorter than LENGTH bytes are kept as they are. Matches never cross documents, but may
overlap inside one. Rows that repeat are documents of their own, so they repeat each other. A null doc_id is allowed. Empty
tables give empty results. Extra columns are ignored by :func:`repeated_spans` and kept by :func:`remove_repeats`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import group_bounds, join_groups, materialise, mix64, only_ids, shuffle_partitions

LENGTH = 400
GRAM = 64
HOT = 512
BLOCK_CONTEXTS = 1500
CHUNK_BYTES = 1 << 20
RANGE_STRINGS = 1_000_000

MULTIPLIERS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
DOCS = "doc_id long, n_bytes long, digest binary, anchors binary"
CONTEXTS = "digest binary, rep long, h long, hot boolean, chunk long, lo long, m int, bytes binary"
SPANS = "digest binary, rep long, start long, end long"


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def rolling(data: np.ndarray, width: int, which: int) -> np.ndarray:
    """A 64-bit hash of every ``width`` bytes of an uint8 array."""
    n = len(data)
    if n < width:
        return np.zeros(0, dtype=np.uint64)
    base = MULTIPLIERS[which]
    back = pow(base, -1, 1 << 64)
    with np.errstate(over="ignore"):
        up, down = powers(base, n), powers(back, n)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * down)])
        return mix64((total[width:] - total[:-width]) * up[: n - width + 1], which)


def window_least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    n = len(x)
    pad = -n % width
    y = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, dtype=x.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(y, axis=1).ravel()
    back = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def find_anchors(data: np.ndarray, ends: np.ndarray, length: int, gram: int) -> list[np.ndarray]:
    """Of each document in a buffer (under 2^24 bytes; ends: theirs): rows of hash and first string start of its anchors."""
    starts = np.concatenate([[0], ends[:-1]])
    none = np.zeros((0, 2), dtype=np.uint64)
    if not len(data) or (ends - starts).max(initial=0) < length:
        return [none] * len(ends)
    h = rolling(data, gram, 0)
    low = np.uint64(0xFFFFFF)
    key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    place = (window_least(key, length - gram + 1) & low).astype(np.int64)
    out = []
    for a, b in zip(starts, ends, strict=True):
        own = place[a : b - length + 1] if b - a >= length else place[:0]
        if not len(own):
            out.append(none)
            continue
        first = group_bounds(own)[:-1]
        out.append(np.stack([h[own[first]], first.astype(np.uint64)], axis=1))
    return out


def anchors_of(text: bytes, length: int, gram: int) -> np.ndarray:
    """find_anchors() of one text of any length, by pieces."""
    step, parts = (1 << 23), []
    for at in range(0, max(1, len(text) - length + 1), step):
        data = np.frombuffer(text[at : at + step + length - 1], dtype=np.uint8)
        rows = find_anchors(data, np.array([len(data)]), length, gram)[0].copy()
        rows[:, 1] += np.uint64(at)
        parts.append(rows)
    return np.concatenate(parts)


def two_stage(texts: list[bytes], starts: list[int], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of ``texts`` in order of their first ``depth`` bytes: text number and position, for the first starts[k] of text k."""
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes + 1) - 1  # each text ends with a sentinel below all bytes
    joined = np.frombuffer(b"\0".join(texts) + b"\0", dtype=np.uint8)
    code = joined.astype(np.int16) + 1
    code[ends] = 0
    n = len(code)
    rise = np.sign(np.append(np.diff(code), 1)).astype(np.int8)
    rise[ends] = 1
    at = np.where(rise != 0, np.arange(n), n - 1)
    at = np.minimum.accumulate(at[::-1])[::-1]
    smaller = rise[at] > 0  # than its successor
    begin = ends - sizes
    next_small = np.minimum.accumulate(np.where(smaller, np.arange(n), n)[::-1])[::-1]
    limit = np.minimum(next_small[np.minimum(begin + np.array(starts), ends)], ends)
    wanted = np.zeros(n + 1, dtype=np.int32)
    np.add.at(wanted, begin, 1)
    np.add.at(wanted, limit + 1, -1)
    wanted = np.cumsum(wanted)[:n] > 0
    owner = np.repeat(np.arange(len(texts)), sizes + 1)

    direct = np.flatnonzero(smaller & wanted)
    inside = (direct - begin[owner[direct]]).tolist()
    keys = [texts[k][i : i + depth] for k, i in zip(owner[direct].tolist(), inside, strict=True)]
    direct = direct[sorted(range(len(keys)), key=keys.__getitem__)]
    del keys
    # sentinels have empty keys and come first, in bucket 0
    cuts = np.searchsorted(code[direct], np.arange(258))
    induced: list[list[np.ndarray]] = [[] for _ in range(257)]
    order = []
    larger = ~smaller & wanted
    for c in range(257):
        bucket = list(induced[c])
        front = np.concatenate(bucket) if bucket else direct[:0]
        while len(front):
            before = front - 1
            front = before[(before >= 0) & larger[before] & (code[before] == c)]
            bucket.append(front)
        bucket.append(direct[cuts[c] : cuts[c + 1]])
        whole = np.concatenate(bucket)
        order.append(whole)
        before = whole[whole > 0] - 1
        before = before[larger[before] & (code[before] > c)]
        heads = code[before]
        by = np.argsort(heads, kind="stable")
        bounds = group_bounds(heads[by])
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            induced[heads[by[a]]].append(before[by[a:b]])
    suffixes = np.concatenate(order)
    text, position = owner[suffixes], suffixes - begin[owner[suffixes]]
    mine = position < np.array(starts)[text]
    return text[mine], position[mine]


def neighbours_share(texts: list[bytes], text: np.ndarray, position: np.ndarray, depth: int) -> np.ndarray:
    """Of suffixes in order: whether the common prefix with the one before has ``depth`` bytes, compared byte for byte."""
    out = np.zeros(len(text), dtype=bool)
    before = None
    for k, (t, i) in enumerate(zip(text.tolist(), position.tolist(), strict=True)):
        own = texts[t][i : i + depth]
        out[k] = own == before
        before = own
    return out


def distinct_texts(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct ones, the number of each text's, and how often each occurs."""
    known: dict[bytes, int] = {}
    number = np.array([known.setdefault(t, len(known)) for t in texts], dtype=np.int64)
    return list(known), number, np.bincount(number, minlength=len(known))


def starts_of(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Row and position of every string start of the contexts, one context after the other."""
    m = pdf["m"].to_numpy(np.int64)
    return np.repeat(np.arange(len(pdf)), m), np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)


def per_row(number: np.ndarray, m: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Flags of the string starts of distinct contexts, one context after the other, given to each row that holds the context."""
    first = np.concatenate([[0], np.cumsum(m)])
    parts = [flags[first[k] : first[k + 1]] for k in number]
    return np.concatenate(parts) if parts else flags[:0]


def _block(length: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Repeats among the contexts of one block, as spans of their documents. Equal contexts repeat each other whole and are
        sorted once."""
        texts, number, times = distinct_texts(list(pdf["bytes"]))
        m = np.array([len(t) - length + 1 for t in texts])
        text, position = two_stage(texts, m.tolist(), length)
        again = neighbours_share(texts, text, position, length)
        again[:-1] |= again[1:]
        flags = np.repeat(times > 1, m)
        flags[(np.cumsum(m) - m)[text[again]] + position[again]] = True
        hit = per_row(number, m, flags)
        row, at = starts_of(pdf)
        return spans_of(pdf, row[hit], at[hit], length)

    return run


def spans_of(pdf: pd.DataFrame, text: np.ndarray, position: np.ndarray, length: int) -> pd.DataFrame:
    """Runs of repeated string starts, by context, as spans of bytes of their document."""
    if not len(text):
        return pd.DataFrame({"digest": [], "rep": [], "start": [], "end": []})
    by = np.lexsort((position, text))
    text, position = text[by], position[by]
    new = np.append(True, (text[1:] != text[:-1]) | (position[1:] != position[:-1] + 1))
    first, last = np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(text)) - 1
    lo = pdf["lo"].to_numpy(np.int64)[text[first]]
    return pd.DataFrame({
        "digest": pdf["digest"].to_numpy()[text[first]], "rep": pdf["rep"].astype("Int64").to_numpy()[text[first]],
        "start": lo + position[first], "end": lo + position[last] + length,
    })


def _hashes(texts: list[bytes], length: int) -> np.ndarray:
    """(strings, 2): 128-bit hashes of the strings of the contexts, one context after the other."""
    parts = [np.zeros((0, 2), np.uint64)]
    for b in texts:
        data = np.frombuffer(b, dtype=np.uint8)
        parts.append(np.stack([rolling(data, length, 1), rolling(data, length, 2)], axis=1))
    return np.concatenate(parts)


def _distinct(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows in order, the number of each row's, and how often each occurs."""
    by = np.lexsort((pairs[:, 1], pairs[:, 0]))
    bounds = group_bounds(pairs[by, 0], pairs[by, 1])
    number = np.empty(len(pairs), dtype=np.int64)
    number[by] = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    return pairs[by[bounds[:-1]]], number, np.diff(bounds)


def _hot_slices(length: int, ranges: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        texts, _, times = distinct_texts(list(pdf["bytes"]))
        values, number, _ = _distinct(_hashes(texts, length))
        counts = np.bincount(number, weights=np.repeat(times, [len(t) - length + 1 for t in texts]), minlength=len(values))
        cuts = np.searchsorted(values[:, 0].astype(np.float64), np.arange(1, ranges) * 2.0**64 / ranges)
        rows = zip(np.split(values, cuts), np.split(counts.astype(np.int64), cuts), strict=True)
        chunk = int(pdf["chunk"].iloc[0])
        return pd.DataFrame([(chunk, r, v.tobytes(), c.tobytes()) for r, (v, c) in enumerate(rows) if len(v)], columns=["chunk", "range", "strings", "counts"])

    return run


def _hot_again(pdf: pd.DataFrame) -> pd.DataFrame:
    values = np.frombuffer(b"".join(pdf["strings"]), dtype=np.uint64).reshape(-1, 2)
    counts = np.frombuffer(b"".join(pdf["counts"]), dtype=np.int64)
    _, number, _ = _distinct(values)
    again = np.bincount(number, weights=counts)[number] > 1
    ends = np.cumsum([len(x) // 16 for x in pdf["strings"]])[:-1]
    return pd.DataFrame({"chunk": pdf["chunk"], "range": pdf["range"], "again": [x.tobytes() for x in np.split(again, ends)]})


def _hot_spans(length: int):
    def run(pdf: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        again = np.frombuffer(b"".join(told.sort_values("range")["again"]), dtype=bool)
        texts, which, _ = distinct_texts(list(pdf["bytes"]))
        _, number, _ = _distinct(_hashes(texts, length))
        hit = per_row(which, np.array([len(t) - length + 1 for t in texts]), again[number])
        row, at = starts_of(pdf)
        return spans_of(pdf, row[hit], at[hit], length)

    return run


def scan(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """DOCS of every document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        size = 0
        for pdf in batches:
            for doc_id, text in zip(pdf["doc_id"].astype("Int64"), pdf["text"], strict=True):
                held.append((doc_id, (text or "").encode("utf-8", "replace")))
                size += len(held[-1][1])
                if size > CHUNK_BYTES or len(held) >= 5000:
                    yield frame(held)
                    held, size = [], 0
        if held:
            yield frame(held)

    def frame(held: list[tuple]) -> pd.DataFrame:
        found: list = [None] * len(held)
        short = [k for k, (_, b) in enumerate(held) if len(b) <= CHUNK_BYTES]
        ends = np.cumsum([len(held[k][1]) for k in short]).astype(np.int64)
        data = np.frombuffer(b"".join(held[k][1] for k in short), dtype=np.uint8)
        for k, rows in zip(short, find_anchors(data, ends, length, gram) if short else [], strict=True):
            found[k] = rows
        found = [anchors_of(b, length, gram) if rows is None else rows for rows, (_, b) in zip(found, held, strict=True)]
        return pd.DataFrame({
            "doc_id": pd.array([d for d, _ in held], dtype="Int64"), "n_bytes": [len(b) for _, b in held],
            "digest": [hashlib.sha256(b).digest() for _, b in held], "anchors": [x.tobytes() for x in found],
        })

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, DOCS)


def _explode(length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a in range(0, len(pdf), 200):
                part = pdf.iloc[a : a + 200]
                rows = [np.frombuffer(b, dtype=np.uint64).reshape(-1, 2) for b in part["anchors"]]
                n = np.array([len(r) for r in rows])
                row = np.repeat(np.arange(len(rows)), n)
                both = np.concatenate(rows)
                lo = both[:, 1].astype(np.int64)
                end = part["n_bytes"].to_numpy(np.int64) - length
                hi = np.append(lo[1:], 0) - 1
                if len(hi):
                    last = np.cumsum(n)[n > 0] - 1
                    hi[last] = end[n > 0]
                yield pd.DataFrame({
                    "h": both[:, 0].view(np.int64), "digest": part["digest"].to_numpy()[row],
                    "rep": part["rep"].astype("Int64").to_numpy()[row], "lo": lo, "m": (hi - lo + 1).astype(np.int32),
                })

    return run


def _contexts(length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunk, room, rows = TaskContext.get().partitionId() << 32, CHUNK_BYTES, []
        for pdf in batches:
            for digest, rep, text, *anchors in zip(pdf["digest"], pdf["rep"].astype("Int64"), pdf["text"], *(pdf[c] for c in ("h", "hot", "lo", "m")), strict=True):
                data = (text or "").encode("utf-8", "replace")
                for h, hot, lo, m in zip(*(x.tolist() for x in anchors), strict=True):
                    part = data[lo : lo + m - 1 + length]
                    rows.append((digest, rep, h, hot, chunk, lo, m, part))
                    room -= len(part) + 64
                    if room < 0:
                        yield frame(rows)
                        chunk, room, rows = chunk + 1, CHUNK_BYTES, []
        yield frame(rows)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["digest", "rep", "h", "hot", "chunk", "lo", "m", "bytes"])
        return out.assign(rep=out["rep"].astype("Int64"))

    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """Two tables: every row of ``docs`` as doc_id, n_bytes, digest, copied (its text occurs twice and goes whole); and, for one
    document (rep) of each text (digest), start, end of each repeat, which may overlap."""
    spark = docs.sparkSession
    scanned = materialise(scan(docs, length, gram), "anchors", "zstd")
    total = scanned.count()
    classes = scanned.groupBy("digest").agg(
        F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.max("anchors").alias("anchors"), F.max("n_bytes").alias("n_bytes")
    )
    classes = materialise(classes, "texts", "zstd")
    every = join_groups(scanned.select("doc_id", "n_bytes", "digest"), classes.select("digest", "copies"), "digest", "copies", total)
    every = every.select("doc_id", "n_bytes", "digest", ((F.col("copies") > 1) & (F.col("n_bytes") >= length)).alias("copied"))

    places = classes.where("length(anchors) > 0").select("digest", "rep", "n_bytes", "anchors").mapInPandas(
        _explode(length), "h long, digest binary, rep long, lo long, m int"
    )
    places = materialise(places, "places", "zstd")
    twice = places.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "n", (F.col("n") > HOT).alias("hot"))
    twice = materialise(twice, "hashes", "zstd")
    met = join_groups(places, twice, "h", "n", places.count())
    own = met.groupBy("digest", "rep").agg(F.collect_list(F.struct("h", "hot", "lo", "m")).alias("anchors"))
    own = materialise(own, "twice", "zstd")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = only_ids(texts, own.select("rep")).withColumn("own", F.unhex(F.sha2("text", 256)))
    met = own.join(texts, F.col("rep").eqNullSafe(F.col("doc_id")) & (F.col("own") == F.col("digest"))).dropDuplicates(["digest"])
    contexts = materialise(met.select("digest", "rep", "text", "anchors.h", "anchors.hot", "anchors.lo", "anchors.m").mapInPandas(_contexts(length), CONTEXTS), "contexts", "zstd")

    light = contexts.where("NOT hot")
    blocks = max(shuffle_partitions(spark), -(-light.count() // BLOCK_CONTEXTS))
    dealt = light.withColumn("block", F.pmod(F.xxhash64("h"), F.lit(blocks))).select("block", "digest", "rep", "lo", "m", "bytes")
    parts = max(shuffle_partitions(spark), blocks // 8)  # of their own number: small in bytes, but long to sort
    spans = dealt.repartition(parts, "block").groupBy("block").applyInPandas(_block(length), SPANS)
    hot = contexts.where("hot").select("chunk", "digest", "rep", "lo", "m", "bytes").repartition(shuffle_partitions(spark), "chunk")
    strings = hot.agg(F.coalesce(F.sum("m"), F.lit(0))).collect()[0][0]
    if strings:
        ranges = max(shuffle_partitions(spark), -(-int(strings) // RANGE_STRINGS))
        slices = hot.groupBy("chunk").applyInPandas(_hot_slices(length, ranges), "chunk long, range int, strings binary, counts binary")
        told = slices.groupBy("range").applyInPandas(_hot_again, "chunk long, range int, again binary")
        spans = spans.unionByName(hot.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInPandas(_hot_spans(length), SPANS))
    return every, materialise(spans, "spans", "zstd")


def cut_spans(data: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left of ``data`` without the bytes in ``spans``, how many bytes went, and in how many maximal runs."""
    kept, at, runs, gone = [], 0, 0, 0
    edge = -1
    for start, end in sorted(spans):
        if start > edge:
            runs += 1
            kept.append(data[at:start])
            gone += end - start
            at = edge = end
        elif end > edge:
            gone += end - edge
            at = edge = end
    return b"".join([*kept, data[at:]]), gone, runs


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary; null where nothing was removed), digest of every row of ``docs``."""
    every, spans = repeated_spans(docs, length)
    grouped = materialise(spans.groupBy("digest", "rep").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "text-spans", "zstd")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = only_ids(texts, grouped.select("rep")).withColumn("own", F.unhex(F.sha2("text", 256)))
    met = grouped.join(texts, F.col("rep").eqNullSafe(F.col("doc_id")) & (F.col("own") == F.col("digest"))).dropDuplicates(["digest"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = [cut_spans(t.encode("utf-8", "replace"), [(s["start"], s["end"]) for s in x]) for t, x in zip(pdf["text"], pdf["spans"], strict=True)]
            yield pd.DataFrame({"digest": pdf["digest"], "kept": [d[0] for d in done], "n_removed": [d[1] for d in done], "n_spans": [d[2] for d in done]})

    cut = met.select("digest", "text", "spans").mapInPandas(run, "digest binary, kept binary, n_removed long, n_spans long")
    whole = every.where("copied").select("doc_id", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(b"").alias("kept"), "digest")
    rest = every.where("NOT copied").join(cut, "digest", "left")
    zero = F.lit(0).cast("long")
    rest = rest.select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), "kept", "digest")
    return whole.unionByName(rest)
