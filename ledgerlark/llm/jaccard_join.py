"""Exact Jaccard join of word n-gram sets by token-combination prefixes, and the groups its links make.

Method. A document is the set of its distinct n-word shingles (tokens, 64-bit hashes). Tokens have one global order, rare ones
first. Were two sets of n tokens to share fewer than i tokens of class i in their prefixes, then with a long enough prefix
they would miss more tokens than the threshold lets them; so two sets that link share, in some class, a combination of i
tokens of both prefixes. Class 1 holds rare tokens, indexed alone; class 2 frequent ones (more than FREQUENT documents), indexed
as pairs within SUBCLASSES by hash, each of which counts as a class of its own. A prefix is extended until its credits, one for
each rare token and one for each frequent token but the first of a subclass, exceed the tokens a partner may lack. Tokens that
only one document has earn credit and are not indexed. The number of subclasses goes by the band (power of two) of the set's
size; a set is indexed in its own band and in that of its largest possible partner, so two sets that can link meet in the
larger one's band. Sets that share an indexed combination are verified on the whole sets.

Order. Half of all tokens, by hash, come first in the order; only their document frequencies are counted (over all documents).
Half is enough for prefixes at the thresholds allowed here (0.8 and more); sets where it falls short bring all their tokens. Sets
that share an entry of this first index are indexed once more, now by all their tokens and their frequencies among these sets
(a link joins two of them), which leaves out the many that share a long passage and little else. Once each entry's sets have met one of them, those that could
still link are indexed a last time; tokens that only sets of one group have count as those of one set there, so near copies
don't hide what tells groups apart. The index knows tokens by 32 bits; tokens that collide there are one to
it, which can only add candidates: a set lacks no more of these than of whole tokens.

Groups. Equal sets are one class from the start, with its smallest doc_id for all. An index entry with many sets doesn't
emit its pairs: it names hubs, the sets with the most tokens that others can have, each other set is verified against these, and sets that are connected by then aren't
compared any more, nor are sets that have too many tokens of their own (or of their own group) alone to link, or whose distances to the entry's first hub tell that they
can't (Jaccard distance is a metric). Sets that can't link with even the likeliest of an entry leave it, and of entries with
the same sets one stays, and large ones with nearly the same sets become one. What is left meets eight times as many hubs in the next round, until each entry's sets are one group or all pairs of
different groups have been compared. So no link between groups is missed, and a group of thousands of near copies costs
thousands of comparisons, not their square.

Scale. Only hashes move, packed by chunk of documents; whole sets are made for the sets an index entry shares with another.
Texts are read twice. Nothing that grows with the corpus is broadcast: the list of those sets only up to SENT_IDS.

Defined cases. Null text, or text without words, has no tokens and links with nothing. Fewer words than n make one token of
the whole sequence. doc_id tells documents apart: rows that repeat one with its text are one document in each result row; a
null doc_id is a group of its own. Empty tables give empty results. Extra columns are ignored by :func:`jaccard_groups` and
kept by :func:`drop_near_copies`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SENT_IDS, group_bounds, in_bounded_set, join_groups, materialise, mix64, shuffle_partitions
from .components import connected_components
from .exact_dedup import text_digest

#: Documents a token may have to be indexed alone.
FREQUENT = 32
#: Sets an entry may have to be compared with each other at once.
ALL_PAIRS = 16
#: Bytes of text whose documents make a chunk, tokens a range of token hashes is planned for.
CHUNK_BYTES = 4 << 20
RANGE_TOKENS = 4_000_000

SETS = "doc_id long, chunk long, n long, digest binary, tokens binary"
PRIME = np.uint64(0x9E3779B97F4A7C15)


#: Words of which a worker keeps the hash.
CACHE_WORDS = 100_000


class WordHashes(dict):
    """64-bit hashes of words, kept."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


WORDS = WordHashes()


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles. Only A-Z are lower-cased and only ASCII white space parts words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.array([WORDS[w] for w in words], dtype=np.uint64)
    n, width = len(h), min(size, len(h))
    with np.errstate(over="ignore"):
        out = np.full(n - width + 1, width, dtype=np.uint64)
        for k in range(width):
            out = out * PRIME + h[k : n - width + 1 + k]
    return np.unique(mix64(out))


def least_overlap(n: int, num: int, den: int) -> int:
    """The fewest tokens a set of n shares with any set it links with."""
    return -(-num * n // den)


def subclasses(band: int) -> int:
    """Subclasses of the frequent tokens in a band; 0 where all tokens are indexed alone."""
    return 0 if band < 5 else max(1, int(0.04 * 2**band))


def is_first(tokens: np.ndarray, every: bool = False) -> np.ndarray:
    """Which tokens are counted and come first in the order; all of them in the second index."""
    return np.ones(len(tokens), dtype=bool) if every else (tokens & np.uint32(1)) == 0


def read_tokens(blob: bytes, every: bool) -> np.ndarray:
    """The index's tokens of a set: as stored for the first index, by 32 bits from the whole set for the second."""
    return np.unique((np.frombuffer(blob, dtype=np.uint64) >> np.uint64(32)).astype(np.uint32)) if every else np.frombuffer(blob, dtype=np.uint32)


def index_tokens(tokens: np.ndarray, num: int, den: int) -> np.ndarray:
    """The tokens, by 32 bits, that a prefix can need: those first in the order if they are enough in any band, else all."""
    n = len(tokens)
    tokens = np.unique((tokens >> np.uint64(32)).astype(np.uint32))
    first = tokens[is_first(tokens)]
    most = (den * n // num).bit_length() - 1
    return first if len(first) >= n - least_overlap(n, num, den) + 1 + subclasses(most) else tokens


def frequency_class(counts: np.ndarray) -> np.ndarray:
    """Document frequencies as a byte that grows with them: 1 is one document."""
    return np.minimum(250, 1 + np.ceil(8 * np.log2(np.maximum(counts, 1)))).astype(np.uint8)


def signatures(tokens: np.ndarray, classes: np.ndarray, n: int, num: int, den: int) -> np.ndarray:
    """The index entries of a set of ``n`` tokens. tokens: as index_tokens() gives them; classes: frequency class, 255 if not counted
    (these come last in the order)."""
    order = np.lexsort((tokens, classes))
    tokens, classes = tokens[order].astype(np.uint64), classes[order]
    need = n - least_overlap(n, num, den) + 1
    often = int(frequency_class(np.array([FREQUENT]))[0])
    out = []
    for band in range(n.bit_length() - 1, (den * n // num).bit_length()):
        parts = subclasses(band)
        frequent = (classes > often) & (classes < 255) if parts else np.zeros(len(tokens), dtype=bool)
        credit = np.ones(len(tokens), dtype=np.int64)
        at = np.flatnonzero(frequent)
        sub = mix64(tokens[at], 9) % np.uint64(max(1, parts))
        if len(at):
            credit[at[np.unique(sub, return_index=True)[1]]] = 0
        end = int(np.searchsorted(np.cumsum(credit), need)) + 1
        alone = tokens[:end][~frequent[:end] & (classes[:end] != 1)]
        out.append(mix64(alone, band))
        inside = at < end
        if inside.any():
            t, s = tokens[at[inside]], sub[inside]
            by = np.lexsort((t, s))
            t, s = t[by], s[by]
            bounds = group_bounds(s)
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                i, j = np.triu_indices(b - a, 1)
                out.append(mix64(mix64(t[a:b][i], 1000 + band) ^ t[a:b][j], 1000 + band))
    return np.concatenate(out)


def make_sets(docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """SETS of every document, in chunks; tokens: what the index needs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunk, room, rows = TaskContext.get().partitionId() << 32, CHUNK_BYTES, []
        for pdf in batches:
            for doc_id, text in zip(pdf["doc_id"].astype("Int64"), pdf["text"], strict=True):
                t = shingles(text, size)
                rows.append((doc_id, chunk, len(t), xxhash.xxh3_128_digest(t.tobytes()), index_tokens(t, num, den).tobytes() if len(t) else b""))
                room -= len(text or "") + 64
                if room <= 0:
                    yield frame(rows)
                    chunk, room, rows = chunk + 1, CHUNK_BYTES, []
        yield frame(rows)

    def frame(rows: list) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["doc_id", "chunk", "n", "digest", "tokens"])
        return out.assign(doc_id=out["doc_id"].astype("Int64"))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, SETS)


def chunk_tokens(blobs: pd.Series, every: bool) -> tuple[np.ndarray, np.ndarray]:
    """The counted tokens of a chunk, sorted and distinct, and how many of its sets have each."""
    t = np.concatenate([np.zeros(0, np.uint32), *(read_tokens(b, every) for b in blobs)])
    return np.unique(t[is_first(t, every)], return_counts=True)


def token_labels(blobs: pd.Series, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest label of the sets of a chunk that have each of its tokens, in their order."""
    sets = [read_tokens(b, True) for b in blobs]
    t = np.concatenate([np.zeros(0, np.uint32), *sets])
    own = np.repeat(labels, [len(x) for x in sets])
    by = np.argsort(t, kind="stable")
    first = group_bounds(t[by])[:-1]
    if not len(first):
        return own[:0], own[:0]
    return np.minimum.reduceat(own[by], first), np.maximum.reduceat(own[by], first)


def _slices(ranges: int, every: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        values, counts = chunk_tokens(pdf["tokens"], every)
        parts = [values, counts.astype(np.uint32)]
        if every:
            parts += token_labels(pdf["tokens"], pdf["label"].to_numpy(np.int64))
        cuts = np.searchsorted(values, np.arange(1, ranges) * 2.0**32 / ranges)
        rows = zip(*(np.split(x, cuts) for x in parts), strict=True)
        chunk = int(pdf["chunk"].iloc[0])
        out = [(chunk, r, *(x.tobytes() for x in row)) for r, row in enumerate(rows) if len(row[0])]
        return pd.DataFrame(out, columns=["chunk", "range", "tokens", "counts", *(["lo", "hi"] if every else [])])

    return run


def _frequencies(every: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Of one range of tokens: for each chunk, the frequency class of each of its tokens, in their order. 1 where all sets that have it are linked."""
        values = np.frombuffer(b"".join(pdf["tokens"]), dtype=np.uint32)
        counts = np.frombuffer(b"".join(pdf["counts"]), dtype=np.uint32)
        _, at = np.unique(values, return_inverse=True)
        classes = frequency_class(np.bincount(at, weights=counts))
        if every and len(at):
            lo, hi = (np.frombuffer(b"".join(pdf[c]), dtype=np.int64) for c in ("lo", "hi"))
            by = np.argsort(at, kind="stable")
            first = group_bounds(at[by])[:-1]
            classes[np.minimum.reduceat(lo[by], first) == np.maximum.reduceat(hi[by], first)] = 1
        ends = np.cumsum([len(x) // 4 for x in pdf["tokens"]])[:-1]
        return pd.DataFrame({"chunk": pdf["chunk"], "range": pdf["range"], "doc_id": None, "classes": [x.tobytes() for x in np.split(classes[at], ends)]})

    return run


def _index(num: int, den: int, every: bool):
    def run(sets: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        """Entries of the sets of a chunk. told: frequency classes by range; and the documents whose set another one stands for."""
        own = told[told["range"] >= 0].sort_values("range")
        values, classes = chunk_tokens(sets["tokens"], every)[0], np.frombuffer(b"".join(own["classes"]), dtype=np.uint8)
        skip = set(told["doc_id"][told["range"] < 0].astype("int64"))
        sigs, docs, sizes, common = [], [], [], []
        for doc_id, n, blob in zip(sets["doc_id"], sets["n"], sets["tokens"], strict=True):
            if not n or doc_id in skip:
                continue
            skip.add(doc_id)
            t = read_tokens(blob, every)
            kind = np.full(len(t), 255, dtype=np.uint8)
            first = is_first(t, every)
            kind[first] = classes[np.searchsorted(values, t[first])]
            s = signatures(t, kind, int(n), num, den)
            sigs.append(s)
            docs.append(np.full(len(s), doc_id, dtype=np.int64))
            sizes.append(np.full(len(s), n, dtype=np.int64))
            common.append(np.full(len(s), n - (kind == 1).sum(), dtype=np.int64))
        if not sigs:
            return pd.DataFrame({"sig": [], "doc": [], "n": [], "m": []}).astype("int64")
        return pd.DataFrame({"sig": np.concatenate(sigs).view(np.int64), "doc": np.concatenate(docs), "n": np.concatenate(sizes), "m": np.concatenate(common)})

    return run


def _whole_sets(size: int, wanted):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = wanted.value if wanted is not None else None
        chunk, room, docs, sets = TaskContext.get().partitionId() << 32, CHUNK_BYTES, [], []
        for pdf in batches:
            if ids is not None:
                own = pdf["doc_id"].to_numpy(np.int64)
                at = np.minimum(np.searchsorted(ids, own), max(0, len(ids) - 1))
                pdf = pdf[(ids[at] == own) if len(ids) else np.zeros(len(own), bool)]
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                docs.append(doc_id)
                sets.append(shingles(text, size).tobytes())
                room -= len(sets[-1]) + 64
                if room <= 0:
                    yield pd.DataFrame({"doc": docs, "chunk": chunk, "tokens": sets})
                    chunk, room, docs, sets = chunk + 1, CHUNK_BYTES, [], []
        yield pd.DataFrame({"doc": docs, "chunk": chunk, "tokens": sets})

    return run


def _verified(num: int, den: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            shares = np.zeros(len(pdf))
            linked = np.zeros(len(pdf), dtype=bool)
            for k, (x, y) in enumerate(zip(pdf["x"], pdf["y"], strict=True)):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                linked[k] = den * shared >= num * (len(x) + len(y) - shared)
                shares[k] = shared / (len(x) + len(y) - shared)
            yield pdf[["a", "b"]].assign(linked=linked, far=1 - shares)

    return run


def jaccard_groups(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs``: links are den * intersection >= num * union, with num/den at least 0.8."""
    if den * 4 > num * 5 or num > den:
        raise ValueError("the threshold must be from 0.8 to 1")
    spark = docs.sparkSession
    sets = materialise(make_sets(docs, size, num, den), "sets", "uncompressed")
    total = sets.count()
    classes = sets.where("n > 0 AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    classes = materialise(classes, "set-classes")
    usable = sets.where("n > 0 AND doc_id IS NOT NULL")
    standing = join_groups(usable.select("doc_id", "chunk", "digest"), classes, "digest", "copies", total).where("rep <> doc_id")
    active = _shared_entries(usable.select("doc_id", "chunk", "n", "tokens"), standing.select("chunk", "doc_id"), num, den, False)
    labels = _link(docs, active, size, num, den)
    groups = classes.join(labels, classes["rep"] == labels["node"], "left").select("digest", "copies", F.coalesce("label", "rep").alias("component_id"))
    mine = sets.select("doc_id", F.col("n").alias("n_shingles"), "digest")
    linked = join_groups(mine.where("n_shingles > 0 AND doc_id IS NOT NULL"), materialise(groups, "groups"), "digest", "copies", total)
    lone = mine.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.select("doc_id", "n_shingles", "component_id").unionByName(lone)


def _shared_entries(sets: DataFrame, standing: DataFrame | None, num: int, den: int, every: bool) -> DataFrame:
    """sig, doc, n, m (tokens that a set of another label can have), label, e of the index entries in which two sets could link. sets: doc_id, chunk, n, tokens,
    and label in the second index; standing: documents (chunk, doc_id) whose set another one stands for."""
    spark = sets.sparkSession
    stored = sets.agg(F.coalesce(F.sum(F.length("tokens")), F.lit(0))).collect()[0][0]
    ranges = max(shuffle_partitions(spark), -(-int(stored) // (8 if every else 4) // RANGE_TOKENS))
    ends = ("label", ", lo binary, hi binary") if every else ("doc_id", "")
    slices = sets.select("chunk", "tokens", ends[0]).groupBy("chunk").applyInPandas(_slices(ranges, every), f"chunk long, range int, tokens binary, counts binary{ends[1]}")
    told = slices.groupBy("range").applyInPandas(_frequencies(every), "chunk long, range int, doc_id long, classes binary")
    if standing is not None:
        told = told.unionByName(standing.select("chunk", F.lit(-1).alias("range"), "doc_id", F.lit(None).cast("binary").alias("classes")))
    entries = sets.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInPandas(_index(num, den, every), "sig long, doc long, n long, m long")
    # two sets share no more tokens than half of what others can have of both, so they can only link if their e add up to 0 or less
    entries = materialise(entries.withColumn("e", F.col("n") * (2 * num) - F.col("m") * (num + den)), "entries", "zstd")
    if every:
        entries = entries.join(sets.select(F.col("doc_id").alias("doc"), "label"), "doc")
    else:
        entries = entries.withColumn("label", F.col("doc"))
    return _open_entries(entries, num, den)


def _open_entries(rows: DataFrame, num: int, den: int) -> DataFrame:
    """``rows`` (sig, doc, n, m, label, e, ...) of entries in which sets of different labels could link, without those that can't link with any other there.

    Of entries with the same sets (told by 128 bits of hashes of their doc_ids) one stays; of those with more than ALL_PAIRS, entries
    of much the same sets (of one power of two in size and with one least hash) become one with the sets of all.
    """
    total = rows.count()
    met = rows.groupBy("sig").agg(
        F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("e").alias("least"), F.min("n").alias("fewest"), F.count(F.lit(1)).alias("members")
    )
    met = materialise(met.where("lo <> hi AND least <= 0").select("sig", "least", "fewest", "members"), "met", "zstd")
    able = (F.col("e") + F.col("least") <= 0) & (F.col("m") * (num + den) >= (F.col("n") + F.col("fewest")) * num)
    rows = materialise(join_groups(rows, met, "sig", "members", total).where(able).drop("least", "fewest", "members").distinct(), "able", "zstd")
    sets = rows.groupBy("sig").agg(
        F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("members"), F.min(F.xxhash64("doc")).alias("low"),
        F.bit_xor(F.xxhash64("doc")).alias("x"), F.bit_xor(F.xxhash64("doc", F.lit(1))).alias("y"),
    )
    sets = sets.where("lo <> hi").groupBy("members", "low", "x", "y").agg(F.min("sig").alias("sig"))
    alike = F.xxhash64("low", F.floor(F.log2("members")))
    sets = materialise(sets.select("sig", "members", F.when(F.col("members") > ALL_PAIRS, alike).otherwise(F.col("sig")).alias("to")), "entry-sets", "zstd")
    total = rows.count()
    rows = join_groups(rows, sets, "sig", "members", total).drop("sig", "members").withColumnRenamed("to", "sig").distinct()
    rows = materialise(rows, "merged", "zstd")
    sizes = materialise(rows.groupBy("sig").agg(F.count(F.lit(1)).alias("members")), "entry-sizes", "zstd")
    return materialise(join_groups(rows, sizes, "sig", "members", rows.count()), "active", "zstd")


def _relabel(labels: DataFrame, new: DataFrame) -> DataFrame:
    """``labels`` (node, label) after the links ``new`` (a, b): only links between labels go into components again."""
    at = lambda end: labels.select(F.col("node").alias(end), F.col("label").alias(f"l{end}"))
    moved = new.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    found = materialise(connected_components(moved), "moved")
    old = labels.join(found.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    return materialise(old.unionByName(found.join(labels, "node", "left_anti").select("node", "label")), "labels")


def _meetings(active: DataFrame, part: DataFrame, hubs: DataFrame, hubs_at_once: int, num: int, den: int) -> DataFrame:
    """a, b of the sets that a round compares: those of each entry with its hubs, without those that can't link.

    part: ``active`` with the part of its entry; hubs: sig, part, members, hub. After the first round each pair comes once.
    """
    total = active.count()
    # two hubs of an entry meet once, not from both sides
    is_hub, own, ends = F.col("members") <= ALL_PAIRS, part, hubs
    if hubs_at_once > 1:
        # sets that share several entries meet in the first of these only; where neither is a hub there, they stay for the next round
        shared = active.groupBy("doc").agg(F.collect_set("sig").alias("sigs"))
        own = part.join(hubs.select("sig", "part", F.col("hub.doc").alias("own")), ["sig", "part"]).join(shared, "doc")
        is_hub = is_hub | (F.col("doc") == F.col("own"))
        ends = hubs.withColumn("at", F.col("hub.doc")).join(shared.select(F.col("doc").alias("at"), F.col("sigs").alias("hub_sigs")), "at")
    listed = [("sigs",), ("hub_sigs",)] if hubs_at_once > 1 else [(), ()]
    own = own.select("sig", "doc", "n", "m", "e", "label", "far", "by", is_hub.alias("is_hub"), *listed[0])
    ends = ends.select("sig", "members", "hub", *listed[1])
    meet = join_groups(own, ends, "sig", "members", total) if hubs_at_once <= 64 else own.join(ends.drop("members"), "sig")
    meet = meet.where("NOT is_hub OR doc < hub.doc")
    meet = meet.where("label <> hub.label AND e + hub.e <= 0").where(F.least("n", "hub.n") * den >= F.greatest("n", "hub.n") * num)
    # a set shares no more tokens than those that sets of another label can have
    most = F.least("m", "hub.m")
    meet = meet.where(most * den >= (F.col("n") + F.col("hub.n") - most) * num)
    # 1 - Jaccard is a metric: two sets whose distances to the entry's first hub differ by more than a link's can't link;
    # entries that became one had different first hubs
    meet = meet.where(F.coalesce((F.col("by") != F.col("hub.by")) | (F.abs(F.col("far") - F.col("hub.far")) <= 1 - num / den + 1e-9), F.lit(True)))
    if hubs_at_once > 1:
        meet = meet.where("sig = array_min(array_intersect(sigs, hub_sigs))")
    return meet.select(F.least("doc", "hub.doc").alias("a"), F.greatest("doc", "hub.doc").alias("b"))


def _link(docs: DataFrame, active: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """node, label of the sets in ``active`` (sig, doc, n, label) that link with another."""
    spark = docs.sparkSession
    ids = in_bounded_set(active.select("doc"), SENT_IDS)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL")
    if ids is None:
        texts = texts.join(active.select(F.col("doc").alias("doc_id")).distinct(), "doc_id", "left_semi")
    sent = None if ids is None else spark.sparkContext.broadcast(ids)
    whole = texts.mapInPandas(_whole_sets(size, sent), "doc long, chunk long, tokens binary").groupBy("doc").agg(F.min(F.struct("tokens", "chunk")).alias("w"))
    whole = materialise(whole.select("doc", "w.chunk", "w.tokens"), "whole-sets", "uncompressed")
    again = whole.select(F.col("doc").alias("doc_id"), "chunk", (F.length("tokens") / 8).cast("long").alias("n"), "tokens")
    labels = spark.createDataFrame([], "node long, label long")
    tested = None
    # once with every set a label of its own and one hub an entry, then by the labels that this gives and until nothing is left
    for last in (False, True):
        if last:
            kept = active.select("doc", "label").distinct()
            again = again.join(kept, again["doc_id"] == kept["doc"]).drop("doc", "label")
        now = again.join(labels, again["doc_id"] == labels["node"], "left").select("doc_id", "chunk", "n", "tokens", F.coalesce("label", "doc_id").alias("label"))
        active = _shared_entries(now if not last else materialise(now, "open-sets", "uncompressed"), None, num, den, True).withColumns({"far": F.lit(None).cast("double"), "by": F.lit(None).cast("long")})
        hubs_at_once = 1
        while not active.isEmpty():
            part = active.withColumn("part", F.when(F.col("members") <= ALL_PAIRS, F.col("doc")).otherwise(F.pmod(F.xxhash64("doc"), F.lit(hubs_at_once))))
            hubs = part.groupBy("sig", "part", "members").agg(F.min(F.struct("e", "doc", "n", "m", "label", "far", "by")).alias("hub"))
            hubs = materialise(hubs, "hubs", "zstd")
            meet = _meetings(active, part, hubs, hubs_at_once, num, den)
            pairs = materialise(meet.distinct(), "met-pairs", "zstd")
            if tested is not None:
                pairs = materialise(pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti"), "pairs", "zstd")
            x = whole.select(F.col("doc").alias("a"), F.col("tokens").alias("x"))
            y = whole.select(F.col("doc").alias("b"), F.col("tokens").alias("y"))
            found = materialise(pairs.join(y, "b").join(x, "a").select("a", "b", "x", "y").mapInPandas(_verified(num, den), "a long, b long, linked boolean, far double"), "found")
            tested = found if tested is None else materialise(tested.unionByName(found), "tested", "zstd")
            new = found.where("linked").select("a", "b")
            if not new.isEmpty():
                labels = _relabel(labels, new)
            rest = part.join(hubs.drop("members"), ["sig", "part"]).where("doc <> hub.doc")
            if hubs_at_once == 1:
                rest = rest.select("sig", "doc", "n", "m", "e", F.col("hub.doc").alias("by"), F.least("doc", "hub.doc").alias("a"), F.greatest("doc", "hub.doc").alias("b"))
                rest = rest.join(tested.select("a", "b", "far"), ["a", "b"], "left")
            rest = rest.select("sig", "doc", "n", "m", "e", "far", "by")
            rest = rest.join(labels, rest["doc"] == labels["node"], "left").select("sig", "doc", "n", "m", "e", F.coalesce("label", "doc").alias("label"), "far", "by")
            active = _open_entries(materialise(rest, "rest", "zstd"), num, den)
            hubs_at_once *= 8
            if not last:
                break
        if active.isEmpty():
            break
    return labels


def drop_near_copies(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one document, that with the smallest doc_id, of each group; columns as they were.

    Of rows that share a doc_id but not the text, those of the least text digest take part under that id; the others stay, as nothing tells
    which of them another document is a copy of.
    """
    told = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("__doc"), text_digest().alias("__digest"))
    texts = told.groupBy("__doc").agg(F.min("__digest").alias("__digest"), F.max("__digest").alias("__other")).where("__digest <> __other").drop("__other")
    texts = materialise(texts, "repeated-ids")
    same_id = docs["doc_id"].cast("long") == texts["__doc"]
    named = docs if texts.isEmpty() else docs.join(texts, same_id & (text_digest() != texts["__digest"]), "left_anti")
    gone = jaccard_groups(named, size, num, den).where("component_id <> doc_id").select(F.col("doc_id").alias("__dropped")).distinct()
    gone = gone.join(texts, gone["__dropped"] == texts["__doc"], "left").select("__dropped", "__digest")
    same = (docs["doc_id"].cast("long") == gone["__dropped"]) & F.coalesce(text_digest() == gone["__digest"], F.lit(True))
    return docs.join(gone, same, "left_anti")
