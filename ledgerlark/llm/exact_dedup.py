"""Exact deduplication with a sharded minimal perfect hash over the digests already seen.

Method. Every text is reduced to its SHA-256 digest. The digests of the *history* are grouped (map-side combined) and dealt
to shards by hash; in each shard a minimal perfect hash maps its n distinct digests one-to-one onto n slots. A slot holds
the full 32-byte digest, the locator of the group's winner (its largest doc_id) and the group's size. A lookup computes
the slot and then compares all 32 bytes, so a digest that is not in the history is never taken for one that is. Digests
of new rows are pre-aggregated, looked up, and merged into the slot they hit; those that miss are grouped on their own.
Last, every row is looked up in the index over all groups and learns whether it is the one that stays.

Scale. Only (doc_id, digest) rows move, never texts. Groups are combined before the shuffle, so a text that fills a third of
the table is one row per task there. Row lookups of the few digests with more than 1/HEAVY_KEYS of all rows (at most
HEAVY_KEYS of them, whatever the size of the data) go through a broadcast; the others are dealt by shard.

Defined cases. Null text counts as the empty text. Rows that repeat both doc_id and text count one by one in :func:`exact_groups`, and one of
them stays in :func:`drop_exact_copies`. A null doc_id loses to any other. An empty table gives an empty result. Extra columns are ignored by :func:`exact_groups` and
kept by :func:`drop_exact_copies`.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HEAVY_KEYS, materialise, mix64, shuffle_partitions

#: Distinct digests a shard is planned for.
SHARD_DIGESTS = 16384
#: Bits a key of a level of the hash has.
GAMMA = 2.0

INDEX = "shard int, levels binary, sizes array<int>, digests binary, winners binary, counts binary"
GROUPS = "digest binary, keep_id long, group_size long"


def perfect_hash(keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Levels of bits and each key's slot, 0..n-1. keys: distinct (n, 2) uint64.

    Each level sets the bits that exactly one remaining key hashes to; keys that collide go to the next level. A key's slot
    is the rank of its bit.
    """
    levels: list[np.ndarray] = []
    slots = np.zeros(len(keys), dtype=np.int64)
    left, base = np.arange(len(keys)), 0
    while len(left):
        size = max(8, int(GAMMA * len(left)))
        at = bit_of(keys[left], len(levels), size)
        alone = np.bincount(at, minlength=size) == 1
        levels.append(alone)
        rank = np.cumsum(alone) - 1
        mine = alone[at]
        slots[left[mine]] = base + rank[at[mine]]
        base += int(alone.sum())
        left = left[~mine]
    return levels, slots


def bit_of(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix64(keys[:, 0] ^ mix64(keys[:, 1], level + 1), level) % np.uint64(size)).astype(np.int64)


def slot_of(keys: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """The slot each key would have; -1 where no level has its bit."""
    out = np.full(len(keys), -1, dtype=np.int64)
    left, base = np.arange(len(keys)), 0
    for k, bits in enumerate(levels):
        at = bit_of(keys[left], k, len(bits))
        hit = bits[at]
        rank = np.cumsum(bits) - 1
        out[left[hit]] = base + rank[at[hit]]
        left, base = left[~hit], base + int(bits.sum())
    return out


def digest_rows(digests: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(digests), dtype=np.uint8).reshape(-1, 32)


def key_pairs(rows: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(rows[:, 8:24]).view(np.uint64).reshape(-1, 2)


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    rows = digest_rows(pdf["digest"])
    levels, slots = perfect_hash(key_pairs(rows))
    place = np.empty_like(slots)
    place[slots] = np.arange(len(slots))
    packed = np.packbits(np.concatenate(levels)) if levels else np.zeros(0, np.uint8)
    winners = pdf["keep_id"].fillna(NO_ID).to_numpy(np.int64)
    return pd.DataFrame({
        "shard": [int(pdf["shard"].iloc[0])], "levels": [packed.tobytes()], "sizes": [[len(x) for x in levels]],
        "digests": [rows[place].tobytes()], "winners": [winners[place].tobytes()],
        "counts": [pdf["group_size"].to_numpy(np.int64)[place].tobytes()],
    })


#: Stands for a null doc_id in a slot.
NO_ID = -(2**63)


class Shard:
    """A shard of the index, as read back."""

    def __init__(self, row: pd.Series):
        bits = np.unpackbits(np.frombuffer(row["levels"], dtype=np.uint8)).astype(bool)
        ends = np.cumsum([0, *row["sizes"]])
        self.levels = [bits[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        self.digests = np.frombuffer(row["digests"], dtype=np.uint8).reshape(-1, 32)
        self.winners = np.frombuffer(row["winners"], dtype=np.int64)
        self.counts = np.frombuffer(row["counts"], dtype=np.int64)

    def find(self, rows: np.ndarray) -> np.ndarray:
        """Slots of the digests that are members, byte for byte; -1 for the others."""
        slots = slot_of(key_pairs(rows), self.levels)
        at = np.flatnonzero(slots >= 0)
        same = (self.digests[slots[at]] == rows[at]).all(axis=1)
        slots[at[~same]] = -1
        return slots


def _ids(values: np.ndarray) -> pd.Series:
    return pd.Series(values, dtype="Int64").mask(values == NO_ID)


def _merge(new: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    """Groups of new rows met with a shard: hits are merged with their slot, misses and untouched slots stay as they are."""
    rows = digest_rows(new["digest"])
    keep, size = new["keep_id"].fillna(NO_ID).to_numpy(np.int64).copy(), new["group_size"].to_numpy(np.int64).copy()
    digests = list(new["digest"])
    if len(index):
        shard = Shard(index.iloc[0])
        slots = shard.find(rows)
        hit = slots >= 0
        keep[hit] = np.maximum(keep[hit], shard.winners[slots[hit]])
        size[hit] += shard.counts[slots[hit]]
        rest = np.ones(len(shard.digests), dtype=bool)
        rest[slots[hit]] = False
        digests += [x.tobytes() for x in shard.digests[rest]]
        keep, size = np.concatenate([keep, shard.winners[rest]]), np.concatenate([size, shard.counts[rest]])
    return pd.DataFrame({"digest": digests, "keep_id": _ids(keep), "group_size": size})


def _look_up(rows: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    """Each row's winner and group size by its slot. Rows whose digest is no member are left out."""
    if not len(rows) or not len(index):
        return pd.DataFrame({"doc_id": [], "digest": [], "keep_id": [], "group_size": []})
    shard = Shard(index.iloc[0])
    slots = shard.find(digest_rows(rows["digest"]))
    hit = slots >= 0
    return pd.DataFrame({"doc_id": rows["doc_id"][hit].astype("Int64").to_numpy(), "digest": rows["digest"][hit].to_numpy(),
                         "keep_id": _ids(shard.winners[slots[hit]]).to_numpy(), "group_size": shard.counts[slots[hit]]})


def text_digest() -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256))


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int")


def _groups(fingerprints: DataFrame) -> DataFrame:
    return fingerprints.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


def build_index(groups: DataFrame, shards: int) -> DataFrame:
    """The index of ``groups`` (digest, keep_id, group_size): one row for each shard, see INDEX. It can be stored as a table."""
    return groups.withColumn("shard", _shard(shards)).groupBy("shard").applyInPandas(_build, INDEX)


def merge_with_index(groups: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """``groups`` of new rows merged with what the index holds."""
    new = groups.withColumn("shard", _shard(shards)).groupBy("shard")
    return new.cogroup(index.groupBy("shard")).applyInPandas(_merge, GROUPS)


def look_up(fingerprints: DataFrame, groups: DataFrame, shards: int, total: int) -> DataFrame:
    """doc_id, digest, keep_id, group_size of every row of ``fingerprints`` that is a member."""
    heavy = F.broadcast(groups.where(F.col("group_size") * HEAVY_KEYS > F.lit(total)))
    hot = fingerprints.join(heavy, "digest").select("doc_id", "digest", "keep_id", "group_size")
    light = fingerprints.join(heavy.select("digest"), "digest", "left_anti").withColumn("shard", _shard(shards))
    index = materialise(build_index(groups, shards), "mph-index")
    cold = light.groupBy("shard").cogroup(index.groupBy("shard")).applyInPandas(_look_up, f"doc_id long, {GROUPS}")
    return hot.unionByName(cold)


def exact_groups(docs: DataFrame, history: Column | None = None) -> DataFrame:
    """doc_id, digest, keep_id, group_size, kept of every document.

    history: which rows of ``docs`` count as seen before (a boolean column on doc_id); default: half of them, by a hash of
    doc_id. The result doesn't depend on it, only the path does.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_digest().alias("digest"))
    seen = F.coalesce(history if history is not None else F.xxhash64("doc_id") < 0, F.lit(False))
    rows = materialise(rows.withColumn("seen", seen), "digests")
    total = rows.count()
    shards = max(shuffle_partitions(spark), -(-total // SHARD_DIGESTS))
    index = build_index(_groups(rows.where("seen")), shards)
    groups = materialise(merge_with_index(_groups(rows.where("NOT seen")), index, shards), "digest-groups")
    out = look_up(rows.drop("seen"), groups, shards, total)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without the documents whose text another document with a larger doc_id has; columns as they were.

    Of rows that repeat both doc_id and text one stays; texts are shuffled for that only where such rows exist.
    """
    groups = materialise(exact_groups(docs), "exact-groups")
    winners = groups.where("kept").select("doc_id", "digest")
    if winners.count() > winners.distinct().count():
        docs = docs.dropDuplicates(["doc_id", "text"])
    dropped = groups.where("NOT kept").select(F.col("doc_id").alias("__dropped"), F.col("digest").alias("__digest"))
    same = docs["doc_id"].cast("long").eqNullSafe(dropped["__dropped"]) & (text_digest() == dropped["__digest"])  # an id may repeat with another text
    return docs.join(dropped, same, "left_anti")
