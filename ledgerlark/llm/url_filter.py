"""URL block and allow rules by a cascade of Bloom filters, exact over the corpus's own keys and without a join.

Method. A url's candidate keys are its host's suffixes at label borders, each followed by the prefixes of its path whose
length some rule has; the key of a rule is its text, like ``net/``. The universe is the distinct keys of all urls. Level 1
of a cascade encodes the listed keys; level 2 the keys of the universe that level 1 wrongly accepts; level 3 the listed
keys that level 2 wrongly accepts, and so on until nothing is wrongly accepted. A key of the universe is listed if the
first level that rejects it is an even one, counted from 1. So membership is exact for every key the corpus can ask for.
One cascade holds the rules that block, one those that allow; of the keys that either has, the longest is the url's rule.

Scale. Keys are dealt to shards by hash; each shard of the universe builds its own cascades, so no task sees more than about
SHARD_KEYS keys. Level 1 takes a false-positive rate that makes what it wrongly accepts about as many as the listed keys,
so a cascade's size follows the lists, not the corpus. Cascades are sent to the workers only up to FILTER_MB in all; larger
sets of them are sent and applied in several passes over the urls, FILTER_MB each.

Defined cases. Null urls and urls without ``://`` have an empty host and path and no rule. A url that no rule fits is
allowed. Repeated rows are judged one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

SHARD_KEYS = 1_000_000
FILTER_MB = 64


class Bloom:
    """A Bloom filter of texts; bits in one bytes object."""

    def __init__(self, bits: bytes, hashes: int, seed: int):
        self.bits, self.hashes, self.seed = bits, hashes, seed

    @classmethod
    def of(cls, keys: Iterable[str], rate: float, seed: int) -> Bloom:
        keys = list(keys)
        size = max(64, math.ceil(-len(keys) * math.log(rate) / math.log(2) ** 2 / 8) * 8)
        bits, hashes = bytearray(size // 8), max(1, round(-math.log2(rate)))
        for key in keys:
            for at in cls._places(key, hashes, seed, size):
                bits[at >> 3] |= 1 << (at & 7)
        return cls(bytes(bits), hashes, seed)

    @staticmethod
    def _places(key: str, hashes: int, seed: int, size: int) -> Iterator[int]:
        h = xxhash.xxh3_128_intdigest(key, seed=seed)
        a, b = h & 0xFFFFFFFFFFFFFFFF, (h >> 64) | 1
        return ((a + i * b) % size for i in range(hashes))

    def __contains__(self, key: str) -> bool:
        return all(self.bits[at >> 3] >> (at & 7) & 1 for at in self._places(key, self.hashes, self.seed, 8 * len(self.bits)))


def build_cascade(listed: set[str], others: set[str]) -> list[Bloom]:
    """Levels that tell ``listed`` from ``others`` exactly."""
    levels: list[Bloom] = []
    inside, outside = listed, others
    while inside:
        rate = 0.5 if levels else min(0.5, max(1e-6, math.sqrt(0.5) * len(listed) / max(1, len(others))))
        levels.append(Bloom.of(inside, rate, len(levels) + 1))
        inside, outside = {x for x in outside if x in levels[-1]}, inside
    return levels


def is_listed(key: str, levels: list[Bloom]) -> bool:
    for k, level in enumerate(levels):
        if key not in level:
            return k % 2 == 1
    return len(levels) % 2 == 1


def candidate_keys(host: str, path: str, lengths: list[int]) -> list[str]:
    """The keys a url can be listed under, longest first."""
    labels = host.split(".")
    hosts = [".".join(labels[k:]) for k in range(len(labels))]
    return sorted({h + path[:n] for h in hosts if h for n in lengths if n <= len(path)}, key=lambda k: (-len(k), k))


def shard_of(key: str, shards: int) -> int:
    return xxhash.xxh3_64_intdigest(key, seed=77) % shards


def url_host(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def filter_urls(pages: DataFrame, block: list[tuple[str, str]], allow: list[tuple[str, str]]) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages`` (page_id, url).

    block, allow: rules as (host, path). A rule in both blocks.
    """
    spark = pages.sparkSession
    urls = pages.select(F.col("page_id"), url_host(F.col("url").cast("string")).alias("host"), url_path(F.col("url").cast("string")).alias("path"))
    lists = [{h + p for h, p in block}, {h + p for h, p in allow} - {h + p for h, p in block}]
    lengths = sorted({len(p) for _, p in [*block, *allow]})

    def keys_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pairs = set(zip(pdf["host"], pdf["path"], strict=True))
            yield pd.DataFrame({"key": sorted({k for h, p in pairs for k in candidate_keys(h, p, lengths)})})

    keys = materialise(urls.select("host", "path").mapInPandas(keys_of, "key string").distinct(), "url-keys")
    shards = max(1, -(-keys.count() // SHARD_KEYS))

    def cascades(batch: pd.DataFrame) -> pd.DataFrame:
        shard, universe, rows = int(batch["shard"].iloc[0]), set(batch["key"]), []
        for which, listed in enumerate(lists):
            mine = {k for k in listed if shard_of(k, shards) == shard}
            rows += [(shard, which, n, x.hashes, x.seed, x.bits) for n, x in enumerate(build_cascade(mine, universe - mine))]
        return pd.DataFrame(rows, columns=["shard", "which", "level", "hashes", "seed", "bits"])

    def numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(shard=[shard_of(k, shards) for k in pdf["key"]])

    kind = "shard int, which int, level int, hashes int, seed int, bits binary"
    filters = materialise(keys.mapInPandas(numbered, "key string, shard int").groupBy("shard").applyInPandas(cascades, kind), "cascades")
    sizes = filters.groupBy("shard").agg(F.sum(F.length("bits")).alias("n")).orderBy("shard").toLocalIterator()
    passes: list[list[int]] = [[]]
    room = FILTER_MB << 20
    for row in sizes:
        if row["n"] > room and passes[-1]:
            passes.append([])
            room = FILTER_MB << 20
        passes[-1].append(row["shard"])
        room -= row["n"]
    hits = urls.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit("allow")})
    for some in passes:
        levels: dict[tuple[int, int], list[Bloom]] = {}
        for x in filters.where(F.col("shard").isin(some)).orderBy("shard", "which", "level").collect() if some else []:
            levels.setdefault((x["shard"], x["which"]), []).append(Bloom(bytes(x["bits"]), x["hashes"], x["seed"]))
        sent = spark.sparkContext.broadcast(levels)
        hits = hits.mapInPandas(_judge(sent, shards, set(some), lengths), hits.schema)
    return hits


def _judge(sent, shards: int, mine: set[int], lengths: list[int]):
    """A pass: the longest of a url's keys that a cascade of these shards holds, if longer than the rule found so far."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        levels, known = sent.value, {}
        for pdf in batches:
            rules, verdicts = pdf["rule"].tolist(), pdf["verdict"].tolist()
            for i, (host, path) in enumerate(zip(pdf["host"], pdf["path"], strict=True)):
                for key in candidate_keys(host, path, lengths):
                    if rules[i] is not None and len(key) <= len(rules[i]):
                        break
                    if key not in known:
                        if len(known) > 500_000:
                            known.clear()
                        shard = shard_of(key, shards)
                        known[key] = next((w for w in (0, 1) if shard in mine and is_listed(key, levels.get((shard, w), []))), None)
                    if known[key] is not None:
                        rules[i], verdicts[i] = key, ("block", "allow")[known[key]]
                        break
            yield pdf.assign(rule=pd.Series(rules, dtype=object, index=pdf.index), verdict=verdicts)

    return run
