"""Importance resampling of documents towards a target distribution of hashed word n-grams.

Method. Features are all runs of one and two consecutive words of a text; a feature's bucket is the CRC-32 of its bytes modulo
BUCKETS. First pass: every partition counts its features with ``np.bincount`` into one vector of BUCKETS longs, and ``treeReduce``
merges these vectors, so the driver receives one vector a corpus. From the vectors of the documents and of the target texts come
the gains of the buckets. Second pass: the gains, BUCKETS longs, are broadcast; a batch of documents gathers the gain of each
feature and sums them a document by ``np.bincount`` with the gains as weights. A document's score is its mean gain plus Gumbel
noise drawn from a hash of its id, and the highest scores are drawn, which samples without replacement by weight.

Scale. Texts are read twice and never shuffled. Ranks are global without a global sort in one task: scored rows (no texts) are
dealt by ranges of (score, doc_id), numbered within their partition, and shifted by the sizes of the partitions before.

Defined cases. Null and empty texts have no feature: weight 0, and too few words to be drawn. A null doc_id is hashed as an empty
one and goes last among ties. Rows that repeat are documents of their own; equal ones take ranks next to each other. Very long
texts are hashed in slices of SLICE bytes that carry the last word on. An empty table gives an empty result, empty targets the
gains of zero counts. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import accumulate
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, shuffle_partitions

BUCKETS = 10_000
#: A document needs so many words to be drawn.
LEAST_WORDS = 20
#: Bytes of a text that are cut into words at once.
SLICE = 1 << 20
#: Features whose gains are gathered at once.
GATHERED = 1_000_000
#: Bytes that are part of words keep their place, A to Z are lower-cased, and all others become spaces.
TO_WORDS = bytes(b if b >= 128 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))
SCORED = "doc_id long, n_features long, n_words long, weight long, score long"


def word_slices(text: bytes) -> Iterator[list[bytes]]:
    """The lower-cased words of a text, in slices that end between words."""
    text, at = text.translate(TO_WORDS), 0
    while at < len(text):
        end = text.find(b" ", at + SLICE)
        yield text[at : end if end >= 0 else len(text)].split()
        at = end if end >= 0 else len(text)


def bucket_slices(text: bytes | None) -> Iterator[tuple[np.ndarray, int]]:
    """The buckets of the one- and two-word features of a text, repeats included, and the number of words, slice by slice."""
    last = None
    for words in word_slices(text or b""):
        ones = [*map(crc32, words)]
        before = ones[:-1] if last is None else [last, *ones[:-1]]
        twos = [*map(crc32, [b" " + w for w in (words[1:] if last is None else words)], before)]  # the CRC of the word before goes on
        last = ones[-1] if ones else last
        yield (np.array(ones + twos, dtype=np.int64) % BUCKETS).astype(np.int16), len(words)


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column("text").cast(pa.large_binary()).to_pylist()


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for text in _texts(batch):
                for buckets, _ in bucket_slices(text):
                    total += np.bincount(buckets, minlength=BUCKETS)
        yield pa.RecordBatch.from_pydict({"counts": [total.tobytes()]})

    parts = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "counts binary").rdd
    if not parts.getNumPartitions():
        return np.zeros(BUCKETS, dtype=np.int64)
    return parts.map(lambda r: np.frombuffer(r[0], dtype=np.int64)).treeReduce(np.add)


def gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln(share of the bucket in the target / share in the corpus)), both smoothed by one a bucket."""
    s, t, all_s, all_t = own.astype(float) + 1, target.astype(float) + 1, float(own.sum()) + BUCKETS, float(target.sum()) + BUCKETS
    return np.array([math.floor(1000 * math.log(a * all_s / (b * all_t))) for a, b in zip(t, s, strict=True)], dtype=np.int64)


def score(docs: DataFrame, gain: np.ndarray, seed: int) -> DataFrame:
    """doc_id, n_features, n_words, weight, score of every row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            sizes, words, total = (np.zeros(n, dtype=np.int64) for _ in range(3))
            held: list[tuple[int, np.ndarray]] = []

            def gather() -> None:
                if held:
                    owner = np.repeat([k for k, _ in held], [len(b) for _, b in held])
                    weights = sent.value[np.concatenate([b for _, b in held])]
                    total[:] += np.bincount(owner, weights=weights, minlength=n).astype(np.int64)  # whole numbers below 2^53
                    held.clear()

            for k, text in enumerate(_texts(batch)):
                for buckets, count in bucket_slices(text):
                    held.append((k, buckets))
                    sizes[k] += len(buckets)
                    words[k] += count
                if sizes[held[0][0] if held else k : k + 1].sum() > GATHERED:
                    gather()
            gather()
            weight = total // np.maximum(sizes, 1)
            ids = batch.column("doc_id").to_pylist()
            draws = (int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16) for i in ids)
            noise = np.array([math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))) for h in draws], dtype=np.int64)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "n_features": sizes, "n_words": words, "weight": weight, "score": weight + noise,
            })

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCORED)


def ranked(rows: DataFrame, percent: int) -> DataFrame:
    """``rows`` with rank: 1, 2, ... by score from the top for the first ``percent`` of them, null for the others."""
    spark = rows.sparkSession
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight")]
    dealt = rows.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    placed = materialise(dealt.withColumn("place", F.monotonically_increasing_id()), "resample-placed")
    part, row = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()  # one row a partition
    *before, eligible = accumulate((r["n"] for r in sizes), initial=0)
    draw = percent * eligible // 100
    shift = spark.createDataFrame([(r["part"], b) for r, b in zip(sizes, before, strict=True)], "part long, before long")
    rank = F.col("before") + row + 1
    joined = placed.withColumn("part", part).join(F.broadcast(shift), "part")
    return joined.withColumn("rank", F.when(rank <= draw, rank)).drop("part", "place", "before")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, seed: int = 7) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; rank is null for those that aren't drawn.

    target: texts whose distribution is sought. Drawn are ``percent`` of the documents with LEAST_WORDS words or more.
    """
    gain = gains(bucket_counts(docs), bucket_counts(target))
    rows = materialise(score(docs, gain, seed), "resample-scored")
    drawn = ranked(rows.where(F.col("n_words") >= LEAST_WORDS), percent)
    others = rows.where(F.col("n_words") < LEAST_WORDS).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(others).select("doc_id", "n_features", "weight", "score", "rank")
