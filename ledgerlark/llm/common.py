"""Helpers shared by the training-data operators.

Intermediate results that are used more than once are written as Parquet into the folder named by
``spark.checkpoint.dir`` (see :func:`materialise`), so that a lost executor costs a re-read and never a wrong answer.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: At most this many keys can hold more than 1/HEAVY_KEYS of the rows, so a table of them has a proven size bound.
HEAVY_KEYS = 256
#: At most this many ids are sent to every task (16 MB); beyond it, rows are not filtered ahead of the join.
SENT_IDS = 2_000_000

#: Bytes of an Arrow batch between the JVM and a Python worker, where :func:`bound_batches` holds.
BATCH_BYTES = 4 << 20

M64 = np.uint64(0xFFFFFFFFFFFFFFFF)


@cache
def local_scratch() -> str:
    return "file://" + tempfile.mkdtemp(prefix="ledgerlark-")


def scratch_dir(spark: SparkSession) -> str:
    """The shared scratch folder: ``spark.checkpoint.dir``. Where that is unset a local one is made, in local mode only (tests)."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not set_dir:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        set_dir = local_scratch()
    return f"{set_dir.rstrip('/')}/ledgerlark-{spark.sparkContext.applicationId}"


def materialise(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` once to the shared scratch folder and return a DataFrame that reads it back.

    Retried tasks commit one attempt only, so values that depend on the task (such as its number) are stable after it.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of queries that nothing refers to any more; by itself it waits for a full driver heap.

    Spark still refers to the last query, so a small one goes before.
    """
    spark.range(1).collect()
    spark.sparkContext._jvm.System.gc()


def clean_scratch(spark: SparkSession) -> None:
    """Delete this application's scratch tables. Results that still read them must have been written before."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bound_batches(spark: SparkSession) -> None:
    """From now on batches of this session hold about BATCH_BYTES at most, however long texts and sets are; a smaller setting stays.

    Spark's own bounds (10,000 rows, 64 MB or more) let a batch of texts take several times its bytes on both sides, and
    neither the JVM nor a worker that is used again gives these back.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def map_whole_groups(
    df: DataFrame, keys: list[str], fn: Callable[[pd.DataFrame], pd.DataFrame | Iterator[pd.DataFrame]], schema: str, order: list[str] | None = None
) -> DataFrame:
    """Run ``fn`` (which returns a frame or yields several) on frames that hold only whole groups of ``keys``, many groups a call.

    Rows are hash-partitioned and sorted by the keys (then ``order``); Spark spills that sort. A worker holds one Arrow batch
    and the group that crosses its end, so use it only for groups whose size is bounded (pairs of documents, one document).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            if not len(pdf):
                continue
            last = pdf[keys].iloc[-1].tolist()
            same = np.ones(len(pdf), dtype=bool)
            for k, v in zip(keys, last, strict=True):
                same &= (pdf[k] == v).to_numpy()
            if same.all() and (not held or held[-1][keys].iloc[-1].tolist() == last):
                held.append(pdf)
                continue
            yield from frames(fn(pd.concat([*held, pdf[~same]], ignore_index=True)))
            held = [pdf[same]]
        if held:
            yield from frames(fn(pd.concat(held, ignore_index=True)))

    def frames(made: pd.DataFrame | Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return iter([made]) if isinstance(made, pd.DataFrame) else made

    return df.repartition(*keys).sortWithinPartitions(*keys, *(order or [])).mapInPandas(run, schema)


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit mix (xor-shift-multiply) of an uint64 array."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def group_bounds(*cols: np.ndarray) -> np.ndarray:
    """Starts of runs of equal key tuples in sorted arrays, with the length appended."""
    n = len(cols[0])
    if not n:
        return np.zeros(1, dtype=np.int64)
    change = np.zeros(n, dtype=bool)
    change[0] = True
    for c in cols:
        change[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(change), n)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column_or_null(df: DataFrame, name: str, kind: str):
    """The named column as ``kind``; a typed null where the frame has none."""
    return F.col(f"`{name}`").cast(kind) if name in df.columns else F.lit(None).cast(kind)


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """``rows`` joined with their group (inner); groups has the number of rows of each key in ``size``.

    Keys with more than 1/HEAVY_KEYS of ``total`` rows, HEAVY_KEYS at most, are broadcast; the others are shuffled.
    """
    is_heavy = F.col(size) * HEAVY_KEYS > F.lit(total)
    heavy = [r[0] for r in groups.where(is_heavy).select(key).distinct().collect()]
    if not heavy:
        return rows.join(groups, key)
    hot = rows.where(F.col(key).isin(heavy)).join(F.broadcast(groups.where(is_heavy)), key)
    cold = rows.where(~F.col(key).isin(heavy)).join(groups.where(~is_heavy), key)
    return hot.unionByName(cold.select(*hot.columns))


def in_bounded_set(ids: DataFrame, most: int) -> np.ndarray | None:
    """The sorted distinct longs of a one-column frame if there are at most ``most``, else None."""
    got = ids.distinct().limit(most + 1).toPandas().iloc[:, 0].to_numpy(np.int64)
    return np.sort(got) if len(got) <= most else None


def only_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose doc_id is among ``ids`` (one column), or null, ahead of a join with these; all rows if they are too many to send."""
    few = in_bounded_set(ids.where(F.col(ids.columns[0]).isNotNull()), SENT_IDS)
    if few is None:
        return rows
    sent = rows.sparkSession.sparkContext.broadcast(few)

    @F.pandas_udf("boolean")
    def member(own: pd.Series) -> pd.Series:
        own = own.to_numpy(np.int64)
        at = np.minimum(np.searchsorted(sent.value, own), max(0, len(sent.value) - 1))
        return pd.Series(sent.value[at] == own if len(sent.value) else np.zeros(len(own), dtype=bool))

    return rows.where(member(F.coalesce("doc_id", F.lit(-(2**63)))) | F.col("doc_id").isNull())
