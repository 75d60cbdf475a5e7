"""A stored trigram index for substring search: a term reads the postings of its rarest trigrams and the texts these point to.

Parquet tables in one folder: ``postings`` (field, gram, block, base, offs: which rows of a block of neighbouring rows have the
gram, as distances of their keys from ``base``), in directories by a hash of the gram and sorted by it; ``grams`` (field, gram, n);
and, where a copy is wanted, ``texts``, the rows themselves in directories by slices of the key: candidates are joined to them by slice
and key, so directories without a candidate aren't read. Without a copy (large texts) candidates are joined to the table itself.
Fields are any text columns: as it is in lower case, folded, by its phonetic key.

A task turns the texts it reads into the postings of whole blocks, so no (gram, row) pair is shuffled, only finished lists. A frequent gram is many
posting rows, never a large one. Texts of one or two characters are their own gram. Keys are unique longs, not null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

GRAM, SLICES, BUCKETS = 3, 256, 32
#: Pairs of gram and row that a block gathers at most, but for its last row; rows of a block, at most.
PAIRS, BLOCK_ROWS = 1_000_000, 4096
#: So many of a term's rarest grams are intersected.
RARE = 3
POSTINGS = "field string, gram string, block long, base long, offs array<int>"


def codes_of(text: str) -> np.ndarray:
    """Distinct trigrams of a text, three code points in a number; a shorter text as one."""
    c = np.frombuffer(text[:GRAM].ljust(GRAM, "\0").encode("utf-32-le") if len(text) < GRAM else text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    return np.unique(c[:-2] << 42 | c[1:-1] << 21 | c[2:])


def texts_of(codes: np.ndarray) -> pa.Array:
    """Trigrams as texts; NUL characters at their end are lost, as they are in what is looked up."""
    points = np.stack([codes >> 42, codes >> 21 & 0x1FFFFF, codes & 0x1FFFFF], axis=1).astype("<u4")
    return pa.array(np.ascontiguousarray(points).view("<U3")[:, 0].tolist(), pa.string())


def _post(key: str, fields: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, base, rows = TaskContext.get().partitionId() << 32, None, 0
        held: dict[str, list[tuple[int, np.ndarray]]] = {f: [] for f in fields}

        def lists() -> Iterator[pa.RecordBatch]:
            for field, own in held.items():
                if own:
                    codes, offs = np.concatenate([c for _, c in own]), np.repeat([o for o, _ in own], [len(c) for _, c in own]).astype(np.int32)
                    order = np.argsort(codes, kind="stable")
                    codes, offs = codes[order], offs[order]
                    starts = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
                    n = len(starts)
                    columns = [[field] * n, texts_of(codes[starts]), np.full(n, block), np.full(n, base), pa.ListArray.from_arrays(pa.array(np.append(starts, len(codes)), pa.int32()), pa.array(offs))]
                    yield pa.RecordBatch.from_arrays([pa.array(c) if not isinstance(c, pa.Array) else c for c in columns], ["field", "gram", "block", "base", "offs"])
                    own.clear()

        for batch in batches:
            texts = [batch.column(f).to_pylist() for f in fields]
            for n, k in enumerate(batch.column(key).to_pylist()):
                if base is not None and (rows == BLOCK_ROWS or abs(k - base) >= 2**31 or pairs > PAIRS):
                    yield from lists()
                    block, base = block + 1, None
                if base is None:
                    base, rows, pairs = k, 0, 0
                rows += 1
                for f, own in zip(fields, texts, strict=True):
                    if own[n]:
                        codes = codes_of(own[n])
                        held[f].append((k - base, codes))
                        pairs += len(codes)
        if base is not None:
            yield from lists()

    return run


def grams_of(text: Column) -> Column:
    """Distinct trigrams of a text; a shorter text itself; none of an empty or null one."""
    n = F.length(text)
    parts = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1))  # a look-ahead at every place, in one pass
    parts = F.transform(parts, lambda g: F.regexp_replace(g, "\\x00+$", ""))
    return F.when(n >= GRAM, F.array_distinct(parts)).when(n > 0, F.array(text)).otherwise(F.array().cast("array<string>"))


def bucket(field: Column, gram: Column) -> Column:
    return F.pmod(F.xxhash64(field, gram), F.lit(BUCKETS)).cast("int")


def _runs(text: Column, size: int) -> Column:
    """All runs of ``size`` characters of a text."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - (size - 1), F.lit(1))), lambda i: F.substring(text, i, size))


def needle_grams(needle: str) -> tuple[list[str], list[str]]:
    """(trigrams of the literal runs of a pattern with % and _, shorter runs where there is no trigram)."""
    runs = [r for r in re.split("[%_]", needle) if r]
    found = {r[k : k + GRAM].rstrip("\0") for r in runs for k in range(len(r) - GRAM + 1)} - {""}
    return sorted(found), [] if found else runs


@dataclass
class TextIndex:
    """key: the key column of ``texts``; slices: rows of the key a directory of the texts holds, 0 if they are no copy."""

    texts: DataFrame
    postings: DataFrame
    grams: DataFrame
    key: str
    slices: int

    def _ids(self, found: DataFrame, by: list[str]) -> DataFrame:
        """Keys in all lists of a block (by, block, base, need, offs): RARE lists of at most BLOCK_ROWS places."""
        lists = found.groupBy(*by, "block", "base").agg(F.collect_list("offs").alias("lists"), F.max("need").alias("need")).where(F.size("lists") == F.col("need"))
        both = F.aggregate(F.slice("lists", F.lit(2), F.size("lists")), F.element_at("lists", 1), lambda a, b: F.array_intersect(a, b))
        return lists.select(*by, "base", F.explode(both).alias("off")).select(*by, (F.col("base") + F.col("off")).alias(self.key))

    def _all_ids(self, found: DataFrame, by: list[str]) -> DataFrame:
        return found.select(*by, "base", F.explode("offs").alias("off")).select(*by, (F.col("base") + F.col("off")).alias(self.key)).distinct()

    def candidates(self, field: str, needle: str) -> DataFrame:
        """Keys of the rows whose field may hold the needle (a pattern with % and _ as wildcards); no row that holds it is missing."""
        grams, short = needle_grams(needle)
        own = F.col("field") == field
        if grams:
            known = {r["gram"]: r["n"] for r in self.grams.where(own & F.col("gram").isin(grams)).collect()}  # at most the term's length
            rare = sorted(grams, key=lambda g: (known.get(g, 0), g))[:RARE]
            own_bucket = reduce(lambda a, b: a | b, [F.col("bucket") == bucket(F.lit(field), F.lit(g)) for g in rare])  # constants: other directories aren't read
            rows = self.postings.where(own_bucket & own & F.col("gram").isin(rare) & F.lit(len(known) == len(grams)))
            return self._ids(rows.withColumn("need", F.lit(len(rare))), [])
        if short:  # every character of a text is in one of its grams
            holds = self.grams.where(own & F.col("gram").contains(max(short, key=len))).select("field", "gram")
            return self._all_ids(self.postings.join(holds, ["field", "gram"]), [])
        return self.texts.select(self.key)

    def rows_of(self, ids: DataFrame) -> DataFrame:
        """The rows of these keys (and what else ``ids`` carries)."""
        if not self.slices:
            return ids.join(self.texts, self.key)
        return ids.withColumn("slice", F.floor(F.col(self.key) / self.slices)).join(self.texts, ["slice", self.key]).drop("slice")

    def search(self, branches: list[tuple[str, str]], verify: Column) -> DataFrame:
        """Rows that ``verify`` holds for, among those that any branch (field, needle) points to."""
        ids = reduce(DataFrame.unionByName, [self.candidates(f, n) for f, n in branches]).distinct()
        return self.rows_of(ids).where(verify)

    def search_many(self, field: str, terms: DataFrame, term: str, carry: list[str]) -> DataFrame:
        """Rows whose field holds the term (no wildcards), for every row of ``terms``: its columns ``carry`` and ``term`` and the text's.

        Each term takes its own rarest grams. Empty and null terms find nothing.
        """
        asked = terms.select(*carry, term).where(F.length(term) > 0).withColumn("__t", F.xxhash64(*carry, term))
        own = F.lit(field).alias("field")
        long_ = asked.where(F.length(term) >= GRAM).select("__t", term, own, F.explode(grams_of(F.col(term))).alias("gram")).distinct()
        rated = long_.join(self.grams, ["field", "gram"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
        place = F.row_number().over(Window.partitionBy("__t", term).orderBy("n", "gram"))
        rare = rated.withColumn("k", place).where(F.col("k") <= RARE)
        rare = rare.withColumn("need", F.count(F.lit(1)).over(Window.partitionBy("__t", term)).cast("int"))
        found = self._ids(rare.select("__t", term, "field", "gram", "need").withColumn("bucket", bucket(F.col("field"), F.col("gram"))).join(self.postings, ["bucket", "field", "gram"]), ["__t", term])
        pieces = F.array_distinct(F.concat(_runs(F.col("gram"), 1), _runs(F.col("gram"), 2)))
        parts = self.grams.where(F.col("field") == field).select("field", "gram", F.explode(pieces).alias(term))
        short = asked.where(F.length(term) < GRAM).select("__t", term).join(parts, term).join(self.postings, ["field", "gram"])
        found = found.unionByName(self._all_ids(short, ["__t", term]))
        met = self.rows_of(found).where(F.col(field).contains(F.col(term)))
        return asked.join(met.drop(term), "__t").drop("__t")


def build(rows: DataFrame, key: str, fields: dict[str, Column], folder: str, copy: bool = True) -> TextIndex:
    """Write the index of ``rows`` into ``folder``, a shared one; ``fields`` become columns of its texts. copy: keep the rows in the index too."""
    spark, keyed, slices = rows.sparkSession, rows.withColumns(fields), 0
    read = lambda name, like: spark.read.schema(like.schema).parquet(f"{folder}/{name}")  # noqa: E731  an empty table has no file to tell its columns
    if copy:
        low, high = rows.agg(F.min(key), F.max(key)).first()
        slices = max(BLOCK_ROWS, ((high or 0) - (low or 0)) // SLICES + 1)
        sliced = keyed.withColumn("slice", F.floor(F.col(key) / slices))
        sliced.repartitionByRange(key).write.partitionBy("slice").parquet(f"{folder}/texts")
        keyed = read("texts", sliced)
    lists = keyed.select(F.col(key).cast("long").alias(key), *[F.col(f).cast("string").alias(f) for f in fields]).mapInArrow(_post(key, list(fields)), POSTINGS)
    lists = lists.withColumn("bucket", bucket(F.col("field"), F.col("gram")))
    spread = lists.repartition("bucket", "gram", F.pmod("block", F.lit(16))).sortWithinPartitions("bucket", "field", "gram", "block")
    spread.write.partitionBy("bucket").parquet(f"{folder}/postings")
    postings = read("postings", lists)
    sizes = postings.groupBy("field", "gram").agg(F.sum(F.size("offs")).alias("n"))
    sizes.sortWithinPartitions("field", "gram").write.parquet(f"{folder}/grams")
    return TextIndex(keyed, postings, read("grams", sizes), key, slices)


def load(spark: SparkSession, folder: str, key: str, slices: int) -> TextIndex:
    """A written index with its copy of the rows; ``slices`` as build() gave it."""
    return TextIndex(*[spark.read.parquet(f"{folder}/{name}") for name in ("texts", "postings", "grams")], key, slices)
