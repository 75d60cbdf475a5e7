"""Readers and sinks: tables, nested documents, binary files, page geometry, snapshots and a catalog of named databases."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlark.functions.textkeys import natural_key


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    return df.where(F.col(key) == value)


def active(df: DataFrame, flag: str = "is_deleted") -> DataFrame:
    return df.where(~F.coalesce(F.col(flag).cast("boolean"), F.lit(False)))


def documents(spark: SparkSession, path: str, schema: T.StructType, **equal) -> DataFrame:
    """JSON documents whose fields equal the given values; None is no filter."""
    return reduce(lambda df, kv: df.where(F.col(kv[0]) == kv[1]), [(k, v) for k, v in equal.items() if v is not None], spark.read.schema(schema).json(path))


def first_available(*readers) -> DataFrame:
    """The first reader that can open its source (analysis fails at once where it can't)."""
    failed = None
    for reader in readers:
        try:
            return reader()
        except Exception as e:  # noqa: BLE001  the last failure is raised
            failed = e
    raise failed


def files(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """Files of a folder in natural order of their names: path, name, length, content (read only if asked for)."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return df.withColumn("name", F.element_at(F.split("path", "/"), -1)).orderBy(natural_key(F.col("name")), "path")


def is_digital(pages: DataFrame, by: list[str], n_chars: str, first: int = 10, least: int = 60) -> DataFrame:
    """Whether most of a document's first pages hold text; a tie counts as digital."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy("page"))
    some = pages.withColumn("__n", n).where(F.col("__n") <= first)
    yes = F.count_if(F.col(n_chars) > least)
    return some.groupBy(*by).agg((yes * 2 >= F.count(F.lit(1))).alias("digital"), yes.alias("text_pages"))


def grid_cells(words: DataFrame, columns: int, rows: int, width: Column, height: Column, left: float = 0.0, top: float = 0.0) -> DataFrame:
    """Words with the row-major number of their grid cell."""
    c = F.least(F.greatest(F.floor((F.col("x0") - left) / (width / columns)), F.lit(0)), F.lit(columns - 1))
    r = F.least(F.greatest(F.floor((F.col("y0") - top) / (height / rows)), F.lit(0)), F.lit(rows - 1))
    return words.withColumn("cell", (r * columns + c).cast("int"))


def column_blocks(blocks: DataFrame, width: Column, by: list[str], edges: tuple[float, ...] = (0.35, 0.68)) -> DataFrame:
    """Blocks in reading order: columns by share of the width, top down, then interleaved row by row."""
    col = reduce(lambda c, e: c + F.when(F.col("x0") >= width * e, 1).otherwise(0), edges, F.lit(0))
    row = F.row_number().over(Window.partitionBy(*by, "column").orderBy("y0", "x0"))
    placed = blocks.withColumn("column", col).withColumn("row", row)
    return placed.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy("row", "column")))


def table_columns(words: DataFrame, limits: dict[str, tuple[float, float]], body_top: float = 115.0) -> DataFrame:
    """Words of a page's body with the table column their left edge is in."""
    name = reduce(lambda c, kv: F.when((F.col("x0") >= kv[1][0]) & (F.col("x0") < kv[1][1]), kv[0]).otherwise(c), limits.items(), F.lit(None).cast("string"))
    return words.where(F.col("y0") >= body_top).withColumn("column", name)


def first_match(text: Column, patterns: list[str]) -> Column:
    """The first group of the first pattern that matches; null if none does."""
    return F.coalesce(*[F.nullif(F.trim(F.regexp_extract(text, p, 1)), F.lit("")) for p in patterns])


def split_records(pages: DataFrame, text: str, boundary: str, fallback: str, least: int = 3) -> DataFrame:
    """Page texts cut after each boundary; by the fallback pattern where that gives fewer than ``least`` parts. position from 0."""
    cut = lambda p: F.filter(F.split(F.col(text), p), lambda b: F.trim(b) != "")
    parts = F.when(F.size(cut(boundary)) < least, cut(fallback)).otherwise(cut(boundary))
    return pages.select("*", F.posexplode(parts).alias("position", "block"))


def decode_glyphs(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """Text of a legacy font: single glyphs by one translate, sequences by ordered replacement (the caller's table)."""
    single = [(a, b) for a, b in pairs if len(a) == len(b) == 1]
    longer = [(a, b) for a, b in pairs if (a, b) not in single]
    done = reduce(lambda c, ab: F.replace(c, F.lit(ab[0]), F.lit(ab[1])), longer, text)
    return F.translate(done, "".join(a for a, _ in single), "".join(b for _, b in single)) if single else done


def write_snapshot(df: DataFrame, path: str, by: list[str] = ()) -> None:
    """A snapshot; with ``by`` only the partitions that ``df`` has are replaced (dynamic overwrite)."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if by else "static")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def restore(spark: SparkSession, backup: str, target: str, needed: list[str], rescue: str) -> DataFrame:
    """A backup put in place after it is checked for its columns; what was there is copied to ``rescue`` first."""
    df = spark.read.parquet(backup)
    if missing := set(needed) - set(df.columns):
        raise ValueError(f"the backup lacks {sorted(missing)}")
    spark.read.parquet(target).write.mode("overwrite").parquet(rescue)
    df.write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def export(df: DataFrame, folder: str, summary: DataFrame | None = None) -> None:
    """All rows (no cap) and a summary as CSV folders with headers."""
    df.write.mode("overwrite").option("header", True).csv(f"{folder}/rows")
    if summary is not None:
        summary.write.mode("overwrite").option("header", True).csv(f"{folder}/summary")


class Catalog:
    """Named databases in a registry table: one is the active target, one the default for search. All methods return a new Catalog."""

    SCHEMA = "db_id string, name string, description string, is_active boolean, is_default boolean"

    def __init__(self, spark: SparkSession, rows: list[tuple] = ()):
        self.spark, self.rows = spark, [tuple(r) for r in rows]

    def _with(self, change) -> Catalog:
        return Catalog(self.spark, [change(r) for r in self.rows])

    def create(self, db_id: str, name: str, description: str = "") -> Catalog:
        if any(r[0] == db_id for r in self.rows):
            raise ValueError(f"{db_id} exists")
        first = not self.rows
        return Catalog(self.spark, [*self.rows, (db_id, name, description, first, first)])

    def rename(self, db_id: str, name: str, description: str = "") -> Catalog:
        return self._with(lambda r: (r[0], name, description, r[3], r[4]) if r[0] == db_id else r)

    def set_active(self, db_id: str) -> Catalog:
        return self._with(lambda r: (*r[:3], r[0] == db_id, r[4]))

    def set_default(self, db_id: str) -> Catalog:
        return self._with(lambda r: (*r[:4], r[0] == db_id))

    def delete(self, db_id: str) -> Catalog:
        if any(r[0] == db_id and r[3] for r in self.rows):
            raise ValueError("the active database stays")
        return Catalog(self.spark, [r for r in self.rows if r[0] != db_id])

    def frame(self) -> DataFrame:
        """The registry, active first, then default, then by name."""
        return self.spark.createDataFrame(self.rows, self.SCHEMA).orderBy(F.desc("is_active"), F.desc("is_default"), F.lower("name"))


def write_observed(df: DataFrame, path: str, columns: list[str]) -> DataFrame:
    """Write ``df`` to ``path`` as Parquet and return what was seen on the way: column, rows, nulls, low, high (as texts) of each of ``columns``.

    The figures come with the write (observed metrics), not from another scan; they are kept beside the table, in ``path``-statistics.
    """
    seen = Observation()
    metrics = [F.count(F.lit(1)).alias("rows")]
    for n, c in enumerate(columns):
        metrics += [F.count_if(F.col(c).isNull()).alias(f"nulls{n}"), F.min(c).cast("string").alias(f"low{n}"), F.max(c).cast("string").alias(f"high{n}")]
    df.observe(seen, *metrics).write.parquet(path)
    got = seen.get
    rows = [(c, got["rows"], got[f"nulls{n}"], got[f"low{n}"], got[f"high{n}"]) for n, c in enumerate(columns)]
    kept = f"{path.rstrip('/')}-statistics"
    df.sparkSession.createDataFrame(rows, "column string, rows long, nulls long, low string, high string").coalesce(1).write.parquet(kept)
    return df.sparkSession.read.parquet(kept)
