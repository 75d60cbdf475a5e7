"""Conditional aggregates, histograms, modes and breakdowns; partial aggregation and one pass wherever the plan allows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def count_where(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def conditional_counts(df: DataFrame, by: list[str], conditions: dict[str, Column]) -> DataFrame:
    """total and one count for each condition, by group (of the whole table without keys), in one pass."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), *[count_where(c).alias(n) for n, c in conditions.items()])


def ratio(part: Column, whole: Column, scale: float = 1000.0) -> Column:
    """part / whole * scale, 0 where whole is 0."""
    return F.when(whole != 0, part.cast("double") / whole * scale).otherwise(0.0)


def valid_mean(value: Column, valid: Column) -> Column:
    return F.avg(F.when(valid, value))


def histogram(df: DataFrame, bucket: Column, name: str = "bucket") -> DataFrame:
    return df.groupBy(bucket.alias(name)).agg(F.count(F.lit(1)).alias("n"))


def buckets(value: Column, edges: list[tuple[float, str]], default: str, low: float | None = None) -> Column:
    """The label of the first edge a value doesn't exceed, the default above all; below ``low`` and null: unknown."""
    out = F.lit(default)
    for edge, label in reversed(edges):
        out = F.when(value <= edge, label).otherwise(out)
    return F.when(value.isNull() | (F.lit(False) if low is None else value < low), "unknown").otherwise(out)


def mode_by(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """The most frequent value of each group and its count; of equally frequent ones the least."""
    counted = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    best = counted.groupBy(*by).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(value).alias("v"))).alias("b"))
    return best.select(*by, F.col("b.v").alias(value), (-F.col("b.m")).alias("n"))


def first_value_by(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Columns that a loose GROUP BY would take from any row: the least of each group, and the group's size."""
    return df.groupBy(*by).agg(*[F.min(c).alias(c) for c in columns], F.count(F.lit(1)).alias("n"))


def counts_in_order(df: DataFrame, key: str, order: Column, most: int | None = None) -> DataFrame:
    """Group counts, ranked by an order on the key (an expression of it) and the key."""
    out = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return out.orderBy(order, key).limit(most) if most else out.orderBy(order, key)


def distinct_options(df: DataFrame, column: str) -> DataFrame:
    """Distinct values that are not blank, in order."""
    return df.where(F.trim(column) != "").select(column).distinct().orderBy(column)


def span_by(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Least, greatest and number of values of each group; 0 counts as unset."""
    v = F.nullif(F.col(value), F.lit(0))
    return df.groupBy(*by).agg(F.min(v).alias("least"), F.max(v).alias("greatest"), F.count(F.lit(1)).alias("n"))


def next_numbers(new: DataFrame, known: DataFrame, by: list[str], number: str, order: list[str]) -> DataFrame:
    """New rows numbered on from the greatest number their group has."""
    last = known.groupBy(*by).agg(F.max(number).alias("__last"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return new.join(last, by, "left").withColumn(number, (F.coalesce("__last", F.lit(0)) + rank).cast("long")).drop("__last")


def member_sets(df: DataFrame, by: list[str], member: str) -> DataFrame:
    """Rows and the sorted distinct members of each group."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set(member)).alias("members"))


def nested_counts(df: DataFrame, by: list[str], members: str, conditions: dict[str, object]) -> DataFrame:
    """Members of nested arrays counted by condition (functions of a member), without exploding."""
    sums = [F.coalesce(F.sum(F.size(F.filter(members, c))), F.lit(0)).alias(n) for n, c in conditions.items()]
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("parents"), F.coalesce(F.sum(F.size(members)), F.lit(0)).alias("members"), *sums)


def label_breakdown(df: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """Rows of each label, those without one as unclassified, with the share of all."""
    named = df.join(labels.select(key, label), key, "left").groupBy(F.coalesce(F.col(label).cast("string"), F.lit("unclassified")).alias("label"))
    counted = named.agg(F.count(F.lit(1)).alias("n"))
    return counted.select("label", "n", (F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy())).alias("percent"))


def confidence_summary(df: DataFrame, confidence: str, high: float = 0.85, low: float = 0.6) -> DataFrame:
    c = F.col(confidence)
    return df.agg(F.count(F.lit(1)).alias("n"), F.avg(c).alias("mean"), count_where(c >= high).alias("high"), count_where(c < low).alias("low"))


def recent_counts(df: DataFrame, at: str, today: Column, days: int = 7) -> DataFrame:
    d = F.to_date(F.col(at))
    return df.agg(count_where(d == today).alias("today"), count_where(d >= F.date_sub(today, days)).alias("recent"))


def majority(df: DataFrame, by: list[str], yes: Column) -> DataFrame:
    """Whether at least half of a group's rows say yes."""
    return df.groupBy(*by).agg((count_where(yes) * 2 >= F.count(F.lit(1))).alias("majority"))
