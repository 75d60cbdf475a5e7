"""Sequence operators: islands, gaps, forward fill, numbering and repair.

Window forms where rows see only their neighbours; a grouped map (one group is one page or list, which is bounded) where each row
depends on what the row before became.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


def islands(df: DataFrame, by: list[str], order: list[str], breaks: Column, name: str = "island") -> DataFrame:
    """Number of the island a row is in: a new one starts where ``breaks`` (which may look back with lag over the same order) is true."""
    w = Window.partitionBy(*by).orderBy(*order)
    flagged = df.withColumn("__new", F.coalesce(breaks, F.lit(True)).cast("int"))
    return flagged.withColumn(name, F.sum("__new").over(w)).drop("__new")


def gap_islands(df: DataFrame, by: list[str], value: Column, order: list[str], most: Column | float, name: str = "island") -> DataFrame:
    """Islands of rows no further than ``most`` from the one before."""
    w = Window.partitionBy(*by).orderBy(*order)
    return islands(df, by, order, value - F.lag(value).over(w) > most, name)


def household_groups(df: DataFrame, part: list[str], key: str, serial: str, most: int = 25, skip: Column | None = None, name: str = "household") -> DataFrame:
    """Rows of one key in a part are one household while they follow each other or their serials are at most ``most`` apart.

    Rows that ``skip`` marks keep their place in the sequence, but belong to no household. Unset serials come last.
    """
    s = F.nullif(F.col(serial), F.lit(0))
    seq = Window.partitionBy(*part).orderBy(F.coalesce(s, F.lit(999999)), key)
    keyed = df.withColumn("__at", F.row_number().over(seq)).withColumn("__s", s)
    keyed = keyed.withColumn("__key", F.when(F.coalesce(skip, F.lit(False)) if skip is not None else F.lit(False), None).otherwise(F.col(key)))
    w = Window.partitionBy(*part, "__key").orderBy("__at")
    near = (F.col("__at") == F.lag("__at").over(w) + 1) | (F.col("__s") - F.last("__s", True).over(w.rowsBetween(Window.unboundedPreceding, -1)) <= most)
    flagged = keyed.withColumn("__new", (~F.coalesce(near, F.lit(False))).cast("int"))
    numbered = flagged.withColumn(name, F.when(F.col("__key").isNotNull(), F.sum("__new").over(w)))
    return numbered.drop("__at", "__s", "__key", "__new")


def missing_numbers(df: DataFrame, by: list[str], number: str) -> DataFrame:
    """Numbers between the least and the greatest of a group that no row has; only gaps are expanded."""
    w = Window.partitionBy(*by).orderBy(number)
    gaps = df.where(F.col(number) > 0).select(*by, number).distinct().withColumn("__before", F.lag(number).over(w))
    gaps = gaps.where(F.col(number) - F.col("__before") > 1)
    return gaps.select(*by, F.explode(F.sequence(F.col("__before") + 1, F.col(number) - 1)).alias("missing"))


def forward_fill(df: DataFrame, by: list[str], order: list[str], value: str, valid: Column, may: Column | None = None) -> DataFrame:
    """Values that aren't valid replaced by the last valid one before them (where ``may`` allows; may look back with lag)."""
    w = Window.partitionBy(*by).orderBy(*order)
    last = F.last(F.when(valid, F.col(value)), True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fill = ~F.coalesce(valid, F.lit(False)) & (may if may is not None else F.lit(True)) & last.isNotNull()
    return df.withColumn("__f", F.when(fill, last).otherwise(F.col(value))).withColumn(value, F.col("__f")).drop("__f")


def renumber(df: DataFrame, by: list[str], order: list[str], start: int = 1, name: str = "serial") -> DataFrame:
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) + (start - 1)).cast("long"))


def renumber_broken(df: DataFrame, by: list[str], order: list[str], number: str) -> DataFrame:
    """Groups that have a number twice or one that isn't positive are numbered anew; the others stay."""
    group = Window.partitionBy(*by)
    first = F.row_number().over(Window.partitionBy(*by, number).orderBy(*order))
    marked = df.withColumn("__bad", (F.coalesce(F.col(number) <= 0, F.lit(True)) | (first > 1)).cast("int"))
    marked = marked.withColumn("__bad", F.max("__bad").over(group))
    fresh = F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")
    return marked.withColumn(number, F.when(F.col("__bad") == 1, fresh).otherwise(F.col(number))).drop("__bad")


def first_occurrences(df: DataFrame, keys: list[str], order: list[str], complete: Column | None = None) -> DataFrame:
    """The first row of each key; rows whose key isn't complete all stay."""
    ok = complete if complete is not None else F.lit(True)
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__n", n).where((F.col("__n") == 1) | ~F.coalesce(ok, F.lit(False))).drop("__n")


def nearest(df: DataFrame, by: list[str], distance: Column, ties: list[str]) -> DataFrame:
    """The nearest candidate of each key."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(distance, *ties))
    return df.withColumn("__n", n).where("__n = 1").drop("__n")


def carry_header(df: DataFrame, by: list[str], order: list[str], header: Column, name: str) -> DataFrame:
    """The last header at or before each row."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.last(header, True).over(w))


def page_blocks(df: DataFrame, by: list[str], page: str, key: list[str]) -> DataFrame:
    """Runs of pages with the same key as blocks (block, first, last page); a page without any key goes with the block before."""
    w = Window.partitionBy(*by).orderBy(page)
    some = F.coalesce(*[F.nullif(F.trim(F.col(k).cast("string")), F.lit("")) for k in key]).isNotNull()
    own = F.when(some, F.struct(*[F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k) for k in key]))
    carried = df.withColumn("__k", F.last(own, True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    marked = carried.withColumn("__new", (~F.col("__k").eqNullSafe(F.lag("__k").over(w)) | (F.row_number().over(w) == 1)).cast("int"))
    numbered = marked.withColumn("block", F.sum("__new").over(w))
    return numbered.groupBy(*by, "block").agg(F.min(page).alias("first_page"), F.max(page).alias("last_page"), F.count(F.lit(1)).alias("pages"))


def start_consensus(df: DataFrame, by: list[str], column: str, printed: str, expected: Column) -> DataFrame:
    """Start number a page's columns agree on: the proposal (printed - column) that two or more make, else column 0's if it is near
    what is expected, else what is expected."""
    votes = df.withColumn("__p", F.col(printed) - F.col(column)).groupBy(*by, "__p").agg(F.count("__p").alias("n"), F.min(column).alias("c"))
    best = votes.groupBy(*by).agg(
        F.min(F.when(F.col("n") >= 2, F.struct((-F.col("n")).alias("m"), F.col("__p").alias("p")))).alias("agreed"),
        F.max(F.when(F.col("c") == 0, F.col("__p"))).alias("zero"),
    )
    near = F.abs(F.col("zero") - expected) <= 6
    return best.select(*by, F.coalesce(F.col("agreed.p"), F.when(near, F.col("zero")), expected).cast("long").alias("start"))


# How far a first column's number may be from the running one, or above the formula; how far any column's may be from the running one.
NEAR_FIRST, ABOVE_FORMULA, NEAR_ANY = 6, 10, 5


def running_starts(pages: DataFrame, file: str, page: str, votes: str, count: str, formula: str) -> DataFrame:
    """``pages`` with ``start``, the number each page begins with, and ``way``, how it was found; read in order of (file, page).

    votes: array of struct<column, start>, what each column proposes (its printed number less its place), in order of columns. In turn: a positive start that two columns propose
    (the first of these by order); the first column's, if positive, where it is at most NEAR_FIRST from the running number or at
    most ABOVE_FORMULA above the page's ``formula``, or no number runs yet; any column's at most NEAR_ANY from the running number; that number; the formula, 1 at least.
    The running number is the start of the page before plus its ``count``, and runs once it is above 1.

    Pages that two columns settle, or the formula, don't depend on those before, so each begins a chain of its own; a long file is many chains.
    """
    sized = pages.withColumn("__some", F.filter(F.transform(votes, lambda v: v["start"]), lambda s: (s >= 1) & (F.size(F.filter(votes, lambda v: v["start"] == s)) >= 2)))
    zero = F.filter(votes, lambda v: v["column"] == 0)
    first = F.when(F.size(zero) > 0, zero[0]["start"])
    alone = F.coalesce(F.element_at(F.when(F.size("__some") > 0, F.col("__some")), 1), F.when((first >= 1) & (first <= F.col(formula) + ABOVE_FORMULA), first))
    marked = sized.withColumns({"__alone": alone, "__first": first})
    chain = F.sum(F.col("__alone").isNotNull().cast("int")).over(Window.partitionBy(file).orderBy(page))
    linked = marked.withColumn("__chain", chain)
    kinds = dict(pages.dtypes)
    schema = f"`{file}` {kinds[file]}, `{page}` {kinds[page]}, start long, way string"

    def settle(own: int | None, first: int | None, votes: list[int], running: int, formula: int, agreed: bool) -> tuple[int, str]:
        runs = running > 1
        if agreed:
            return own, "agreed"
        if first is not None and first >= 1:
            if runs and abs(first - running) <= NEAR_FIRST:
                return first, "first"
            if own is not None:
                return own, "first"
            if not runs:
                return first, "first"
        for v in votes if runs else ():
            if abs(v - running) <= NEAR_ANY:
                return v, "any, near"
        return (running, "running") if runs else (max(1, formula), "formula")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, running = None, 0
        for pdf in batches:
            out = []
            for f, p, link, own, first, votes_, agreed, n, form in pdf.itertuples(index=False):
                if (f, link) != at:
                    at, running = (f, link), 0
                number = lambda x: None if pd.isna(x) else int(x)
                start, way = settle(number(own), number(first), [int(v) for v in votes_], running, int(form), bool(agreed))
                running = start + int(n)
                out.append((f, p, start, way))
            yield pd.DataFrame(out, columns=[file, page, "start", "way"])

    plain = linked.select(file, page, "__chain", "__alone", "__first", F.transform(votes, lambda v: v["start"]).alias("__votes"), (F.size("__some") > 0).alias("__agreed"), count, formula)
    dealt = plain.repartition(file, "__chain").sortWithinPartitions(file, "__chain", page)
    return pages.join(dealt.mapInPandas(run, schema), [file, page])


def text_rows(df: DataFrame, by: list[str], x: str, y: str, gap: float = 5.0) -> DataFrame:
    """Words grouped to rows: a word starts a row if it is ``gap`` or more below the running middle of the row before."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([y, x], kind="stable")
        rows, middle, row = [], None, 0
        for at in pdf[y]:
            if middle is not None and abs(at - middle) >= gap:
                row, middle = row + 1, None
            middle = at if middle is None else (middle + at) / 2
            rows.append(row)
        return pdf.assign(text_row=rows)

    return df.groupBy(*by).applyInPandas(run, StructType([*df.schema.fields, StructField("text_row", IntegerType())]))


def fold_continuations(df: DataFrame, by: list[str], order: list[str], starts: Column, text: str) -> DataFrame:
    """Rows that continue the record above are appended to its text; one row a record stays."""
    marked = islands(df, by, order, F.when(starts, F.lit(True)).otherwise(F.lit(False)), "__rec")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, text))), lambda r: r[text]), " ")
    return marked.where("__rec > 0").groupBy(*by, F.col("__rec").alias("record")).agg(joined.alias(text), F.count(F.lit(1)).alias("rows"))


def repair_monotone(numbers: list) -> list[int]:
    """Numbers made rising: an unset, repeated or falling one becomes the greater of the last plus one and its place."""
    out, seen, last = [], set(), 0
    for at, n in enumerate(numbers, 1):
        if n is None or n != n or n <= 0 or n in seen or n < last:
            n = max(last + 1, at)
        n = int(n)
        seen.add(n)
        last = n
        out.append(n)
    return out


def heal_serials(numbers: list[int], start: int | None = None) -> list[int]:
    """Serials of a page healed: lost leading digits put back, unread ones filled, sorted, then anchored to the expected start."""
    healed = list(numbers)
    for k, now in enumerate(numbers):
        before = healed[k - 1] if k else (start - 1 if start else now - 1)
        after = numbers[k + 1] if k + 1 < len(numbers) else None
        if before > 50 and now < before:
            options = (now + base for base in range(100, 1001, 100))
            fits = (c for c in options if abs(c - before - 1) <= 1 or (after and abs(after - 1 - c) <= 1))
            healed[k] = next(fits, now)
        if healed[k] <= 0 and before > 0:
            healed[k] = before + 1
    healed.sort(key=lambda n: n if n > 0 else 999999)
    if start and start > 0:
        expect = start
        for k, n in enumerate(healed):
            healed[k] = n if abs(n - expect) <= 2 else expect
            expect = healed[k] + 1
    return healed


def map_sequence(df: DataFrame, by: list[str], order: list[str], number: str, fix, resort: bool = False) -> DataFrame:
    """``number`` of each group replaced by fix(list in order).

    Rows are dealt and sorted by group, so one Python call handles all groups of a batch; only the group that crosses the end of
    a batch is held. One group (a page, a list) must fit a worker.
    """

    def groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            if len(pdf):
                last = (pdf[by] == pdf[by].iloc[-1]).all(axis=1)
                if held and not (held[-1][by].iloc[-1] == pdf[by].iloc[0]).all():
                    yield pd.concat(held)
                    held = []
                if not last.all():
                    yield pd.concat([*held, pdf[~last]])
                    held = []
                held.append(pdf[last])
        if held:
            yield pd.concat(held)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in groups(batches):
            values = [None if pd.isna(v) else int(v) for v in pdf[number]]
            new = (pdf[by] != pdf[by].shift()).any(axis=1).to_numpy()
            starts = [*new.nonzero()[0].tolist(), len(pdf)]
            fixed: list[int] = []
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                fixed += fix([v or 0 for v in values[a:b]] if resort else values[a:b])
            yield pdf.assign(**{number: pd.array(fixed, dtype="Int64")})

    typed = df.withColumn(number, F.col(number).cast("long"))
    return typed.repartition(*by).sortWithinPartitions(*by, *order).mapInPandas(run, typed.schema)


def best_strategy(df: DataFrame, by: list[str], rank: str, count: str, least: int) -> DataFrame:
    """Of several ways to read a page the first that found enough rows, else the one that found most."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(F.when(F.col(count) >= least, F.col(rank)).otherwise(F.lit(1 << 30)), F.desc(count), rank))
    return df.withColumn("__n", n).where("__n = 1").drop("__n")
