"""Join operators: cascades, overlays, fallbacks, banded and range joins, each as a plan of equi-joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cascade(left: DataFrame, right: DataFrame, left_id: str, right_id: str, passes: list[tuple[int, list[tuple[Column, Column]], Column | None]]) -> DataFrame:
    """Each left row with the right row of the first pass that matches it; in a pass, with the least right id.

    passes: score, pairs of equal (left, right) keys, further condition (or None). Each is an equi-join reduced to the least
    match before the passes meet, so fan-out doesn't travel.
    """
    parts = []
    for k, (score, keys, more) in enumerate(passes, 1):
        on = reduce(lambda a, b: a & b, [a == b for a, b in keys])
        met = left.join(right, on if more is None else on & more).groupBy(left_id).agg(F.min(right_id).alias(right_id))
        parts.append(met.withColumns({"pass": F.lit(k), "score": F.lit(score)}))
    every = reduce(DataFrame.unionByName, parts)
    best = every.groupBy(left_id).agg(F.min(F.struct("pass", right_id, "score")).alias("m"))
    return best.select(left_id, "m.*")


def overlay(base: DataFrame, edits: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """``base`` with the non-null values of each key's latest edit."""
    last = edits.groupBy(key).agg(F.max_by(F.struct(*columns), F.col(order)).alias("__e"))
    return base.join(last, key, "left").withColumns({c: F.coalesce(F.col(f"__e.{c}"), F.col(c)) for c in columns}).drop("__e")


def with_fallback(first: DataFrame, second: DataFrame) -> DataFrame:
    """``first``, or ``second`` if that has no row at all."""
    some = first.select(F.lit(1).alias("__some")).limit(1)
    return first.unionByName(second.join(F.broadcast(some), F.lit(True), "left_anti"))


def band_join(left: DataFrame, right: DataFrame, by: list[str], left_at: str, right_at: str, reach: int) -> DataFrame:
    """Pairs of a group at most ``reach`` apart: positions are cut into bins of that width, each left row meets its own bin and the
    two beside it, so it is an equi-join of bounded fan-out."""
    bins = left.withColumn("__bin", F.explode(F.array(*[F.floor(F.col(left_at) / reach) + d for d in (-1, 0, 1)])))
    keyed = right.withColumn("__bin", F.floor(F.col(right_at) / reach))
    return bins.join(keyed, [*by, "__bin"]).where(F.abs(F.col(left_at) - F.col(right_at)) <= reach).drop("__bin")


def range_lookup(df: DataFrame, value: str, ranges: DataFrame, low: str, high: str, order: str, key: str, most: int = 10_000) -> DataFrame:
    """The first range (by ``order``) that holds each row's value; rows without one keep nulls.

    Up to ``most`` ranges are configuration and are broadcast; beyond that they meet the values by dyadic blocks, see range_first().
    """
    if ranges.limit(most + 1).count() > most:
        return range_first(df, value, ranges, low, high, order)
    met = df.join(F.broadcast(ranges), F.col(value).between(F.col(low), F.col(high)), "left")
    n = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return met.withColumn("__n", n).where("__n = 1").drop("__n")


def dyadic_blocks(low: Column, high: Column) -> Column:
    """array<struct<level, prefix>>: the fewest aligned blocks (2^level whole numbers from prefix * 2^level) that make up low..high; none if low > high."""
    kind = "array<struct<level:int,prefix:bigint>>"

    def step(state: Column, level: Column) -> Column:
        lo, hi = state["lo"], state["hi"]
        odd, even = (lo <= hi) & (lo.bitwiseAND(1) == 1), (lo <= hi) & (hi.bitwiseAND(1) == 0)
        block = lambda at: F.array(F.struct(level.cast("int").alias("level"), at.alias("prefix"))).cast(kind)
        none = F.array().cast(kind)
        out = F.concat(state["out"], F.when(odd, block(lo)).otherwise(none), F.when(even, block(hi)).otherwise(none))
        up = lambda at: F.when(lo <= hi, F.shiftright(at, 1))  # noqa: E731  an empty rest stays empty
        return F.struct(F.coalesce(up(lo + odd.cast("long")), lo).alias("lo"), F.coalesce(up(hi - even.cast("long")), hi).alias("hi"), out.alias("out"))

    start = F.struct(low.cast("long").alias("lo"), high.cast("long").alias("hi"), F.array().cast(kind).alias("out"))
    levels = F.sequence(F.lit(0), F.length(F.bin(F.greatest(high - low, F.lit(0)).cast("long"))))
    return F.aggregate(levels, start, step, lambda s: s["out"])


def range_first(df: DataFrame, value: str, ranges: DataFrame, low: str, high: str, order: str) -> DataFrame:
    """The first range (by ``order``, distinct) that holds each row's value, for any number of ranges; rows without one keep nulls.

    Every range is cut into aligned blocks, at most two a level, and every value looks its ancestors up, one for each level that occurs: an
    equi-join. A block keeps its first range only, so nested ranges don't multiply. Values and ends are numbers below 2^62 in
    size; with fractions, the two unit cells where a range begins and ends are joined apart and checked. Null ends hold nothing.
    """
    from ledgerlark.operators.resolve import cut

    columns = ranges.columns
    r = ranges.where(F.col(low).isNotNull() & F.col(high).isNotNull()).select(F.struct(order, *[c for c in columns if c != order]).alias("__r"), F.col(low).alias("__lo"), F.col(high).alias("__hi"))
    inner = r.select("__r", F.explode(dyadic_blocks(F.ceil("__lo"), F.floor(F.col("__hi")) - 1)).alias("b"))
    blocks = cut(inner.groupBy("b.level", "b.prefix").agg(F.min("__r").alias("__r")), "range-blocks")
    ends = r.where(F.col("__lo") <= F.col("__hi")).select("__r", "__lo", "__hi", F.explode(F.array_distinct(F.array(F.floor("__lo"), F.floor("__hi")))).alias("cell"))
    levels = sorted(x[0] for x in blocks.select("level").distinct().collect())  # at most 63
    values = df.select(F.col(value).alias("__v")).where(F.col("__v").isNotNull()).distinct()
    cell = F.floor("__v").cast("long")
    above = values.select("__v", F.explode(F.array(*[F.struct(F.lit(n).alias("level"), F.shiftright(cell, n).alias("prefix")) for n in levels])).alias("b")) if levels else None
    hits = values.select("__v", cell.alias("cell")).join(ends, "cell").where(F.col("__v").between(F.col("__lo"), F.col("__hi"))).select("__v", "__r")
    if above is not None:
        hits = hits.unionByName(above.select("__v", "b.level", "b.prefix").join(blocks, ["level", "prefix"]).select("__v", "__r"))
    first = hits.groupBy("__v").agg(F.min("__r").alias("__r"))
    return df.join(first, F.col(value) == F.col("__v"), "left").select(*df.columns, *[F.col(f"__r.{c}").alias(c) for c in columns])


def nearest_within(left: DataFrame, right: DataFrame, by: list[str], at: str, reach: int, carry: list[str]) -> DataFrame:
    """Left rows with ``carry`` and the place (``near_at``) of the right row of their group that is nearest in ``at``, at most ``reach`` away (else
    nulls); ties go to the lower place, then to the least carried values. ``at`` is a whole number; rows without one keep nulls.

    An as-of join in both directions: windows over the union of both sides carry the last right row before and the first one after. Groups
    are cut into spans of places, and right rows near an end of a span go to both, so a large group is many windows.
    """
    span = 16 * (reach + 1)
    rights = right.where(F.col(at).isNotNull()).groupBy(*by, at).agg(F.min(F.struct(*carry)).alias("__r"))
    spans = F.sequence(F.floor((F.col(at) - reach) / span), F.floor((F.col(at) + reach) / span))
    spread = rights.withColumn("__span", F.explode(spans)).withColumn("__r", F.struct(F.col(at).alias("at"), F.col("__r").alias("v")))
    own = left.withColumn("__span", F.floor(F.col(at) / span))
    both = own.withColumn("__left", F.lit(1)).unionByName(spread.withColumn("__left", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(*by, "__span").orderBy(at, "__left")
    before = F.last("__r", True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.first("__r", True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    seen = both.withColumns({"__b": before, "__a": after}).where("__left = 1")
    lower = F.col("__a").isNull() | (F.col(at) - F.col("__b.at") <= F.col("__a.at") - F.col(at))
    pick = F.when(F.col("__b").isNotNull() & lower, F.col("__b")).otherwise(F.col("__a"))
    near = F.when(F.abs(pick["at"] - F.col(at)) <= reach, pick)
    return seen.withColumn("__p", near).select(*left.columns, F.col("__p.at").alias("near_at"), *[F.col(f"__p.v.{c}").alias(c) for c in carry])


def assign_best(pairs: DataFrame, left: str, right: str, score: str) -> DataFrame:
    """One-to-one assignment: ``left``, ``right``, ``score`` of the pairs that are taken when the best open pair is taken again and again.

    The order of pairs is by score from the top, then by keys, the same for both sides; so a pair that is the best of both its ends can be taken
    at once, and a round takes all of these. Rounds end when no pair is open. Null keys and scores take no part.
    """
    from ledgerlark.operators.resolve import cut

    open_ = cut(pairs.where(F.col(left).isNotNull() & F.col(right).isNotNull() & F.col(score).isNotNull()).groupBy(left, right).agg(F.max(score).alias(score)), "open-pairs")
    taken = None
    while not open_.isEmpty():
        best = F.min(F.struct((-F.col(score)).alias("__s"), F.col(left).alias("__l"), F.col(right).alias("__r"))).alias("__best")
        mine = open_.groupBy(left).agg(best).select("__best.*")
        theirs = open_.groupBy(right).agg(best).select("__best.*")
        mutual = cut(mine.join(theirs, ["__l", "__r"]).select(F.col("__l").alias(left), F.col("__r").alias(right), (-mine["__s"]).alias(score)), "taken-pairs")
        taken = mutual if taken is None else taken.unionByName(mutual)
        open_ = cut(open_.join(mutual.select(left), left, "left_anti").join(mutual.select(right), right, "left_anti"), "open-pairs")
    return taken if taken is not None else open_.select(left, right, score)


def either_join(left: DataFrame, right: DataFrame, by: list[str], options: list[Column], keep: list[str]) -> DataFrame:
    """Pairs that meet any of several conditions, as a union of joins; no join has an OR."""
    parts = [left.join(right, by).where(c).select(*keep) for c in options]
    return reduce(DataFrame.unionByName, parts).distinct()


def blocked_pairs(df: DataFrame, key: str, block: list[str], carry: list[str], condition: Column) -> DataFrame:
    """Pairs a < b of rows of one block that meet ``condition`` on the columns x_* and y_*."""
    columns = [key, *carry]
    x = df.select(*block, *[F.col(c).alias(f"x_{c}") for c in columns])
    y = df.select(*block, *[F.col(c).alias(f"y_{c}") for c in columns])
    return x.join(y, block).where((F.col(f"x_{key}") < F.col(f"y_{key}")) & condition)


def multi_key_candidates(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_keys: Column, right_keys: Column, block: int = 8192) -> DataFrame:
    """Distinct candidate pairs that share any of their keys (arrays of texts).

    A pair is made once, under the first key that both have, so pairs need no shuffle to be told apart. The rows of a frequent key are dealt into
    blocks of about ``block`` that meet each other. How many rows keys make the planner can't foresee, so none of these joins may become a broadcast.
    """

    def keyed(df: DataFrame, id_: str, keys: Column, side: str) -> DataFrame:
        every = F.array_sort(F.array_distinct(F.filter(F.flatten(F.collect_list("k")), lambda k: k.isNotNull())))
        own = df.select(id_, keys.alias("k")).groupBy(id_).agg(every.alias("k")).select(id_, "k", F.posexplode("k").alias("at", "key"))
        before = F.slice("k", F.lit(1), F.col("at")).alias(f"before_{side}")
        bits = F.expr(f"aggregate(before_{side}, 0L, (m, k) -> m | shiftleft(1L, cast(pmod(xxhash64(k), 64L) AS int)))")
        return own.select(id_, "key", before).withColumn(f"bits_{side}", bits)

    x, y = keyed(left, left_id, left_keys, "x"), keyed(right, right_id, right_keys, "y")
    blocks = lambda df, side: df.groupBy("key").agg(F.expr(f"int(1 + count(1) div {block})").alias(f"n_{side}"))
    both = blocks(x, "x").hint("merge").join(blocks(y, "y").hint("merge"), "key").hint("merge")
    own = lambda id_, n: F.pmod(F.xxhash64(id_), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    x = x.hint("merge").join(both, "key").withColumn("block_x", own(left_id, "n_x")).withColumn("block_y", each("n_y")).drop("n_x", "n_y")
    y = y.hint("merge").join(both, "key").withColumn("block_y", own(right_id, "n_y")).withColumn("block_x", each("n_x")).drop("n_x", "n_y")
    first = (F.col("bits_x").bitwiseAND(F.col("bits_y")) == 0) | ~F.arrays_overlap("before_x", "before_y")
    # a number of partitions is given, since few bytes of keys make many pairs and would be put together
    spark, met = left.sparkSession, ["key", "block_x", "block_y"]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return x.repartition(parts, *met).hint("merge").join(y.repartition(parts, *met).hint("merge"), met).where(first).select(left_id, right_id)


def multi_key_counts(df: DataFrame, key: str, keys: Column) -> DataFrame:
    """``key``, candidates: how many other rows share any of a row's keys (an array, few a row; ``key`` is unique).

    Counted by inclusion and exclusion over the subsets of a row's keys, so no pair is made. Rows of the same keys are counted as one kind;
    kinds make 2 to the number of their keys rows, which the planner can't foresee, so none of these joins may become a broadcast.
    """
    own = df.select(key, F.array_sort(F.array_distinct(F.filter(keys, lambda k: k.isNotNull()))).alias("kind"))
    kinds = own.where("kind IS NOT NULL").groupBy("kind").agg(F.count(F.lit(1)).alias("many"))
    subsets = F.aggregate("kind", F.array(F.array().cast("array<string>")), lambda have, k: F.concat(have, F.transform(have, lambda s: F.array_append(s, k))))
    rows = kinds.select("kind", "many", F.explode(subsets).alias("s")).where(F.size("s") > 0)
    sizes = rows.groupBy("s").agg(F.sum("many").alias("n"))
    signed = F.when(F.size("s") % 2 == 1, F.col("n") - 1).otherwise(1 - F.col("n"))
    found = rows.drop("many").hint("merge").join(sizes.hint("merge"), "s").groupBy("kind").agg(F.sum(signed).alias("candidates"))
    return own.join(found.hint("merge"), "kind", "left").select(key, F.coalesce("candidates", F.lit(0).cast("long")).alias("candidates"))


def existing(df: DataFrame, keys: DataFrame, on: list[str], present: bool = True) -> DataFrame:
    return df.join(keys.select(*on), on, "left_semi" if present else "left_anti")
