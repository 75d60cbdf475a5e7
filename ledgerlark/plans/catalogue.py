"""The engine's registered queries: each operator applied to the driver's tables, with DuckDB SQL that says the same.

Every entry is (query, SQL); the query takes (spark, folder). Doubles are compared unrounded, sums of money as integers of cents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlark.functions import textkeys as T
from ledgerlark.operators import aggregates as A
from ledgerlark.operators import dml, joins, predicates as P, quality, resolve, sequences as S
from ledgerlark.sources import readers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def register(sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def t(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return readers.table(spark, folder, name)


def cents(column: str):
    return F.round(F.col(column) * 100).cast("long")


# ------------------------------------------------------------------ search and filters
@register("""
SELECT p_partkey, p_name, p_brand, CASE WHEN lower(p_name) = 'red' THEN 1 WHEN lower(p_name) LIKE '%red%' THEN 2 WHEN upper(p_brand) LIKE '%RED%' THEN 3 ELSE 4 END AS rank
FROM part WHERE p_name ILIKE '%red%' OR upper(p_brand) LIKE '%RED%' OR p_name ILIKE '%1%' ORDER BY rank, p_size, p_partkey LIMIT 50
""")
def tolerant_search_paged(spark, folder):
    part = t(spark, folder, "part")
    name, brand = F.col("p_name"), F.col("p_brand")
    found = part.where(P.tolerant("red", [name], codes=[brand]) | P.like_folded(name, "1"))
    rank = P.relevance([F.lower(name) == "red", P.like_folded(name, "red"), F.upper(brand).contains("RED")])
    ranked = found.withColumn("rank", rank)
    return P.page(ranked, [F.col("rank"), F.col("p_size"), F.col("p_partkey")], 1, 50).select("p_partkey", "p_name", "p_brand", "rank")


@register("SELECT * FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority ILIKE '%urgent%' AND o_totalprice >= 1000 AND o_totalprice <= 200000")
def multi_criteria_filter(spark, folder):
    spec = P.SearchSpec(equals={"o_orderstatus": "F", "o_custkey": "all"}, contains={"o_orderpriority": "urgent"}, ranges={"o_totalprice": (1000, 200000)})
    return spec.apply(t(spark, folder, "orders"))


@register("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%R_d%g%'")
def ilike_wildcards(spark, folder):
    return t(spark, folder, "part").where(P.like_folded(F.col("p_name"), "R_d%g")).select("p_partkey", "p_name")


@register("SELECT * FROM customer WHERE NOT coalesce(c_mktsegment = 'BUILDING' AND nullif(c_acctbal, 0) > 500, false)")
def complement_filter(spark, folder):
    spec = P.SearchSpec(equals={"c_mktsegment": "BUILDING"}, extra=[F.nullif(F.col("c_acctbal"), F.lit(0.0)) > 500])
    return spec.complement(t(spark, folder, "customer"))


@register("SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT coalesce(CASE WHEN o_orderstatus = 'F' THEN true WHEN o_orderstatus = 'O' THEN false END, false)")
def tri_state_filter(spark, folder):
    flag = F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False)
    return t(spark, folder, "orders").where(P.tri_state(flag, "active")).select("o_orderkey", "o_orderstatus")


@register("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def dynamic_sort_page(spark, folder):
    keys = {"date": [F.col("o_orderdate")], "price": [F.col("o_totalprice")]}
    order = P.sort_columns(keys, "price", True, "date", "o_orderkey")
    return P.page(t(spark, folder, "orders"), order, 3, 25).select("o_orderkey", "o_custkey")


@register("SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
def blocklist_anti(spark, folder):
    blocked = t(spark, folder, "nation").where("n_regionkey = 2").select(F.col("n_nationkey").alias("c_nationkey"))
    return P.without_blocked(t(spark, folder, "customer"), blocked, ["c_nationkey"]).select("c_custkey", "c_nationkey")


@register("SELECT n_nationkey AS c_nationkey, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey WHERE n_regionkey = 2 GROUP BY 1")
def blocklist_impact(spark, folder):
    blocked = t(spark, folder, "nation").where("n_regionkey = 2").select(F.col("n_nationkey").alias("c_nationkey"))
    return P.block_impact(t(spark, folder, "customer"), blocked, ["c_nationkey"])


@register("""
SELECT doc_id, CASE WHEN (contains(lower(text), 'license')::int + contains(lower(text), 'rights')::int + contains(lower(text), 'copyright')::int) >= 2 THEN 'legal'
  WHEN (contains(lower(text), 'the ')::int + contains(lower(text), ' of ')::int + contains(lower(text), ' and ')::int) >= 2 THEN 'prose' ELSE 'other' END AS kind FROM documents
""")
def keyword_classes(spark, folder):
    words = {"legal": ["license", "rights", "copyright"], "prose": ["the ", " of ", " and "]}
    return t(spark, folder, "documents").select("doc_id", P.keyword_class(F.col("text"), words).alias("kind"))


# ------------------------------------------------------------------ aggregates
@register("""
SELECT l_returnflag, count(*) AS total, count(*) FILTER (l_linestatus = 'O') AS open, count(*) FILTER (l_discount > 0.05) AS discounted FROM lineitem GROUP BY 1
""")
def segment_counts_conditional(spark, folder):
    return A.conditional_counts(t(spark, folder, "lineitem"), ["l_returnflag"], {"open": F.col("l_linestatus") == "O", "discounted": F.col("l_discount") > 0.05})


@register("""
WITH c AS (SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o FROM orders GROUP BY 1)
SELECT *, CASE WHEN o <> 0 THEN CAST(f AS DOUBLE) / o * 1000.0 ELSE 0.0 END AS per_thousand FROM c
""")
def ratio_per_thousand(spark, folder):
    counts = A.conditional_counts(t(spark, folder, "orders"), ["o_orderpriority"], {"f": F.col("o_orderstatus") == "F", "o": F.col("o_orderstatus") == "O"})
    return counts.select("o_orderpriority", "f", "o", A.ratio(F.col("f"), F.col("o")).alias("per_thousand"))


@register("""
SELECT CASE WHEN c_acctbal IS NULL OR c_acctbal < 0 THEN 'unknown' WHEN c_acctbal <= 1000 THEN 'low' WHEN c_acctbal <= 5000 THEN 'middle' ELSE 'high' END AS bucket, count(*) AS n FROM customer GROUP BY 1
""")
def bucket_histogram(spark, folder):
    return A.histogram(t(spark, folder, "customer"), A.buckets(F.col("c_acctbal"), [(1000, "low"), (5000, "middle")], "high", 0))


@register("SELECT c_nationkey, count(DISTINCT c_mktsegment) AS segments, count(*) AS n FROM customer GROUP BY 1")
def distinct_counts_by_group(spark, folder):
    return t(spark, folder, "customer").groupBy("c_nationkey").agg(F.countDistinct("c_mktsegment").alias("segments"), F.count(F.lit(1)).alias("n"))


@register("""
SELECT c_nationkey, c_mktsegment, n FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n, row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, c_mktsegment) AS k
FROM customer GROUP BY 1, 2) WHERE k = 1
""")
def mode_per_group(spark, folder):
    return A.mode_by(t(spark, folder, "customer"), ["c_nationkey"], "c_mktsegment")


@register("SELECT p_brand, min(p_type) AS p_type, min(p_name) AS p_name, count(*) AS n FROM part GROUP BY 1")
def any_value_group(spark, folder):
    return A.first_value_by(t(spark, folder, "part"), ["p_brand"], ["p_type", "p_name"])


@register("""
SELECT k, coalesce(try_cast(regexp_extract(k, '^\\s*([+-]?\\d+)', 1) AS BIGINT), 0) AS number, count(*) AS n
FROM (SELECT substring(p_brand, 7) AS k FROM part UNION ALL SELECT unnest(['12x', 'x12', '', ' 7', '-3a'])) GROUP BY 1
""")
def numeric_cast_order(spark, folder):
    odd = spark.createDataFrame([("12x",), ("x12",), ("",), (" 7",), ("-3a",)], "k string")
    keys = t(spark, folder, "part").select(F.substring("p_brand", 7, 100).alias("k")).unionByName(odd)
    return A.counts_in_order(keys, "k", T.leading_int(F.col("k"))).select("k", T.leading_int(F.col("k")).alias("number"), "n")


@register("SELECT o_custkey, min(nullif(o_orderkey, 0)) AS least, max(nullif(o_orderkey, 0)) AS greatest, count(*) AS n FROM orders GROUP BY 1")
def number_spans(spark, folder):
    return A.span_by(t(spark, folder, "orders"), ["o_custkey"], "o_orderkey")


@register("SELECT n_regionkey, count(*) AS n, list_sort(list(DISTINCT n_name))::VARCHAR AS members FROM nation GROUP BY 1")
def member_sets(spark, folder):
    sets = A.member_sets(t(spark, folder, "nation"), ["n_regionkey"], "n_name")
    return sets.withColumn("members", F.concat(F.lit("["), F.array_join("members", ", "), F.lit("]")))


@register("""
SELECT l_orderkey, count(*) AS members, count(*) FILTER (l_quantity >= 25) AS large FROM lineitem GROUP BY 1
""")
def nested_member_filter(spark, folder):
    nested = t(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_quantity")).alias("members"))
    counts = A.nested_counts(nested, ["l_orderkey"], "members", {"large": lambda m: m["l_quantity"] >= 25})
    return counts.select("l_orderkey", "members", "large")


@register("""
WITH l AS (SELECT coalesce(CAST(quality AS VARCHAR), 'unclassified') AS label, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1)
SELECT label, n, n * 100.0::DOUBLE / (SELECT sum(n) FROM l)::DOUBLE AS percent FROM l
""")
def label_breakdown(spark, folder):
    return A.label_breakdown(t(spark, folder, "documents"), t(spark, folder, "labels"), "doc_id", "quality")


@register("SELECT count(*) FILTER (CAST(ts AS DATE) = DATE '2024-01-20') AS today, count(*) FILTER (CAST(ts AS DATE) >= DATE '2024-01-13') AS recent FROM events")
def recent_counts(spark, folder):
    return A.recent_counts(t(spark, folder, "events"), "ts", F.lit("2024-01-20").cast("date"))


@register("SELECT event_type, count(*) FILTER (value > 50) * 2 >= count(*) AS majority FROM events GROUP BY 1")
def majority_vote(spark, folder):
    return A.majority(t(spark, folder, "events"), ["event_type"], F.col("value") > 50)


@register("SELECT DISTINCT p_type FROM part WHERE trim(p_type) <> ''")
def filter_options(spark, folder):
    return A.distinct_options(t(spark, folder, "part"), "p_type")


@register("""
SELECT l_returnflag, l_linestatus, sum(CAST(round(l_extendedprice * 100) AS BIGINT))::BIGINT AS cents, sum(CAST(l_quantity AS BIGINT))::BIGINT AS quantity, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2
""")
def pricing_summary(spark, folder):
    rows = t(spark, folder, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum(cents("l_extendedprice")).alias("cents"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"), F.count(F.lit(1)).alias("n")
    )


@register("""
SELECT o_orderkey + 1000000000 AS o_orderkey, o_custkey, (SELECT count(*) FROM orders k WHERE k.o_custkey = o.o_custkey AND k.o_orderstatus <> 'P')
  + row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS serial FROM orders o WHERE o_orderstatus = 'P'
""")
def allocate_serials(spark, folder):
    orders = t(spark, folder, "orders")
    known = S.renumber(orders.where("o_orderstatus <> 'P'"), ["o_custkey"], ["o_orderkey"])
    new = orders.where("o_orderstatus = 'P'").withColumn("serial", F.lit(None).cast("long"))
    return A.next_numbers(new, known, ["o_custkey"], "serial", ["o_orderkey"]).select((F.col("o_orderkey") + 1000000000).alias("o_orderkey"), "o_custkey", "serial")


# ------------------------------------------------------------------ joins
@register("""
WITH x AS (SELECT doc_id AS p_id, text AS p_text, lower(trim(text)) AS p_low, left(text, 12) AS p_pre, n_chars AS p_n FROM documents WHERE CAST(substring(source, 4) AS INT) % 2 = 0),
y AS (SELECT doc_id AS v_id, text AS v_text, lower(trim(text)) AS v_low, left(text, 12) AS v_pre, n_chars AS v_n FROM documents WHERE CAST(substring(source, 4) AS INT) % 2 = 1),
m AS (SELECT p_id, v_id, 1 AS pass, 100 AS score FROM x JOIN y ON p_text = v_text UNION ALL SELECT p_id, v_id, 2, 95 FROM x JOIN y ON p_low = v_low
  UNION ALL SELECT p_id, v_id, 3, 85 FROM x JOIN y ON p_pre = v_pre AND abs(p_n - v_n) <= 4)
SELECT p_id, pass, v_id, score FROM (SELECT *, row_number() OVER (PARTITION BY p_id ORDER BY pass, v_id) AS k FROM m) WHERE k = 1
""")
def cross_list_cascade(spark, folder):
    docs = t(spark, folder, "documents").withColumn("odd", F.substring("source", 4, 10).cast("int") % 2)

    def side(p: str) -> DataFrame:
        return docs.where(F.col("odd") == int(p == "v_")).select(
            F.col("doc_id").alias(p + "id"), F.xxhash64("text").alias(p + "text"), F.xxhash64(F.lower(F.trim("text"))).alias(p + "low"),
            F.substring("text", 1, 12).alias(p + "pre"), F.col("n_chars").alias(p + "n"),
        )

    on = lambda k: [(F.col("p_" + k), F.col("v_" + k))]
    return joins.cascade(side("p_"), side("v_"), "p_id", "v_id", [
        (100, on("text"), None), (95, on("low"), None), (85, on("pre"), F.abs(F.col("p_n") - F.col("v_n")) <= 4),
    ])


@register("""
WITH e AS (SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events WHERE event_id % 3 = 0 GROUP BY 1),
b AS (SELECT user_id, min(event_type) AS event_type, min(value) AS value FROM events GROUP BY 1)
SELECT user_id, coalesce(e.event_type, b.event_type) AS event_type, coalesce(e.value, b.value) AS value FROM b LEFT JOIN e USING (user_id)
""")
def latest_overlay(spark, folder):
    events = t(spark, folder, "events")
    base = events.groupBy("user_id").agg(F.min("event_type").alias("event_type"), F.min("value").alias("value"))
    return joins.overlay(base, events.where("event_id % 3 = 0"), "user_id", "event_id", ["event_type", "value"])


@register("SELECT p_partkey, p_brand FROM part WHERE lower(p_brand) = 'brand#11'")
def fallback_join(spark, folder):
    part = t(spark, folder, "part").select("p_partkey", "p_brand")
    return joins.with_fallback(part.where(F.col("p_brand") == "BRAND#11 "), part.where(F.lower("p_brand") == "brand#11"))


@register("""
SELECT a, b, days FROM (SELECT x.o_orderkey AS a, y.o_orderkey AS b, abs(date_diff('day', CAST(x.o_orderdate AS DATE), CAST(y.o_orderdate AS DATE))) AS days,
  row_number() OVER (PARTITION BY x.o_orderkey ORDER BY abs(date_diff('day', CAST(x.o_orderdate AS DATE), CAST(y.o_orderdate AS DATE))), y.o_orderkey) AS k
  FROM orders x JOIN orders y ON x.o_custkey = y.o_custkey AND x.o_orderkey <> y.o_orderkey AND abs(date_diff('day', CAST(x.o_orderdate AS DATE), CAST(y.o_orderdate AS DATE))) <= 30) WHERE k = 1
""")
def range_join_nearest(spark, folder):
    day = F.unix_date(F.to_date("o_orderdate")).cast("long")
    orders = t(spark, folder, "orders").select("o_custkey", "o_orderkey", day.alias("d"))
    x = orders.select("o_custkey", F.col("o_orderkey").alias("a"), F.col("d").alias("da"))
    y = orders.select("o_custkey", F.col("o_orderkey").alias("b"), F.col("d").alias("db"))
    near = joins.band_join(x, y, ["o_custkey"], "da", "db", 30).where("a <> b")
    return S.nearest(near.withColumn("days", F.abs(F.col("da") - F.col("db"))), ["a"], F.col("days"), ["b"]).select("a", "b", "days")


@register("""
WITH r(k, lo, hi, name) AS (VALUES (1, 0.0, 50000.0, 'small'), (2, 40000.0, 150000.0, 'middle'), (3, 150000.0, 300000.0, 'large'))
SELECT o_orderkey, name FROM (SELECT o_orderkey, name, row_number() OVER (PARTITION BY o_orderkey ORDER BY k) AS n FROM orders LEFT JOIN r ON o_totalprice BETWEEN lo AND hi) WHERE n = 1
""")
def range_config_lookup(spark, folder):
    ranges = spark.createDataFrame([(1, 0.0, 50000.0, "small"), (2, 40000.0, 150000.0, "middle"), (3, 150000.0, 300000.0, "large")], "k int, lo double, hi double, name string")
    return joins.range_lookup(t(spark, folder, "orders"), "o_totalprice", ranges, "lo", "hi", "k", "o_orderkey").select("o_orderkey", "name")


@register("SELECT c_custkey, count(o_orderkey) AS orders, max(o_orderkey) AS last FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def left_join_fanout(spark, folder):
    per = t(spark, folder, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("orders"), F.max("o_orderkey").alias("last"))
    return t(spark, folder, "customer").select("c_custkey").join(per, "c_custkey", "left").na.fill(0, ["orders"])


@register("""
SELECT c_custkey, true AS has_orders FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)
UNION ALL SELECT c_custkey, false FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)
""")
def semi_anti_ids(spark, folder):
    customers, keys = t(spark, folder, "customer").select("c_custkey"), t(spark, folder, "orders").select(F.col("o_custkey").alias("c_custkey"))
    yes, no = joins.existing(customers, keys, ["c_custkey"]), joins.existing(customers, keys, ["c_custkey"], False)
    return yes.withColumn("has_orders", F.lit(True)).unionByName(no.withColumn("has_orders", F.lit(False)))


@register("""
SELECT DISTINCT x.s_suppkey AS a, y.s_suppkey AS b FROM supplier x JOIN supplier y ON x.s_nationkey = y.s_nationkey AND x.s_suppkey < y.s_suppkey
  AND (abs(x.s_suppkey - y.s_suppkey) <= 25 OR floor(x.s_acctbal / 1000) = floor(y.s_acctbal / 1000))
""")
def either_condition_join(spark, folder):
    s = t(spark, folder, "supplier").select("s_nationkey", "s_suppkey", F.floor(F.col("s_acctbal") / 1000).alias("k"))
    x = s.select("s_nationkey", F.col("s_suppkey").alias("a"), F.col("k").alias("ka"))
    y = s.select("s_nationkey", F.col("s_suppkey").alias("b"), F.col("k").alias("kb"))
    options = [(F.col("a") < F.col("b")) & (F.col("b") - F.col("a") <= 25), (F.col("a") < F.col("b")) & (F.col("ka") == F.col("kb"))]
    return joins.either_join(x, y, ["s_nationkey"], options, ["a", "b"])


@register("""
WITH k AS (SELECT p_partkey, unnest([p_brand || '|' || p_type, p_brand || '|' || p_size || '|' || string_split(lower(p_name), ' ')[1], array_to_string(string_split(lower(p_name), ' ')[1:2], ' ')]) AS k FROM part)
SELECT DISTINCT a.p_partkey AS a, b.p_partkey AS b FROM k a JOIN k b ON a.k = b.k AND a.p_partkey < b.p_partkey
""")
def multi_key_blocking(spark, folder):
    """Pairs of all parts that share a brand and type, a brand, size and first word of the name, or that name's first two words."""
    part = t(spark, folder, "part")
    words = F.split(F.lower("p_name"), " ")
    first = F.array_join(F.slice(words, 1, 2), " ")
    keys = F.array(F.concat_ws("|", "p_brand", "p_type"), F.concat_ws("|", "p_brand", "p_size", words[0]), first)
    x, y = part.select(F.col("p_partkey").alias("a"), keys.alias("x")), part.select(F.col("p_partkey").alias("b"), keys.alias("y"))
    return joins.multi_key_candidates(x, y, "a", "b", F.col("x"), F.col("y")).where("a < b")


@register("""
WITH k AS (SELECT p_partkey, list_concat([lower(p_brand), lower(p_type)], string_split(lower(p_name), ' ')) AS k FROM part)
SELECT a.p_partkey, count(b.p_partkey) AS candidates FROM k a LEFT JOIN k b ON a.p_partkey <> b.p_partkey AND list_has_any(a.k, b.k) GROUP BY 1
""")
def multi_key_candidate_counts(spark, folder):
    """p_partkey, candidates: of every part, how many others share its brand, its type or a word of its name."""
    part = t(spark, folder, "part")
    keys = F.concat(F.array(F.lower("p_brand"), F.lower("p_type")), F.split(F.lower("p_name"), " "))
    return joins.multi_key_counts(part, "p_partkey", keys)


# ------------------------------------------------------------------ sequences
@register("""
WITH g AS (SELECT event_id, user_id, ts, coalesce(date_diff('microsecond', lag(ts) OVER w, ts) > 6 * 3600 * 1000000::BIGINT, true)::INT AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, user_id, CAST(sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS island FROM g
""")
def gaps_islands(spark, folder):
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return S.gap_islands(t(spark, folder, "events"), ["user_id"], micros, ["ts", "event_id"], 6 * 3600 * 1_000_000).select("event_id", "user_id", "island")


@register("""
WITH p AS (SELECT p_brand, p_partkey FROM part WHERE p_partkey % 7 <> 0), s AS (SELECT p_brand, lag(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS lo, p_partkey AS hi FROM p)
SELECT p_brand, unnest(generate_series(lo + 1, hi - 1)) AS missing FROM s WHERE hi - lo > 1
""")
def missing_serials(spark, folder):
    return S.missing_numbers(t(spark, folder, "part").where("p_partkey % 7 <> 0"), ["p_brand"], "p_partkey")


@register("""
WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE l_partkey END AS v FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, coalesce(v, last_value(v IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS v FROM l
""")
def forward_fill(spark, folder):
    rows = t(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_partkey") % 3 != 0, F.col("l_partkey")).alias("v"))
    return S.forward_fill(rows, ["l_orderkey"], ["l_linenumber", "l_partkey"], "v", F.col("v").isNotNull())


@register("SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) + 100 AS serial FROM lineitem")
def continuous_renumber(spark, folder):
    return S.renumber(t(spark, folder, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], 101).select("l_orderkey", "l_linenumber", "l_partkey", "serial")


@register("""
WITH r AS (SELECT o_custkey, o_orderkey, o_orderkey % 9 AS s FROM orders), b AS (SELECT *, max((s <= 0)::INT) OVER (PARTITION BY o_custkey) AS z,
  count(*) OVER (PARTITION BY o_custkey) AS n FROM r), d AS (SELECT o_custkey, count(DISTINCT s) AS u FROM r GROUP BY 1)
SELECT b.o_custkey, o_orderkey, CASE WHEN z = 1 OR n <> u THEN row_number() OVER (PARTITION BY b.o_custkey ORDER BY o_orderkey) ELSE s END AS s FROM b JOIN d ON b.o_custkey = d.o_custkey
""")
def renumber_broken_groups(spark, folder):
    rows = t(spark, folder, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") % 9).alias("s"))
    return S.renumber_broken(rows, ["o_custkey"], ["o_orderkey"], "s")


@register("""
WITH RECURSIVE o AS (SELECT o_custkey, o_orderkey, o_orderkey % 11 AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders),
g AS (
  SELECT o_custkey, o_orderkey, k, CASE WHEN n <= 0 THEN 1 ELSE n END AS s FROM o WHERE k = 1
  UNION ALL
  SELECT o.o_custkey, o.o_orderkey, o.k, CASE WHEN o.n <= greatest(g.s, 0) THEN greatest(g.s + 1, o.k) ELSE o.n END FROM g JOIN o ON o.o_custkey = g.o_custkey AND o.k = g.k + 1
) SELECT o_custkey, o_orderkey, s FROM g
""")
def monotone_repair(spark, folder):
    rows = t(spark, folder, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") % 11).alias("s"))
    return S.map_sequence(rows, ["o_custkey"], ["o_orderkey"], "s", S.repair_monotone)


def _healed_sql(number: str) -> str:
    return f"""
WITH RECURSIVE o AS (
  SELECT l_orderkey, l_linenumber, l_partkey, n, lead(n) OVER w AS after, row_number() OVER w AS k FROM (SELECT *, {number} AS n FROM lineitem) WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, n)
), g AS (
  SELECT l_orderkey, k, CASE WHEN h <= 0 AND before > 0 THEN before + 1 ELSE h END AS h FROM (
    SELECT *, n - 1 AS before, CASE WHEN n - 1 > 50 AND n < n - 1 THEN 0 ELSE n END AS h FROM o WHERE k = 1)
  UNION ALL
  SELECT l_orderkey, k, CASE WHEN h <= 0 AND before > 0 THEN before + 1 ELSE h END FROM (
    SELECT o.l_orderkey, o.k, g.h AS before, CASE WHEN g.h > 50 AND n < g.h
      THEN coalesce(list_filter(list_transform(range(1, 11), lambda b: n + 100 * b), lambda c: abs(c - g.h - 1) <= 1 OR coalesce(after, 0) <> 0 AND abs(after - 1 - c) <= 1)[1], n) ELSE n END AS h
    FROM g JOIN o ON o.l_orderkey = g.l_orderkey AND o.k = g.k + 1)
), s AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN h > 0 THEN h ELSE 999999 END, k) AS place FROM g)
SELECT o.l_orderkey, l_linenumber, l_partkey, s.h AS s FROM o JOIN s ON s.l_orderkey = o.l_orderkey AND s.place = o.k
"""


@register(_healed_sql("l_linenumber % 5"))
def heal_serials(spark, folder):
    rows = t(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_linenumber") % 5).alias("s"))
    return S.map_sequence(rows, ["l_orderkey"], ["l_linenumber", "l_partkey"], "s", S.heal_serials, resort=True)


_LOST = "CASE (l_partkey + l_linenumber) % 5 WHEN 0 THEN l_linenumber + 20 WHEN 1 THEN 0 ELSE l_linenumber + 120 + l_orderkey % 4 * 100 END"


@register(_healed_sql(_LOST))
def heal_lost_hundreds(spark, folder):
    """Serials of which every fifth lost its hundreds and every fifth is unread."""
    rows = t(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.expr(_LOST).cast("long").alias("s"))
    return S.map_sequence(rows, ["l_orderkey"], ["l_linenumber", "l_partkey", "s"], "s", S.heal_serials, resort=True)


@register("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text, lang ORDER BY doc_id) AS k FROM documents) WHERE k = 1")
def first_occurrence_dedup(spark, folder):
    docs = t(spark, folder, "documents").select("doc_id", F.sha2("text", 256).alias("text"), "lang")
    return S.first_occurrences(docs, ["text", "lang"], ["doc_id"]).select("doc_id")


@register("""
WITH k AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN role END AS r FROM conversations), f AS (SELECT conv_id, turn, last_value(r IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM k),
n AS (SELECT *, (row_number() OVER w = 1 OR r IS DISTINCT FROM lag(r) OVER w)::INT AS s FROM f WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
b AS (SELECT conv_id, turn, CAST(sum(s) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS block FROM n)
SELECT conv_id, block, min(turn) AS first_page, max(turn) AS last_page, count(*) AS pages FROM b GROUP BY 1, 2
""")
def page_blocks(spark, folder):
    rows = t(spark, folder, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, F.col("role")).alias("role"))
    return S.page_blocks(rows, ["conv_id"], "turn", ["role"])


@register("""
WITH k AS (SELECT conv_id, turn, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS header FROM conversations) SELECT * FROM k
""")
def running_header(spark, folder):
    rows = t(spark, folder, "conversations").select("conv_id", "turn", "role")
    return S.carry_header(rows, ["conv_id"], ["turn"], F.when(F.col("role") == "user", F.col("turn")), "header").select("conv_id", "turn", "header")


@register("""
WITH s AS (SELECT o_custkey, o_orderkey, nullif(o_orderkey, 0) AS s, o_orderpriority AS house, row_number() OVER (PARTITION BY o_custkey ORDER BY coalesce(nullif(o_orderkey, 0), 999999), o_orderpriority) AS pos FROM orders),
k AS (SELECT *, lag(pos) OVER w AS pat, last_value(s IGNORE NULLS) OVER (PARTITION BY o_custkey, house ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ps FROM s WHERE house <> '5-LOW' WINDOW w AS (PARTITION BY o_custkey, house ORDER BY pos)),
n AS (SELECT *, CASE WHEN pos = pat + 1 OR s - ps <= 2500 THEN 0 ELSE 1 END AS b FROM k)
SELECT o_custkey, o_orderkey, house, CAST(sum(b) OVER (PARTITION BY o_custkey, house ORDER BY pos) AS BIGINT) AS household FROM n
UNION ALL SELECT o_custkey, o_orderkey, house, NULL FROM s WHERE house = '5-LOW'
""")
def household_groups(spark, folder):
    rows = t(spark, folder, "orders").select("o_custkey", "o_orderkey", F.col("o_orderpriority").alias("house"))
    return S.household_groups(rows, ["o_custkey"], "house", "o_orderkey", 2500, F.col("house") == "5-LOW")


# ------------------------------------------------------------------ resolution and quality
@register("""
WITH d AS (SELECT doc_id, text, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS low FROM documents),
c AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY low) AS cluster, count(*) OVER (PARTITION BY low) AS size, min(doc_id) OVER (PARTITION BY text) AS same, count(*) OVER (PARTITION BY text) AS exact FROM d),
e AS (SELECT cluster, max(exact) AS exact FROM c GROUP BY 1)
SELECT c.doc_id AS id, c.cluster, CASE WHEN e.exact > 1 THEN 1 ELSE 3 END AS tier, CASE WHEN e.exact > 1 THEN 100 ELSE 95 END AS confidence, size FROM c JOIN e ON c.cluster = e.cluster WHERE size > 1
""")
def internal_duplicates(spark, folder):
    low = F.lower(F.trim(F.regexp_replace("text", r"\s+", " ")))
    docs = t(spark, folder, "documents").select("doc_id", F.sha2("text", 256).alias("text"), F.sha2(low, 256).alias("low"))
    links = resolve.star_links(docs, "doc_id", ["text"], 1).unionByName(resolve.star_links(docs, "doc_id", ["low"], 3))
    return resolve.clusters(links)


def _rules() -> list[quality.Rule]:
    text = F.col("text")
    return [
        quality.Rule("short", 30, F.length(text) < 40, "size"), quality.Rule("long", 15, F.length(text) > 8000, "size"),
        quality.Rule("mail", 25, text.rlike("[a-z0-9.]+@[a-z0-9.]+")), quality.Rule("symbols", 20, text.rlike("[|#$%&*]{2}")),
        quality.Rule("digits", 10, text.rlike("[0-9]{5}")),
    ]


_DOC_RULES = """
SELECT doc_id, CASE WHEN length(text) < 40 THEN 30 WHEN length(text) > 8000 THEN 15 ELSE 0 END AS a, CASE WHEN regexp_matches(text, '[a-z0-9.]+@[a-z0-9.]+') THEN 25 ELSE 0 END AS b,
  CASE WHEN regexp_matches(text, '[|#$%&*]{2}') THEN 20 ELSE 0 END AS c, CASE WHEN regexp_matches(text, '[0-9]{5}') THEN 10 ELSE 0 END AS d FROM documents
"""


@register(f"""
WITH r AS ({_DOC_RULES}) SELECT doc_id, greatest(100 - a - b - c - d, 0) AS score, (a > 0)::INT + (b > 0)::INT + (c > 0)::INT + (d > 0)::INT AS defects,
  100 - a - b - c - d >= 95 AND a + b + c + d = 0 AS perfect FROM r
""")
def quality_score(spark, folder):
    scored = quality.with_quality(t(spark, folder, "documents"), _rules())
    return scored.select("doc_id", "score", F.size("defects").alias("defects"), "perfect")


@register(f"""
WITH r AS ({_DOC_RULES}), s AS (SELECT greatest(100 - a - b - c - d, 0) / 100.0::DOUBLE AS q FROM r)
SELECT count(*) AS n, count(*) FILTER (q >= 0.85) AS high, count(*) FILTER (q < 0.6) AS low FROM s
""")
def quality_defects_summary(spark, folder):
    scored = quality.with_quality(t(spark, folder, "documents"), _rules()).withColumn("q", F.col("score") / 100.0)
    return A.confidence_summary(scored, "q").select("n", "high", "low")


@register("""
WITH r AS (SELECT doc_id, text, trim(regexp_replace(regexp_replace(text, '[|#$%&*]{2,}', '', 'g'), '\\s+', ' ', 'g')) AS fixed FROM documents),
s AS (SELECT doc_id, text, fixed, CASE WHEN regexp_matches(text, '[|#$%&*]{2}') THEN 20 ELSE 0 END + CASE WHEN regexp_matches(text, '\\n') THEN 5 ELSE 0 END AS lost,
  CASE WHEN regexp_matches(fixed, '[|#$%&*]{2}') THEN 20 ELSE 0 END + CASE WHEN regexp_matches(fixed, '\\n') THEN 5 ELSE 0 END AS after FROM r)
SELECT doc_id, 100 - lost AS score_before, 100 - after AS score_after, fixed <> text AND after <= lost AS accepted, md5(CASE WHEN fixed <> text AND after <= lost THEN fixed ELSE text END) AS text FROM s
""")
def repair_accept(spark, folder):
    rules = [quality.Rule("symbols", 20, F.col("text").rlike("[|#$%&*]{2}")), quality.Rule("breaks", 5, F.col("text").rlike("\\n"))]
    new = {"text": T.collapse(F.regexp_replace("text", "[|#$%&*]{2,}", ""))}
    done = quality.accept_repairs(t(spark, folder, "documents").select("doc_id", "text"), new, rules)
    return done.select("doc_id", "score_before", "score_after", "accepted", F.md5("text").alias("text"))


@register("""
WITH n AS (SELECT DISTINCT p_type, string_split(p_type, ' ') AS w FROM part)
SELECT a.p_type AS a, b.p_type AS b FROM n a JOIN n b ON a.w[1] = b.w[1] AND a.p_type < b.p_type AND (len(list_filter(a.w, lambda x: NOT list_contains(b.w, x))) = 0 OR len(list_filter(b.w, lambda x: NOT list_contains(a.w, x))) = 0)
""")
def token_set_relations(spark, folder):
    types = t(spark, folder, "part").select("p_type").distinct().withColumn("w", F.split("p_type", " "))
    subset = (F.size(F.array_except("x_w", "y_w")) == 0) | (F.size(F.array_except("y_w", "x_w")) == 0)
    pairs = joins.blocked_pairs(types.withColumn("first", F.col("w")[0]), "p_type", ["first"], ["w"], subset)
    return pairs.select(F.col("x_p_type").alias("a"), F.col("y_p_type").alias("b"))


@register("""
SELECT doc_id, md5(trim(regexp_replace(translate(text, '०१२३४५६७८९', '0123456789'), '\\s+', ' ', 'g'))) AS plain, coalesce(try_cast(regexp_extract(text, '^\\s*([+-]?\\d+)', 1) AS BIGINT), 0) AS number FROM documents
""")
def text_normalise_key(spark, folder):
    return t(spark, folder, "documents").select("doc_id", F.md5(T.collapse(T.digits_to_ascii(F.col("text")))).alias("plain"), T.leading_int(F.col("text")).alias("number"))


_WORD = "regexp_replace(" * 11 + "w" + "".join(f", '{a}', '{b}', 'g')" for a, b in T.DIGRAPHS)


@register(f"""
WITH w AS (SELECT p_partkey, generate_subscripts(l, 1) AS i, unnest(l) AS w FROM (SELECT p_partkey, string_split(trim(regexp_replace(regexp_replace(lower(p_name), '[^a-z\\s]', '', 'g'), '\\s+', ' ', 'g')), ' ') AS l FROM part)),
c AS (SELECT p_partkey, i, translate(regexp_replace({_WORD}, '^[aeiouy]', 'A'), 'szbvwpkcqgtdnmrlhjaeiouyfx', 'SSBBBBKKKKDDNNRLHJVVVVVV') AS k FROM w),
d AS (SELECT p_partkey, i, list_reduce(list_prepend('', string_split(k, '')), lambda x, y: CASE WHEN right(x, 1) = y THEN x ELSE x || y END) AS k FROM c)
SELECT p_partkey, string_agg(left(k, 1) || replace(substring(k, 2), 'V', ''), ' ' ORDER BY i) AS phonetic FROM d GROUP BY 1
""")
def phonetic_key(spark, folder):
    return t(spark, folder, "part").select("p_partkey", T.phonetic_key(F.col("p_name")).alias("phonetic"))


@register("SELECT p_partkey, p_name, CASE WHEN length(p_name) = 0 AND length(p_type) = 0 THEN 1.0 ELSE len(list_filter(string_split(p_name, ''), lambda c: c <> '' AND contains(p_type, c)))::DOUBLE / greatest(length(p_name), length(p_type)) END AS overlap FROM part")
def character_overlap(spark, folder):
    return t(spark, folder, "part").select("p_partkey", "p_name", T.char_overlap(F.col("p_name"), F.col("p_type")).alias("overlap"))


@register("""
SELECT event_id, CAST(o AS VARCHAR) AS old, CAST(n AS VARCHAR) AS new FROM (SELECT event_id, lag(json_extract_string(props, '$.k')) OVER (PARTITION BY user_id ORDER BY event_id) AS o, json_extract_string(props, '$.k') AS n FROM events)
WHERE o IS NOT NULL AND o IS DISTINCT FROM n
""")
def json_field_diff(spark, folder):
    fields = F.from_json("props", "map<string,string>")
    rows = t(spark, folder, "events").withColumn("new", fields).withColumn("old", F.lag("new").over(Window.partitionBy("user_id").orderBy("event_id")))
    diff = rows.where("old IS NOT NULL").select("event_id", F.explode(dml.field_diff(F.col("old"), F.col("new"))))
    return diff.select("event_id", "value.old", "value.new")


# ------------------------------------------------------------------ writes
@register("""
SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 5 <> 0
UNION ALL SELECT c_custkey, c_name, c_nationkey, c_acctbal + 1, 'NEW' FROM customer WHERE c_custkey % 5 = 0
UNION ALL SELECT c_custkey + 10000000, c_name, c_nationkey, c_acctbal, 'NEW' FROM customer WHERE c_custkey % 50 = 0
""")
def upsert_snapshot(spark, folder):
    now = t(spark, folder, "customer")
    changed = now.where("c_custkey % 5 = 0").withColumns({"c_mktsegment": F.lit("NEW"), "c_acctbal": F.col("c_acctbal") + 1, "at": F.lit(2)})
    stale = now.where("c_custkey % 5 = 0").withColumns({"c_mktsegment": F.lit("OLD"), "at": F.lit(1)})
    added = now.where("c_custkey % 50 = 0").withColumns({"c_mktsegment": F.lit("NEW"), "c_custkey": F.col("c_custkey") + 10000000, "at": F.lit(2)})
    return dml.upsert(now, changed.unionByName(stale).unionByName(added), ["c_custkey"], "at")


@register("""
WITH c AS (SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer), b AS (SELECT c_custkey + 5 AS b_id, c_name AS b_name, c_nationkey AS b_nation, 'X' AS b_segment FROM customer WHERE c_custkey % 10 = 0)
SELECT b_id, min(c_custkey) AS c_custkey, 1 AS rule FROM b JOIN c ON b_name = c_name GROUP BY 1
""")
def identity_upsert_matches(spark, folder):
    now = t(spark, folder, "customer")
    batch = now.where("c_custkey % 10 = 0").select((F.col("c_custkey") + 5).alias("b_id"), F.col("c_name").alias("b_name"), F.col("c_nationkey").alias("b_nation"), F.lit("X").alias("b_segment"))
    rules = [([(F.col("b_name"), F.col("c_name"))], None), ([(F.col("b_id"), F.col("c_custkey"))], F.col("b_nation") == F.col("c_nationkey"))]
    return dml.identity_matches(now, batch, "c_custkey", "b_id", rules)


@register("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_totalprice > 1000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def bulk_update(spark, folder):
    orders = t(spark, folder, "orders")
    done = dml.bulk_update(orders, (F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 1000), {"o_orderstatus": F.lit("X")}, {"o_orderstatus"})
    return done.select("o_orderkey", "o_orderstatus")


@register("SELECT o_orderkey, o_custkey FROM orders WHERE NOT coalesce(o_orderstatus = 'F' OR o_totalprice < 500, false)")
def delete_by_filter(spark, folder):
    return dml.delete_where(t(spark, folder, "orders"), (F.col("o_orderstatus") == "F") | (F.col("o_totalprice") < 500)).select("o_orderkey", "o_custkey")


@register("SELECT event_type AS source, count(*) + CASE WHEN event_type = 'click' THEN 0 ELSE 0 END AS n FROM events GROUP BY 1")
def replace_by_source(spark, folder):
    events = t(spark, folder, "events").withColumnRenamed("event_type", "source")
    again = events.where("source = 'click'")
    return dml.replace_by(events, again, ["source"]).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@register("SELECT count(*) AS total, count(*) FILTER (event_id % 3 = 0) AS pending, count(*) FILTER (event_id % 3 = 1) AS approved, count(*) FILTER (event_id % 3 = 2) AS rejected FROM events")
def pending_status_counts(spark, folder):
    status = F.element_at(F.array(F.lit("pending"), F.lit("approved"), F.lit("rejected")), (F.col("event_id") % 3 + 1).cast("int"))
    return dml.pending_counts(t(spark, folder, "events").select(status.alias("status")))


@register("""
WITH n AS (SELECT d.doc_id AS id, d.text, CAST(l.quality AS VARCHAR) AS label, min(d.doc_id) OVER (PARTITION BY d.text) AS hub FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
g AS (SELECT *, max(label) FILTER (id = hub) OVER (PARTITION BY text) AS own, min(label) FILTER (id <> hub) OVER (PARTITION BY text) AS other FROM n)
SELECT id, coalesce(label, CASE WHEN id = hub THEN other ELSE coalesce(own, other) END) AS label,
       CASE WHEN label IS NOT NULL THEN 0 WHEN id = hub AND other IS NOT NULL OR id <> hub AND own IS NOT NULL THEN 1 WHEN id <> hub AND other IS NOT NULL THEN 2 END AS hops FROM g
""")
def label_propagation(spark, folder):
    docs = t(spark, folder, "documents").select("doc_id", F.sha2("text", 256).alias("text"))
    nodes = docs.join(t(spark, folder, "labels").select("doc_id", F.col("quality").cast("string").alias("label")), "doc_id", "left").withColumnRenamed("doc_id", "id")
    return resolve.propagate_labels(nodes.select("id", "label"), resolve.star_links(docs, "doc_id", ["text"], 1))


@register("""
WITH l AS (SELECT doc_id, generate_subscripts(b, 1) - 1 AS position, unnest(b) AS block FROM (SELECT doc_id, list_filter(string_split_regex(text, '\\. '), lambda x: trim(x) <> '') AS b FROM documents))
SELECT doc_id, position::INT AS position, md5(block) AS block FROM l
""")
def split_records(spark, folder):
    parts = readers.split_records(t(spark, folder, "documents"), "text", r"\. ", r"\. ", 1)
    return parts.select("doc_id", "position", F.md5("block").alias("block"))


# ------------------------------------------------------------------ audits, pages, edits
@register("""
WITH r AS (SELECT o_custkey, o_orderkey % 40 AS s, o_totalprice / 400000.0 AS c, o_orderstatus = 'P' AS w FROM orders),
t AS (SELECT o_custkey, count(*) AS total, coalesce(min(CASE WHEN s > 0 THEN s END), 0) AS least, coalesce(max(CASE WHEN s > 0 THEN s END), 0) AS greatest,
  count(*) FILTER (c < 0.9) AS low_confidence, count(*) FILTER (w) AS warned, count(DISTINCT CASE WHEN s > 0 THEN s END) AS u FROM r GROUP BY 1)
SELECT o_custkey, total, least, greatest, low_confidence, warned, CASE WHEN u = 0 THEN 0 ELSE greatest - least + 1 - u END AS missing_count FROM t
""")
def audit_metrics(spark, folder):
    rows = t(spark, folder, "orders").select("o_custkey", (F.col("o_orderkey") % 40).alias("s"), (F.col("o_totalprice") / 400000.0).alias("c"), (F.col("o_orderstatus") == "P").alias("w"))
    return quality.audit(rows, ["o_custkey"], "s", "c", "w").drop("missing")


@register("""
WITH b AS (SELECT p_partkey, p_size AS x, CASE WHEN p_partkey % 4 = 0 THEN p_size + 3 WHEN p_partkey % 4 = 1 THEN NULL ELSE p_size END AS y FROM part)
SELECT p_partkey, CASE WHEN y IS NULL THEN 0.3 WHEN y = x THEN 1.0 ELSE 1.0 - 3 * 0.05::DOUBLE END::DOUBLE AS size_confidence FROM b
""")
def number_agreement(spark, folder):
    part = t(spark, folder, "part")
    again = F.when(F.col("p_partkey") % 4 == 0, F.col("p_size") + 3).when(F.col("p_partkey") % 4 == 1, F.lit(None)).otherwise(F.col("p_size"))
    return part.select("p_partkey", T.field_confidence(F.col("p_size"), again).alias("size_confidence"))


@register("""
WITH e AS (SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN 'DELETE' WHEN c_custkey % 7 = 0 THEN 'UPDATE' END AS action FROM customer)
SELECT c.c_custkey, c.c_name, CASE WHEN e.action = 'UPDATE' THEN 'EDITED' ELSE c_mktsegment END AS c_mktsegment FROM customer c JOIN e ON c.c_custkey = e.c_custkey WHERE e.action IS DISTINCT FROM 'DELETE'
UNION ALL SELECT 99999999, 'added', 'NEW'
""")
def pending_edit_apply(spark, folder):
    rows = t(spark, folder, "customer").select("c_custkey", "c_name", "c_mktsegment")
    first = rows.where("c_custkey % 7 = 0").select(F.col("c_custkey").alias("target_id"), F.lit("UPDATE").alias("action"), F.col("c_custkey").alias("edit_id"), F.create_map(F.lit("c_mktsegment"), F.lit("EDITED")).alias("proposed"))
    then = rows.where("c_custkey % 11 = 0").select(F.col("c_custkey").alias("target_id"), F.lit("DELETE").alias("action"), (F.col("c_custkey") + 10_000_000).alias("edit_id"), F.create_map(F.lit("c_mktsegment"), F.lit("x")).alias("proposed"))
    add = spark.createDataFrame([(None, "ADD", 1, {"c_custkey": "99999999", "c_name": "added", "c_mktsegment": "NEW"})], "target_id long, action string, edit_id long, proposed map<string,string>")
    edits = first.unionByName(then).unionByName(add).withColumn("status", F.lit("approved"))
    return dml.apply_pending(rows, edits, "c_custkey", ["c_name", "c_mktsegment"])


@register("""
SELECT l_orderkey, l_linenumber, l_partkey, CAST(least(greatest(floor((l_quantity - 0.0) / (50.0 / 10)), 0), 9) * 3 + least(greatest(floor((l_linenumber * 10.0 - 0.0) / (80.0 / 3)), 0), 2) AS INTEGER) AS cell FROM lineitem
""")
def page_grid_cells(spark, folder):
    words = t(spark, folder, "lineitem").withColumns({"x0": F.col("l_linenumber") * 10.0, "y0": F.col("l_quantity")})
    return readers.grid_cells(words, 3, 10, F.lit(80.0), F.lit(50.0)).select("l_orderkey", "l_linenumber", "l_partkey", "cell")


@register("""
WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_quantity >= 17.5)::INT + (l_quantity >= 34)::INT AS c FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, c ORDER BY l_linenumber, l_partkey * 1000000 + l_suppkey) AS n FROM b)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(c AS INTEGER) AS "column", CAST(n AS INTEGER) AS "row" FROM r
""")
def column_reading_order(spark, folder):
    blocks = t(spark, folder, "lineitem").withColumns({"c": F.col("l_quantity"), "q": F.col("l_linenumber"), "k": F.col("l_partkey") * 1000000 + F.col("l_suppkey")})
    col = F.when(F.col("c") >= 17.5, 1).otherwise(0) + F.when(F.col("c") >= 34, 1).otherwise(0)
    row = F.row_number().over(Window.partitionBy("l_orderkey", "column").orderBy("q", "k"))
    return blocks.withColumn("column", col).withColumn("row", row).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "column", "row")


@register("""
WITH p AS (SELECT source, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents)
SELECT source, count(*) FILTER (n_chars > 600) * 2 >= count(*) AS digital, count(*) FILTER (n_chars > 600) AS text_pages FROM p WHERE k <= 10 GROUP BY 1
""")
def digital_majority(spark, folder):
    pages = t(spark, folder, "documents").select("source", F.col("doc_id").alias("page"), "n_chars")
    return readers.is_digital(pages, ["source"], "n_chars", 10, 600)


@register("""
WITH v AS (SELECT l_orderkey, l_linenumber - 1 AS c, l_linenumber - 1 + 100 + CASE WHEN l_partkey % 3 = 0 THEN l_partkey % 5 ELSE 0 END AS printed FROM lineitem),
p AS (SELECT l_orderkey, printed - c AS p, count(*) AS n, min(c) AS c FROM v GROUP BY 1, 2),
b AS (SELECT l_orderkey, first(p ORDER BY n DESC, p) FILTER (n >= 2) AS agreed, max(CASE WHEN c = 0 THEN p END) AS zero FROM p GROUP BY 1)
SELECT l_orderkey, CAST(coalesce(agreed, CASE WHEN abs(zero - 100) <= 6 THEN zero END, 100) AS BIGINT) AS start FROM b
""")
def start_serial_consensus(spark, folder):
    odd = F.when(F.col("l_partkey") % 3 == 0, F.col("l_partkey") % 5).otherwise(0)
    votes = t(spark, folder, "lineitem").select("l_orderkey", (F.col("l_linenumber") - 1).alias("c"), (F.col("l_linenumber") + 99 + odd).alias("printed"))
    return S.start_consensus(votes, ["l_orderkey"], "c", "printed", F.lit(100))


@register("""
SELECT page_id, coalesce(nullif(trim(regexp_extract(url, '[?&]ref=([^&#]+)', 1)), ''), nullif(trim(regexp_extract(url, '/(\\d+)\\.html', 1)), ''), nullif(trim(regexp_extract(url, '/([a-z]{2})/', 1)), '')) AS meta FROM pages
""")
def header_first_match(spark, folder):
    patterns = [r"[?&]ref=([^&#]+)", r"/(\d+)\.html", r"/([a-z]{2})/"]
    return t(spark, folder, "pages").select("page_id", readers.first_match(F.col("url"), patterns).alias("meta"))


@register("""
WITH i AS (SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN 'ABC' || lpad(CAST(s_suppkey AS VARCHAR), 7, '0') WHEN 1 THEN 'UP/9/42/' || CAST(s_suppkey + 1000 AS VARCHAR) WHEN 2 THEN 'AB' WHEN 3 THEN '' WHEN 4 THEN 'AB#1234567' ELSE 'ABCD1234567' END AS c FROM supplier)
SELECT s_suppkey, CASE WHEN c = '' THEN 'MISSING' WHEN contains(c, '/') THEN 'LEGACY_VALID' WHEN contains(c, '#') THEN 'NOISE_SYMBOLS' WHEN length(c) < 10 THEN 'TOO_SHORT' WHEN length(c) > 10 THEN 'TOO_LONG' ELSE 'STANDARD_VALID' END AS kind FROM i
""")
def id_format_defects(spark, folder):
    k = F.col("s_suppkey") % 6
    code = F.when(k == 0, F.concat(F.lit("ABC"), F.lpad(F.col("s_suppkey").cast("string"), 7, "0"))).when(k == 1, F.concat(F.lit("UP/9/42/"), (F.col("s_suppkey") + 1000).cast("string")))
    code = code.when(k == 2, "AB").when(k == 3, "").when(k == 4, "AB#1234567").otherwise("ABCD1234567")
    return t(spark, folder, "supplier").select("s_suppkey", T.id_defect(code)["type"].alias("kind"))


@register("""
SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[\\r\\n\\t]+', ' ', 'g'), '^[\\s:\\-–—.*|]+', ''), '[\\s:\\-–—.*|]+$', ''), '\\s+', ' ', 'g'))) AS clean FROM documents
""")
def clean_text_edges(spark, folder):
    return t(spark, folder, "documents").select("doc_id", F.md5(T.clean_text(F.col("text"))).alias("clean"))


@register("""
WITH o AS (SELECT l_orderkey, l_linenumber, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS pos FROM lineitem),
i AS (SELECT *, sum((l_quantity > 20)::INT) OVER (PARTITION BY l_orderkey ORDER BY pos) AS record FROM o)
SELECT l_orderkey, CAST(record AS BIGINT) AS record, count(*) AS rows, string_agg(CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), ' ' ORDER BY pos) AS q FROM i WHERE record > 0 GROUP BY 1, 2
""")
def continuation_rows(spark, folder):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    rows = t(spark, folder, "lineitem").withColumn("pos", F.row_number().over(w)).withColumn("q", F.col("l_quantity").cast("long").cast("string"))
    return S.fold_continuations(rows.select("l_orderkey", "pos", "l_quantity", "q"), ["l_orderkey"], ["pos"], F.col("l_quantity") > 20, "q")


@register("SELECT c_custkey, concat_ws('_', c_nationkey, c_custkey) AS link FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def link_keys(spark, folder):
    mine = joins.existing(t(spark, folder, "customer"), t(spark, folder, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])
    return mine.select("c_custkey", dml.link_key(F.col("c_nationkey"), F.col("c_custkey")).alias("link"))


@register()
def fuzzy_name_matches(spark, folder):
    """Sequence similarity of blocked pairs (T20-T23): rows only, SQL has no such function."""
    from ledgerlark.functions import matchers

    pairs = joins.blocked_pairs(t(spark, folder, "nation"), "n_name", ["n_regionkey"], [], F.lit(True))
    return pairs.select(F.col("x_n_name").alias("a"), F.col("y_n_name").alias("b")).withColumn("similarity", matchers.similarity_udf("a", "b")).where("similarity >= 0.5")


from ledgerlark.plans import derived, lookups, surveys  # noqa: E402,F401 (they add their queries to the catalogue)
