"""Registered queries of registry rules over the driver's tables: names, houses, ids and marks are derived from keys, and SQL computes what the rules say."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.functions import textkeys as T
from ledgerlark.operators import aggregates as A
from ledgerlark.operators import dml, joins, predicates as P, quality, resolve
from ledgerlark.plans.catalogue import register, t
from ledgerlark.plans.forms import SYLLABLES, folded_sql, phonetic_sql, pick, pick_sql, spelt
from ledgerlark.sources import readers

GENDERS = ("Female", "महिला", "other", "पुरुष", "M", " f. ", "तृतीय", "स्त्री")
RELATIONS = ("पति", "husband of", "Mother", "माता", "guardian", "पिता", "son", "अन्य")


def _label_sql(text: str, words) -> str:
    cases = " ".join(f"WHEN {' OR '.join(f'contains({text}, {w!r})' for w in own)} THEN '{label}'" for label, own in words if own)
    return f"CASE {cases} ELSE '{words[-1][0]}' END"


@register(f"""
WITH c AS (SELECT c_custkey, {pick_sql(GENDERS, 'c_custkey')} AS g, {pick_sql(RELATIONS, 'c_custkey // 8')} AS r FROM customer)
SELECT c_custkey, {_label_sql('lower(g)', T.GENDER_WORDS)} AS gender, {_label_sql('r', T.RELATION_WORDS)} AS relation FROM c
""")
def labelled_customers(spark, folder):
    k = F.col("c_custkey")
    return t(spark, folder, "customer").select("c_custkey", T.gender_label(pick(GENDERS, k)).alias("gender"), T.relation_label(pick(RELATIONS, F.floor(k / 8))).alias("relation"))


@register("""
WITH s AS (SELECT o_orderkey, floor(o_custkey * 1.7::DOUBLE * 10 + 0.5) / 10 AS x FROM orders), m AS (SELECT *, CAST(floor(x + 0.5) AS BIGINT) AS w FROM s)
SELECT o_orderkey, CASE WHEN x < 60 AND x = floor(x) THEN CAST(x AS BIGINT) || ' s' WHEN x < 60 THEN printf('%.1f s', x) WHEN w % 60 = 0 THEN (w // 60) || ' min' ELSE (w // 60) || ' min ' || (w % 60) || ' s' END AS took FROM m
""")
def order_durations(spark, folder):
    return t(spark, folder, "orders").select("o_orderkey", T.duration_label(F.col("o_custkey") * 1.7).alias("took"))


@register("""
WITH p AS (SELECT p_partkey, p_type || p_size || '-' || p_brand || 'x' AS label FROM part),
k AS (SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(lower(label), '\\d+|\\D+'), lambda r: CASE WHEN left(r, 1) BETWEEN '0' AND '9' THEN lpad(r, 20, '0') ELSE r END), chr(1)) AS k FROM p)
SELECT p_partkey, CAST(rank() OVER (PARTITION BY p_partkey % 100 ORDER BY k) AS INTEGER) AS place FROM k
""")
def parts_in_natural_order(spark, folder):
    """Places by natural order within a hundred groups of parts."""
    key = T.natural_key(F.concat("p_type", F.col("p_size").cast("string"), F.lit("-"), "p_brand", F.lit("x")))
    return t(spark, folder, "part").select("p_partkey", F.rank().over(Window.partitionBy(F.col("p_partkey") % 100).orderBy(key)).alias("place"))


@register("""
SELECT c_custkey, (c_custkey % 40 + 1) || ['', 'A', 'B', '/C'][c_custkey % 4 + 1] AS key, c_custkey % 9 = 0 AS generic FROM customer
""")
def customers_houses(spark, folder):
    """Houses written with leading zeros, noise and hyphens, by their key; every ninth says nothing."""
    k = F.col("c_custkey")
    house = F.concat(pick(("", "0", " 00"), k), (k % 40 + 1).cast("string"), pick(("", " ", "#", "*"), F.floor(k / 7)), pick(("", "-a", " b", "/c"), k))
    stated = F.when(k % 9 == 0, pick(("", "00", " na", "unknown,", "--", "०"), F.floor(k / 9))).otherwise(house)
    return t(spark, folder, "customer").select("c_custkey", T.house_key(house).alias("key"), T.is_generic_house(stated).alias("generic"))


@register("SELECT p_brand, sum(CASE WHEN p_size > 10 THEN p_size END) / CAST(count(CASE WHEN p_size > 10 THEN 1 END) AS DOUBLE) AS mean FROM part GROUP BY 1")
def mean_of_larger_sizes(spark, folder):
    return t(spark, folder, "part").groupBy("p_brand").agg(A.valid_mean(F.col("p_size"), F.col("p_size") > 10).alias("mean"))


@register("SELECT c_custkey, c_name, c_nationkey, CAST(NULL AS DOUBLE) AS c_acctbal, CAST(NULL AS VARCHAR) AS c_mktsegment FROM customer")
def redacted_customers(spark, folder):
    return P.redact(t(spark, folder, "customer"), ["c_acctbal", "c_mktsegment"], False)


@register("SELECT event_id, event_type FROM events WHERE event_type = 'error' OR value / 100 < 0.9::DOUBLE")
def events_to_review(spark, folder):
    rows = t(spark, folder, "events").select("event_id", "event_type", (F.col("event_type") == "error").alias("warned"), (F.col("value") / 100).alias("sure"))
    return P.review_filter(rows, "warned", "sure").select("event_id", "event_type")


@register("""
WITH n AS (SELECT p_brand, count(*) // 2 AS n FROM part WHERE p_size % 5 > 0 GROUP BY 1), p AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS serial FROM part)
SELECT p_partkey FROM p LEFT JOIN n ON n.p_brand = p.p_brand WHERE p_size % 10 <> 7 AND NOT coalesce(serial > n.n, false)
""")
def parts_after_reload(spark, folder):
    """Blank names, and serials above what the reload brought for their brand, go."""
    part = t(spark, folder, "part")
    counts = part.where("p_size % 5 > 0").groupBy("p_brand").agg(F.floor(F.count(F.lit(1)) / 2).alias("n"))
    serial = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    rows = part.withColumn("serial", serial).withColumn("name", F.when(F.col("p_size") % 10 == 7, F.lit(" : ")).otherwise(F.col("p_name")))
    return P.purge_reloaded(rows, "name", "serial", ["p_brand"], counts).select("p_partkey")


@register("SELECT p_partkey, p_brand FROM part WHERE p_brand = 'Brand#11'")
def first_input_kept(spark, folder):
    """The other way of fallback_join: the first input has rows, so the second doesn't count."""
    part = t(spark, folder, "part").select("p_partkey", "p_brand")
    return joins.with_fallback(part.where("p_brand = 'Brand#11'"), part.where("p_brand = 'Brand#12'"))


@register("""
SELECT event_id, event_type AS source, value FROM events WHERE event_type <> 'click'
UNION ALL SELECT event_id, 'click', value * 2 FROM events WHERE event_type = 'click' AND event_id % 2 = 0
""")
def replaced_source(spark, folder):
    """The rows of one source are replaced by fewer and other ones."""
    events = t(spark, folder, "events").select("event_id", F.col("event_type").alias("source"), "value")
    again = events.where("source = 'click' AND event_id % 2 = 0").withColumn("value", F.col("value") * 2)
    return dml.replace_by(events, again, ["source"])


@register("""
WITH w AS (SELECT *, l_quantity * 10 AS x0, l_linenumber * 1000.0 + l_partkey % 997 AS y0, (l_quantity * 10 >= 500 * 0.35::DOUBLE)::INT + (l_quantity * 10 >= 500 * 0.68::DOUBLE)::INT AS c FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, c ORDER BY y0, x0) AS r FROM w)
SELECT l_orderkey, x0, y0, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY r, c) AS INTEGER) AS position FROM r
""")
def blocks_in_reading_order(spark, folder):
    words = t(spark, folder, "lineitem").select("l_orderkey", (F.col("l_quantity") * 10).alias("x0"), (F.col("l_linenumber") * 1000.0 + F.col("l_partkey") % 997).alias("y0"))
    return readers.column_blocks(words, F.lit(500.0), ["l_orderkey"]).select("l_orderkey", "x0", "y0", "position")


@register("SELECT p_partkey, CAST(CASE WHEN a = 8 THEN 18 WHEN a BETWEEN 1 AND 9 THEN 20 + a WHEN a < 18 THEN 18 WHEN a > 120 THEN 65 ELSE a END AS INTEGER) AS age FROM (SELECT p_partkey, p_size * 3 - 10 AS a FROM part)")
def enforced_ages_of_parts(spark, folder):
    return t(spark, folder, "part").select("p_partkey", quality.enforce_age(F.col("p_size") * 3 - 10).cast("int").alias("age"))


NAMES = ("राम", "मोहन ", "x राम", "र", "", "ram")


@register(f"""
WITH c AS (SELECT c_custkey, {pick_sql(NAMES, 'c_custkey')} AS name, c_custkey % 7 AS k, c_custkey % 150 AS age FROM customer)
SELECT c_custkey FROM c WHERE coalesce(k = 3, false) OR length(regexp_replace(name, '[^ऀ-ॿ]', '', 'g')) >= 2 AND (k = 1 OR k = 2 OR age BETWEEN 18 AND 120 OR k = 5)
""")
def genuine_customers(spark, folder):
    k = F.col("c_custkey") % 7
    code, relation = F.when(k == 1, F.lit("AB123")).otherwise(F.lit("A1")), F.when(k == 2, F.lit("मोहन")).otherwise(F.lit("म"))
    house, gone = F.when(k == 5, F.lit("12")).otherwise(F.lit("--")), F.when(k == 3, F.lit(True))
    return t(spark, folder, "customer").where(P.is_genuine(pick(NAMES, F.col("c_custkey")), code, relation, F.col("c_custkey") % 150, house, gone)).select("c_custkey")


# ------------------------------------------------------------------ two lists compared (E5)
def _list(df: DataFrame, key: str, p: str) -> DataFrame:
    k = F.col(key)
    name = F.concat_ws(" ", F.when(k % 4 == 1, F.replace(spelt(k % 90, 2), F.lit("a"), F.lit("aa"))).otherwise(spelt(k % 90, 2)), pick(("kumar", "devi"), k))
    code = F.when(k % 6 == 0, F.concat(F.lit("abc"), F.lpad((k % 50).cast("string"), 4, "0")))
    return df.select(k.alias(f"{p}id"), code.alias(f"{p}code"), name.alias(f"{p}name"), spelt(k % 30 + 1, 2).alias(f"{p}relation"), (k % 70).cast("int").alias(f"{p}age"))


def _list_sql(table: str, key: str) -> str:
    word = lambda x: f"{pick_sql(SYLLABLES, x)} || {pick_sql(SYLLABLES, f'({x} // 10)')}"
    name = f"CASE WHEN {key} % 4 = 1 THEN replace({word(f'({key} % 90)')}, 'a', 'aa') ELSE {word(f'({key} % 90)')} END || ' ' || {pick_sql(('kumar', 'devi'), key)}"
    return f"SELECT {key} AS id, CASE WHEN {key} % 6 = 0 THEN 'ABC' || lpad(CAST({key} % 50 AS VARCHAR), 4, '0') END AS code, {folded_sql(name)} AS n, {folded_sql(word(f'({key} % 30 + 1)'))} AS r, {key} % 70 AS age FROM {table}"


@register(f"""
WITH x0 AS ({_list_sql('customer', 'c_custkey')}), y0 AS ({_list_sql('supplier', 's_suppkey')}),
x AS (SELECT x0.*, a.phonetic AS np, b.phonetic AS rp FROM x0 LEFT JOIN {phonetic_sql('x0', 'id', 'n')} a USING (id) LEFT JOIN {phonetic_sql('x0', 'id', 'r')} b USING (id)),
y AS (SELECT y0.*, a.phonetic AS np, b.phonetic AS rp FROM y0 LEFT JOIN {phonetic_sql('y0', 'id', 'n')} a USING (id) LEFT JOIN {phonetic_sql('y0', 'id', 'r')} b USING (id)),
m AS (
  SELECT x.id AS p_id, y.id AS v_id, 1 AS pass, 100 AS score FROM x JOIN y ON x.code = y.code
  UNION ALL SELECT x.id, y.id, 2, 95 FROM x JOIN y ON x.n = y.n AND x.r = y.r WHERE length(x.r) >= 3
  UNION ALL SELECT x.id, y.id, 3, 85 FROM x JOIN y ON x.np = y.np AND x.rp = y.rp WHERE x.age > 0 AND y.age > 0 AND abs(x.age - y.age) <= 4
) SELECT p_id, v_id, score FROM (SELECT *, row_number() OVER (PARTITION BY p_id ORDER BY pass, v_id) AS k FROM m) WHERE k = 1
""")
def lists_of_customers_and_suppliers(spark, folder):
    """Customers found among suppliers by code, by folded names, or by sound and age, the first way that matches."""
    left, right = _list(t(spark, folder, "customer"), "c_custkey", "p_"), _list(t(spark, folder, "supplier"), "s_suppkey", "v_")
    return resolve.compare_lists(left, right).select("p_id", "v_id", "score")
