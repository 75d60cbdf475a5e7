"""Registered queries of indexed search, near-text joins and ordered look-ups, over the driver's tables, with DuckDB SQL that computes the same.

Names, houses and ages that the tables don't have are derived from their keys by expressions, in the query and in its SQL alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlark.functions import textkeys as T
from ledgerlark.operators import dml, joins, lexicon, nearjoin, predicates as P, resolve, sequences as S, textindex
from ledgerlark.plans.catalogue import register, t
from ledgerlark.plans.forms import folded_sql, phonetic_sql, pick, pick_sql, spelt
from ledgerlark.sources import readers

# Given names in pairs of spellings, and family names, picked by the digits of a key.
GIVEN = ("अरुण", "अरूण", "सुरेश", "सूरेश", "दीपक", "दिपक", "किरण", "कीरन", "शिव", "सिव")
FAMILY = ("कुमार", "कूमार", "देवी", "लाल", "वर्मा", "बर्मा", "ज्ञानी")


# ------------------------------------------------------------------ search by index
FIELDS = ("exact", "folded", "sound")


def name_index(rows: DataFrame, key: str, name: Column, code: Column) -> textindex.TextIndex:
    folded = T.fold_devanagari(name)
    fields = {"exact": F.lower(name), "folded": folded, "sound": T.phonetic_key(folded), "code_low": F.lower(code)}
    return textindex.build(rows, key, fields, resolve.new_folder(rows.sparkSession, "text-index"))


def name_search(index: textindex.TextIndex, term: str) -> DataFrame:
    """Rows found by a term in a name as it is, folded or by sound, or in a code, with their rank (1 equal name, 2 in it, 3 folded, 4 sound, 5 code)."""
    forms = index.texts.sparkSession.range(1).select(*[c.alias(k) for k, c in T.expand_term(term).items()]).first()
    low, folded, sound = term.lower(), forms["folded"], forms["phonetic"]
    branches = [("exact", low), ("code_low", low)] + [("folded", folded)] * bool(folded) + [("sound", sound)] * bool(sound)
    holds = lambda c, form: F.coalesce(F.col(c).contains(form), F.lit(False)) & F.lit(form != "")
    tests = [F.col("exact") == low, P.like_folded(F.col("exact"), low), holds("folded", folded), holds("sound", sound), P.like_folded(F.col("code_low"), low)]
    found = index.search(branches, P.any_of([F.coalesce(x, F.lit(False)) for x in tests[1:]]))
    return found.withColumn("rank", P.relevance(tests[:4]))


def _search_sql(rows: str, key: str, name: str, code: str, term: str, folded: str, sound: str) -> str:
    return f"""
WITH n AS (SELECT {key}, {name} AS name, {code} AS code, {folded_sql(name)} AS folded FROM {rows}),
p AS (SELECT n.*, coalesce(s.phonetic, '') AS sound FROM n LEFT JOIN {phonetic_sql('n', key, 'folded')} s ON s.{key} = n.{key})
SELECT {key}, name, CASE WHEN lower(name) = '{term}' THEN 1 WHEN name ILIKE '%{term}%' THEN 2 WHEN contains(folded, '{folded}') THEN 3 WHEN contains(sound, '{sound}') THEN 4 ELSE 5 END AS rank
FROM p WHERE name ILIKE '%{term}%' OR contains(folded, '{folded}') OR contains(sound, '{sound}') OR code ILIKE '%{term}%'
"""


@register(_search_sql("part", "p_partkey", "p_name", "p_brand", "old g", "old g", "ALD K"))
def indexed_part_search(spark, folder):
    """Parts by a Latin term of two words, through the index."""
    index = name_index(t(spark, folder, "part").select("p_partkey", "p_name", "p_brand"), "p_partkey", F.col("p_name"), F.col("p_brand"))
    return name_search(index, "old g").select("p_partkey", F.col("p_name").alias("name"), "rank")


@register(_search_sql("part", "p_partkey", "p_name", "p_brand", "r_d%i", "r_d%i", "RD"))
def indexed_pattern_search(spark, folder):
    """A pattern whose literal runs are shorter than a trigram: the grams that hold one point to the candidates."""
    index = name_index(t(spark, folder, "part").select("p_partkey", "p_name", "p_brand"), "p_partkey", F.col("p_name"), F.col("p_brand"))
    return name_search(index, "r_d%i").select("p_partkey", F.col("p_name").alias("name"), "rank")


_PERSON = f"{pick_sql(GIVEN, 'c_custkey')} || ' ' || {pick_sql(FAMILY, 'c_custkey // 10')}"


@register(_search_sql("customer", "c_custkey", _PERSON, "c_name", "अरुण क", "अरुन क", "ARN K"))
def indexed_people_search(spark, folder):
    """People named by the digits of customers' keys, by a term that other spellings only share folded or by sound."""
    name = F.concat_ws(" ", pick(GIVEN, F.col("c_custkey")), pick(FAMILY, F.floor(F.col("c_custkey") / 10)))
    index = name_index(t(spark, folder, "customer").select("c_custkey", "c_name", name.alias("name")), "c_custkey", F.col("name"), F.col("c_name"))
    return name_search(index, "अरुण क").select("c_custkey", "name", "rank")


@register("""
WITH q AS (SELECT item_id, lower(substr(text, 1 + item_id % 3, 2 + item_id % 40)) AS term FROM benchmark)
SELECT item_id, doc_id, n_chars FROM q JOIN documents ON contains(lower(documents.text), q.term) WHERE q.term <> '' AND length(q.term) > 2
""")
def indexed_phrases_in_documents(spark, folder):
    """Every document that holds the first words of a benchmark text, for all benchmark texts at once."""
    docs = t(spark, folder, "documents").select("doc_id", "text", "n_chars")
    index = textindex.build(docs.select("doc_id", "n_chars", "text"), "doc_id", {"text": F.lower("text")}, resolve.new_folder(spark, "text-index"), copy=False)
    start, size = (1 + F.col("item_id") % 3).cast("int"), (2 + F.col("item_id") % 40).cast("int")
    terms = t(spark, folder, "benchmark").select("item_id", F.lower(F.substring("text", start, size)).alias("term")).where(F.length("term") > 2)
    return index.search_many("text", terms, "term", ["item_id"]).select("item_id", "doc_id", "n_chars")


# ------------------------------------------------------------------ near texts and duplicate people
@register("""
WITH p AS (SELECT DISTINCT p_type, p_name || '-' || p_size || '-' || p_brand AS label FROM part)
SELECT a.p_type, a.label AS x_label, b.label AS y_label, CAST(levenshtein(a.label, b.label) AS INTEGER) AS distance FROM p a JOIN p b ON a.p_type = b.p_type
WHERE abs(length(a.label) - length(b.label)) <= 2 AND (length(a.label) < length(b.label) OR length(a.label) = length(b.label) AND a.label < b.label) AND levenshtein(a.label, b.label) <= 2
""")
def near_part_labels(spark, folder):
    """Labels of one type at most two edits apart."""
    label = F.concat_ws("-", "p_name", "p_size", "p_brand").alias("label")
    return nearjoin.near_pairs(t(spark, folder, "part").select("p_type", label).distinct(), "label", ["p_type"], 2)


@register("""
SELECT a.c_name AS x_c_name, b.c_name AS y_c_name, 1 AS distance FROM (SELECT DISTINCT c_name FROM customer) a JOIN (SELECT DISTINCT c_name FROM customer) b
ON length(a.c_name) <= length(b.c_name) AND (length(a.c_name) < length(b.c_name) OR a.c_name < b.c_name) AND levenshtein(a.c_name, b.c_name) = 1
""")
def near_customer_names(spark, folder):
    """Names one edit apart, all of one beginning."""
    return nearjoin.near_pairs(t(spark, folder, "customer").select("c_name").distinct(), "c_name", [], 1)


def people(spark: SparkSession, folder: str) -> DataFrame:
    """People out of customers: neighbouring keys share a name, a relation and a house, which every few rows spell or state otherwise."""
    k, base = F.col("c_custkey"), F.floor(F.col("c_custkey") / 3)
    given = spelt(base * 7 + 3, 3)
    given = F.when(k % 9 == 1, F.replace(given, F.lit("a"), F.lit("aa"))).when(k % 9 == 5, F.concat(given, F.lit("n"))).when(k % 9 == 7, F.replace(given, F.lit("s"), F.lit("sh"))).otherwise(given)
    kin = F.when(k % 11 == 4, F.concat(spelt(base, 2), F.lit(" lal"))).otherwise(spelt(base, 2))
    return t(spark, folder, "customer").select(
        k.alias("id"), F.when(k % 17 == 2, F.concat(F.lit("ABC"), F.lpad((base % 40).cast("string"), 7, "0"))).alias("code"),
        F.concat_ws(" ", given, pick(("kumar", "devi", "lal"), base)).alias("name"), kin.alias("relation"),
        F.when(k % 5 == 3, F.lit("0")).otherwise((base % 25).cast("string")).alias("house"), F.when(k % 13 == 6, F.lit(None)).otherwise(20 + base % 60 + k % 3 * 2).cast("int").alias("age"),
        F.when(k % 7 == 1, F.lit(None)).otherwise(pick(("M", "F"), base)).alias("gender"), (F.col("c_nationkey") % 2).cast("string").alias("place"),
    )


@register()
def people_duplicates(spark, folder):
    """All four tiers over people out of customers; sequence similarity has no SQL, so tests hold it against all pairs."""
    return resolve.clusters(resolve.duplicate_links(people(spark, folder)))


# ------------------------------------------------------------------ ranges, nearest rows, assignment
@register("""
WITH r AS (SELECT o_orderkey, o_totalprice / 10 AS lo, o_totalprice / 10 + o_custkey % 50 AS hi, o_orderstatus FROM orders),
m AS (SELECT v.price, min(o_orderkey) AS o_orderkey FROM (SELECT DISTINCT l_extendedprice AS price FROM lineitem) v JOIN r ON v.price BETWEEN lo AND hi GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, r.o_orderkey, r.o_orderstatus FROM lineitem LEFT JOIN m ON m.price = l_extendedprice LEFT JOIN r ON r.o_orderkey = m.o_orderkey
""")
def first_range_of_many(spark, folder):
    """The first of as many ranges as there are orders that holds each line's price."""
    lo = F.col("o_totalprice") / 10
    ranges = t(spark, folder, "orders").select("o_orderkey", "o_orderstatus", lo.alias("lo"), (lo + F.col("o_custkey") % 50).alias("hi"))
    lines = t(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return joins.range_first(lines, "l_extendedprice", ranges, "lo", "hi", "o_orderkey").drop("lo", "hi")


@register("""
WITH o AS (SELECT o_orderkey, o_custkey % 10 AS part, o_orderkey // 2 AS serial, o_orderpriority AS label, o_orderstatus = 'F' AS known FROM orders),
k AS (SELECT part, serial, min(label) AS label FROM o WHERE known GROUP BY 1, 2),
n AS (SELECT o.o_orderkey, k.serial, k.label, row_number() OVER (PARTITION BY o.o_orderkey ORDER BY abs(o.serial - k.serial), k.serial) AS n FROM o LEFT JOIN k ON k.part = o.part AND abs(o.serial - k.serial) <= 7 WHERE NOT known)
SELECT o_orderkey, serial AS near_at, label FROM n WHERE n = 1
""")
def nearest_label(spark, folder):
    """Orders without a label take the one of the nearest labelled serial of their part, at most 7 away."""
    rows = t(spark, folder, "orders").select("o_orderkey", (F.col("o_custkey") % 10).alias("part"), F.floor(F.col("o_orderkey") / 2).alias("serial"), F.col("o_orderpriority").alias("label"), "o_orderstatus")
    open_ = rows.where("o_orderstatus <> 'F'").select("o_orderkey", "part", "serial")
    return joins.nearest_within(open_, rows.where("o_orderstatus = 'F'"), ["part"], "serial", 7, ["label"]).select("o_orderkey", "near_at", "label")


@register("""
WITH RECURSIVE p AS (
  SELECT a.o_custkey AS c, a.o_orderkey AS a, b.o_orderkey AS b, CAST(round(abs(a.o_totalprice - b.o_totalprice) * 100) AS BIGINT) AS gap
  FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderstatus = 'O' AND b.o_orderstatus = 'F' AND abs(CAST(round(a.o_totalprice * 100) AS BIGINT) - CAST(round(b.o_totalprice * 100) AS BIGINT)) <= 10000000
), k AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY gap, a, b) AS k FROM p),
g(c, k, a, b, gap, la, lb, ok) AS (
  SELECT c, k, a, b, gap, [a], [b], true FROM k WHERE k = 1
  UNION ALL
  SELECT k.c, k.k, k.a, k.b, k.gap, CASE WHEN list_contains(la, k.a) OR list_contains(lb, k.b) THEN la ELSE list_append(la, k.a) END,
         CASE WHEN list_contains(la, k.a) OR list_contains(lb, k.b) THEN lb ELSE list_append(lb, k.b) END, NOT (list_contains(la, k.a) OR list_contains(lb, k.b))
  FROM g JOIN k ON k.c = g.c AND k.k = g.k + 1
) SELECT a, b, -gap AS score FROM g WHERE ok
""")
def family_assignment(spark, folder):
    """Open orders of a customer assigned to finished ones of near price, one to one, best first."""
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    rows = t(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", cents.alias("price"))
    x = rows.where("o_orderstatus = 'O'").select("o_custkey", F.col("o_orderkey").alias("a"), F.col("price").alias("pa"))
    y = rows.where("o_orderstatus = 'F'").select("o_custkey", F.col("o_orderkey").alias("b"), F.col("price").alias("pb"))
    near = joins.band_join(x, y, ["o_custkey"], "pa", "pb", 10_000_000)
    return joins.assign_best(near.select("a", "b", (-F.abs(F.col("pa") - F.col("pb"))).alias("score")), "a", "b", "score")


# ------------------------------------------------------------------ replay of an edit log
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
_SEG = f"[{', '.join(repr(s) for s in SEGMENTS)}]"


@register(f"""
WITH RECURSIVE bulk AS (
  SELECT n_nationkey * 97 + 50 AS id, {_SEG}[n_nationkey % 5 + 1] AS match, CASE WHEN n_nationkey % 4 < 2 THEN {_SEG}[(n_nationkey * 3 + 1) % 5 + 1] END AS seg,
         CASE WHEN n_nationkey % 3 = 0 THEN n_regionkey END AS nation FROM nation
), r AS (SELECT c_custkey AS k, c_name AS name, c_mktsegment AS seg, c_nationkey AS nation, 0 AS since FROM customer UNION ALL SELECT 10000000 + s_suppkey, s_name, {_SEG}[s_suppkey % 5 + 1], s_nationkey, s_suppkey * 5 + 3 FROM supplier),
ev AS (
  SELECT k, id, 'bulk' AS what, match, bulk.seg, bulk.nation, NULL AS name FROM r, bulk WHERE id > since
  UNION ALL SELECT c_custkey, c_custkey * 2 + 1, 'set', NULL, NULL, NULL, 'named ' || c_custkey FROM customer WHERE c_custkey % 3 = 0
  UNION ALL SELECT c_custkey, c_custkey + 1000 - c_custkey % 2 * 500, 'set', NULL, {_SEG}[c_nationkey % 5 + 1], 90 + c_nationkey, NULL FROM customer WHERE c_custkey % 4 = 1
), o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY id) AS n FROM ev),
g AS (
  SELECT k, name, seg, nation, 0 AS n FROM r
  UNION ALL
  SELECT g.k, CASE WHEN what = 'set' THEN coalesce(o.name, g.name) ELSE g.name END, CASE WHEN what = 'set' OR match = g.seg THEN coalesce(o.seg, g.seg) ELSE g.seg END,
         CASE WHEN what = 'set' OR match = g.seg THEN coalesce(o.nation, g.nation) ELSE g.nation END, o.n FROM g JOIN o ON o.k = g.k AND o.n = g.n + 1
)
SELECT k AS c_custkey, arg_max(name, n) AS c_name, CAST(arg_max(nation, n) AS INTEGER) AS c_nationkey, arg_max(seg, n) AS c_mktsegment FROM g WHERE k % 13 <> 6 OR k >= 10000000 GROUP BY 1
""")
def replayed_edits(spark, folder):
    """A log in which edits of single customers, added rows, deletions and edits of whole segments (which rename segments) alternate."""
    rows = t(spark, folder, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    k, text = F.col("c_custkey"), lambda c: c.cast("string")
    none, no_match = F.lit(None).cast("long"), F.lit(None).cast("string")
    edit = lambda df, number, action, target, match, proposed: df.select(number.cast("long").alias("edit_id"), F.lit(action).alias("action"), target.alias("target_id"), match.alias("match"), proposed.alias("proposed"))
    fields = lambda **v: F.map_filter(F.create_map(*[x for n, c in v.items() for x in (F.lit(n), c)]), lambda _, x: x.isNotNull())
    named = edit(rows.where(k % 3 == 0), k * 2 + 1, "UPDATE", k, no_match, fields(c_name=F.concat(F.lit("named "), text(k))))
    moved = edit(rows.where(k % 4 == 1), k + 1000 - k % 2 * 500, "UPDATE", k, no_match, fields(c_mktsegment=pick(SEGMENTS, F.col("c_nationkey")), c_nationkey=text(F.col("c_nationkey") + 90)))
    gone = edit(rows.where(k % 13 == 6), k * 7 + 5, "DELETE", k, no_match, fields(c_name=F.lit("x")))
    s = F.col("s_suppkey")
    added = fields(c_custkey=text(s + 10_000_000), c_name=F.col("s_name"), c_mktsegment=pick(SEGMENTS, s), c_nationkey=text(F.col("s_nationkey")))
    added = edit(t(spark, folder, "supplier"), s * 5 + 3, "ADD", none, no_match, added)
    n = F.col("n_nationkey")
    whole = fields(c_mktsegment=F.when(n % 4 < 2, pick(SEGMENTS, n * 3 + 1)), c_nationkey=F.when(n % 3 == 0, text(F.col("n_regionkey"))), c_name=F.lit("  "))
    whole = edit(t(spark, folder, "nation"), n * 97 + 50, "BULK", none, pick(SEGMENTS, n), whole)
    log = named.unionByName(moved).unionByName(gone).unionByName(added).unionByName(whole).withColumn("status", F.lit("approved"))
    return dml.replay_edits(rows, log, "c_custkey", "c_mktsegment", ["c_name", "c_nationkey", "c_mktsegment"])


# ------------------------------------------------------------------ deep pages, statistics of a written table, running page numbers
@register("SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 1225")
def deep_order_page(spark, folder):
    return P.deep_page(t(spark, folder, "orders"), "o_totalprice", "o_orderkey", 50, 25, descending=True).select("o_orderkey", "o_totalprice", "o_orderstatus")


@register(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) FILTER ({v} IS NULL) AS nulls, CAST(min({v}) AS VARCHAR) AS low, CAST(max({v}) AS VARCHAR) AS high FROM orders"
    for c, v in (("o_orderkey", "o_orderkey"), ("o_custkey", "nullif(o_custkey % 10, 3)"), ("o_orderpriority", "nullif(o_orderpriority, '1-URGENT')"))
))
def statistics_of_a_write(spark, folder):
    """Row count, null counts and spans of a table, seen while it is written."""
    orders = t(spark, folder, "orders").select("o_orderkey", F.nullif(F.col("o_custkey") % 10, F.lit(3)).alias("o_custkey"), F.nullif("o_orderpriority", F.lit("1-URGENT")).alias("o_orderpriority"))
    return readers.write_observed(orders, resolve.new_folder(spark, "observed"), orders.columns)


@register("""
WITH RECURSIVE p AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page FROM orders),
v AS (
  SELECT o_custkey, page, l_linenumber - 1 AS c, min((page - 1) * 30 + 1 + CASE l_partkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 20 + l_suppkey % 9 WHEN 2 THEN l_suppkey % 5 ELSE l_suppkey % 50 - 25 END) AS s
  FROM p JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber <= 3 AND l_partkey % 5 > 0 GROUP BY 1, 2, 3
), l AS (
  SELECT p.o_custkey, p.page, (p.page - 1) * 30 + 1 AS formula, 25 + p.o_orderkey % 8 AS n, coalesce(list(v.s ORDER BY v.c) FILTER (v.s IS NOT NULL), []) AS s, min(CASE WHEN v.c = 0 THEN v.s END) AS first
  FROM p LEFT JOIN v ON v.o_custkey = p.o_custkey AND v.page = p.page GROUP BY 1, 2, 3, 4
), a AS (SELECT *, list_filter(s, lambda x: x >= 1 AND len(list_filter(s, lambda y: y = x)) >= 2)[1] AS agreed FROM l),
g AS (
  SELECT o_custkey, 0::BIGINT AS page, 0::BIGINT AS start, 0::BIGINT AS running FROM a WHERE page = 1
  UNION ALL
  SELECT o_custkey, page, start, start + n FROM (
    SELECT a.o_custkey, a.page, a.n, CASE
      WHEN agreed IS NOT NULL THEN agreed
      WHEN first >= 1 AND (running > 1 AND abs(first - running) <= 6 OR first <= formula + 10 OR running <= 1) THEN first
      WHEN running > 1 THEN coalesce(list_filter(s, lambda x: abs(x - running) <= 5)[1], running) ELSE greatest(1, formula) END AS start
    FROM g JOIN a ON a.o_custkey = g.o_custkey AND a.page = g.page + 1)
)
SELECT o_custkey, page, start FROM g WHERE page > 0
""")
def running_page_starts(spark, folder):
    """The number each order of a customer, taken as a page, begins with, from what its first three lines say."""
    at = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long")
    pages = t(spark, folder, "orders").select("o_custkey", "o_orderkey", at.alias("page"), (25 + F.col("o_orderkey") % 8).alias("n"))
    pages = pages.withColumn("formula", (F.col("page") - 1) * 30 + 1)
    k, s = F.col("l_partkey") % 4, F.col("l_suppkey")
    lines = t(spark, folder, "lineitem").where("l_linenumber <= 3 AND l_partkey % 5 > 0").groupBy(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_linenumber") - 1).alias("column"))
    off = F.when(k == 0, 0).when(k == 1, 20 + s % 9).when(k == 2, s % 5).otherwise(s % 50 - 25)
    votes = lines.agg(F.min(off).alias("off")).groupBy("o_orderkey").agg(F.sort_array(F.collect_list(F.struct("column", "off"))).alias("offs"))
    seen = pages.join(votes, "o_orderkey", "left").withColumn("votes", F.coalesce(F.transform("offs", lambda v: F.struct(v["column"].alias("column"), (v["off"] + F.col("formula")).alias("start"))), F.array()))
    return S.running_starts(seen, "o_custkey", "page", "votes", "n", "formula").select("o_custkey", "page", "start")


# ------------------------------------------------------------------ compounds and typos, over a lexicon of the documents themselves
_WORDS = "SELECT w AS word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[^\\x00-\\x60\\x7B-\\x7F]+')) AS w FROM documents) GROUP BY 1"


@register(f"""
WITH RECURSIVE c AS ({_WORDS}), l AS (SELECT word FROM c WHERE n >= 20 AND length(word) BETWEEN 3 AND 12),
s AS (SELECT word FROM c WHERE n < 20 AND length(word) >= 6),
p AS (
  SELECT word, 0::BIGINT AS pos, []::VARCHAR[] AS pieces FROM s
  UNION ALL
  SELECT p.word, p.pos + length(l.word), list_append(pieces, l.word) FROM p JOIN l ON substr(p.word, p.pos + 1, 3) = substr(l.word, 1, 3) AND substr(p.word, p.pos + 1, length(l.word)) = l.word
)
SELECT word, array_to_string(pieces, '+') AS pieces FROM (SELECT word, pieces, row_number() OVER (PARTITION BY word ORDER BY len(pieces), pieces) AS n FROM p WHERE pos = length(word)) WHERE n = 1
""")
def compound_words(spark, folder):
    """Rare words of the documents that frequent ones make up."""
    counts = resolve.cut(lexicon.word_counts(t(spark, folder, "documents"), "text"), "word-counts")
    found = lexicon.split_compounds(counts.where("n < 20"), counts.where("n >= 20 AND length(word) BETWEEN 3 AND 12"), 3, 12)
    return found.select("word", F.array_join("pieces", "+").alias("pieces"))


@register(f"""
WITH c AS ({_WORDS}), l AS (SELECT * FROM c WHERE n >= 50 AND length(word) >= 4), s AS (SELECT word FROM c WHERE n = 1 AND length(word) >= 4),
p AS (
  SELECT s.word, l.word AS correction, l.n, length(s.word) - length(l.word) AS d, list_filter(range(1, length(s.word) + 1), lambda i: substr(s.word, i, 1) <> substr(l.word, i, 1)) AS off
  FROM s JOIN l ON abs(length(s.word) - length(l.word)) <= 1 AND (left(s.word, 1) = left(l.word, 1) OR right(s.word, 1) = right(l.word, 1))
), m AS (
  SELECT word, correction, n FROM p WHERE CASE d
    WHEN 0 THEN len(off) = 1 OR len(off) = 2 AND off[2] = off[1] + 1 AND substr(word, off[1], 1) = substr(correction, off[2], 1) AND substr(word, off[2], 1) = substr(correction, off[1], 1)
    WHEN 1 THEN left(word, coalesce(off[1], length(word)) - 1) || substr(word, coalesce(off[1], length(word)) + 1) = correction
    ELSE left(correction, coalesce(off[1], length(correction)) - 1) || substr(correction, coalesce(off[1], length(correction)) + 1) = word END)
SELECT word, correction, n FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY n DESC, correction) AS k FROM m) WHERE k = 1
""")
def corrected_words(spark, folder):
    """Words that occur once, one slip away from a frequent one."""
    counts = resolve.cut(lexicon.word_counts(t(spark, folder, "documents"), "text"), "word-counts").where("length(word) >= 4")
    return lexicon.correct(counts.where("n = 1"), counts.where("n >= 50"))
