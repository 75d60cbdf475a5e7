"""The registered queries of the training-data operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, exact_dedup, jaccard_join, language_id, mixing, packing, passages, prefix_trie, resampling, suffix_dedup, topk, toxicity, url_filter
from .common import table

BLOCKED = [("net", "/"), ("example.com", "/de/")]
ALLOWED = [("example.net", "/en/"), ("org", "/fr/")]


@cache
def encoder() -> packing.Encoder:
    """One encoder for each worker process; the tokenizer files stay where they are installed."""
    import public_tokenizers

    return packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def make_encoder() -> packing.Encoder:
    return encoder()


def op1_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_groups(table(spark, sf_dir, "documents"), size=4, num=85)


def op3_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), make_encoder)
    return pieces.select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset"
    )


def op4_kdtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    model = language_id.learn(docs, fold != 2)
    out = language_id.predict(docs.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "text"), model, ["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "lang_pred", "score")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_dedup.exact_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    lexicon = toxicity.learn(docs, table(spark, sf_dir, "labels"), fold != 0)
    out = toxicity.score(docs.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "text"), lexicon, ["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "score", "predicted")


def op8_shared_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.shared_passages(table(spark, sf_dir, "documents"))


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), BLOCKED, ALLOWED)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    kept = F.lower(F.coalesce(F.sha2("kept", 256), F.hex("digest"))).alias("kept_sha256")
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", kept, (F.col("n_removed") > 0).alias("removed"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=25, seed=7)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op13_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), k=10)


QUERIES = {
    f.__name__: f
    for f in (
        op1_cube_mix, op2_jaccard_join, op3_bin_completion, op4_kdtree_topk, op5_language_id, op6_exact_dedup, op7_toxicity,
        op8_shared_passages, op9_url_rules, op10_suffix_dedup, op11_importance_resampling, op12_prefix_trie, op13_posting_lists,
    )
}

#: CRC-32 of a string's bytes, four bits at a time: columns c16 (the table of the sixteen remainders) and s (the string) give it.
CRC16 = "list_transform(range(16), lambda n: list_reduce([0, 0, 0, 0], lambda c, k: xor(c >> 1, (c & 1) * 3988292384), n))"
CRC32 = """xor(list_reduce(list_transform(range(length(hex(s))), lambda i: CAST(strpos('0123456789ABCDEF', substr(hex(s), xor(i, 1) + 1, 1)) - 1 AS BIGINT)),
  lambda c, x: xor(c16[(xor(c, x) & 15) + 1], c >> 4), 4294967295), 4294967295)"""

ORACLE_SQL = {
    "op2_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2], w[i + 3])))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(root) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY 1
""",
    "op4_kdtree_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5
""",
    "op6_exact_dedup": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
""",
    "op9_url_rules": """
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         substr(regexp_extract(rest, '^[^?#]*'), length(regexp_extract(rest, '^[^/?#]*')) + 1) AS path FROM u
), r(rule_host, rule_path, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), m AS (
  SELECT page_id, host, path, rule_host || rule_path AS rule, r.verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC NULLS LAST) AS n
  FROM h LEFT JOIN r ON ('.' || host) LIKE ('%.' || rule_host) AND starts_with(path, rule_path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE n = 1
""",
    "op11_importance_resampling": rf"""
WITH c AS (SELECT {CRC16} AS c16),
w AS (
  SELECT true AS own, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT false, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
), f AS (SELECT own, doc_id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS s FROM w),
g AS (SELECT own, doc_id, s, count(*) AS n FROM f GROUP BY ALL),
b AS (SELECT s, {CRC32} % 10000 AS bucket FROM (SELECT DISTINCT s FROM g), c),
h AS (SELECT own, doc_id, bucket, sum(n) AS n FROM g JOIN b USING (s) GROUP BY ALL),
k AS (SELECT bucket, coalesce(sum(n) FILTER (own), 0) AS s, coalesce(sum(n) FILTER (NOT own), 0) AS t FROM h GROUP BY 1),
a AS (SELECT coalesce(sum(s), 0) AS s, coalesce(sum(t), 0) AS t FROM k),
gain AS (
  SELECT bucket, floor(1000 * ln((CAST(k.t AS DOUBLE) + 1) * (CAST(a.s AS DOUBLE) + 10000) / ((CAST(k.s AS DOUBLE) + 1) * (CAST(a.t AS DOUBLE) + 10000)))) AS gain FROM k, a
), d AS (SELECT doc_id, sum(n) AS n, floor(sum(n * gain) / sum(n)) AS weight FROM h JOIN gain USING (bucket) WHERE own GROUP BY 1),
e AS (
  SELECT w.doc_id, len(w.w) AS words, CAST(coalesce(d.n, 0) AS BIGINT) AS n_features, CAST(coalesce(d.weight, 0) AS BIGINT) AS weight,
         CAST('0x' || substr(sha256('7:' || w.doc_id), 1, 8) AS BIGINT) AS h FROM w LEFT JOIN d USING (doc_id) WHERE own
), r AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM e),
o AS (SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id) AS k, count(*) OVER (PARTITION BY words >= 20) AS n FROM r)
SELECT doc_id, n_features, weight, score, CASE WHEN words >= 20 AND k <= 25 * n // 100 THEN k END AS rank FROM o
""",
    "op12_prefix_trie": f"""
WITH c AS (SELECT {CRC16} AS c16),
o AS (
  SELECT conv_id, list((coalesce(role, ''), coalesce(text, '')) ORDER BY turn NULLS FIRST) AS t FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1
), h AS (SELECT conv_id, t, {CRC32} % 6 AS h FROM (SELECT *, CAST(conv_id AS VARCHAR) AS s FROM o), c),
r AS (
  SELECT h.conv_id, list_concat(coalesce(list_slice(b.t, 1, h.h), []), list_slice(h.t, h.h + 1, len(h.t))) AS t
  FROM h LEFT JOIN o b ON b.conv_id = h.conv_id - h.conv_id % 100
), m AS (SELECT conv_id, len(t) AS size, d, list_slice(t, 1, d) AS p FROM (SELECT *, unnest(range(0, len(t) + 1)) AS d FROM r)),
n AS (
  SELECT p, d, min(conv_id) AS conv_id, count(*) AS n, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (size = d), '') AS ends,
         CASE WHEN d > 0 THEN length(p[d][2]) ELSE 0 END AS chars FROM m GROUP BY p, d
), k AS (SELECT list_slice(p, 1, d - 1) AS p, d - 1 AS d, count(*) AS children FROM n WHERE d > 0 GROUP BY ALL),
f AS (SELECT n.*, coalesce(k.children, 0) AS children FROM n LEFT JOIN k ON k.p = n.p AND k.d = n.d),
u AS (SELECT list_slice(p, 1, a) AS p, a AS d, count(*) FILTER (children = 0) AS leaves, sum((n - 1) * chars) AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM f) GROUP BY ALL)
SELECT f.conv_id, f.d AS depth, q.conv_id AS parent_conv_id, f.n AS n_convs, f.children AS n_children, u.leaves AS n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM f JOIN u ON u.p = f.p AND u.d = f.d LEFT JOIN f q ON q.d = f.d - 1 AND q.p = list_slice(f.p, 1, f.d - 1)
""",
}
