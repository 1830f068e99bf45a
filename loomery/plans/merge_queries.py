"""Queries of merges, look-ups, semi joins and de-duplication."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomery.operators import merge as M
from loomery.plans.registry import register
from loomery.sources.tables import table


def _halves(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return o.where("o_orderkey % 3 <> 0"), o.where("o_orderkey % 3 <> 1").withColumn("o_totalprice", F.col("o_totalprice") + 1)


@register("merge_summary_full_outer", """
WITH o AS (SELECT * FROM orders WHERE o_orderkey % 3 <> 0), n AS (SELECT * FROM orders WHERE o_orderkey % 3 <> 1)
SELECT coalesce(n.o_orderkey, o.o_orderkey) AS o_orderkey, coalesce(n.o_orderstatus, o.o_orderstatus) AS o_orderstatus, round(coalesce(n.o_totalprice + 1, o.o_totalprice), 2) AS o_totalprice,
  CASE WHEN o.o_orderkey IS NULL THEN 1 ELSE 0 END AS place
FROM o FULL JOIN n ON o.o_orderkey = n.o_orderkey""")
def merge_summary_full_outer(spark, sf_dir):
    old, new = (d.withColumn("at", F.col("o_orderkey")) for d in _halves(spark, sf_dir))
    out = M.merge_by_key(old, new, "o_orderkey", "at")
    return out.select("o_orderkey", "o_orderstatus", F.round("o_totalprice", 2).alias("o_totalprice"), F.col("place.group").alias("place"))


@register("snapshot_diff", """
SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'added' ELSE 'removed' END AS change FROM orders WHERE o_orderkey % 3 < 2""")
def snapshot_diff(spark, sf_dir):
    return M.snapshot_diff(*_halves(spark, sf_dir), "o_orderkey")


@register("anti_urls", "SELECT DISTINCT url FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 2 = 0)")
def anti_urls(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("url", "page_id")
    return p.select("url").distinct().join(p.where("page_id % 2 = 0").select("url"), "url", "left_anti")


@register("substring_semi_join", """
SELECT DISTINCT doc_id, item_id FROM documents d, benchmark b WHERE contains(d.text, b.text)""")
def substring_semi_join(spark, sf_dir):
    needles = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("needle"))
    return M.substring_join(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", needles, "needle").select("doc_id", "item_id").distinct()


@register("whitelist_match", """
SELECT p_partkey, p_name FROM part WHERE p_partkey IN (1, 2, 3) OR p_name IN ('part 10', 'x') OR contains(p_name, 'part 10')""")
def whitelist_match(spark, sf_dir):
    return M.whitelisted(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey", "p_name", ["1", "2", "3"], ["part 10", "x"])


@register("lookup_cascade", """
WITH r AS (SELECT DISTINCT (n_nationkey * 7)::VARCHAR AS wanted FROM nation UNION SELECT c_name FROM customer WHERE c_custkey < 20 UNION SELECT 'nobody')
SELECT wanted, coalesce(a.c_custkey, b.c_custkey)::VARCHAR AS id, CASE WHEN a.c_custkey IS NOT NULL THEN 'id' WHEN b.c_custkey IS NOT NULL THEN 'name' END AS kind
FROM r LEFT JOIN customer a ON wanted = a.c_custkey::VARCHAR LEFT JOIN customer b ON wanted = b.c_name""")
def lookup_cascade(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    r = table(spark, sf_dir, "nation").select((F.col("n_nationkey") * 7).cast("string").alias("wanted"))
    r = r.unionByName(c.where("c_custkey < 20").select(F.col("c_name").alias("wanted"))).unionByName(spark.createDataFrame([("nobody",)], "wanted string"))
    return M.lookup_cascade(r, "wanted", c, [("id", "c_custkey"), ("name", "c_name")], "c_custkey").withColumn("id", F.col("id").cast("string"))


@register("dedupe_exact_rank", """
SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY md5(coalesce(text, '')) ORDER BY length(source) DESC, source, doc_id) = 1""")
def dedupe_exact_rank(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.md5(F.coalesce("text", F.lit(""))).alias("h"))
    return M.first_of_each(d, ["h"], [F.length("source").desc(), F.col("source"), F.col("doc_id")]).drop("h")


@register("dedupe_greedy_multi_key")
def dedupe_greedy_multi_key(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    e = d.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.md5("text")).alias("doc_no"), F.substring("text", 1, 40).alias("title"), F.concat_ws("/", "source", F.length("text")).alias("path"))
    return M.greedy_dedupe(e, "doc_id")


@register("catalog_merge", """
SELECT source, list(lang ORDER BY first_at) AS langs, arg_max(last_text, last_at) AS summary, max(last_at) AS last_id, min(first_at) AS place FROM (
  SELECT source, lang, min(doc_id) AS first_at, max(doc_id) AS last_at, arg_max(substr(text, 1, 20), doc_id) AS last_text FROM documents GROUP BY source, lang) GROUP BY source""")
def catalog_merge(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", "doc_id", F.array("lang").alias("langs"), F.substring("text", 1, 20).alias("summary"), F.col("doc_id").alias("last_id"))
    return M.catalogue_merge(d, "source", "doc_id", ["langs"], ["summary"], ["last_id"])


@register("reasons_merge", """
SELECT c_nationkey, string_agg(c_mktsegment, '; ' ORDER BY first_at) AS reason FROM (SELECT c_nationkey, c_mktsegment, min(c_custkey) AS first_at FROM customer GROUP BY ALL) GROUP BY c_nationkey""")
def reasons_merge(spark, sf_dir):
    return M.reasons_merge(table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", F.col("c_mktsegment").alias("reason")), "c_nationkey", "c_custkey", "reason")


@register("bfs_reachability", """
WITH RECURSIVE e AS (SELECT n_nationkey AS src, (n_nationkey * 2 + 1) % 25 AS dst FROM nation UNION ALL SELECT n_nationkey, (n_nationkey + 7) % 25 FROM nation),
r AS (SELECT 0 AS node, 0 AS depth UNION SELECT dst, depth + 1 FROM r JOIN e ON node = src WHERE depth < 25)
SELECT node, min(depth)::INT AS depth FROM r GROUP BY node""")
def bfs_reachability(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("src"))
    e = n.select("src", ((F.col("src") * 2 + 1) % 25).alias("dst")).unionByName(n.select("src", ((F.col("src") + 7) % 25).alias("dst")))
    return M.reachable(e, [0])


@register("latest_record", "SELECT user_id, max(ts) AS ts, arg_max(event_type, event_id) AS event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1 GROUP BY user_id")
def latest_record(spark, sf_dir):
    g = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.struct("event_id", "ts", "event_type")).alias("m"))
    return g.select("user_id", "m.ts", "m.event_type")
