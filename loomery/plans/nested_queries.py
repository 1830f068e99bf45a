"""Queries of nested records. Trees are made of regions, nations, suppliers and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomery.operators import nested as N
from loomery.plans.registry import register
from loomery.sources.tables import table


def _tree(spark, sf_dir):
    """(id, json): for each region an object of its nations, with suppliers and customers two levels further down."""
    s = leaf_of(table(spark, sf_dir, "supplier"), "s", "s_suppkey")
    c = leaf_of(table(spark, sf_dir, "customer"), "c", "c_custkey")
    n = table(spark, sf_dir, "nation").join(s, F.col("n_nationkey") == F.col("s_n"), "left").join(c, F.col("n_nationkey") == F.col("c_n"), "left")
    nation = F.struct(F.col("n_name").alias("title"), F.lit(0).alias("id"), F.struct(F.col("s_rows").alias("policies"), F.struct(F.col("c_rows").alias("deep")).alias("more")).alias("children"))
    rows = n.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", nation.alias("x")))).alias("a"))
    r = table(spark, sf_dir, "region").join(rows, F.col("r_regionkey") == F.col("n_regionkey"))
    tree = F.struct(F.col("r_name").alias("title"), F.col("r_name").alias("id"), F.lit("").alias("summary"), F.transform("a", lambda x: x["x"]).alias("nations"))
    return r.select(F.col("r_regionkey").alias("id"), F.to_json(tree).alias("json"))


def leaf_of(rows, p: str, key: str):
    one = F.struct(F.col(f"{p}_name").alias("title"), F.when(F.col(key) % 3 == 0, F.concat(F.lit(" d"), F.col(key).cast("string"))).alias("document_id"), F.when(F.col(key) % 2 == 0, " kept ").alias("summary"))
    return rows.groupBy(F.col(f"{p}_nationkey").alias(f"{p}_n")).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), one.alias("x")))), lambda x: x["x"]).alias(f"{p}_rows"))


@register("catalogue_harvest", """
SELECT r_regionkey AS id, r_name AS title, r_name AS node_id, NULL AS summary FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)
UNION ALL SELECT n_regionkey, n_name, NULL, NULL FROM nation
UNION ALL SELECT n_regionkey, s_name, CASE WHEN s_suppkey % 3 = 0 THEN 'd' || s_suppkey END, CASE WHEN s_suppkey % 2 = 0 THEN 'kept' END FROM supplier JOIN nation ON n_nationkey = s_nationkey
UNION ALL SELECT n_regionkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN 'd' || c_custkey END, CASE WHEN c_custkey % 2 = 0 THEN 'kept' END FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def catalogue_harvest(spark, sf_dir):
    """All titled nodes of trees of five levels, found without knowing their schema."""
    return N.catalogue_nodes(_tree(spark, sf_dir)).select("id", "title", "node_id", "summary")


@register("whitelisted_entries", """
WITH w AS (SELECT DISTINCT s_name AS name FROM supplier WHERE s_suppkey % 3 = 0), i AS (SELECT (s_suppkey * 5)::VARCHAR AS id FROM supplier),
e AS (SELECT o_orderkey AS entry, o_orderkey::VARCHAR AS id, CASE o_orderkey % 4 WHEN 0 THEN o_clerk WHEN 1 THEN o_clerk || ' rest' WHEN 2 THEN left(o_clerk, 5) ELSE 'x' END AS title, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey + 1 END AS d_id, 'of ' || o_clerk AS d_title FROM (
  SELECT o_orderkey, 'Supplier#' || lpad((o_custkey % 40)::VARCHAR, 9, '0') AS o_clerk FROM orders))
SELECT entry FROM e WHERE id IN (SELECT id FROM i) OR EXISTS (SELECT 1 FROM w WHERE contains(e.title, w.name)) OR (d_id IS NOT NULL AND (d_id::VARCHAR IN (SELECT id FROM i) OR EXISTS (SELECT 1 FROM w WHERE contains(e.d_title, w.name))))""")
def whitelisted_entries(spark, sf_dir):
    """Orders as entries, some with a duplicate, against a white list of suppliers' names and ids that is a nested JSON text for each nation."""
    s = table(spark, sf_dir, "supplier")
    names = F.collect_list(F.when(F.col("s_suppkey") % 3 == 0, F.col("s_name")))
    ids = F.collect_list((F.col("s_suppkey") * 5).cast("string"))
    lists = s.groupBy(F.col("s_nationkey").alias("id")).agg(F.to_json(F.struct(names.alias("policy_titles"), F.struct(F.transform(ids, lambda x: F.struct(x.alias("id"))).alias("entries")).alias("policies"))).alias("json"))
    k = F.col("o_orderkey")
    clerk = F.concat(F.lit("Supplier#"), F.lpad((F.col("o_custkey") % 40).cast("string"), 9, "0"))
    title = F.when(k % 4 == 0, clerk).when(k % 4 == 1, F.concat(clerk, F.lit(" rest"))).when(k % 4 == 2, F.left(clerk, F.lit(5))).otherwise("x")
    twin = F.when(k % 5 == 0, F.array(F.struct((k + 1).cast("string").alias("id"), F.concat(F.lit("of "), clerk).alias("title"))))
    entries = table(spark, sf_dir, "orders").select(k.alias("entry"), k.cast("string").alias("id"), title.alias("title"), twin.alias("duplicates"))
    return N.whitelisted_entries(entries, N.whitelist_names(lists)).select("entry")


@register("paths_rewritten", """
SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'pages/' || page_id || '.html' WHEN 1 THEN '/other/' || page_id ELSE 'x/' || page_id END AS one,
  ['a/' || page_id, '/root2/a'] AS many, CASE WHEN page_id % 2 = 0 THEN 'm/' || page_id END AS in_map, '/data/corpus/kept/' || page_id AS url,
  '/data/corpus/' || CASE page_id % 3 WHEN 0 THEN 'pages/' || page_id || '.html' WHEN 1 THEN '../../other/' || page_id ELSE 'x/' || page_id END AS whole_raw,
  CASE page_id % 3 WHEN 1 THEN '/other/' || page_id WHEN 0 THEN '/data/corpus/pages/' || page_id || '.html' ELSE '/data/corpus/x/' || page_id END AS back FROM pages""")
def paths_rewritten(spark, sf_dir):
    """Paths at four depths made relative, and absolute again."""
    i = F.col("page_id").cast("string")
    base = "/data/corpus"
    path = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit(f"{base}/pages/"), i, F.lit(".html"))).when(F.col("page_id") % 3 == 1, F.concat(F.lit("/other/"), i)).otherwise(F.concat(F.lit(f"{base}/y/.././x//"), i))
    docs = F.array(F.struct(F.concat(F.lit(f"{base}/a/"), i).alias("local_path"), F.concat(F.lit(f"{base}/kept/"), i).alias("url")), F.struct(F.lit("/root2/a").alias("local_path"), F.lit(None).cast("string").alias("url")))
    extra = F.create_map(F.lit("state_file"), F.when(F.col("page_id") % 2 == 0, F.concat(F.lit(f"{base}/m/"), i)))
    state = table(spark, sf_dir, "pages").select("page_id", F.struct(path.alias("html_path"), F.struct(docs.alias("documents"), extra.alias("extra")).alias("inner")).alias("entry"))
    short = N.relative_paths(state, base)
    again = N.absolute_paths(short, base).select(F.col("page_id").alias("b_id"), F.col("entry.html_path").alias("back"))
    raw = F.concat(F.lit(f"{base}/"), F.when(F.col("page_id") % 3 == 1, F.concat(F.lit("../.."), F.col("one"))).otherwise(F.col("one")))
    out = short.select("page_id", F.col("entry.html_path").alias("one"), F.transform("entry.inner.documents", lambda d: d["local_path"]).alias("many"), F.try_element_at("entry.inner.extra", F.lit("state_file")).alias("in_map"), F.get("entry.inner.documents", F.lit(0))["url"].alias("url"))
    return out.withColumn("whole_raw", raw).join(again, F.col("page_id") == F.col("b_id")).drop("b_id")
