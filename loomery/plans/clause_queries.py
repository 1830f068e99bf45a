"""Queries of clauses. The documents are orders written as articles, a document for each customer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomery.functions import clauses as C
from loomery.operators import clauses as K
from loomery.plans.registry import register
from loomery.sources.tables import table


def _laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): an article of two paragraphs for each order, the second with two items."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus")
    o = o.withColumn("n", F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")))
    text = F.format_string("第%s条 %d\n第一款 %s\n第二款 （一）%s（二）%d。", C.chinese(F.col("n")), "o_orderkey", "o_orderpriority", "o_orderstatus", "o_orderkey")
    parts = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("n", text.alias("t")))).alias("a"))
    return parts.select(F.col("o_custkey").alias("doc_id"), F.concat(F.array_join(F.transform("a", lambda x: x["t"]), "\n"), F.lit("\n特此公告。")).alias("text"))


_ORDERED = "o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, count(*) OVER (PARTITION BY o_custkey) AS m FROM orders)"


@register("clause_lookup", f"""
WITH {_ORDERED}, a AS (SELECT o_custkey, o_orderkey, o_orderpriority, o_orderstatus FROM o WHERE n = 2)
SELECT c_custkey AS ref, '第二款 （一）' || o_orderstatus || '（二）' || o_orderkey || '。' AS paragraph_text, '（二）' || o_orderkey || '。' AS item_text,
  length('第二条 ' || o_orderkey || chr(10) || '第一款 ' || o_orderpriority || chr(10) || '第二款 （一）' || o_orderstatus || '（二）' || o_orderkey || '。')::BIGINT AS n_article,
  CASE WHEN a.o_custkey IS NOT NULL THEN NULL WHEN EXISTS (SELECT 1 FROM orders x WHERE x.o_custkey = c_custkey) THEN 'article_not_found' ELSE 'document_unavailable' END AS error
FROM customer LEFT JOIN a ON o_custkey = c_custkey""")
def clause_lookup(spark, sf_dir):
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ref"), F.col("c_custkey").alias("doc_id"), F.lit("第二条，第二款（二）项").alias("clause"))
    return K.find_clauses(_laws(spark, sf_dir), asked).select("ref", "paragraph_text", "item_text", F.length("article_text").cast("long").alias("n_article"), "error")


@register("clause_outline", f"""
WITH {_ORDERED}
SELECT o_custkey AS doc_id, (3 * (n - 1))::INT AS line, 'article' AS level, n AS number, n AS article, NULL::BIGINT AS paragraph FROM o
UNION ALL SELECT o_custkey, (3 * (n - 1) + p)::INT, 'paragraph', p, n, p FROM o, (VALUES (1::BIGINT), (2::BIGINT)) AS v(p)""")
def clause_outline(spark, sf_dir):
    return K.outline(_laws(spark, sf_dir)).drop("label")


@register("clause_key_rows", """
WITH k AS (SELECT n_name AS name, '《' || n_name || '》第三条，第一款，第二款 《' || n_name || '附》第一条' AS key FROM nation),
s AS (SELECT s_name AS name, s_name || '：第二条，第一款（二）项及第四条' AS key FROM supplier)
SELECT key, 0::INT AS n, name AS title, '第三条 第一款' AS clause FROM k UNION ALL SELECT key, 1, name, '第三条 第二款' FROM k
UNION ALL SELECT key, 2, name || '附', '第一条' FROM k UNION ALL SELECT key, 0, name, '第二条 第一款（二）项' FROM s UNION ALL SELECT key, 1, name, '第四条' FROM s""")
def clause_key_rows(spark, sf_dir):
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    keys = n.select(F.concat(F.lit("《"), "n_name", F.lit("》第三条，第一款，第二款 《"), "n_name", F.lit("附》第一条")).alias("key"))
    return K.clause_keys(keys.unionByName(s.select(F.concat("s_name", F.lit("：第二条，第一款（二）项及第四条")).alias("key"))))


@register("chinese_numbers", """
SELECT p_partkey AS n, CASE WHEN p_partkey < 10000 THEN p_partkey END AS back, '第' || p_partkey || '条' AS shown FROM part""")
def chinese_numbers(spark, sf_dir):
    n = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(n.alias("n"), F.when(n < 10000, C.number(C.chinese(n))).alias("back"), F.concat(F.lit("第"), n.cast("string"), F.lit("条")).alias("shown"))


@register("clause_in_policies", f"""
WITH {_ORDERED}, c AS (SELECT c_custkey, c_mktsegment FROM customer), t AS (SELECT o_custkey, max(m) AS m FROM o GROUP BY o_custkey)
SELECT c_custkey AS ref, CASE WHEN m >= 2 THEN 'b' END AS path, CASE WHEN m IS NULL THEN 'policy_not_found' WHEN m < 2 THEN 'article_not_found' END AS error FROM c LEFT JOIN t ON o_custkey = c_custkey""")
def clause_in_policies(spark, sf_dir):
    laws = _laws(spark, sf_dir).select(F.col("doc_id").cast("string").alias("title"), "text")
    # of two documents the pdf comes first but has no articles
    policies = laws.select("title", F.lit("html").alias("type"), F.lit("b").alias("path"), "text").unionByName(laws.select("title", F.lit("pdf").alias("type"), F.lit("a").alias("path"), F.lit("扫描件").alias("text")))
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ref"), F.col("c_custkey").cast("string").alias("title"), F.lit("第二条").alias("clause"))
    return K.find_in_policies(policies, asked).select("ref", "path", "error")
