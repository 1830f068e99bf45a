"""Queries of reading documents. The documents are the orders of customers, as articles under chapters and sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomery.operators import reading as R
from loomery.plans.registry import register
from loomery.sources.tables import table


def _laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): an article for each order; each third begins a chapter, and chapters of even number have a section from
    their second article on. What is before the first article, here a chapter's title, counts as an article."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    n = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    o = o.withColumn("n", n).withColumn("k", F.floor((F.col("n") - 1) / 3) + 1)
    chapter = F.when(F.col("n") % 3 == 1, F.format_string("第%d章 订单\n", "k")).otherwise("")
    section = F.when((F.col("n") % 3 == 2) & (F.col("k") % 2 == 0), "第1节 其余\n").otherwise("")
    text = F.concat(chapter, section, F.format_string("第%d条 %d %s\n", "n", "o_orderkey", "o_orderpriority"))
    rows = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("n", text.alias("t")))).alias("a"))
    return rows.select(F.col("o_custkey").alias("doc_id"), F.array_join(F.transform("a", lambda x: x["t"]), "").alias("text"))


_ARTICLES = """
o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
k AS (SELECT *, (n - 1) // 3 + 1 AS k FROM o), m AS (SELECT *, max(n) OVER (PARTITION BY o_custkey, k) AS last_n FROM k),
s AS (SELECT *, k % 2 = 0 AND last_n >= 3 * (k - 1) + 2 AS has_sections FROM m),
a AS (SELECT o_custkey AS doc_id, k, n AS "index", CASE WHEN has_sections THEN '第' || k || '章 订单 第1节 其余' ELSE '第' || k || '章 订单' END AS label, '第' || n || '条' AS article_no, o_orderkey, o_orderpriority
  FROM s WHERE NOT (has_sections AND n % 3 = 1)
  UNION ALL SELECT DISTINCT o_custkey, 1, 0, '第1章 订单', '全文', NULL, NULL FROM orders)"""


@register("law_structure", f"""WITH {_ARTICLES} SELECT doc_id, label, "index"::BIGINT AS "index", article_no FROM a""")
def law_structure(spark, sf_dir):
    return R.structured(_laws(spark, sf_dir)).select("doc_id", "label", F.col("index").cast("long").alias("index"), "article_no")


@register("law_chapter", f"""WITH {_ARTICLES} SELECT doc_id, "index"::BIGINT AS "index" FROM a WHERE k = 2""")
def law_chapter(spark, sf_dir):
    return R.in_range(R.structured(_laws(spark, sf_dir)), "chapter", index=2).select("doc_id", F.col("index").cast("long").alias("index"))


@register("law_section", f"""WITH {_ARTICLES} SELECT doc_id, "index"::BIGINT AS "index" FROM a WHERE contains(label, '第2章') AND contains(label, '第1节')""")
def law_section(spark, sf_dir):
    return R.in_range(R.structured(_laws(spark, sf_dir)), "section", chapter="第2章", section="第1节").select("doc_id", F.col("index").cast("long").alias("index"))


@register("law_articles_plain", f"""WITH {_ARTICLES}
SELECT doc_id, count(*)::BIGINT AS n_lines, min(article_no) AS first_no FROM a WHERE "index" BETWEEN 1 AND 3 GROUP BY doc_id""")
def law_articles_plain(spark, sf_dir):
    rows = R.in_range(R.structured(_laws(spark, sf_dir)), "articles", first=2, last=4)
    text = R.plain_text(rows)
    n = F.size(F.regexp_extract_all("text", F.lit("第[0-9]+条"), F.lit(0))).cast("long")
    return text.select("doc_id", n.alias("n_lines"), F.regexp_extract("text", "^(第[0-9]+条)", 1).alias("first_no"))


@register("policy_parts", "SELECT doc_id, lang, source, length(text)::BIGINT AS n FROM documents")
def policy_parts(spark, sf_dir):
    return R.parts(table(spark, sf_dir, "documents"), {"meta", "text"}, ["lang", "source"]).select("doc_id", "lang", "source", F.length("text").cast("long").alias("n"))


@register("policy_list", "SELECT p_partkey AS entry_id, p_name AS title FROM part WHERE p_size < 10 AND p_partkey IN (SELECT ps FROM (SELECT l_partkey AS ps FROM lineitem WHERE l_quantity > 45))")
def policy_list(spark, sf_dir):
    p = table(spark, sf_dir, "part").where("p_size < 10").select(F.col("p_partkey").alias("entry_id"), F.col("p_name").alias("title"), F.lit(None).cast("string").alias("norm_title"))
    listed = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("entry_id"))
    return R.policy_list(p, listed).select("entry_id", "title")


@register("contents_page", """
WITH w AS (SELECT item_id AS ordinal, (item_id * 3)::VARCHAR AS id FROM benchmark UNION ALL SELECT item_id + 100000, (item_id * 3)::VARCHAR || '-article-2' FROM benchmark),
f AS (SELECT split_part(id, '-', 1) AS law, min(ordinal) AS ordinal FROM w GROUP BY 1), p AS (SELECT * FROM f ORDER BY ordinal LIMIT 20 OFFSET 20)
SELECT doc_id, ordinal, source FROM documents JOIN p ON doc_id::VARCHAR = law""")
def contents_page(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    key = (F.col("item_id") * 3).cast("string")
    wanted = b.select(F.col("item_id").alias("ordinal"), key.alias("id")).unionByName(b.select((F.col("item_id") + 100000).alias("ordinal"), F.concat(key, F.lit("-article-2")).alias("id")))
    return R.contents(table(spark, sf_dir, "documents").select("doc_id", "source"), wanted, 2, 20).select("doc_id", "ordinal", "source")


@register("joined_contents", """
WITH t AS (SELECT conv_id, string_agg(role || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS t FROM conversations GROUP BY conv_id)
SELECT conv_id, length(left(t, 500))::BIGINT AS n, md5(left(t, 500)) AS digest FROM t""")
def joined_contents(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("ordinal"), F.col("role").alias("title"), "text")
    t = R.contents_of(c, "conv_id", 500).withColumnRenamed("text", "t")
    return t.select("conv_id", F.length("t").cast("long").alias("n"), F.md5("t").alias("digest"))
