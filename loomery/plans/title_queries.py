"""Queries that find documents by inexact titles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.operators import titles as T
from loomery.plans.clause_queries import _ORDERED, _laws
from loomery.plans.registry import register
from loomery.sources.checkpoints import cut
from loomery.sources.tables import table

_WORDS = "list_filter(string_split(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'), ' '), lambda w: w <> '')"


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.filter(F.split(F.regexp_replace(F.coalesce("text", F.lit("")), "[ \\t\\n\\r\\f]+", " "), " "), lambda w: w != "")
    return table(spark, sf_dir, "documents").select("doc_id", words.alias("w")).where("doc_id is not null")


def titles_and_requests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Titles have a Chinese character for each of the first 16 words of every document. Each document asks for a title: its own, a part of it, one with more
    than any title has, or its own with three characters changed."""
    alphabet = F.lit("".join(chr(0x4E00 + i) for i in range(2000)))
    sign = lambda w: F.substring(alphabet, (F.conv(F.substring(F.md5(w), 1, 5), 16, 10).cast("int") % 2000) + 1, F.lit(1))
    rows = _words(spark, sf_dir).select("doc_id", F.array_join(F.transform(F.slice("w", 1, 20), sign), "").alias("t"))
    part = lambda a, n: F.substring("t", a, n)
    entries = rows.select(F.col("doc_id").alias("entry"), part(1, 16).alias("title"), F.col("doc_id").alias("ordinal"))
    kind = F.col("doc_id") % 4
    changed = F.concat(part(1, 3), F.lit("龘"), part(5, 4), F.lit("龘"), part(10, 3), F.lit("龘"), part(14, 3))
    asked = F.when(kind == 0, part(1, 16)).when(kind == 1, part(3, 9)).when(kind == 2, part(1, 20)).otherwise(changed)
    return entries, rows.select(F.col("doc_id").alias("ref"), asked.alias("title"))


@register("title_containment", f"""
WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE doc_id IS NOT NULL),
k AS (SELECT DISTINCT trim(array_to_string(w[1:8], ' ')) AS title FROM w), r AS (SELECT DISTINCT trim(array_to_string(w[2:5], ' ')) AS asked FROM w UNION SELECT trim(array_to_string(w[1:11], ' ')) FROM w)
SELECT asked, title FROM r, k WHERE asked <> '' AND title <> '' AND (contains(title, asked) OR contains(asked, title))""")
def title_containment(spark, sf_dir):
    """Titles that are inside of what is asked for, or around it."""
    rows = _words(spark, sf_dir)
    entries = rows.select(F.array_join(F.slice("w", 1, 8), " ").alias("title"))
    asked = rows.select(F.explode(F.array(F.array_join(F.slice("w", 2, 4), " "), F.array_join(F.slice("w", 1, 11), " "))).alias("x")).where("x <> ''").distinct()
    asked, known = cut(asked), cut(entries.select("title").where("title <> ''").distinct())  # each is read twice
    inside = T.contained(asked.withColumnRenamed("x", "needle"), known.withColumnRenamed("title", "text")).select(F.col("needle").alias("asked"), F.col("text").alias("title"))
    around = T.contained(known.withColumnRenamed("title", "needle"), asked.withColumnRenamed("x", "text")).select(F.col("text").alias("asked"), F.col("needle").alias("title"))
    return inside.unionByName(around).distinct()


@register("title_cascade")
def title_cascade(spark, sf_dir):
    """The entries that each document's request names: equal, partial or closest titles; tests compare it with the loop over all titles."""
    entries, requests = titles_and_requests(spark, sf_dir)
    return T.title_matches(requests, entries).select("ref", "kind", "entry")


@register("clauses_by_title", f"""
WITH {_ORDERED}, t AS (SELECT o_custkey, max(m) AS m FROM o GROUP BY o_custkey),
r AS (SELECT o_orderkey AS ref, o_custkey AS c, o_orderkey % 6 AS kind, o_orderkey % 5 + 1 AS a,
    CASE o_orderkey % 6 WHEN 0 THEN '' WHEN 1 THEN '客户' || o_custkey || '号管理条例 附则' ELSE '客户' || o_custkey || '号管理条例' END AS title, o_orderkey % 6 = 2 AS bad FROM orders),
x AS (SELECT r.*, t.m, o.o_orderkey AS k, o.o_orderpriority AS p, o.o_orderstatus AS s FROM r JOIN t ON t.o_custkey = r.c LEFT JOIN o ON o.o_custkey = r.c AND o.n = r.a)
SELECT ref, CASE WHEN kind > 2 OR kind = 1 THEN c END AS entry, CASE WHEN kind > 2 THEN 'exact' WHEN kind = 1 THEN 'partial' END AS kind,
  CASE WHEN k IS NOT NULL AND (kind > 2 OR kind = 1) THEN CASE WHEN c % 2 = 0 THEN 'a.txt' ELSE 'b.html' END END AS path,
  CASE WHEN k IS NOT NULL AND (kind > 2 OR kind = 1) THEN '（二）' || k || '。' END AS item_text,
  CASE WHEN kind = 0 THEN 'missing_title' WHEN kind = 2 THEN 'invalid_clause_reference' WHEN k IS NULL THEN CASE WHEN c % 2 = 1 THEN 'document_unavailable' ELSE 'article_not_found' END END AS error
FROM x""")
def clauses_by_title(spark, sf_dir):
    """For every order a clause of the law of its customer, by a title that is missing, partly right or right. Of a law there is a text, for
    every second one unreadable, and a page."""
    laws = _laws(spark, sf_dir)
    name = lambda c: F.concat(F.lit("客户"), c, F.lit("号管理条例"))
    entries = laws.select(F.col("doc_id").alias("entry"), name(F.col("doc_id")).alias("title"), F.col("doc_id").alias("ordinal"))
    kinds = F.array(F.struct(F.lit(0).alias("at"), F.lit("text").alias("type"), F.lit("a.txt").alias("path")), F.struct(F.lit(1).alias("at"), F.lit("html").alias("type"), F.lit("b.html").alias("path")))
    docs = laws.select(F.col("doc_id").alias("entry"), "text", F.explode(kinds).alias("d")).select("entry", "d.*", F.when((F.col("d.type") == "html") | (F.col("entry") % 2 == 0), F.col("text")).alias("text"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    kind = F.col("o_orderkey") % 6
    title = F.when(kind == 0, "").when(kind == 1, F.concat(name(F.col("o_custkey")), F.lit(" 附则"))).otherwise(name(F.col("o_custkey")))
    clause = F.when(kind == 2, "附件").otherwise(F.concat(F.lit("第"), F.col("o_orderkey") % 5 + 1, F.lit("条，第二款（二）")))
    asked = orders.select(F.col("o_orderkey").alias("ref"), title.alias("title"), clause.alias("clause"))
    return T.clauses_by_title(asked, entries, docs).select("ref", "entry", "kind", "path", "item_text", "error")
