"""Queries of small filters and columns. Orders are entries, and their line items are documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomery.operators import predicates as P
from loomery.plans.registry import register
from loomery.sources.tables import table


#: The order of an entry's documents.
_ORDER = "l_linenumber, CASE WHEN l_quantity > 5 THEN 1 END NULLS FIRST, CASE WHEN l_quantity = 50 THEN 1 ELSE 0 END, 'f/' || l_suppkey, l_returnflag = 'R'"


def _entries(spark, sf_dir):
    n = F.col("l_linenumber")
    kind = F.when(n % 2 == 1, "HTML").otherwise("pdf")
    d = F.struct(n.alias("n"), F.when(F.col("l_quantity") > 5, F.concat(F.lit("u/"), n.cast("string"))).alias("url"), kind.alias("type"), F.when(F.col("l_quantity") == 50, "关于废止的决定").otherwise("x").alias("title"), F.lit(None).cast("string").alias("remark"), F.concat(F.lit("f/"), F.col("l_suppkey").cast("string")).alias("local_path"), (F.col("l_returnflag") == "R").alias("downloaded"))
    docs = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(d)).alias("documents"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("entry_id"), "o_orderpriority")
    return o.join(docs, F.col("entry_id") == F.col("l_orderkey"), "left").drop("l_orderkey")


@register("html_only_entries", """
SELECT l_orderkey AS entry_id FROM lineitem GROUP BY 1 HAVING bool_and(l_linenumber % 2 = 1)""")
def html_only_entries(spark, sf_dir):
    return _entries(spark, sf_dir).where(P.html_only(F.col("documents"))).select("entry_id")


@register("abolished_entries", """
SELECT DISTINCT l_orderkey AS entry_id FROM lineitem WHERE l_quantity = 50""")
def abolished_entries(spark, sf_dir):
    return _entries(spark, sf_dir).where(P.abolished(F.col("o_orderpriority"), F.lit(None).cast("string"), F.col("documents"))).select("entry_id")


@register("downloaded_documents", f"""
SELECT l_orderkey AS entry_id, (row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) - 1)::INT AS "index", l_linenumber AS n FROM lineitem QUALIFY l_returnflag = 'R'""")
def downloaded_documents(spark, sf_dir):
    return P.downloaded_documents(_entries(spark, sf_dir)).select("entry_id", "index", F.col("document.n").alias("n"))


@register("flat_documents", """
SELECT l_orderkey AS entry_id, 'u/' || l_linenumber AS url, 'pdf' AS type FROM lineitem WHERE l_quantity > 5 AND l_linenumber % 2 = 0""")
def flat_documents(spark, sf_dir):
    return P.flat_documents(_entries(spark, sf_dir)).select("entry_id", "url", "type")


@register("allowed_documents", "SELECT p_partkey FROM part WHERE lower(p_brand) IN ('brand#1', 'brand#12', 'brand#3')")
def allowed_documents(spark, sf_dir):
    return table(spark, sf_dir, "part").where(P.allowed_types(F.col("p_brand"), ["BRAND#1", "Brand#12", "brand#3"])).select("p_partkey")


@register("tasks_like", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND contains(lower(c_name), '1')")
def tasks_like(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"), F.lit("").alias("slug"), F.lit(None).cast("string").alias("url"), F.col("c_mktsegment").alias("status"))
    return P.tasks_like(c, "BUILDING", " 1").select("c_custkey")


@register("chosen_tasks", "SELECT n_nationkey FROM nation WHERE lower(n_name) IN ('nation_1', 'nation_20') OR n_nationkey = 3")
def chosen_tasks(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("name"), F.concat(F.lit("slug-"), F.col("n_nationkey").cast("string")).alias("slug"))
    return P.chosen_tasks(n, ["Nation_1", " NATION_20 ", "Slug-3"]).select("n_nationkey")


@register("events_of_types", "SELECT event_id FROM events WHERE event_type IN ('click', 'view')")
def events_of_types(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("event"))
    return P.events_of(e, ["click", "view"]).select("event_id")


@register("in_years", "SELECT o_orderkey FROM orders WHERE o_orderkey % 7 = 0 OR year(o_orderdate) BETWEEN 1994 AND 1996")
def in_years(spark, sf_dir):
    year = F.when(F.col("o_orderkey") % 7 != 0, F.year("o_orderdate"))
    return table(spark, sf_dir, "orders").where(P.in_years(year, 1994, 1996)).select("o_orderkey")


@register("comparable_paths", r"""
SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'x/' || s_name WHEN 1 THEN 'y/' || s_name ELSE 'other/' || s_name END AS tail, CASE WHEN s_suppkey % 3 = 2 THEN s_name ELSE 'b' END AS public FROM supplier""")
def comparable_paths(spark, sf_dir):
    k = F.col("s_suppkey") % 3
    path = F.when(k == 0, F.concat(F.lit("C:\\data\\downloads\\x\\"), "s_name")).when(k == 1, F.concat(F.lit("files/y/"), "s_name")).otherwise(F.concat(F.lit("other/"), "s_name"))
    public = P.public_path(F.when(k == 2, F.concat(F.lit("./files/extract/"), "s_name")).otherwise("b"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", P.comparable_path(path).alias("tail"), public.alias("public"))


@register("first_filled", "SELECT doc_id, coalesce(nullif(trim(source), ''), nullif(trim(lang), ''), doc_id::VARCHAR) AS id FROM documents")
def first_filled(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", P.first_filled("source", "lang", "doc_id").alias("id"))


@register("used_paths", f"""
SELECT o_orderkey AS entry_id, coalesce('f/' || (SELECT l_suppkey FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R' ORDER BY {_ORDER} LIMIT 1), 'none') AS path FROM orders""")
def used_paths(spark, sf_dir):
    e = _entries(spark, sf_dir)
    attempts = F.transform("documents", lambda d: F.struct(d["downloaded"].alias("used"), d["local_path"].alias("path")))
    return e.select("entry_id", P.used_path(attempts, F.lit("none")).alias("path"))


@register("next_runs", "SELECT event_id, floor(epoch(ts))::BIGINT + 72000 AS from_s, floor(epoch(ts))::BIGINT + 115200 AS to_s FROM events")
def next_runs(spark, sf_dir):
    due = P.next_run(F.col("ts").cast("timestamp"), 20, 32)
    e = table(spark, sf_dir, "events").select("event_id", due.alias("d"))
    return e.select("event_id", F.unix_timestamp("d.from").alias("from_s"), F.unix_timestamp("d.to").alias("to_s"))


@register("distinct_paths", """
SELECT l_orderkey AS entry_id, count(DISTINCT l_suppkey)::BIGINT + 1 AS n FROM lineitem GROUP BY 1""")
def distinct_paths(spark, sf_dir):
    e = _entries(spark, sf_dir).where("documents is not null")
    return e.select("entry_id", F.size(P.distinct_paths(F.col("documents"), F.lit("best"))).cast("long").alias("n"))
