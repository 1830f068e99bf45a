"""Queries of extraction: an order is an entry, and its line items are its documents or attempts."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomery.operators import extraction as E
from loomery.operators import rollups
from loomery.plans.registry import register
from loomery.sources.tables import table


@register("candidate_rank", """
WITH d AS (SELECT l_orderkey AS entry_id, l_linenumber AS place, o_orderpriority AS entry_title,
    CASE l_linenumber % 5 WHEN 0 THEN 'docx' WHEN 1 THEN 'pdf' WHEN 2 THEN 'html' WHEN 3 THEN 'text' ELSE 'word' END AS type,
    CASE l_linenumber % 3 WHEN 0 THEN o_orderpriority || '.pdf' WHEN 1 THEN '附件' || o_orderpriority ELSE '说明' END AS title, l_quantity = 50 AS preferred
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
p AS (SELECT *, CASE place % 3 WHEN 0 THEN 3000 + 2.0 WHEN 1 THEN 2000 + 1.0 - 0.5 ELSE 0 END + 10 * CASE type WHEN 'docx' THEN 3 WHEN 'word' THEN 3 WHEN 'pdf' THEN 2 WHEN 'html' THEN 1 ELSE 0 END
    - CASE WHEN place % 3 = 2 AND type IN ('docx', 'word') THEN 1 ELSE 0 END AS priority FROM d)
SELECT entry_id, place::INT AS place, priority::DOUBLE AS priority, row_number() OVER (PARTITION BY entry_id ORDER BY preferred DESC, priority DESC, place)::INT AS rank FROM p""")
def candidate_rank(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("entry_title"))
    n, t = F.col("l_linenumber"), F.col("entry_title")
    kind = F.element_at(F.array(*map(F.lit, ("docx", "pdf", "html", "text", "word"))), (n % 5 + 1).cast("int"))
    title = F.when(n % 3 == 0, F.concat(t, F.lit(".pdf"))).when(n % 3 == 1, F.concat(F.lit("附件"), t)).otherwise("说明")
    docs = table(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_orderkey").alias("entry_id"), "entry_title", n.cast("int").alias("place"), kind.alias("type"), title.alias("title"), F.lit("x").alias("path"), (F.col("l_quantity") == 50).alias("preferred"))
    return E.candidates(docs).select("entry_id", "place", "priority", "rank")


@register("extraction_status", """
WITH a AS (SELECT l_orderkey AS e, l_linenumber * 100000000::BIGINT + floor(l_extendedprice)::BIGINT AS r, CASE WHEN l_quantity > 40 THEN 'x' ELSE '' END AS text, CASE WHEN l_tax = 0.05 THEN 'failed' END AS error, l_returnflag = 'R' AS ocr, CASE WHEN l_linestatus = 'F' THEN 'pdf' ELSE 'html' END AS type FROM lineitem),
f AS (SELECT *, min(r) FILTER (text <> '') OVER (PARTITION BY e) AS first FROM a), t AS (SELECT * FROM f WHERE first IS NULL OR r <= first),
u AS (SELECT *, bool_or(type = 'pdf' AND ocr) OVER (PARTITION BY e) AS flag, row_number() OVER (PARTITION BY e ORDER BY text <> '' DESC, r) AS k FROM t)
SELECT o_orderkey AS entry_id, coalesce(flag, FALSE) AS requires_ocr, CASE WHEN u.e IS NULL THEN 'no_source' WHEN error IS NOT NULL AND ocr AND (type = 'pdf' OR flag) THEN 'needs_ocr' WHEN error IS NOT NULL THEN 'error'
  WHEN text <> '' THEN 'success' WHEN ocr AND (type = 'pdf' OR flag) THEN 'needs_ocr' ELSE 'empty' END AS status
FROM orders LEFT JOIN (SELECT * FROM u WHERE k = 1) u ON u.e = o_orderkey""")
def extraction_status(spark, sf_dir):
    attempts = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("entry_id"), (F.col("l_linenumber").cast("long") * 100_000_000 + F.floor("l_extendedprice")).alias("rank"), F.when(F.col("l_linestatus") == "F", "pdf").otherwise("html").alias("type"),
        F.when(F.col("l_quantity") > 40, "x").otherwise("").alias("text"), F.when(F.col("l_tax") == 0.05, "failed").alias("error"), (F.col("l_returnflag") == "R").alias("requires_ocr"),
    )
    return E.statuses(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("entry_id")), attempts).select("entry_id", "requires_ocr", "status")


def _entries(spark, sf_dir):
    """(task, serial, status, types, reused, is_policy, documents): orders by priority, with line items as documents."""
    doc = F.struct(F.lower("l_linestatus").alias("type"), (F.col("l_returnflag") == "R").alias("requires_ocr"), F.col("l_quantity").cast("int").alias("page_count"))
    docs = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(doc).alias("documents"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("task"), F.col("o_custkey").alias("serial"), "o_orderstatus")
    types = F.array(F.when(F.col("o_orderkey") % 4 == 0, "application/pdf; x").when(F.col("o_orderkey") % 4 == 1, " WPS ").when(F.col("o_orderkey") % 4 == 2, "password"), F.lit("htm"))
    status = F.when(F.col("o_orderstatus") == "F", " Success").when(F.col("o_orderstatus") == "O", "error")
    return o.join(docs, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("task", "serial", status.alias("status"), types.alias("types"), (F.col("o_orderkey") % 3 == 0).alias("reused"), (F.col("o_orderkey") % 2 == 0).alias("is_policy"), "documents")


_SUMS = """
l AS (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') AS n_ocr, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity::INT ELSE 0 END) AS pages FROM lineitem GROUP BY 1),
e AS (SELECT o_orderpriority AS task, o_custkey, o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'error' ELSE 'unknown' END AS status, CASE WHEN o_orderstatus = 'F' THEN coalesce(n_ocr, 0) ELSE 0 END AS n_ocr, CASE WHEN o_orderstatus = 'F' THEN coalesce(pages, 0) ELSE 0 END AS pages
  FROM orders LEFT JOIN l ON l_orderkey = o_orderkey)"""
_SELECT = "SELECT task, count(*)::BIGINT AS total, count(*) FILTER (status = 'success')::BIGINT AS success, count(*) FILTER (o_orderkey % 3 = 0)::BIGINT AS reused, sum(n_ocr)::BIGINT AS requires_ocr, sum(pages)::BIGINT AS ocr_pages, count(*) FILTER (status = 'error')::BIGINT AS errors, count(*) FILTER (o_orderkey % 4 = 2)::BIGINT AS odd_types"


def _flat(rollup):
    return rollup.select("task", "total", "success", "reused", "requires_ocr", "ocr_pages", F.col("statuses")["error"].alias("errors"), F.col("types")["password"].alias("odd_types"))


@register("extract_summary", f"WITH {_SUMS} {_SELECT} FROM e GROUP BY task")
def extract_summary(spark, sf_dir):
    return _flat(E.summary_rollup(_entries(spark, sf_dir)))


@register("extract_summary_of_serials", f"WITH {_SUMS} {_SELECT} FROM e WHERE task = '5-LOW' OR o_custkey % 2 = 0 GROUP BY task")
def extract_summary_of_serials(spark, sf_dir):
    entries = _entries(spark, sf_dir)
    serials = entries.where("task <> '5-LOW' and serial % 2 = 0").select("task", "serial")
    return _flat(E.summary_rollup(E.with_serials(entries, serials)))


@register("policy_rollup", """
SELECT o_orderpriority AS task, count(*)::BIGINT AS policies, count(DISTINCT o_custkey)::BIGINT AS serials, count(*) FILTER (o_orderkey % 4 = 0)::BIGINT AS pdfs, count(*) FILTER (o_orderkey % 4 = 2)::BIGINT AS pages
FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1""")
def policy_rollup(spark, sf_dir):
    out = E.policy_rollup(_entries(spark, sf_dir))
    return out.select("task", "policies", F.size("serials").cast("long").alias("serials"), F.col("types")["pdf"].alias("pdfs"), F.col("types")["html"].alias("pages"))


@register("preferred_types", """
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 1 THEN 'doc' WHEN o_orderkey % 4 = 0 THEN 'pdf' ELSE 'html' END AS type FROM orders""")
def preferred_types(spark, sf_dir):
    k = F.col("o_orderkey")
    types = F.array(F.when(k % 4 == 0, "application/pdf; x").when(k % 4 == 1, " WPS ").when(k % 4 == 2, "password"), F.lit("htm"))
    return table(spark, sf_dir, "orders").select("o_orderkey", rollups.preferred_type(types).alias("type"))


@register("incremental_reuse", """
SELECT o_orderkey AS entry_id, o_orderstatus = 'F' AND o_orderkey % 5 <> 0 AS reused FROM orders""")
def incremental_reuse(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    path = F.concat(F.lit("t/"), F.col("o_orderkey").cast("string"), F.lit(".txt"))
    before = o.select(F.col("o_orderkey").alias("entry_id"), F.when(F.col("o_orderstatus") == "F", "success").otherwise("error").alias("status"), path.alias("text_path"))
    files = o.where("o_orderkey % 5 <> 0").select(path.alias("path"))
    return E.reusable(o.select(F.col("o_orderkey").alias("entry_id")), before, files).select("entry_id", "reused")


@register("text_document", """
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 2 END::BIGINT AS n, 'text' AS last_type FROM part""")
def text_document(spark, sf_dir):
    key = F.col("p_partkey").cast("string")
    one = F.struct(F.lit(None).cast("string").alias("url"), F.lit("pdf").alias("type"), F.col("p_name").alias("title"), F.when(F.col("p_partkey") % 3 == 0, F.concat(key, F.lit(".txt"))).otherwise("x.pdf").alias("local_path"))
    docs = E.with_text_document(F.array(one), F.concat(key, F.lit(".txt")), F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", docs.alias("d")).select("p_partkey", F.size("d").cast("long").alias("n"), F.element_at("d", -1)["type"].alias("last_type"))


@register("running_lines", """
WITH p AS (SELECT c.conv_id AS doc_id, turn, 'Page of ' || conv_id || chr(10) || role || chr(10) || 'end ' || turn AS body FROM conversations c)
SELECT doc_id, line, count(*)::BIGINT AS n_pages FROM (SELECT DISTINCT doc_id, turn, unnest(string_split(body, chr(10))) AS line FROM p) GROUP BY ALL HAVING count(*) >= 2""")
def running_lines(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    body = F.concat(F.lit("Page of "), F.col("conv_id").cast("string"), F.lit("\n"), F.col("role"), F.lit("\nend "), F.col("turn").cast("string"))
    docs = c.groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", body.alias("b")))), lambda x: x["b"]), "\f").alias("text"))
    return E.running_lines(docs)


@register("pages_for_ocr", """
WITH p AS (SELECT o_custkey AS doc_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, CASE WHEN o_orderkey % 2 = 0 THEN 3 ELSE 20 END AS n FROM orders)
SELECT doc_id, coalesce(list(i::INT ORDER BY i) FILTER (n < 12 AND most >= 12), []) AS pages FROM (SELECT *, max(n) OVER (PARTITION BY doc_id) AS most FROM p) GROUP BY doc_id""")
def pages_for_ocr(spark, sf_dir):
    body = F.when(F.col("o_orderkey") % 2 == 0, " a \n bc ").otherwise("x" * 10 + "\n" + " " + "y" * 10)
    docs = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", body.alias("b")))), lambda x: x["b"]), "\f").alias("text"))
    return docs.select("doc_id", E.pages_for_ocr(F.col("text")).alias("pages"))


@register("summary_texts", """
SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN '' WHEN 1 THEN '内容不明确，无法摘要。' ELSE s_name || '。' END AS summary FROM supplier""")
def summary_texts(spark, sf_dir):
    k = F.col("s_suppkey") % 4
    raw = F.when(k == 0, " \n").when(k == 1, "摘要：内容不明确，无法摘要。").when(k == 2, F.concat(F.lit(" 摘要： "), "s_name", F.lit("。。\n"))).otherwise(F.col("s_name"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", E.summary_text(raw).alias("summary"))
