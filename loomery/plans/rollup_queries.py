"""Queries of roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomery.operators import rollups as R
from loomery.plans.registry import register
from loomery.sources.tables import table


@register("task_rollup", """
WITH e AS (SELECT o_orderkey, any_value(o_orderpriority) AS task, count(l_orderkey) AS n, count(*) FILTER (l_returnflag = 'R') AS d FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey)
SELECT task, count(*)::BIGINT AS entries, sum(n)::BIGINT AS documents, sum(d)::BIGINT AS downloaded, count(*) FILTER (n = 0)::BIGINT AS without_documents, sum(n - d)::BIGINT AS pending FROM e GROUP BY task""")
def task_rollup(spark, sf_dir):
    """Orders stand for entries, their lines for documents."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct((F.col("l_returnflag") == "R").alias("downloaded"))).alias("documents"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("task"))
    return R.task_rollup(orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left"))


@register("status_case", """
WITH t AS (SELECT c_custkey, count(o_orderkey) AS n, count(*) FILTER (o_orderstatus = 'O') AS p, datediff('hour', max(o_orderdate), TIMESTAMP '1998-12-01') AS age FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey)
SELECT c_custkey, CASE WHEN n = 0 THEN 'waiting' WHEN p > 0 THEN 'attention' WHEN age > 4800 THEN 'stale' ELSE 'ok' END AS status FROM t""")
def status_case(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "O").alias("p"), F.max("o_orderdate").alias("last"))
    t = table(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    age = F.timestamp_diff("HOUR", F.date_trunc("HOUR", F.col("last").cast("timestamp")), F.lit("1998-12-01").cast("timestamp"))
    return t.select("c_custkey", R.status(F.coalesce("p", F.lit(0)), F.coalesce("n", F.lit(0)), age, 4800).alias("status"))


@register("type_counts", """
WITH t AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'doc' WHEN 1 THEN 'pdf' WHEN 2 THEN 'html' ELSE 'doc' END AS type FROM documents)
SELECT type, count(*)::BIGINT AS n FROM t GROUP BY type""")
def type_counts(spark, sf_dir):
    """The preferred type among an entry's types."""
    kinds = F.array(*[F.array(*map(F.lit, k)) for k in (["html", "doc"], ["html", "application/pdf"], ["html"], ["application/vnd.openxmlformats-officedocument.wordprocessingml.document", "pdf"])])
    d = table(spark, sf_dir, "documents").select(R.preferred_type(F.element_at(kinds, (F.col("doc_id") % 4 + 1).cast("int"))).alias("type"))
    return d.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@register("fleet_totals", """
SELECT count(*)::BIGINT AS tasks, sum(n)::BIGINT AS entries, round(sum(total), 2) AS total FROM (SELECT o_orderpriority, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY 1)""")
def fleet_totals(spark, sf_dir):
    per = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))
    return per.agg(F.count(F.lit(1)).alias("tasks"), F.sum("n").alias("entries"), F.round(F.sum("total"), 2).alias("total"))


@register("extract_rollup", """
SELECT o_orderstatus AS status, count(*)::BIGINT AS entries, sum(l_quantity)::BIGINT AS pages, count(*) FILTER (l_returnflag = 'R')::BIGINT AS reused, count(*) FILTER (l_linestatus = 'O')::BIGINT AS needs_ocr, greatest(0, count(*) - count(*) FILTER (l_linestatus = 'F'))::BIGINT AS pending
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def extract_rollup(spark, sf_dir):
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    done = F.count_if(F.col("l_linestatus") == "F")
    return j.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("entries"), F.sum("l_quantity").cast("long").alias("pages"), F.count_if(F.col("l_returnflag") == "R").alias("reused"), F.count_if(F.col("l_linestatus") == "O").alias("needs_ocr"), F.greatest(F.lit(0), F.count(F.lit(1)) - done).alias("pending"))


@register("coverage_rollup", r"""
SELECT CASE WHEN grouping(lang) = 1 THEN 'TOTAL' ELSE lang END AS task, count(*)::BIGINT AS files, count(*) FILTER (contains(coalesce(text, ''), 'licen'))::BIGINT AS flagged, sum(length(coalesce(text, '')))::BIGINT AS chars FROM documents GROUP BY ROLLUP (lang)""")
def coverage_rollup(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("lang", F.coalesce("text", F.lit("")).alias("text"))
    return d.rollup("lang").agg(F.count(F.lit(1)).alias("files"), F.count_if(F.contains("text", F.lit("licen"))).alias("flagged"), F.sum(F.length("text")).alias("chars"), F.grouping("lang").alias("total")).select(F.when(F.col("total") == 1, "TOTAL").otherwise(F.col("lang")).alias("task"), "files", "flagged", "chars")


@register("char_totals_having", "SELECT source, sum(length(text))::BIGINT AS chars, count(*)::BIGINT AS files FROM documents GROUP BY source HAVING sum(length(text)) >= 10000")
def char_totals_having(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.sum(F.length("text")).alias("chars"), F.count(F.lit(1)).alias("files")).where("chars >= 10000")


@register("dup_group_counts", "SELECT count(*)::BIGINT AS groups, coalesce(sum(n), 0)::BIGINT AS rows FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_partkey, l_suppkey, l_quantity HAVING count(*) > 1)")
def dup_group_counts(spark, sf_dir):
    return R.duplicate_groups(table(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey", "l_quantity"])


@register("trace_summary", """
SELECT user_id, count(*)::BIGINT AS n_events, arg_min(ts, event_id) FILTER (event_type = 'view') AS started, arg_max(ts, event_id) FILTER (event_type = 'purchase') AS ended FROM events GROUP BY user_id""")
def trace_summary(spark, sf_dir):
    return R.trace_summary(table(spark, sf_dir, "events"), "user_id", "event_id", "ts", "event_type", "view", "purchase").drop("duration_ms")


@register("trace_page", """
WITH s AS (SELECT user_id, max(ts) AS updated, arg_min(ts, event_id) FILTER (event_type = 'view') AS a, arg_max(ts, event_id) FILTER (event_type = 'purchase') AS b FROM events GROUP BY user_id)
SELECT user_id, floor((epoch_us(b) - epoch_us(a)) / 1000.0)::BIGINT AS duration_ms FROM s ORDER BY updated DESC, user_id LIMIT 10 OFFSET 5""")
def trace_page(spark, sf_dir):
    """The second handful and more of the traces that were updated last, with how long they took."""
    e = table(spark, sf_dir, "events")
    s = R.trace_summary(e, "user_id", "event_id", "ts", "event_type", "view", "purchase")
    updated = e.groupBy(F.col("user_id").alias("u")).agg(F.max("ts").alias("updated"))
    return R.trace_page(s.join(updated, F.col("user_id") == F.col("u")), "updated", "user_id", 10, 5).select("user_id", "duration_ms")


@register("event_types", "SELECT DISTINCT coalesce(event_type, 'event') AS event FROM events")
def event_types(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.coalesce("event_type", F.lit("event")).alias("event")).distinct()


@register("events_json", """
SELECT event_type, (json_extract_string(props, '$.k'))::BIGINT AS k, count(*)::BIGINT AS n FROM events GROUP BY ALL""")
def events_json(spark, sf_dir):
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "long")
    return table(spark, sf_dir, "events").select("event_type", k.alias("k")).groupBy("event_type", "k").agg(F.count(F.lit(1)).alias("n"))


@register("delta_assemble", """
SELECT conv_id, string_agg(text, '' ORDER BY turn) AS content, count(*)::BIGINT AS n FROM conversations
WHERE role = 'assistant' GROUP BY conv_id""")
def delta_assemble(spark, sf_dir):
    """Streamed deltas put together in order."""
    c = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    g = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("d"), F.count(F.lit(1)).alias("n"))
    return g.select("conv_id", F.array_join(F.transform("d", lambda x: x["text"]), "").alias("content"), "n")


@register("tree_group", "SELECT r_name, list(n_name ORDER BY n_name) AS children FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def tree_group(spark, sf_dir):
    j = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name").agg(F.array_sort(F.collect_list("n_name")).alias("children"))
