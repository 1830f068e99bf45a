"""Queries of keyed state and event time. Windows go beyond what document catalogues need."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loomery.plans.registry import register
from loomery.sources.checkpoints import shared_dir
from loomery.sources.tables import table
from loomery.streaming import entries as E
from loomery.streaming import state as S


@register("stateful_upsert_fold", """
SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(v, event_id) FILTER (v IS NOT NULL) AS value, bool_or(event_type = 'purchase') AS bought, max(event_id) AS event_id
FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN value END AS v FROM events) GROUP BY user_id""")
def stateful_upsert_fold(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("value"), (F.col("event_type") == "purchase").alias("bought"))
    return S.upsert(e, "user_id", "event_id", ["event_type", "value"], ["bought"])


@register("assign_serials")
def assign_serials(spark, sf_dir):
    o = table(spark, sf_dir, "events").select(F.col("user_id").alias("task"), "event_id", (F.col("event_id") % 50).alias("wanted"))
    return S.serials(o, "event_id", "wanted")


@register("stream_tumbling", """
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def stream_tumbling(spark, sf_dir):
    return S.tumbling(table(spark, sf_dir, "events")).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@register("stream_sessions", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*)::BIGINT AS n FROM s GROUP BY user_id, s""")
def stream_sessions(spark, sf_dir):
    return S.sessions(table(spark, sf_dir, "events")).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@register("document_flags", """
WITH c AS (SELECT *, CASE event_type WHEN 'click' THEN 'mark' WHEN 'error' THEN 'clear' WHEN 'view' THEN 'retitle' END AS op FROM events),
l AS (SELECT user_id, arg_max(op, event_id) FILTER (op IN ('mark', 'clear')) AS op, max(event_id) FILTER (op IN ('mark', 'clear')) AS last_at, max(event_id) FILTER (op = 'retitle') AS t FROM c GROUP BY user_id)
SELECT user_id, coalesce(op = 'mark', FALSE) AS downloaded, CASE WHEN op = 'mark' THEN 'p' || last_at END AS local_path, 't' || t AS title FROM l""")
def document_flags(spark, sf_dir):
    op = F.when(F.col("event_type") == "click", "mark").when(F.col("event_type") == "error", "clear").when(F.col("event_type") == "view", "retitle")
    name = lambda c: F.concat(F.lit(c), F.col("event_id").cast("string")).alias({"p": "local_path", "t": "title"}[c])
    return S.flags(table(spark, sf_dir, "events").select("user_id", "event_id", op.alias("op"), name("p"), name("t")), "user_id", "event_id")


@register("settled_entries", """
SELECT o_orderkey AS ordinal, CASE WHEN o_orderkey % 3 = 0 THEN 'old' || o_custkey WHEN o_orderkey % 3 = 1 THEN 'u/' || o_orderkey ELSE 'title::' || o_orderpriority || '::r' END AS entry_id FROM orders""")
def settled_entries(spark, sf_dir):
    k = F.col("o_orderkey") % 3
    url = F.when(k == 0, F.concat(F.lit("c/"), F.col("o_custkey").cast("string"))).when(k == 1, F.concat(F.lit("u/"), F.col("o_orderkey").cast("string")))
    docs = F.array(F.struct(url.alias("url"), F.lit("pdf").alias("type")))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ordinal"), F.col("o_orderpriority").alias("title"), F.lit("r").alias("remark"), F.lit(1).alias("serial"), docs.alias("documents"))
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("old"), F.col("c_custkey").cast("string")).alias("entry_id"), F.concat(F.lit("c/"), F.col("c_custkey").cast("string")).alias("url"))
    return S.settle(o, c).select("ordinal", "entry_id")


@register("entry_stream", """
WITH c AS (SELECT c_mktsegment AS task, c_custkey AS n, c_nationkey AS k, c_name FROM customer),
e AS (SELECT task, k, min(n) AS first_at, max(n) AS last_at, arg_max(c_name, n) AS title, count(DISTINCT n % 7) AS n_documents, bool_or(n % 5 = 0) AS any_downloaded FROM c GROUP BY task, k)
SELECT task, 'http://x/' || k AS entry_id, row_number() OVER (PARTITION BY task ORDER BY first_at) AS serial, title, 'r' || last_at AS remark, n_documents + 1 AS n_documents, any_downloaded FROM e""")
def entry_stream(spark, sf_dir):
    """Customers as a stream of listing entries: an entry for each nation of a segment, known by its page, with further documents."""
    schema = table(spark, sf_dir, "customer").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/customer.parque[t]")  # as a pattern, a table may be a file or a folder
    n, page = F.col("c_custkey"), F.concat(F.lit("http://x/"), "c_nationkey")
    no = F.lit(None).cast("string")

    def doc(url, kind, done):
        return F.struct(url.alias("url"), F.lit(kind).alias("type"), F.lit("").alias("title"), done.alias("downloaded"), no.alias("local_path"))

    docs = F.array(doc(page, "html", F.lit(False)), doc(F.concat_ws("/", page, (n % 7).cast("string")), "pdf", n % 5 == 0))
    entries = rows.select(F.col("c_mktsegment").alias("task"), n.alias("ordinal"), F.lit(None).cast("long").alias("serial"), F.col("c_name").alias("title"), F.concat(F.lit("r"), n).alias("remark"), docs.alias("documents"))
    base = f"{shared_dir(spark)}/entries-{uuid.uuid4().hex}"
    E.run_stream(E.entry_changes(entries), f"{base}/log", f"{base}/checkpoint")
    out = E.latest_entries(spark.read.schema(E.CHANGES).parquet(f"{base}/log"))
    return out.select("task", "entry_id", "serial", "title", "remark", F.size("documents").cast("long").alias("n_documents"), F.exists("documents", lambda d: d["downloaded"]).alias("any_downloaded"))


@register("snapshot_record", """
WITH l AS (SELECT DISTINCT o_orderpriority AS task, (year(o_orderdate) * 12 + month(o_orderdate))::BIGINT AS snapshot, o_custkey AS e FROM orders),
s AS (SELECT task, snapshot, lag(snapshot) OVER w AS before, lead(snapshot) OVER w AS after FROM (SELECT DISTINCT task, snapshot FROM l) WINDOW w AS (PARTITION BY task ORDER BY snapshot)),
n AS (SELECT task, snapshot, count(*) AS n FROM l GROUP BY ALL),
g AS (SELECT s.task, s.snapshot, count(*) FILTER (p.e IS NULL) AS added FROM s JOIN l USING (task, snapshot) LEFT JOIN l p ON p.task = s.task AND p.snapshot = s.before AND p.e = l.e GROUP BY ALL)
SELECT task, snapshot, n.n AS entries_total, n.n - coalesce(m.n, 0) AS entries_diff, added, coalesce(m.n, 0) - (n.n - added) AS removed
FROM s JOIN n USING (task, snapshot) LEFT JOIN n m ON m.task = s.task AND m.snapshot = s.before JOIN g USING (task, snapshot) WHERE after IS NOT NULL AND (added > 0 OR coalesce(m.n, 0) > n.n - added)""")
def snapshot_record(spark, sf_dir):
    """Each month's customers of a priority as a listing: what came and went against the one before."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("task"), (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("long").alias("snapshot"), F.concat(F.lit("c"), "o_custkey").alias("entry_id")).distinct()
    out = E.snapshot_history(o, always=True)
    return out.select("task", "snapshot", "entries_total", "entries_diff", F.size("added").cast("long").alias("added"), F.size("removed").cast("long").alias("removed"))
