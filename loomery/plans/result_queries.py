"""Queries of results: snippets, fused hits, merges by clause, streams, histories and look-ups with fallbacks."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomery.operators import results as R
from loomery.operators import search as S
from loomery.plans.registry import register
from loomery.plans.search_queries import _BM25, _VEC, TERMS, _query_vector
from loomery.sources.tables import table


@register("snippets", r"""
WITH d AS (SELECT doc_id, trim(replace(coalesce(text, ''), chr(10), ' '), ' ') AS t FROM documents),
p AS (SELECT doc_id, t, CASE WHEN contains(t, 'tionand') THEN instr(t, 'tionand') WHEN contains(t, 'the') THEN instr(t, 'the') ELSE 0 END AS place FROM d)
SELECT doc_id, CASE WHEN place > 0 THEN trim(substr(t, greatest(place - 60, 1), 180), ' ') ELSE left(t, 180) END AS snippet FROM p""")
def snippets(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", R.snippet(F.col("text"), ["the", "tionand"]).alias("snippet"))


@register("hybrid_with_penalties", f"""WITH {_BM25}, {_VEC},
h AS (SELECT id, 2.0 * score AS score, 'bm25' AS channel FROM (SELECT * FROM bm WHERE score > 0 ORDER BY score DESC, id LIMIT 40)
  UNION ALL SELECT id, score, 'vector' FROM (SELECT * FROM ve WHERE score > 0 ORDER BY score DESC, id LIMIT 40)
  UNION ALL SELECT id, score, 'bm25' FROM (SELECT * FROM bm WHERE score > 0 ORDER BY score DESC, id LIMIT 20))
SELECT source AS id, round(sum(score), 5) AS score, string_agg(DISTINCT channel, '+' ORDER BY channel) AS match_type FROM h JOIN documents ON doc_id = id GROUP BY source ORDER BY sum(score) DESC, id LIMIT 20""")
def hybrid_with_penalties(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("law_id"), "text")
    near = S.vector_scores(table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir))
    out = R.fused_hits(" ".join(TERMS), docs, near, level="law", penalty_words=("the",), penalty_query=tuple(TERMS))
    return out.select("id", F.round("score", 5).alias("score"), "match_type")


@register("bm25_from_postings", f"WITH {_BM25} SELECT id, round(score, 6) AS score FROM bm WHERE score > 0")
def bm25_from_postings(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return S.bm25_postings(S.postings(docs), S.lengths(docs), TERMS).select("id", F.round("score", 6).alias("score"))


@register("merged_matches", """
WITH m AS (SELECT event_id, user_id::VARCHAR AS id, nullif(event_type, 'error') AS clause FROM events)
SELECT id, clause, 'User ' || id AS title, CASE WHEN max(event_id % 3) <> min(event_id % 3) OR count(*) > 0 THEN string_agg(DISTINCT 'r' || (event_id % 3), ' ' ORDER BY 'r' || (event_id % 3)) END AS reasons, min(event_id)::BIGINT AS place
FROM m WHERE clause IS NOT NULL GROUP BY ALL""")
def merged_matches(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("ordinal"), F.col("user_id").cast("string").alias("id"), F.nullif("event_type", F.lit("error")).alias("clause"), F.lit("").alias("title"), F.concat(F.lit("r"), (F.col("event_id") % 3).cast("string")).alias("reason"))
    titles = e.select("id").distinct().select("id", F.concat(F.lit("User "), "id").alias("title"))
    out = R.merge_matches(e, titles)
    return out.select("id", "clause", "title", F.array_join(F.array_sort(F.split("reason", "; ")), " ").alias("reasons"), "place")


@register("reason_lists", """
WITH f AS (SELECT user_id::VARCHAR AS id, event_type AS reason, min(event_id) AS o FROM events GROUP BY ALL) SELECT id, list(reason ORDER BY o) AS reasons FROM f GROUP BY id""")
def reason_lists(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("ordinal"), F.col("user_id").cast("string").alias("id"), F.col("event_type").alias("reason"))
    return R.reason_lists(e)


@register("streamed_answers", """
WITH e AS (SELECT user_id AS conversation, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'error' ELSE 'content_delta' END AS event, event_type || ';' AS delta FROM events),
d AS (SELECT *, min(seq) FILTER (event = 'done') OVER (PARTITION BY conversation) AS done FROM e)
SELECT conversation, coalesce(string_agg(delta, '' ORDER BY seq) FILTER (event = 'content_delta'), '') AS answer, bool_or(event = 'error') AS failed FROM d WHERE done IS NULL OR seq < done GROUP BY conversation""")
def streamed_answers(spark, sf_dir):
    kind = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "error").otherwise("content_delta")
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("conversation"), F.col("event_id").alias("seq"), kind.alias("event"), F.concat("event_type", F.lit(";")).alias("delta"))
    return R.streamed_answers(e)


@register("answers_as_json", """
SELECT event_id, CASE WHEN event_id % 3 < 2 THEN (props::JSON->>'k')::BIGINT END AS k FROM events""")
def answers_as_json(spark, sf_dir):
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Here:\n```json\n"), "props", F.lit("\n```\nDone"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit(" "), "props", F.lit("\n"))).otherwise(F.concat(F.lit("no { "), "props"))
    e = table(spark, sf_dir, "events").select("event_id", R.answer_json(text).alias("v"))
    return e.select("event_id", F.try_variant_get("v", "$.k", "bigint").alias("k"))


@register("compacted_traces", """
SELECT user_id, count(*)::BIGINT AS n, max(event_id) AS last, list(event_id ORDER BY event_id)[-3:] AS tail FROM events GROUP BY user_id""")
def compacted_traces(spark, sf_dir):
    return R.compacted(table(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id", 3).select("user_id", "n", "last", "tail")


@register("snapshot_history", """
SELECT count(*) FILTER (o_orderkey % 3 <> 1)::BIGINT AS entries_total, (count(*) FILTER (o_orderkey % 3 = 0) - count(*) FILTER (o_orderkey % 3 = 1))::BIGINT AS entries_diff,
  count(*) FILTER (o_orderkey % 3 = 0)::BIGINT AS added, count(*) FILTER (o_orderkey % 3 = 1)::BIGINT AS removed FROM orders
HAVING count(*) FILTER (o_orderkey % 3 = 0) <> count(*) FILTER (o_orderkey % 3 = 1)""")
def snapshot_history(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    return R.history(o.where("o_orderkey % 3 <> 0"), o.where("o_orderkey % 3 <> 1"), "o_orderkey")


@register("summary_match", """
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'index' WHEN 2 THEN 'serial' END AS value FROM customer""")
def summary_match(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").alias("serial"), (F.col("c_custkey") + 7).alias("index"))
    k, none = F.col("c_custkey") % 4, F.lit(None).cast("long")
    s = c.where(k < 3).select(F.when(k == 1, none).otherwise(F.col("serial")).alias("serial"), F.when(k == 2, F.lit(-1)).otherwise(F.col("index")).alias("index"), F.when(k == 0, "exact").when(k == 1, "index").otherwise("serial").alias("value"))
    return R.summary_match(c, s).select("c_custkey", "value")


@register("embedding_cache_hits", """
SELECT item_id AS id, sha1(text) AS hash, item_id % 3 = 0 AS held FROM benchmark""")
def embedding_cache_hits(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    text = F.when(F.col("id") % 3 == 0, F.col("text")).otherwise("an earlier text")
    cache = b.where("id % 3 <> 2").select("id", F.sha1(F.encode(text, "UTF-8")).alias("hash"), F.array(F.lit(1.0), F.lit(2.0)).alias("vector"))
    return R.cached(b, cache).select("id", "hash", F.col("vector").isNotNull().alias("held"))


@register("requested_tasks", """
WITH r AS (SELECT min(o_orderkey) AS ordinal, CASE WHEN o_orderkey % 11 = 0 THEN 'none' ELSE o_orderpriority END AS slug FROM orders GROUP BY 2)
SELECT slug, ordinal, CASE WHEN slug = 'none' THEN NULL ELSE (SELECT count(*) FROM orders o WHERE o.o_orderpriority = slug) END::BIGINT AS n, CASE WHEN slug = 'none' THEN 'not_found' END AS error FROM r""")
def requested_tasks(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    overview = o.groupBy(F.col("o_orderpriority").alias("slug")).agg(F.count(F.lit(1)).alias("n"))
    asked = o.select(F.col("o_orderkey").alias("ordinal"), F.when(F.col("o_orderkey") % 11 == 0, "none").otherwise(F.col("o_orderpriority")).alias("slug"))
    return R.requested(asked, overview).select("slug", "ordinal", "n", "error")


@register("dedupe_counts", """
SELECT c_mktsegment AS task, count(*)::BIGINT AS original, count(*) FILTER (c_custkey % 3 <> 0)::BIGINT AS "unique", count(*) FILTER (c_custkey % 3 = 0)::BIGINT AS duplicate FROM customer GROUP BY 1""")
def dedupe_counts(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("task"), (F.col("c_custkey") % 3 != 0).alias("kept"))
    return R.dedupe_counts(c)


@register("numbered_titles", "SELECT p_partkey, row_number() OVER (ORDER BY lower(p_name), p_partkey)::BIGINT AS seq FROM part")
def numbered_titles(spark, sf_dir):
    return R.numbered(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", "p_partkey").select("p_partkey", "seq")


@register("known_titles", """
SELECT o_orderkey, c_name AS title FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_custkey % 2 = 0""")
def known_titles(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("id"), F.lit("old").alias("title"))
    titles = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"))
    return R.catalogue_titles(rows, titles).select("o_orderkey", "title")
