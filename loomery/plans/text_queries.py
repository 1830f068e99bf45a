"""Queries of scalar text functions, line statistics, chunking and quality flags."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomery.functions import text as X
from loomery.operators import packing, ranking
from loomery.plans.registry import register
from loomery.sources.tables import table


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))


@register("token_stats", r"""
WITH t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[A-Za-z0-9]+|[\x{4e00}-\x{9fff}]') AS w FROM documents)
SELECT doc_id, len(w)::BIGINT AS n_tokens, len(list_distinct(w))::BIGINT AS n_distinct FROM t""")
def token_stats(spark, sf_dir):
    t = _docs(spark, sf_dir).select("doc_id", X.tokenize_terms(F.col("text")).alias("w"))
    return t.select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"))


@register("line_stats", r"""
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
SELECT doc_id, len(l)::BIGINT AS n_lines, len(list_filter(l, lambda x: trim(x) <> ''))::BIGINT AS n_filled, list_max(list_transform(l, lambda x: length(x)))::BIGINT AS longest FROM l""")
def line_stats(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", F.split("text", "\n").alias("l"))
    filled = F.size(F.filter("l", lambda x: F.btrim(x) != ""))
    return d.select("doc_id", F.size("l").cast("long").alias("n_lines"), filled.cast("long").alias("n_filled"), F.array_max(F.transform("l", F.length)).cast("long").alias("longest"))


@register("quality_flags", r"""
WITH m AS (SELECT doc_id, length(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9]', '', 'g')) AS meaningful, length(coalesce(text, '')) AS n, len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '')) AS lines FROM documents)
SELECT doc_id, meaningful::BIGINT AS meaningful, meaningful < 100 AS short, n > 0 AND lines <= 1 AS header_only FROM m""")
def quality_flags(spark, sf_dir):
    lines = F.size(F.filter(F.split("text", "\n"), lambda x: F.btrim(x) != ""))
    meaningful = F.length(F.regexp_replace("text", "[^A-Za-z0-9]", "")).cast("long")
    return _docs(spark, sf_dir).select("doc_id", meaningful.alias("meaningful"), (meaningful < 100).alias("short"), ((F.length("text") > 0) & (lines <= 1)).alias("header_only"))


@register("garbled_ratio", r"""
WITH m AS (SELECT doc_id, length(regexp_replace(coalesce(text, ''), '[^#*$%&|]', '', 'g')) AS bad, length(regexp_replace(coalesce(text, ''), '[ \n]', '', 'g')) AS n FROM documents)
SELECT doc_id, round(CASE WHEN n = 0 THEN 0.0 ELSE bad / n END, 6) AS ratio, n > 0 AND bad * 50 >= n AS garbled FROM m""")
def garbled_ratio(spark, sf_dir):
    """Share of characters that extraction leaves behind when it fails; 2 % make a text garbled."""
    m = _docs(spark, sf_dir).select("doc_id", F.length(F.regexp_replace("text", "[^#*$%&|]", "")).alias("bad"), F.length(F.regexp_replace("text", "[ \\n]", "")).alias("n"))
    return m.select("doc_id", F.round(F.when(F.col("n") == 0, 0.0).otherwise(F.col("bad") / F.col("n")), 6).alias("ratio"), ((F.col("n") > 0) & (F.col("bad") * 50 >= F.col("n"))).alias("garbled"))


@register("chunk_overlap", r"""
WITH d AS (SELECT doc_id, text FROM documents WHERE length(text) > 0),
r AS (SELECT doc_id, text, unnest(range(greatest(1, ceil((length(text) - 200) / 1800.0)::BIGINT))) AS i FROM d)
SELECT doc_id, i AS chunk, length(substr(text, i * 1800 + 1, 2000))::BIGINT AS n, md5(substr(text, i * 1800 + 1, 2000)) AS digest FROM r""")
def chunk_overlap(spark, sf_dir):
    d = _docs(spark, sf_dir).where("length(text) > 0").select("doc_id", F.posexplode(X.chunks(F.col("text"), 2000, 200)).alias("chunk", "c"))
    return d.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.length("c").cast("long").alias("n"), F.md5("c").alias("digest"))


@register("chunk_count_quirk", r"""
SELECT doc_id, greatest(1, ceil(length(text) / 1800.0))::BIGINT AS emitted, (1 + greatest(0, ceil((length(text) - 2000) / 1800.0)))::BIGINT AS labelled FROM documents WHERE length(text) > 0""")
def chunk_count_quirk(spark, sf_dir):
    """Pieces started at every step, against the number that their label announces."""
    d = _docs(spark, sf_dir).where("length(text) > 0")
    return d.select("doc_id", F.size(X.chunks_with_tail(F.col("text"), 2000, 200)).cast("long").alias("emitted"), (1 + F.greatest(F.lit(0), F.ceil((F.length("text") - 2000) / 1800))).cast("long").alias("labelled"))


@register("chunk_fixed", """
SELECT batch, count(*)::BIGINT AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM (
  SELECT doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 60 AS b, source || ':' || ((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 60) AS batch FROM documents
) GROUP BY batch""")
def chunk_fixed(spark, sf_dir):
    """Batches of 60 in each source."""
    rows = ranking.fixed_batches(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 60)
    d = rows.select("doc_id", F.concat_ws(":", "source", F.col("batch").cast("string")).alias("batch"))
    return d.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


@register("greedy_pack")
def greedy_pack(spark, sf_dir):
    """Batches in order, of at most 5 entries and 30,000 characters; a larger entry stands alone."""
    d = table(spark, sf_dir, "documents").select("source", "doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("size"))
    return packing.greedy_batches(d, "source", "doc_id", "size", 5, 30_000)


@register("find_sentence", r"""
SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[.;]\s*'), lambda s: contains(s, 'thing') OR contains(s, 'reour'))[1] AS sentence FROM documents""")
def find_sentence(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.find_sentence(F.col("text"), ("thing", "reour"), "[.;]\\s*").alias("sentence"))


@register("year_prefix", r"""
SELECT doc_id, regexp_extract(coalesce(text, ''), '(19|20)[0-9]{2}', 1) AS year_prefix, regexp_extract(coalesce(text, ''), '(19|20)[0-9]{2}', 0) AS year_full FROM documents""")
def year_prefix(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.year_prefix(F.col("text")).alias("year_prefix"), X.year_full(F.col("text")).alias("year_full"))


@register("parse_date", """
SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS parsed FROM orders""")
def parse_date(spark, sf_dir):
    """Three spellings of a date, one of them of no such day."""
    day = F.col("o_orderdate").cast("date")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.lit("2023-02-31")).when(F.col("o_orderkey") % 3 == 1, F.date_format(day, "yyyy/M/d")).otherwise(F.concat(F.date_format(day, "yyyy"), F.lit("年"), F.date_format(day, "M"), F.lit("月"), F.date_format(day, "d"), F.lit("日")))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(X.parse_date(text), "yyyy-MM-dd").alias("parsed"))


@register("entry_features")
def entry_features(spark, sf_dir):
    """The scalar features of entries over CJK titles made from the rows' numbers."""
    n = F.col("p_partkey").cast("string")
    title = F.concat(F.lit("中国人民银行公告〔2023〕第"), n, F.lit("号（关于测试管理办法）"))
    e = table(spark, sf_dir, "part").select("p_partkey", X.norm_text(title).alias("t"))
    return e.select("p_partkey", "t", X.extract_docno(F.col("t")).alias("doc_no"), X.first_keyword(F.col("t")).alias("doctype"), X.keyword_list(F.col("t")).alias("agency"), X.tokenize(F.col("t")).alias("tokens"), X.is_current(F.col("t"), F.lit("")).alias("is_policy"))
