"""Queries of the metadata DSL, pagination and field profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomery.operators.metadata import describe_fields, query_metadata
from loomery.plans.registry import register
from loomery.sources.tables import table


@register("meta_filter_ops", """
SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders
WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority IS DISTINCT FROM '5-LOW' AND contains(lower(o_orderpriority), 'high')
  AND o_totalprice > 100000 AND o_totalprice <= 400000""")
def meta_filter_ops(spark, sf_dir):
    filters = [
        {"field": "o_orderstatus", "op": "in", "value": ["F", "O"]},
        {"field": "o_orderpriority", "op": "!=", "value": "5-LOW"},
        {"field": "o_orderpriority", "op": "contains", "value": "HIGH"},
        {"field": "o_totalprice", "op": ">", "value": 100000.0},
        {"field": "o_totalprice", "op": "<=", "value": 400000.0},
    ]
    return query_metadata(table(spark, sf_dir, "orders"), select=["o_orderkey", "o_orderstatus", "o_orderpriority"], filters=filters)


@register("meta_null_filters", "SELECT doc_id FROM documents WHERE lang IS DISTINCT FROM 'en' AND (source IN ('src1', 'src2') OR source IS NULL)")
def meta_null_filters(spark, sf_dir):
    filters = [{"field": "lang", "op": "!=", "value": "en"}, {"field": "source", "op": "in", "value": ["src1", "src2", None]}]
    return query_metadata(table(spark, sf_dir, "documents"), select=["doc_id"], filters=filters)


@register("meta_any_case", """
SELECT o_orderstatus, count(*)::BIGINT AS "COUNT", round(sum(o_totalprice), 2) AS "SUM_o_totalprice" FROM orders
WHERE o_orderstatus IN ('F', 'O') AND contains(lower(o_orderpriority), 'medium') GROUP BY o_orderstatus""")
def meta_any_case(spark, sf_dir):
    """Operators and functions in capitals; a filter without an operator, and one with an unknown one, let all rows pass."""
    filters = [{"field": "o_orderstatus", "op": "IN", "value": ["F", "O"]}, {"field": "o_orderpriority", "op": "Contains", "value": "MEDIUM"}, {"field": "o_orderkey", "value": 1}, {"field": "o_orderkey", "op": "like", "value": "x"}]
    aggs = [{"func": "COUNT"}, {"func": "SUM", "field": "o_totalprice"}]
    out = query_metadata(table(spark, sf_dir, "orders"), filters=filters, group_by=["o_orderstatus"], aggregates=aggs, ordinal="o_orderkey")
    return out.withColumn("SUM_o_totalprice", F.round("SUM_o_totalprice", 2))


@register("meta_group_agg", """
SELECT o_orderstatus, o_orderpriority, count(*)::BIGINT AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 2) AS mean
FROM orders GROUP BY ALL""")
def meta_group_agg(spark, sf_dir):
    aggs = [{"func": "count", "field": "*", "as": "n"}, {"func": "sum", "field": "o_totalprice", "as": "total"}, {"func": "avg", "field": "o_totalprice", "as": "mean"}]
    out = query_metadata(table(spark, sf_dir, "orders"), group_by=["o_orderstatus", "o_orderpriority"], aggregates=aggs, ordinal="o_orderkey")
    return out.withColumns({"total": F.round("total", 2), "mean": F.round("mean", 2)})


@register("meta_global_agg_empty", "SELECT 0::BIGINT AS n, 0.0::DOUBLE AS total, 0.0::DOUBLE AS mean")
def meta_global_agg_empty(spark, sf_dir):
    aggs = [{"func": "count", "field": "*", "as": "n"}, {"func": "sum", "field": "o_totalprice", "as": "total"}, {"func": "avg", "field": "o_totalprice", "as": "mean"}]
    return query_metadata(table(spark, sf_dir, "orders"), filters=[{"field": "o_orderkey", "op": "<", "value": 0}], aggregates=aggs, ordinal="o_orderkey")


@register("meta_group_first", """
SELECT c_nationkey, c_mktsegment, count(*)::BIGINT AS n, arg_min(c_name, c_custkey) AS c_name FROM customer GROUP BY ALL""")
def meta_group_first(spark, sf_dir):
    aggs = [{"func": "count", "field": "c_custkey", "as": "n"}]
    return query_metadata(table(spark, sf_dir, "customer"), select=["c_name"], group_by=["c_nationkey", "c_mktsegment"], aggregates=aggs, ordinal="c_custkey")


@register("meta_order_limit", """
SELECT p_name, p_size, p_retailprice FROM part ORDER BY lower(p_name) DESC NULLS LAST, p_retailprice NULLS LAST, p_partkey LIMIT 25""")
def meta_order_limit(spark, sf_dir):
    order = [{"field": "p_name", "direction": "desc"}, {"field": "p_retailprice", "direction": "asc"}]
    return query_metadata(table(spark, sf_dir, "part"), select=["p_name", "p_size", "p_retailprice"], order_by=order, limit=25, ordinal="p_partkey")


@register("describe_fields", """
WITH v AS (
  SELECT 'lang' AS field, lang AS value, doc_id AS pos FROM documents UNION ALL SELECT 'source', source, doc_id FROM documents
), g AS (SELECT field, value, count(*)::BIGINT AS n, min(pos) AS first_at FROM v WHERE value IS NOT NULL GROUP BY ALL)
SELECT field, value, n, first_at FROM g QUALIFY row_number() OVER (PARTITION BY field ORDER BY first_at, value) <= 15""")
def describe(spark, sf_dir):
    return describe_fields(table(spark, sf_dir, "documents"), ["lang", "source"], "doc_id")


@register("pagination_page", """
SELECT doc_id, lang, source, count(*) OVER () > 60 AS has_more FROM documents ORDER BY doc_id LIMIT 20 OFFSET 40""")
def pagination_page(spark, sf_dir):
    """Page 3 of 20 rows; one more row than asked for tells whether there are more."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source").orderBy("doc_id").offset(40).limit(21)
    more = rows.agg((F.count(F.lit(1)) > 20).alias("has_more"))
    return rows.orderBy("doc_id").limit(20).crossJoin(F.broadcast(more))


@register("semi_anti_labels", """
SELECT doc_id, TRUE AS labelled FROM documents SEMI JOIN labels USING (doc_id)
UNION ALL SELECT doc_id, FALSE FROM documents ANTI JOIN labels USING (doc_id)""")
def semi_anti_labels(spark, sf_dir):
    """Semi and anti join in one pass: a left join with the distinct keys."""
    labels = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("l", F.lit(True))
    return table(spark, sf_dir, "documents").select("doc_id").join(labels, "doc_id", "left").select("doc_id", F.col("l").isNotNull().alias("labelled"))
