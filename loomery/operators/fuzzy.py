"""Weighted search of entries: a declared list of features, each with a weight and a value over an entry and a query."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomery.functions import text as X

#: More queries than this go in several calls: each is a literal of the plan.
MOST_QUERIES = 1000

_QUERY = ("plain", "doc_no", "years", "doctype", "agency", "phrases", "tokens")


def _filled(c: Column) -> Column:
    return F.coalesce(c != "", F.lit(False))


def _bare(c: Column) -> Column:
    return F.translate(c, "[]", "")


def _either_way(a: Column, b: Column) -> Column:
    return _filled(a) & _filled(b) & (F.contains(a, b) | F.contains(b, a))


def _phrase_points(title: Column, phrases: Column) -> Column:
    each = F.transform(F.filter(phrases, lambda p: F.contains(title, p)), lambda p: F.least(F.lit(8.0), 2.0 + 0.8 * F.length(p)))
    return F.aggregate(each, F.lit(0.0), lambda a, x: a + x)


#: Name, weight, and what it is multiplied by (a truth counts 1). e and q name the columns of an entry and of a query.
FEATURES: tuple[tuple[str, float, Callable[[Callable[[str], Column], Callable[[str], Column]], Column]], ...] = (
    ("doc_no", 120.0, lambda e, q: _filled(e("doc_no")) & (e("doc_no") == q("doc_no"))),
    ("doc_no_part", 80.0, lambda e, q: _filled(e("doc_no")) & (e("doc_no") != q("doc_no")) & F.contains(_bare(e("doc_no")), _bare(q("doc_no")))),
    ("year", 30.0, lambda e, q: F.array_contains(q("years"), e("year"))),
    ("other_year", -5.0, lambda e, q: (F.size(q("years")) > 0) & _filled(e("year")) & ~F.array_contains(q("years"), e("year"))),
    ("doctype", 15.0, lambda e, q: e("doctype") == q("doctype")),
    ("agency", 10.0, lambda e, q: _either_way(e("agency"), q("agency"))),
    ("phrases", 1.0, lambda e, q: _phrase_points(e("norm_title"), q("phrases"))),
    ("tokens", 40.0, lambda e, q: X.jaccard(e("tokens"), q("tokens"))),
    ("doc_no_inside", 30.0, lambda e, q: _filled(e("doc_no")) & F.contains(q("plain"), e("doc_no"))),
    ("doctype_inside", 10.0, lambda e, q: _filled(e("doctype")) & F.contains(q("plain"), e("doctype")) & F.contains(e("title"), e("doctype"))),
    ("pdf", 3.0, lambda e, q: F.lower(e("best_path")).endswith(".pdf")),
)


def query_features(spark: SparkSession, queries: Sequence[str]) -> DataFrame:
    """(query_id, query, and the columns that features read) of some queries, by the functions that entries' columns come from."""
    rows = spark.createDataFrame(list(enumerate(queries)), "query_id int, query string").withColumn("plain", X.norm_text("query"))
    plain = F.col("plain")
    return rows.withColumns({
        "doc_no": X.extract_docno(plain),
        "years": F.regexp_extract_all(plain, F.lit("(19|20)[0-9]{2}"), F.lit(1)),
        "doctype": X.first_keyword(plain),
        "agency": X.keyword_list(plain),
        "phrases": F.regexp_extract_all(plain, F.lit("[\\u4e00-\\u9fff]{2,}"), F.lit(0)),
        "tokens": X.tokenize(plain),
    })


def fuzzy_points(entries: DataFrame, queries: Sequence[str]) -> DataFrame:
    """Every entry with every query: query_id, a column of points for each feature, and score, their sum. entries has norm_title,
    title, tokens, doc_no, year, doctype, agency and best_path; what is null has no points."""
    if len(queries) > MOST_QUERIES:
        raise ValueError(f"at most {MOST_QUERIES} queries in one call")
    asked = query_features(entries.sparkSession, queries).collect()  # as many rows as queries were given
    literals = [F.struct(F.lit(r["query_id"]).alias("query_id"), *[_literal(r[c]).alias(c) for c in _QUERY]) for r in asked]
    rows = entries.withColumn("__q", F.explode(F.array(*literals)))

    def points(weight: float, value: Column) -> Column:
        return F.coalesce(weight * value.cast("double"), F.lit(0.0))

    named = {name: points(weight, value(lambda c: F.col(f"`{c}`"), lambda c: F.col(f"__q.{c}"))) for name, weight, value in FEATURES}
    scored = rows.withColumns({f"points_{name}": p for name, p in named.items()})
    total = reduce(add, [F.col(f"points_{name}") for name in named])
    return scored.select(F.col("__q.query_id").alias("query_id"), *entries.columns, *[f"points_{name}" for name in named], total.alias("score"))


def _literal(value) -> Column:
    if isinstance(value, list):
        return F.array(*map(F.lit, value)).cast("array<string>")
    return F.lit(value).cast("string")


def fuzzy_search_all(entries: DataFrame, queries: Sequence[str], k: int = 5, order: str = "rank") -> DataFrame:
    """The k best entries of each query, ties in the given order, with their points by feature and place."""
    scored = fuzzy_points(entries, queries)
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), order))
    # ranks are counted over scores alone; entries, which are wide, are sorted if they aren't behind their query's last place
    key = F.struct((-F.col("score")).alias("s"), F.col(order).alias("o"))
    ranked = scored.select("query_id", "score", order).withColumn("place", place).where(F.col("place") <= k)
    last = ranked.groupBy(F.col("query_id").alias("l_id")).agg(F.max(key).alias("l_key"))  # a row for each query, MOST_QUERIES at most
    best = scored.join(F.broadcast(last), (F.col("query_id") == F.col("l_id")) & (key <= F.col("l_key"))).drop("l_id", "l_key")
    return best.withColumn("place", place).where(F.col("place") <= k)


def fuzzy_search(entries: DataFrame, query: str, k: int = 5, order: str = "rank") -> DataFrame:
    """The k best entries of one query."""
    scored = fuzzy_points(entries, [query])
    return scored.select(*entries.columns, "score").orderBy(F.desc("score"), order).limit(k)
