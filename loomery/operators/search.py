"""Searches over document tables: text, keyword, fuzzy, BM25, vector and hybrid."""

from __future__ import annotations

from collections import Counter
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomery.functions import text as X
from loomery.operators.fuzzy import fuzzy_search, fuzzy_search_all  # noqa: F401


def text_search(docs: DataFrame, query: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 20) -> DataFrame:
    """(id, score, snippet): documents with the query (case ignored), most occurrences first. A limit
    of 0 means 20, a negative one none."""
    low = F.lower(F.coalesce(text_col, F.lit("")))
    hits = docs.select(id_col, low.alias("low"), text_col).where(F.contains("low", F.lit(query.lower())))
    out = hits.select(id_col, X.occurrences(F.col("low"), query.lower()).alias("score"), _around(query).alias("snippet"))
    out = out.orderBy(F.desc("score"), id_col)
    return out if limit < 0 else out.limit(limit or 20)


def _around(query: str, text_col: str = "text", before: int = 60, after: int = 120) -> Column:
    at = F.instr("low", query.lower())
    start = F.greatest(at - before, F.lit(1))
    return F.substring(F.col(text_col), start, at + after - start)


def keyword_search(entries: DataFrame, query: str, id_col: str = "doc_id", title_col: str = "norm_title", text_col: str = "norm_text", stopwords: tuple[str, ...] = X.STOPWORDS) -> DataFrame:
    """(id, title, title_exact, title_hits, content_hits), best first. Both texts are folded; the content
    counts only where the title has neither the query nor one of its words."""
    import re

    q = X.fold(query)
    words = list(dict.fromkeys(t for t in re.findall("[一-鿿]+|[a-zA-Z0-9]+", q) if t not in stopwords))
    if not q:
        return entries.select(id_col, F.col(title_col).alias("title"), *[F.lit(0).alias(c) for c in ("title_exact", "title_hits", "content_hits")]).limit(0)

    def hits(col: str) -> Column:
        return F.get(F.transform(F.array(F.coalesce(col, F.lit(""))), lambda t: reduce(add, [F.contains(t, F.lit(w)).cast("int") for w in words], F.lit(0))), F.lit(0))

    exact = F.coalesce(F.contains(F.col(title_col), F.lit(q)), F.lit(False)).cast("int")
    in_title = hits(title_col)
    content = hits(text_col) if words else F.coalesce(F.contains(F.col(text_col), F.lit(q)), F.lit(False)).cast("int")
    found = (exact > 0) | (in_title > 0)
    from_title = in_title if words else exact
    # the texts may be expressions that a projection would repeat in each use: each is computed once, in a lambda of
    # one element, and the counts behind a generator, so that filter and sort read them. The content is counted only where it counts
    one = F.explode(F.array(F.struct(F.col(title_col).alias("title"), exact.alias("title_exact"), in_title.alias("title_hits"), F.when(found, from_title).otherwise(content).alias("content_hits")))).alias("one")
    out = entries.select(id_col, one).select(id_col, "one.*")
    return out.where("title_exact > 0 or title_hits > 0 or content_hits > 0").orderBy(F.desc("title_exact"), F.desc("title_hits"), F.desc("content_hits"), "title")


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, term, tf, dl): the index that bm25_postings reads. Counted with the terms of a document side by
    side, so that nothing but (id, term) pairs is shuffled."""
    words = docs.select(F.col(id_col).alias("id"), X.tokenize_terms(F.coalesce(text_col, F.lit(""))).alias("words"))
    return words.select("id", F.size("words").alias("dl"), F.explode("words").alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").cast("long").alias("dl"))


def _is(term: str):
    return lambda w: w == term


def bm25(docs: DataFrame, query_terms: list[str], id_col: str = "doc_id", text_col: str = "text", k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(id, score) of documents with a query term; a repeated term counts repeatedly. One pass: each
    document gives its frequencies of the query's terms alone, and statistics are sums over these."""
    weight = Counter(t.lower() for t in query_terms)
    terms = sorted(weight)
    if not terms:
        return docs.select(F.col(id_col).alias("id"), F.lit(0.0).alias("score")).limit(0)
    words = X.tokenize_terms(F.coalesce(text_col, F.lit("")))
    rows = docs.select(F.col(id_col).alias("id"), words.alias("words"))
    rows = rows.select("id", F.size("words").alias("dl"), *[F.size(F.filter("words", _is(t))).alias(f"tf_{i}") for i, t in enumerate(terms)])
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *[F.sum((F.col(f"tf_{i}") > 0).cast("long")).alias(f"df_{i}") for i in range(len(terms))])
    score = F.lit(0.0)
    for i, t in enumerate(terms):
        df, tf = F.col(f"df_{i}"), F.col(f"tf_{i}")
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        score = score + F.when(tf > 0, weight[t] * idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))).otherwise(0.0)
    return rows.crossJoin(F.broadcast(stats)).select("id", score.alias("score")).where("score > 0")


def lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(n, avgdl): one row, to be kept with the postings. Documents without a term count as well."""
    dl = F.size(X.tokenize_terms(F.coalesce(text_col, F.lit(""))))
    return docs.agg(F.count(F.lit(1)).alias("n"), F.avg(dl).alias("avgdl"))


def save_postings(index: DataFrame, path: str, buckets: int = 256) -> None:
    """Writes postings by hash of the term, sorted, so that a query reads the folders of its own terms alone."""
    index.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets))).repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(16))).sortWithinPartitions("term").write.partitionBy("bucket").parquet(path)


def read_postings(spark: SparkSession, path: str, query_terms: list[str], buckets: int = 256) -> DataFrame:
    """The postings of some terms, from their folders."""
    wanted = sorted({t.lower() for t in query_terms})
    places = {r[0] for r in spark.createDataFrame([(t,) for t in wanted], "t string").select(F.pmod(F.xxhash64("t"), F.lit(buckets))).collect()}
    return spark.read.parquet(path).where(F.col("bucket").isin(*places) & F.col("term").isin(wanted)).drop("bucket")


def bm25_postings(index: DataFrame, stats: DataFrame, query_terms: list[str], k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """As bm25, from postings (id, term, tf, dl) and their statistics (n, avgdl): only the query's own terms are read, and scores
    are sums over them."""
    weight = Counter(t.lower() for t in query_terms)
    words = index.where(F.col("term").isin(sorted(weight)))
    asked = index.sparkSession.createDataFrame(sorted(weight.items()), "t string, weight long")
    df = words.groupBy(F.col("term").alias("d")).agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(asked), F.col("d") == F.col("t"))
    rows = words.join(F.broadcast(df), F.col("term") == F.col("d")).crossJoin(F.broadcast(stats))  # a row per term of the query, and one of statistics
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    points = F.col("weight") * idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return rows.groupBy("id").agg(F.sum(points).alias("score"))


def vector_scores(vectors: DataFrame, query: list[float], id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, score): cosines above zero."""
    lit = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(F.col(id_col).alias("id"), X.cosine(F.col(vector_col), lit).alias("score")).where("score > 0")


def top(scores: DataFrame, k: int) -> DataFrame:
    return scores.orderBy(F.desc("score"), "id").limit(k)


def hybrid(channels: list[tuple[str, float, DataFrame]], k: int = 20) -> DataFrame:
    """Fuses ranked channels (name, weight, (id, score)): sum of weighted scores, names of the channels
    that found the row."""
    parts = [s.select("id", (F.col("score") * w).alias("score"), F.lit(name).alias("channel")) for name, w, s in channels]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    fused = both.groupBy("id").agg(F.sum("score").alias("score"), F.array_join(F.array_sort(F.collect_set("channel")), "+").alias("match_type"))
    return top(fused, k)


def top_per_query(scores: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query (query_id, id, score)."""
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)
