"""Results of searches and model answers: snippets, merges by clause, streamed answers, histories and look-ups with fallbacks."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomery.operators.merge import reasons_merge
from loomery.operators.ranking import placed
from loomery.operators.search import bm25, top

# fixed values: words of questions about penalties, and the words searched for them
PENALTY_WORDS = ("处罚", "违法", "罚款")
PENALTY_QUERY = ("罚款", "责令", "违反")


def snippet(text: Column, terms: list[str], most: int = 180) -> Column:
    """The text around the first place of the longest term that is in it, or else its beginning."""
    clean = F.btrim(F.replace(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit(" ")))
    out = F.when(clean == "", "")
    for t in sorted({t for t in terms if t}, key=lambda t: (-len(t), t)):
        at = F.instr(clean, t)
        out = out.when(at > 0, F.btrim(F.substring(clean, F.greatest(at - most // 3, F.lit(1)), F.lit(most))))
    return out.otherwise(F.left(clean, F.lit(most)))


def fused_hits(query: str, articles: DataFrame, vector_hits: DataFrame, k: int = 20, level: str = "article", penalty_words: tuple[str, ...] = PENALTY_WORDS, penalty_query: tuple[str, ...] = PENALTY_QUERY) -> DataFrame:
    """(id, score, match_type, snippet): articles (id, law_id, text) found by words, by vectors (id, score) and, for questions about
    penalties, by words of penalties. Scores of a record are summed, at level `law` those of its articles; the first hit, by
    channel and rank, gives the snippet."""
    words = lambda text: re.findall("[A-Za-z0-9]+|[一-鿿]", text.lower())  # noqa: E731  as the index has them
    channels = [("bm25", 2.0, 2 * k, bm25(articles, words(query), "id")), ("vector", 1.0, 2 * k, vector_hits)]
    if any(w in query for w in penalty_words):
        channels.append(("bm25", 1.0, k, bm25(articles, words(" ".join(penalty_query)), "id")))
    parts = []
    for i, (name, weight, n, found) in enumerate(channels):
        best = top(found.select("id", "score"), n)
        rank = F.row_number().over(W.orderBy(F.desc("score"), "id"))  # of a bounded list
        parts.append(best.select(F.col("id").alias("hit"), (F.col("score") * weight).alias("points"), F.lit(name).alias("name"), F.lit(i).alias("channel"), rank.alias("rank")))
    hits = reduce(DataFrame.unionByName, parts)
    rows = articles.select("id", "law_id", "text").join(F.broadcast(hits), F.col("id") == F.col("hit"))
    record = F.col("id" if level == "article" else "law_id").alias("record")
    first = F.min_by(snippet(F.col("text"), query.split()), F.struct("channel", "rank")).alias("snippet")
    out = rows.groupBy(record).agg(F.sum("points").alias("score"), F.array_join(F.array_sort(F.collect_set("name")), "+").alias("match_type"), first)
    return out.orderBy(F.desc("score"), "record").limit(k).withColumnRenamed("record", "id")


def merge_matches(matches: DataFrame, titles: DataFrame) -> DataFrame:
    """(id, clause, title, reason, place) of matches (ordinal, id, clause, title, reason): one row for each id and clause, with the
    title of its first match or else the catalogue's (titles: id, title), and its reasons joined. Matches without a clause are out; those
    without an id stay apart."""
    named = matches.where("coalesce(clause, '') <> ''").withColumn("key", F.concat_ws("::", F.coalesce(F.nullif("id", F.lit("")), F.concat(F.lit("?"), F.col("ordinal").cast("string"))), "clause"))
    filled = F.nullif(F.col("title"), F.lit(""))
    one = named.groupBy("key").agg(F.min_by("id", "ordinal").alias("id"), F.min_by("clause", "ordinal").alias("clause"), F.min_by(filled, "ordinal").alias("given"), F.min("ordinal").alias("place"))
    reasons = reasons_merge(named, "key", "ordinal", "reason").withColumnRenamed("key", "r_key")
    known = titles.select(F.col("id").alias("t_id"), F.col("title").alias("t_title"))
    out = one.join(reasons, F.col("key") == F.col("r_key")).join(known, F.col("id") == F.col("t_id"), "left")
    return out.select("id", "clause", F.coalesce("given", "t_title").alias("title"), "reason", "place")


def reason_lists(matches: DataFrame) -> DataFrame:
    """(id, reasons): the distinct reasons of each id in the order of their first place."""
    first = matches.where("coalesce(reason, '') <> '' and coalesce(id, '') <> ''").groupBy("id", "reason").agg(F.min("ordinal").alias("o"))
    return first.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "reason"))), lambda x: x["reason"]).alias("reasons"))


def catalogue_titles(rows: DataFrame, titles: DataFrame) -> DataFrame:
    """rows (id, ...) that the catalogue (id, title) knows, under its titles."""
    t = titles.select(F.col("id").alias("__i"), F.col("title").alias("__t"))
    return rows.drop("title").join(t, F.col("id") == F.col("__i")).withColumnRenamed("__t", "title").drop("__i")


def streamed_answers(events: DataFrame) -> DataFrame:
    """(conversation, answer, failed): the deltas of content up to the first `done`, in order; an `error` before it fails."""
    done = F.min(F.when(F.col("event") == "done", F.col("seq"))).over(W.partitionBy("conversation"))
    rows = events.withColumn("__done", done).where("__done is null or seq < __done")
    items = F.array_sort(F.collect_list(F.when(F.col("event") == "content_delta", F.struct("seq", "delta"))))
    return rows.groupBy("conversation").agg(F.array_join(F.transform(items, lambda x: x["delta"]), "").alias("answer"), F.max(F.col("event") == "error").alias("failed"))


def answer_json(text: Column) -> Column:
    """The JSON inside of a fenced block, or else of the whole text, as a variant; null for anything else."""
    fenced = F.regexp_extract(text, "(?s)```(?:json|JSON)?\\s*(.*?)\\s*```", 1)
    return F.try_parse_json(F.when(fenced != "", fenced).otherwise(F.btrim(text)))


def compacted(events: DataFrame, key: str, order: str, tail: int) -> DataFrame:
    """(key, n, last, tail): how many events a key has, its last, and the last ones in order. Only the tail is gathered."""
    back = F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))
    counts = events.groupBy(F.col(key).alias("__k")).agg(F.count(F.lit(1)).alias("n"))
    late = events.withColumn("__b", back).where(F.col("__b") <= tail)
    tails = late.groupBy(key).agg(F.max(order).alias("last"), F.array_sort(F.collect_list(order)).alias("tail"))
    return tails.join(counts, F.col(key) == F.col("__k")).drop("__k")


def history(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """One row (entries_total, entries_diff, added, removed) for the history of snapshots, or none if the number of entries hasn't changed."""
    a, b = before.select(F.col(key).alias("x")).distinct(), after.select(F.col(key).alias("y")).distinct()
    both = a.join(b, F.col("x") == F.col("y"), "full_outer")
    out = both.agg(F.count("y").alias("entries_total"), (F.count("y") - F.count("x")).alias("entries_diff"), F.count_if(F.col("x").isNull()).alias("added"), F.count_if(F.col("y").isNull()).alias("removed"))
    return out.where("entries_diff <> 0")


def summary_match(entries: DataFrame, summaries: DataFrame) -> DataFrame:
    """entries (serial, index, ...) with the summary (serial, index, value) of the same serial and index, or of the index without
    a serial, or of the serial without an index (-1)."""
    exact, index, serial = (summaries.select(F.col("serial").alias(f"s{i}"), F.col("index").alias(f"i{i}"), F.col("value").alias(f"v{i}")) for i in range(3))
    out = entries.join(exact, (F.col("serial") == F.col("s0")) & (F.col("index") == F.col("i0")), "left")
    out = out.join(index.where("s1 is null"), F.col("index") == F.col("i1"), "left").join(serial.where("i2 = -1"), F.col("serial") == F.col("s2"), "left")
    return out.select(*entries.columns, F.coalesce("v0", "v1", "v2").alias("value"))


def cached(articles: DataFrame, cache: DataFrame) -> DataFrame:
    """articles (id, text) with the vector of the cache (id, hash, vector) where id and SHA-1 of the text agree; null vectors are to be made."""
    own = articles.withColumn("hash", F.sha1(F.encode("text", "UTF-8")))
    held = cache.select(F.col("id").alias("c_id"), F.col("hash").alias("c_hash"), "vector")
    return own.join(held, (F.col("id") == F.col("c_id")) & (F.col("hash") == F.col("c_hash")), "left").drop("c_id", "c_hash")


def requested(requests: DataFrame, overview: DataFrame) -> DataFrame:
    """requests (ordinal, slug), each slug once and in order, with the overview's row or an error."""
    first = requests.groupBy("slug").agg(F.min("ordinal").alias("ordinal"))
    known = overview.withColumnRenamed("slug", "__s").withColumn("__there", F.lit(True))
    out = first.join(known, F.col("slug") == F.col("__s"), "left")
    return out.withColumn("error", F.when(F.col("__there").isNull(), "not_found")).drop("__s", "__there")


def dedupe_counts(rows: DataFrame) -> DataFrame:
    """Per task of rows (task, kept): original, unique and duplicate entries."""
    out = rows.groupBy("task").agg(F.count(F.lit(1)).alias("original"), F.count_if("kept").alias("unique"))
    return out.withColumn("duplicate", F.greatest(F.col("original") - F.col("unique"), F.lit(0)))


def numbered(rows: DataFrame, title: str, id_col: str) -> DataFrame:
    """rows with seq, their number in the order of lower-cased titles and ids. Rows are dealt by range, so that no task has all that begin alike."""
    keyed = rows.withColumn("__low", F.lower(F.coalesce(title, F.lit(""))))
    return placed(keyed, ["__low", id_col], name="seq").drop("__low")
