"""Stages that compute only what is new: vectors of texts, summaries, merged extracts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.functions.text import chunks
from loomery.operators.merge import merge_by_key
from loomery.sources.checkpoints import cut
from loomery.sources.results import Results

# fixed values: the size of a text that is embedded as a whole, and the overlap of its pieces beyond
CHUNK, OVERLAP = 8192, 200

Hook = Callable[[DataFrame], DataFrame]


def pooled(texts: DataFrame, embed: Hook, key: str, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(key, hash, vector) of texts (key, hash, text): embed gives rows (key, piece, vector, ok) for rows (key, piece, text). A text's vector is the mean of its
    pieces' by position; if any piece isn't ok, or there is none, it has no row and is missing next time."""
    pieces = texts.select(key, "hash", F.posexplode(chunks(F.col("text"), size, overlap)).alias("piece", "text"))
    found = embed(pieces.select(key, "piece", "text"))
    good = found.groupBy(F.col(key).alias("g_key")).agg(F.bool_and(F.coalesce("ok", F.lit(False)) & F.col("vector").isNotNull()).alias("good")).where("good")
    places = found.select(key, F.posexplode("vector").alias("at", "x")).groupBy(key, "at").agg(F.avg(F.col("x").cast("double")).alias("x"))
    vectors = places.groupBy(F.col(key).alias("v_key")).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda z: z["x"]).alias("vector"))  # one vector's positions
    return texts.select(key, "hash").join(good, F.col(key) == F.col("g_key")).join(vectors, F.col(key) == F.col("v_key")).select(key, "hash", "vector")


def embed_missing(texts: DataFrame, results: Results, embed: Hook, key: str, size: int = CHUNK, overlap: int = OVERLAP, batch_rows: int = 1_000_000) -> int:
    """Adds the vectors of texts (key, text) that the results don't have for that very text; blank texts have none. The number of batches."""
    rows = texts.where(F.btrim(F.coalesce("text", F.lit(""))) != "").select(key, F.sha1(F.encode("text", "UTF-8")).alias("hash"), "text")
    return results.fill(rows, lambda todo: pooled(todo, embed, key, size, overlap), batch_rows)


def fill_blank(rows: DataFrame, results: Results, summarise: Hook, key: str, batch_rows: int = 1_000_000) -> DataFrame:
    """Rows (key, text, summary, others) with a summary: their own unless it is blank, or else what summarise gives, rows (key, hash, summary) for rows (key, hash, text),
    computed once for each text and kept in the results. A blank text keeps its blank summary."""
    blank = (F.btrim(F.coalesce("summary", F.lit(""))) == "") & (F.btrim(F.coalesce("text", F.lit(""))) != "")
    todo = rows.where(blank).select(key, F.sha1(F.encode("text", "UTF-8")).alias("hash"), "text")
    results.fill(todo, summarise, batch_rows)
    made = results.current().select(F.col(key).alias("m_key"), F.col("hash").alias("m_hash"), F.col("summary").alias("m_summary"))
    joined = rows.join(made, (F.col(key) == F.col("m_key")) & (F.sha1(F.encode("text", "UTF-8")) == F.col("m_hash")), "left")
    return joined.select(*[F.when(blank, F.coalesce("m_summary", "summary")).otherwise(F.col("summary")).alias("summary") if c == "summary" else F.col(c) for c in rows.columns])


def merge_extracts(old: DataFrame, new: DataFrame, path: str, task: str, key: str, order: str) -> None:
    """Writes the extracts of the tasks that new has, merged into what old has of them: new rows in the place of old ones with their key, others behind.
    The partitions of other tasks aren't touched; the same call again writes the same."""
    touched = new.select(task).distinct()
    mine = old.join(touched, task, "left_semi")
    keyed = lambda df: df.withColumn("__key", F.when(F.col(key).isNotNull(), F.struct(F.col(task).alias("t"), F.col(key).alias("k"))))
    merged = merge_by_key(keyed(mine), keyed(new.select(*old.columns)), "__key", order)
    rows = cut(merged.select(*[F.col(c) for c in old.columns], "place"))  # old may be what is written over
    rows.repartition(task).sortWithinPartitions(task, "place").drop("place").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(task).parquet(path)
