"""Keyed upserts and event streams: batch folds and their Structured Streaming forms."""

from __future__ import annotations

from array import array
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(changes: DataFrame, key: str, order: str, last_filled: list[str], sticky: list[str]) -> DataFrame:
    """The state after all changes: of some fields the last non-null value, of flags whether they were ever
    true. Aggregates combine in each task, so that a hot key is no hot task."""
    filled = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in last_filled]
    return changes.groupBy(key).agg(*filled, *[F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in sticky], F.max(order).alias(order))


def crawl_id(title, remark, serial, documents):
    """What names an entry: its first page, or else its first document, or its title and remark, or its serial."""
    page = F.get(F.filter(documents, lambda d: (d["type"] == "html") & d["url"].isNotNull()), F.lit(0))["url"]
    any_ = F.get(F.filter(documents, lambda d: F.coalesce(d["url"], F.lit("")) != ""), F.lit(0))["url"]
    named = F.when(F.coalesce(title, F.lit("")) != "", F.concat_ws("::", F.lit("title"), title, F.nullif(remark, F.lit(""))))
    return F.coalesce(page, any_, named, F.concat(F.lit("serial::"), serial.cast("string")))


def settle(entries: DataFrame, state: DataFrame) -> DataFrame:
    """entries (ordinal, title, remark, serial, documents) with entry_id: that of the state's document (entry_id, url) with the first of their
    URLs that it knows, or else their own."""
    urls = entries.select("ordinal", F.posexplode("documents").alias("at", "d")).select("ordinal", "at", F.col("d.url").alias("url")).where("coalesce(url, '') <> ''")
    known = state.select(F.col("url").alias("k_url"), "entry_id").groupBy("k_url").agg(F.min("entry_id").alias("known"))
    met = urls.join(known, F.col("url") == F.col("k_url")).groupBy(F.col("ordinal").alias("o")).agg(F.min_by("known", "at").alias("known"))
    own = crawl_id(F.col("title"), F.col("remark"), F.col("serial"), F.col("documents"))
    return entries.join(met, F.col("ordinal") == F.col("o"), "left").withColumn("entry_id", F.coalesce("known", own)).drop("o", "known")


def flags(changes: DataFrame, key: str, order: str) -> DataFrame:
    """(key, downloaded, local_path, title) after changes (key, order, op, local_path, title), of which `mark` sets a document's path, `clear` takes it
    away and `retitle` names it anew. Aggregates combine in each task."""
    put = F.col("op").isin("mark", "clear")
    last = F.max_by(F.struct((F.col("op") == "mark").alias("on"), "local_path"), F.when(put, F.col(order)))
    out = changes.groupBy(key).agg(last.alias("l"), F.max_by("title", F.when((F.col("op") == "retitle") & (F.coalesce("title", F.lit("")) != ""), F.col(order))).alias("title"))
    return out.select(key, F.coalesce("l.on", F.lit(False)).alias("downloaded"), F.when(F.col("l.on"), F.col("l.local_path")).alias("local_path"), "title")


def upsert_into(state_path: str, key: str, order: str, last_filled: list[str], sticky: list[str]):
    """A foreachBatch function that merges each micro-batch into a Parquet state in versions; a batch
    that is repeated after a failure writes its version again."""

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rows = batch
        if epoch > 0:
            rows = spark.read.parquet(f"{state_path}/v={epoch - 1}").unionByName(batch.select(key, order, *last_filled, *sticky))
        upsert(rows.select(key, order, *last_filled, *sticky), key, order, last_filled, sticky).write.mode("overwrite").parquet(f"{state_path}/v={epoch}")

    return merge


class _Used:
    """The serials in use, as runs of consecutive ones (starts and ends, both included)."""

    def __init__(self) -> None:
        self.starts, self.ends = array("q"), array("q")

    def __contains__(self, s: int) -> bool:
        i = bisect_right(self.starts, s)
        return i > 0 and s <= self.ends[i - 1]

    def next(self) -> int:
        return self.ends[-1] + 1 if self.ends else 1

    def add(self, s: int) -> None:
        """Adds a serial that is free."""
        i = bisect_right(self.starts, s)
        left, right = i > 0 and self.ends[i - 1] == s - 1, i < len(self.starts) and self.starts[i] == s + 1
        if left and right:
            self.ends[i - 1] = self.ends[i]
            del self.starts[i], self.ends[i]
        elif left:
            self.ends[i - 1] = s
        elif right:
            self.starts[i] = s
        else:
            self.starts.insert(i, s)
            self.ends.insert(i, s)


def serials(entries: DataFrame, order: str, wanted: str) -> DataFrame:
    """Serials of one task's entries, in order: the wanted one if it is free, else the largest so far plus 1. A fold
    in order over one task's keys, as each answer depends on all before it, but as a stream: rows are sorted
    by Spark, and what is held is the runs of serials in use, not the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, used = object(), _Used()
        for batch in batches:
            out = []
            for task, w in zip(batch.column("task").to_pylist(), batch.column("wanted_").to_pylist()):
                if task != now:
                    now, used = task, _Used()
                s = w if w is not None and w not in used else used.next()
                used.add(s)
                out.append(s)
            yield pa.RecordBatch.from_arrays([batch.column("task"), batch.column(order), pa.array(out, pa.int64())], names=["task", order, "serial"])

    kinds = dict(entries.dtypes)
    slim = entries.select("task", order, F.col(wanted).cast("long").alias("wanted_"))
    return slim.repartition("task").sortWithinPartitions("task", F.asc_nulls_last(order)).mapInArrow(run, f"task {kinds['task']}, {order} {kinds[order]}, serial long")


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums per window and type; the watermark drops what comes too late. Batch or stream."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("ts", late)
    g = timed.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of a user, apart by more than a gap."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("ts", late)
    g = timed.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return g.select("user_id", F.col("session_window.start").alias("start"), "n")
