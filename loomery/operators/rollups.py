"""Roll-ups of tasks, documents, traces and types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def task_rollup(entries: DataFrame, task: str = "task", documents: str = "documents") -> DataFrame:
    """Per task: entries, documents, downloaded, pending, entries without documents. documents is an
    array of structs with a boolean `downloaded`."""
    n = F.size(F.coalesce(documents, F.array().cast(entries.schema[documents].dataType)))
    down = F.size(F.filter(documents, lambda d: d["downloaded"]))
    out = entries.groupBy(task).agg(F.count(F.lit(1)).alias("entries"), F.sum(n).alias("documents"), F.sum(F.greatest(down, F.lit(0))).alias("downloaded"), F.count_if(n == 0).alias("without_documents"))
    return out.withColumn("pending", F.col("documents") - F.col("downloaded"))


def status(pending: Column, entries: Column, age_hours: Column, stale_after: float) -> Column:
    """waiting (nothing yet), attention (something pending), stale (too old), ok."""
    return F.when(entries == 0, "waiting").when(pending > 0, "attention").when(age_hours > stale_after, "stale").otherwise("ok")


# fixed values: names of types
TYPE_NAMES = {
    "doc": ("doc", "docx", "docm", "word", "wps", "application/msword", "application/vnd.openxmlformats-officedocument.wordprocessingml.document"),
    "pdf": ("pdf", "application/pdf"),
    "html": ("html", "htm", "text/html"),
}


def plain_type(value: Column) -> Column:
    """Lower case, without what follows a semicolon; null if nothing is left."""
    return F.nullif(F.btrim(F.split_part(F.lower(value), F.lit(";"), F.lit(1))), F.lit(""))


def canonical_type(value: Column) -> Column:
    out = F.when(F.lit(False), value)
    for kind, names in TYPE_NAMES.items():
        out = out.when(value.isin(*names), kind)
    return out.otherwise(value)


def preferred_type(types: Column) -> Column:
    """doc before pdf before html among an entry's types, with their other names; else the first one, else unknown."""
    known = F.array_compact(F.transform(types, lambda x: canonical_type(plain_type(x))))
    out = F.when(F.lit(False), "")
    for kind in TYPE_NAMES:
        out = out.when(F.array_contains(known, kind), kind)
    return F.coalesce(out.otherwise(F.get(known, F.lit(0))), F.lit("unknown"))


def trace_summary(events: DataFrame, trace: str = "trace_id", seq: str = "seq", ts: str = "ts", event: str = "event", start: str = "trace_start", end: str = "trace_end") -> DataFrame:
    """Per trace: number of events, first start, last end, and their distance in milliseconds if there are both."""
    first = F.min(F.when(F.col(event) == start, F.struct(seq, ts)))
    last = F.max(F.when(F.col(event) == end, F.struct(seq, ts)))
    out = events.groupBy(trace).agg(F.count(F.lit(1)).alias("n_events"), first.alias("a"), last.alias("b"))
    started, ended = F.col(f"a.{ts}"), F.col(f"b.{ts}")
    far = ended - started if dict(events.dtypes)[ts] in ("bigint", "int", "double") else F.floor((F.unix_micros(ended.cast("timestamp")) - F.unix_micros(started.cast("timestamp"))) / 1000)
    return out.select(trace, "n_events", started.alias("started"), ended.alias("ended"), far.alias("duration_ms"))


def trace_page(summaries: DataFrame, updated: str, trace: str = "trace_id", limit: int = 50, offset: int = 0) -> DataFrame:
    """The traces updated last, some of them skipped; ties by trace. A limit of 0 or less gives none."""
    return summaries.orderBy(F.desc(updated), trace).offset(max(0, offset)).limit(max(0, limit))


def duplicate_groups(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: groups of equal keys with several rows, and the rows in them."""
    many = df.groupBy(*keys).count().where("count > 1")
    return many.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("count"), F.lit(0)).alias("rows"))
