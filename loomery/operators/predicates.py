"""Small filters and columns of entries, documents and traces."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the word of abolished entries, folders of downloads
ABOLISHED = "废止"
FOLDERS = "downloads|attachments|files"


def html_only(documents: Column) -> Column:
    """Entries that have documents, all of them pages."""
    return (F.size(F.coalesce(documents, F.slice(documents, 1, 0))) > 0) & F.forall(documents, lambda d: F.coalesce(F.lower(d["type"]) == "html", F.lit(False)))


def abolished(title: Column, remark: Column, documents: Column, fields: tuple[str, ...] = ("title", "remark", "local_path", "url")) -> Column:
    has = lambda c: F.coalesce(F.contains(c, F.lit(ABOLISHED)), F.lit(False))
    return has(title) | has(remark) | F.coalesce(F.exists(documents, lambda d: reduce(lambda a, b: a | b, [has(d[f]) for f in fields])), F.lit(False))


def allowed_types(kind: Column, allowed: list[str] | None) -> Column:
    return F.lit(True) if not allowed else F.lower(kind).isin([a.lower() for a in allowed])


def tasks_like(tasks: DataFrame, status: str | None = None, query: str = "") -> DataFrame:
    """tasks (name, slug, url, status) of a status (None or `all`: any) that have the query in one of their names."""
    out = tasks if status in (None, "", "all") else tasks.where(F.col("status") == status)
    return out.where(F.contains(F.lower(F.concat_ws(" ", "name", "slug", "url")), F.lit(query.strip().lower())))


def chosen_tasks(tasks: DataFrame, chosen: list[str]) -> DataFrame:
    """tasks (name, slug) by name or slug, case ignored; none chosen means all."""
    wanted = [c.strip().lower() for c in chosen if c.strip()]
    return tasks if not wanted else tasks.where(F.lower("name").isin(wanted) | F.lower("slug").isin(wanted))


def events_of(events: DataFrame, types: list[str] | None) -> DataFrame:
    """Events of some types; one without a type is an `event`."""
    return events if not types else events.where(F.coalesce(F.nullif("event", F.lit("")), F.lit("event")).isin(types))


def in_years(year: Column, first: int | None, last: int | None) -> Column:
    """Whether a year is in a range; an unknown one is."""
    return year.isNull() | (F.lit(first is None) | (year >= (first or 0))) & (F.lit(last is None) | (year <= (last or 0)))


def as_filters(meta: dict) -> list[dict]:
    """Filters of the metadata DSL: lists are `in`, single values `=`; a date range is none of them."""
    return [{"field": k, "op": "in" if isinstance(v, list) else "=", "value": v} for k, v in meta.items() if k != "date_range" and v is not None]


def downloaded_documents(entries: DataFrame, id_col: str = "entry_id") -> DataFrame:
    """(id, index, document): documents that are there, with their place in the entry."""
    return entries.select(id_col, F.posexplode("documents").alias("index", "document")).where("document.downloaded")


def flat_documents(entries: DataFrame, id_col: str = "entry_id") -> DataFrame:
    """(id, url, type, title): documents with a URL that aren't pages."""
    d = entries.select(id_col, F.explode("documents").alias("d"))
    return d.where("coalesce(d.url, '') <> '' and lower(coalesce(d.type, '')) <> 'html'").select(id_col, "d.url", "d.type", "d.title")


def public_path(path: Column) -> Column:
    return F.regexp_replace(path, "^\\./files/extract/", "")


def comparable_path(path: Column) -> Column:
    """What is behind the folder of downloads; paths outside of such folders as they are."""
    plain = F.replace(path, F.lit("\\"), F.lit("/"))
    tail = F.regexp_extract(plain, f"(?:^|/)(?:{FOLDERS})/(.*)$", 1)
    return F.when(tail != "", tail).otherwise(plain)


def first_filled(*columns: str) -> Column:
    """The first column that isn't blank, trimmed."""
    return F.coalesce(*[F.nullif(F.btrim(F.col(c).cast("string")), F.lit("")) for c in columns])


def used_path(attempts: Column, source_path: Column) -> Column:
    """The path of the attempt that was used, or else the entry's."""
    return F.coalesce(F.get(F.filter(attempts, lambda a: F.coalesce(a["used"], F.lit(False))), F.lit(0))["path"], source_path)


def next_run(updated: Column, least_hours: float, most_hours: float) -> Column:
    """Struct (from, to): when the next run is due."""
    return F.struct((updated + F.make_interval(hours=F.lit(least_hours))).alias("from"), (updated + F.make_interval(hours=F.lit(most_hours))).alias("to"))


def distinct_paths(documents: Column, best: Column) -> Column:
    """The paths of an entry's documents, each once, and its best one behind them."""
    return F.array_distinct(F.array_compact(F.concat(F.transform(documents, lambda d: F.nullif(d["local_path"], F.lit(""))), F.array(F.nullif(best, F.lit(""))))))
