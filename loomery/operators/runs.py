"""Counters of a run that come with the run itself, and comparisons of two orders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

def crawl_counters() -> dict[str, Column]:
    """What is counted of a crawl's rows (kind, from_cache, downloaded, reused)."""
    is_page, is_document = F.col("kind") == "page", F.col("kind") == "document"
    flag = lambda c: F.coalesce(c, F.lit(False))
    return {
        "pages_total": F.count_if(is_page),
        "pages_fetched": F.count_if(is_page & ~flag("from_cache")),
        "pages_from_cache": F.count_if(is_page & flag("from_cache")),
        "entries_seen": F.count_if(F.col("kind") == "entry"),
        "documents_seen": F.count_if(is_document),
        "files_downloaded": F.count_if(is_document & flag("downloaded") & ~flag("reused")),
        "files_reused": F.count_if(is_document & flag("reused")),
    }


def observed(rows: DataFrame, counters: dict[str, Column], sink: Callable[[DataFrame], None]) -> dict:
    """The counters of rows, from the one job in which sink takes them."""
    seen = Observation()
    sink(rows.observe(seen, *[c.alias(name) for name, c in counters.items()]))
    return seen.get


def displacements(ranked: DataFrame, first: str = "place_a", second: str = "place_b") -> DataFrame:
    """One row over two places of each key: n, how many stay, the sum and the largest of the distances, and how many only one order has. One
    pass: no order is sorted."""
    both = F.col(first).isNotNull() & F.col(second).isNotNull()
    far = F.abs(F.col(first) - F.col(second))
    return ranked.agg(
        F.count_if(both).alias("n"), F.count_if(both & (far == 0)).alias("same"), F.coalesce(F.sum(far), F.lit(0)).cast("long").alias("total"),
        F.max(far).cast("long").alias("most"), F.count_if(F.col(second).isNull()).alias("only_a"), F.count_if(F.col(first).isNull()).alias("only_b"),
    )


def compared_choices(entries: DataFrame) -> DataFrame:
    """One row over entries (selected, candidates: an array of path, place and priority), of comparable paths: total, how many chose the first candidate by
    place, how many that by priority (highest, then by place), differing from the first, and entries that can't be compared because nothing is
    selected or there are no candidates."""
    first = F.array_min(F.transform("candidates", lambda c: F.struct(c["place"].alias("place"), c["path"].alias("path"))))["path"]
    best = F.array_min(F.transform("candidates", lambda c: F.struct((-c["priority"]).alias("priority"), c["place"].alias("place"), c["path"].alias("path"))))["path"]
    rows = entries.select("selected", first.alias("first"), best.alias("best"))
    chosen, has = F.col("selected").isNotNull(), F.col("first").isNotNull()
    ok = chosen & has
    return rows.agg(
        F.count_if(ok).alias("total"), F.count_if(ok & (F.col("selected") == F.col("first"))).alias("as_first"), F.count_if(ok & (F.col("selected") == F.col("best"))).alias("as_best"),
        F.count_if(ok & (F.col("selected") != F.col("first"))).alias("differing"), F.count_if(~chosen).alias("not_selected"), F.count_if(chosen & ~has).alias("no_candidates"),
    )
