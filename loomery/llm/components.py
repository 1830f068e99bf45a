"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.llm.common import forget, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    seen = both if large else both.where("b < a")
    least = seen.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("of"), F.least("m", "a").alias("m"))
    joined = seen.join(least, F.col("a") == F.col("of"))
    if large:  # every larger neighbour moves to the smallest one
        return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    own = least.select(F.col("of").alias("a"), F.col("m").alias("b"))
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(own).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of edges (a, b): the smallest node that it reaches. Logarithmic rounds
    as a rule; each round is a written table, so that no lineage grows."""
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    seen = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
        after = written(_star(_star(now, True), False), "edges")
        forget(now)
        now = after
    own = now.select(F.col("b").alias("a"), "b").distinct()
    return now.unionByName(own).select(F.col("a").alias("node"), F.col("b").alias("component"))
