"""Places in an order without a window over all rows, or over all rows of a hot key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomery.sources.checkpoints import cut


def placed(rows: DataFrame, order: list[str], within: list[str] | None = None, name: str = "place") -> DataFrame:
    """The rows with their place from 1 in the order of columns, of each group of `within` (nulls are one group) or of all. The order has to be
    unique for places to be the same in every run; nulls come first.

    Rows are dealt by range of group and order, so that a hot group spreads over tasks; a row's place is its number in its task and how many of its
    group are in tasks before. What is summed up has a row for each task and group in it."""
    keys = within or []
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(tasks, *keys, *order).sortWithinPartitions(*keys, *order)
    # ranges come from a sample: written down, they stay what they are if a task runs again
    dealt = cut(dealt.withColumns({"__task": F.spark_partition_id(), "__row": F.monotonically_increasing_id()}))
    held = [F.col(k).alias(f"__g{i}") for i, k in enumerate(keys)]
    counts = dealt.groupBy(F.col("__task").alias("__t"), *held).agg(F.min("__row").alias("__first"), F.count(F.lit(1)).alias("__n"))
    groups = [f"__g{i}" for i in range(len(keys))]
    order_of_tasks = W.partitionBy(*groups).orderBy("__t") if groups else W.orderBy("__t")  # a row per task and group
    starts = counts.withColumn("__before", F.sum("__n").over(order_of_tasks) - F.col("__n"))
    same = F.col("__task") == F.col("__t")
    for k, g in zip(keys, groups):
        same = same & F.col(k).eqNullSafe(F.col(g))
    joined = dealt.join(starts, same)
    return joined.withColumn(name, F.col("__before") + F.col("__row") - F.col("__first") + 1).select(*rows.columns, name)


def fixed_batches(rows: DataFrame, group: str, order: str, size: int) -> DataFrame:
    """The rows with `batch`, their number from 0 of so many rows in order in each group."""
    return placed(rows, [order], [group], "__place").withColumn("batch", F.floor((F.col("__place") - 1) / size)).drop("__place")
