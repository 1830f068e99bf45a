"""Writers: state by task, keyed overwrite of touched partitions, JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.operators.nested import relative_paths


def write_by_task(entries: DataFrame, path: str, task: str = "task", base: str | None = None) -> None:
    """A folder per task, rows in order (serial, nulls last, then title). With a base, paths inside of it are written relative to it."""
    if base is not None:
        entries = relative_paths(entries, base)
    entries.repartition(task).sortWithinPartitions(task, F.col("serial").asc_nulls_last(), "title").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(task).parquet(path)


def write_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def unique_names(rows: DataFrame, name: str, order: str, separator: str = "_") -> DataFrame:
    """Names made unique: the first keeps its name, the others get _2, _3 and so on, before the extension."""
    from pyspark.sql import Window as W

    n = F.row_number().over(W.partitionBy(name).orderBy(order))
    stem, ext = F.regexp_extract(name, "^(.*?)(\\.[^.]*)?$", 1), F.regexp_extract(name, "^(.*?)(\\.[^.]*)?$", 2)
    return rows.withColumn(name, F.when(n == 1, F.col(name)).otherwise(F.concat(stem, F.lit(separator), n.cast("string"), ext)))
