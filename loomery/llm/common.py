"""What several operators share: white space, written tables, a bounded filter, ranks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.operators.membership import _flagged, fresh, maybe_in  # noqa: F401

#: The six characters that separate words.
SPACE = " \t\n\x0b\x0c\r"
#: A run of them, as a Java regular expression.
SPACE_RUN = "[\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only in local mode, where there is one machine, a session
    that names none gets one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith(("local[", "local*")) and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    return (named or "/tmp/loomery-checkpoints").rstrip("/")


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder, reread: lineage ends here and any
    executor can be lost later. The table stays until `forget` or the folder's owner removes it."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Removes tables made by `written` once nothing reads them any more."""
    for df in tables:
        spark = df.sparkSession
        for file in df.inputFiles()[:1]:
            path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def without_space(text: Column) -> Column:
    for c in SPACE:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def words(text: Column) -> Column:
    """Words of a text in order; none for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))


def without(df: DataFrame, key: str, keys: DataFrame, n_bits: int = 1 << 26) -> DataFrame:
    """Rows of df whose key isn't among the (one-column) keys; rows with a null key stay. Most rows
    are settled by the bitmap and don't move; the others are joined."""
    flagged, flag = _flagged(df, F.col(f"`{key}`"), keys, n_bits)
    gone = fresh(df, "gone")
    ids = keys.select(F.col(f"`{keys.columns[0]}`").alias(gone)).distinct()
    joined = flagged.where(F.col(flag)).join(ids, F.col(f"`{key}`") == F.col(gone), "left_anti")
    return flagged.where(~F.col(flag)).unionByName(joined).drop(flag)
