"""Where lineage is cut."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster names its shared folder in spark.checkpoint.dir. Only in local mode, where there is one machine, a
    session that names none gets a folder of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not named and master != "local" and not master.startswith(("local[", "local*")):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    return (named or "/tmp/loomery-checkpoints").rstrip("/")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Where `cut` writes: the shared folder."""
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def cut(df: DataFrame) -> DataFrame:
    """The rows, checkpointed in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()
