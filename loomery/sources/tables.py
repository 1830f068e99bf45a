"""Reading the Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the folder; any path that Spark's readers can open will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
