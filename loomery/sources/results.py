"""A table of results by key that grows in batches: what is there isn't computed again, and a run that is cut goes on where it was.

A batch is a folder that is written once and counts from the moment its writer has committed it. The latest batch of a key has its result. Compaction
writes a new generation with the latest rows alone, in its own folder, and takes the older ones away only when that is committed; a
reader sees one whole generation or the other.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Results:
    """Rows (key, hash, and the columns of values) in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, key: str, values: str) -> None:
        self.spark, self.path, self.key, self.values = spark, path.rstrip("/"), key, values

    def _folders(self, pattern: str) -> list[str]:
        """Committed folders, in order of their names."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        root = hadoop.Path(self.path)
        found = root.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(hadoop.Path(f"{self.path}/{pattern}/_SUCCESS"))
        return sorted(str(f.getPath().getParent().toString()) for f in found or [])

    def _generation(self) -> int:
        bases = self._folders("generation=*/base")
        return max((int(p.rsplit("generation=", 1)[1].split("/")[0]) for p in bases), default=0)

    def batches(self) -> DataFrame:
        """Every row of the generation with `batch`, later ones greater."""
        now = self._generation()
        folders = self._folders(f"generation={now}/*")
        schema = f"{self.key}, hash string, {self.values}, batch long"
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def current(self) -> DataFrame:
        """The latest row of each key."""
        name = self.key.split()[0]
        rows = self.batches()
        last = rows.groupBy(name).agg(F.max_by(F.struct(*[c for c in rows.columns if c != name]), "batch").alias("r"))
        return last.select(name, "r.*")

    def add(self, rows: DataFrame) -> None:
        """Commits rows (key, hash, values) as one batch."""
        now = self._generation()
        number = 1 + max((int(p.rsplit("/", 1)[1].split("-")[1]) for p in self._folders(f"generation={now}/batch-*")), default=0)
        columns = [self.key.split()[0], "hash", *[v.strip().split()[0].split(":")[0] for v in _top_level(self.values)]]
        rows.select(*columns, F.lit(number).cast("long").alias("batch")).write.parquet(f"{self.path}/generation={now}/batch-{number:08d}-{uuid.uuid4().hex}")

    def compact(self) -> None:
        """A new generation of the latest rows; the one before goes when it is there."""
        now = self._generation()
        self.current().withColumn("batch", F.lit(0).cast("long")).write.mode("overwrite").parquet(f"{self.path}/generation={now + 1}/base")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/generation={now}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def missing(self, rows: DataFrame) -> DataFrame:
        """Rows (key, hash and others) whose key has no result for that hash."""
        name = self.key.split()[0]
        known = self.current().select(F.col(name).alias("k_key"), F.col("hash").alias("k_hash"))
        return rows.join(known, F.col(name).eqNullSafe(F.col("k_key")) & (F.col("hash") == F.col("k_hash")), "left_anti")

    def fill(self, rows: DataFrame, compute: Callable[[DataFrame], DataFrame], batch_rows: int = 1_000_000) -> int:
        """Computes what is missing of rows (key, hash and what compute reads) in batches of about so many rows, each committed before the next; the
        number of batches. compute gives rows (key, hash, values). A batch is the rows with one remainder of the key's hash, so that a
        run that begins anew after a cut has the same ones less what is done."""
        name = self.key.split()[0]
        left = self.missing(rows).count()
        parts = -(-left // batch_rows)
        done = 0
        for part in range(parts):
            todo = self.missing(rows).where(F.pmod(F.xxhash64(F.col(name)), F.lit(parts)) == part)
            if not todo.isEmpty():
                self.add(compute(todo))
                done += 1
        return done


def _top_level(columns: str) -> list[str]:
    """A schema's columns, without the commas inside of types."""
    out, depth = [""], 0
    for c in columns:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out
