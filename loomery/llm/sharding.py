"""Uniform shuffling into shards of exact sizes by a hypergeometric communication matrix.

How many rows go from each input partition to each shard is drawn so that the whole is distributed
as in a uniform random permutation while every count is exact. The matrix is nowhere as a whole: the shards' places are
split down a binary tree over the partitions, at each node by multivariate hypergeometric draws that the node's own
number seeds, so that a task finds its row of the matrix by itself, in as many steps as the tree is deep. Each partition permutes its
own rows and deals them out by its counts (only row numbers go through Python, not texts);
one exchange moves the rows; inside its shard each row then gets a place by a second
permutation. Shards may be larger than a task: the second order is cut into slices, and a
place is the slice's offset plus the rank inside the slice.

What reaches the driver and is sent to the tasks is one number for each partition; more than `MOST_PARTITIONS` raise. The partitions of the
input have to be the same when it is read twice, as those of a table are; a task finds out if
it has more or fewer rows than were counted and fails. A lost task deals the same rows again, as everything is seeded.

Defined cases: null texts have no bytes; null or repeated ids are rows like others; an empty
table gives an empty result; the input's columns are kept, and shard and slot replace any
that it has of these names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomery.llm.common import fresh


def shard_sizes(n_rows: int, n_shards: int) -> list[int]:
    """Counts at most one apart."""
    return [n_rows // n_shards + (i < n_rows % n_shards) for i in range(n_shards)]


#: 8 bytes of each are sent: 80 MB.
MOST_PARTITIONS = 10_000_000


def matrix_row(upto: np.ndarray, partition: int, sizes: list[int], seed: int) -> np.ndarray:
    """How many rows go from one partition to each shard. upto has the rows of all partitions before each, and of all at its end. Every task that comes
    through a node of the tree draws the same there."""
    places = np.array(sizes, dtype=np.int64)
    low, high = 0, len(upto) - 1
    while high - low > 1:
        middle = (low + high) // 2
        rng = np.random.default_rng([seed, low, high])
        todo, pool = int(upto[middle] - upto[low]), int(places.sum())
        left = np.zeros_like(places)
        for j in range(len(places)):  # conditional draws: exact at any size
            pool -= int(places[j])
            left[j] = _hypergeometric(rng, int(places[j]), pool, todo)
            todo -= int(left[j])
        if partition < middle:
            places, high = left, middle
        else:
            places, low = places - left, middle
    return places


def communication_matrix(partition_rows: list[int], sizes: list[int], seed: int) -> np.ndarray:
    """All rows of the matrix, for small numbers of partitions."""
    upto = np.concatenate([[0], np.cumsum(np.array(partition_rows, dtype=np.int64))])
    return np.array([matrix_row(upto, i, sizes, seed) for i in range(len(partition_rows))])


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """One draw by the exact law. Beyond numpy's range by inverse transform: the ratios of neighbouring probabilities
    are known, so that the law is summed up outwards from its mode to where nothing is left in double precision."""
    if n == 0 or good == 0:
        return 0
    if bad == 0:
        return n
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, n))
    low, high = max(0, n - bad), min(n, good)
    mode = min(high, max(low, (n + 1) * (good + 1) // (good + bad + 2)))
    total = good + bad
    reach = 40 + int(12 * np.sqrt(n * (good / total) * (bad / total)))
    up = np.arange(mode, min(high, mode + reach), dtype=np.float64)
    down = np.arange(mode, max(low, mode - reach), -1, dtype=np.float64)
    above = np.cumprod((good - up) * (n - up) / ((up + 1) * (bad - n + up + 1)))
    below = np.cumprod(down * (bad - n + down) / ((good - down + 1) * (n - down + 1)))
    weights = np.concatenate([below[::-1], [1.0], above])
    upto = np.cumsum(weights)
    return mode - len(below) + int(np.searchsorted(upto, rng.random() * upto[-1], side="right"))


def shard(docs: DataFrame, n_shards: int, seed: int = 11, slices: int | None = None) -> DataFrame:
    """The rows with shard (0 to n_shards - 1, counts at most one apart) and slot (gapless)."""
    keep = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    place, slice_, key = (fresh(docs, x) for x in ("place_", "slice_", "key_"))
    numbered = docs.select(*[F.col(f"`{c}`") for c in keep], F.monotonically_increasing_id().alias(place))
    counts = dict(docs.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect())
    parts = sorted(counts)
    slices = slices or max(64, (sum(counts.values()) // n_shards) >> 20)
    if len(parts) > MOST_PARTITIONS:
        raise ValueError(f"{len(parts)} partitions: one number for each is sent to all tasks")
    sizes = shard_sizes(sum(counts.values()), n_shards)
    upto = np.concatenate([[0], np.cumsum(np.array([counts[p] for p in parts], dtype=np.int64))])
    known = docs.sparkSession.sparkContext.broadcast((np.array(parts, dtype=np.int64), upto))

    @F.pandas_udf("struct<shard int, key long>")
    def deal(places: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        parts, upto = known.value
        dealt: dict[int, np.ndarray] = {}
        seen = 0

        def complete() -> None:
            for p, deals in dealt.items():
                if seen != len(deals):
                    raise ValueError(f"partition {p} has {seen} rows, but {len(deals)} were counted")

        for at in places:
            at = at.to_numpy()
            shards = np.empty(len(at), dtype=np.int32)
            for p in np.unique(at >> 33):
                if p not in dealt:
                    complete()
                    i = int(np.searchsorted(parts, p))
                    row = matrix_row(upto, i, sizes, seed) if i < len(parts) and parts[i] == p else np.zeros(n_shards, np.int64)
                    dealt, seen = {p: np.random.default_rng([seed, int(p)]).permutation(np.repeat(np.arange(n_shards, dtype=np.int32), row))}, 0
                mine = at >> 33 == p
                seen += int(mine.sum())
                shards[mine] = dealt[p][at[mine] & (1 << 33) - 1]  # fails if the partition has more rows than were counted
            mixed = at.astype(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)
            for k, m in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
                mixed = (mixed ^ (mixed >> np.uint64(k))) * np.uint64(m)
            yield pd.DataFrame({"shard": shards, "key": (mixed >> np.uint64(1)).astype(np.int64)})
        complete()

    dealt = numbered.withColumn(key, deal(F.col(place)))
    dealt = dealt.select(*[F.col(f"`{c}`") for c in keep], F.col(key)["shard"].alias("shard"), F.col(key)["key"].alias(key), place)
    dealt = dealt.withColumn(slice_, F.pmod(F.shiftright(F.col(key), 40), F.lit(slices)).cast("int"))
    to_shard, at, first = (fresh(dealt, x) for x in ("to_shard_", "at_", "start_"))
    light = numbered.select(deal(F.col(place)).alias("d")).select(F.col("d.shard").alias(to_shard), F.pmod(F.shiftright("d.key", 40), F.lit(slices)).cast("int").alias(at))
    sizes = light.groupBy(to_shard, at).agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.select(to_shard, at, (F.sum("n").over(W.partitionBy(to_shard).orderBy(at)) - F.col("n")).alias(first))
    # a bit of a place's mixture is dropped to make it a number above 0, so that two may be equal
    rank = F.row_number().over(W.partitionBy("shard", slice_).orderBy(key, place)) - 1
    ranked = dealt.withColumn(key, rank)
    out = ranked.join(starts, (F.col("shard") == F.col(to_shard)) & (F.col(slice_) == F.col(at)))
    return out.select(*[F.col(f"`{c}`") for c in keep], "shard", (F.col(first) + F.col(key)).alias("slot"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), 40)
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return out.select("doc_id", (F.octet_length(raw) + 16).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
