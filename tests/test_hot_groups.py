"""Places, batches and joined contents where one key has nearly all rows."""

import random

import pytest
from pyspark.sql import functions as F

from loomery.operators import packing
from loomery.operators import ranking
from loomery.operators import reading
from loomery.operators import results
from loomery.operators import rollups


def windows(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x for x in plan.splitlines() if "Window" in x and "__t" not in x]


def test_places_of_a_hot_group(spark):
    rng = random.Random(0)
    rows = [(rng.choice(["hot"] * 9 + ["b", None]), i * 7 % 2003, f"x{i}") for i in range(2003)] + [("c", None, "null")]
    df = spark.createDataFrame(rows, "g string, o int, v string").repartition(5)
    got = {(r["g"], r["o"]): r["place"] for r in ranking.placed(df, ["o"], ["g"]).collect()}
    for g in ("hot", "b", None, "c"):
        mine = sorted((r[1] for r in rows if r[0] == g), key=lambda o: (o is not None, o or 0))
        assert [got[g, o] for o in mine] == list(range(1, len(mine) + 1))
    spread = {r["__task"]: r["n"] for r in df.repartitionByRange(4, "g", "o").groupBy(F.spark_partition_id().alias("__task")).agg(F.count(F.lit(1)).alias("n")).collect()}
    assert max(spread.values()) < 0.5 * len(rows)  # the hot group is in several tasks
    titles = spark.range(500).select(F.concat(F.lit("中国"), F.lpad((F.col("id") * 37 % 500).cast("string"), 4, "0")).alias("t"), F.col("id").alias("i"))
    numbered = results.numbered(titles, "t", "i")
    assert [r["seq"] for r in numbered.orderBy(F.lower("t"), "i").collect()] == list(range(1, 501)) and not windows(numbered)
    assert ranking.placed(df.limit(0), ["o"], ["g"]).count() == 0


@pytest.mark.parametrize("tasks", ["1", "3", "40"])
def test_batches_equal_the_loop_however_rows_are_dealt(spark, tasks):
    rng = random.Random(4)
    rows = [(rng.choice(["hot"] * 8 + ["b", "c", None]), i, rng.choice([None, 0, 1, 5, 9, 20, 31, 100])) for i in range(600)]
    want, open_ = {}, {}
    for g, o, s in rows:
        s = s or 0
        at, n, total = open_.get(g, (-1, 5, 31))
        at, n, total = (at, n + 1, total + s) if n < 5 and total + s <= 30 else (at + 1, 1, s)
        open_[g] = (at, n, total)
        want[g, o] = at
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", tasks)
    try:
        df = spark.createDataFrame(rows, "g string, o int, s int").repartition(4)
        assert {(r["g"], r["o"]): r["batch"] for r in packing.greedy_batches(df, "g", "o", "s", 5, 30).collect()} == want
        assert packing.greedy_batches(df.limit(0), "g", "o", "s", 5, 30).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_contents_are_cut_before_they_are_gathered(spark):
    df = spark.range(5000).select(F.lit("k").alias("k"), F.col("id").alias("ordinal"), F.lit("t").alias("title"), F.concat(F.lit("x"), "id").alias("text"))
    text = reading.contents_of(df, "k", 60).first()["text"]
    assert text == "\n\n".join(f"t\nx{i}" for i in range(20))[:60]
    long = spark.createDataFrame([("k", 1, None, "y" * 500), ("k", 2, "t", "z"), ("l", 1, "a", None)], "k string, ordinal int, title string, text string")
    assert {r["k"]: r["text"] for r in reading.contents_of(long, "k", 50).collect()} == {"k": "y" * 50, "l": "a"}


def test_traces_by_page(spark):
    rows = [("a", 1, 1000, "trace_start"), ("a", 2, 5500, "trace_end"), ("b", 1, 2000, "trace_start"), ("c", 1, 9000, "other"), ("d", 1, 9000, "trace_end")]
    s = rollups.trace_summary(spark.createDataFrame(rows, "trace_id string, seq int, ts long, event string"))
    assert {r["trace_id"]: r["duration_ms"] for r in s.collect()} == {"a": 4500, "b": None, "c": None, "d": None}
    page = rollups.trace_page(s.withColumn("at", F.when(F.col("trace_id") == "a", 9).otherwise(1)), "at", limit=2, offset=1)
    assert [r["trace_id"] for r in page.collect()] == ["b", "c"] and rollups.trace_page(s, "n_events", limit=0).count() == 0
