"""Nearest neighbours against all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomery.llm import ann_search

SCHEMA = "vec_id long, embedding array<float>"


def rows(n=900, dims=24, seed=2):
    rng = random.Random(seed)
    middle = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(6)]
    out = []
    for i in range(n):
        m = rng.choice(middle)
        out.append((i, [float(np.float32(c + rng.gauss(0, 0.9))) for c in m]))
    hot = out[50][1]
    out += [(2_000 + 5 * i, hot) for i in range(400)]  # copies: a third of the rows, forty of them queries
    out += [(5_000, [2 * x for x in hot]), (5_001, [-x for x in hot])]  # the same direction, and the opposite one
    out += [(100, out[7][1]), (100, out[100][1])]  # an id with a second vector, and a repeated row
    out += [(None, hot), (150, None), (200, [0.0] * dims), (250, [math.nan] * dims), (300, [None] * dims), (350, []), (6_000, [1.0] * 3), (400, [math.inf] * dims)]
    return out


def brute(table, k=5, every=50):
    dims = 24
    good = sorted({(i, tuple(v)) for i, v in table if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v) and len(v) == dims})
    ids, x = np.array([i for i, _ in good]), np.array([v for _, v in good])
    norm = np.sqrt((x * x).sum(1))
    out = []
    for a in np.flatnonzero(ids % every == 0):
        score = (x @ x[a]) / (norm * norm[a])
        order = [j for j in np.lexsort((ids, -np.round(score, 12))) if ids[j] != ids[a]][:k]
        out += [(int(ids[a]), r + 1, int(ids[j]), round(float(score[j]), 9)) for r, j in enumerate(order)]
    return sorted(out)


def search(spark, table, every=50, **options):
    df = spark.createDataFrame(table, SCHEMA).repartition(5)
    got = ann_search.nearest(df, df.where(F.col("vec_id") % every == 0), **options)
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    return sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in got.collect())


@pytest.mark.parametrize("options", [{}, {"list_rows": 60, "block_rows": 16, "query_rows": 3}])
def test_one_list_without_tests_is_exact(spark, options):
    """Splits, blocks, copies, ties and odd rows: with every list probed and nobody abandoned, the result is that of all pairs."""
    table = rows()
    assert search(spark, table, max_lists=1, sure=1e6, **options) == brute(table)


def test_recall_is_measured_and_no_query_is_short(spark):
    table = [(i, v) for i, v in rows(3_000, seed=9)]
    want, got = brute(table, every=20), search(spark, table, every=20)
    hits = len({r[::2] for r in want} & {r[::2] for r in got})
    assert hits >= 0.9 * len(want) and [r[:2] for r in got] == [r[:2] for r in want]
    exact = {r[::2]: r[3] for r in want}
    assert all(abs(exact[r[::2]] - r[3]) < 1e-9 for r in got if r[::2] in exact)


def test_query_on_the_given_table(spark):
    data = "/root/testdata/sf0.01"
    vectors = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    got = ann_search.query(spark, data).collect()
    ids, x = np.array([i for i, _ in vectors]), np.array([v for _, v in vectors], np.float64)
    norm = np.sqrt((x * x).sum(1))
    want = set()
    for a in np.flatnonzero(ids % 50 == 0):
        score = (x @ x[a]) / (norm * norm[a])
        want |= {(int(ids[a]), int(ids[j])) for j in [j for j in np.lexsort((ids, -score)) if j != a][:5]}
    assert len(got) == len(want) and len({(r["query_id"], r["vec_id"]) for r in got} & want) >= 0.9 * len(want)


def test_candidates_are_abandoned_early_and_never_the_near_ones():
    rng = np.random.default_rng(0)
    x = ann_search.units(rng.normal(size=(40, 128))[rng.integers(0, 40, 4000)] + 0.5 * rng.normal(size=(4000, 128)))
    q = x[:40]
    rotation = np.linalg.qr(rng.normal(size=(128, 128)))[0]
    x, q = (x @ rotation).astype(np.float32), (q @ rotation).astype(np.float32)
    apart = ((q[:, None] - x[None]) ** 2).sum(2)
    bound = np.partition(apart, 5, axis=1)[:, 5]
    looked = []

    class Columns(np.ndarray):
        def __getitem__(self, key):
            out = np.asarray(super().__getitem__(key))
            if isinstance(key, tuple):
                looked.append(out.size)
            return out

    who, what, found = ann_search.adaptive_scan(q, x.T.copy().view(Columns), bound, 2.1)
    assert np.allclose(found, apart[who, what], atol=1e-4)
    near = set(zip(*np.nonzero(apart <= bound[:, None])))
    assert len(near & set(zip(who.tolist(), what.tolist()))) >= 0.98 * len(near)
    assert looked and sum(looked) < 0.1 * 128 * 4000 * 40  # by pairs, a small part of what all dimensions would be


def test_lists_and_their_queries_are_not_broadcast(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    found = ann_search.nearest(df, df.where("vec_id % 50 = 0"))
    found.collect()
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_tiny_and_empty_tables_and_other_columns(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], "x"), (1, [1.0, 1.0], "x"), (50, [0.0, 2.0], "x")], SCHEMA + ", list string").withColumn("split", F.lit(1)).withColumn("number", F.lit("n")).withColumn("score", F.lit(2))
    got = ann_search.nearest(df, df.where("vec_id % 50 = 0"))
    half = round(math.sqrt(0.5), 9)
    assert sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in got.collect()) == [(0, 1, 1, half), (0, 2, 50, 0.0), (50, 1, 1, half), (50, 2, 0, 0.0)]
    assert ann_search.nearest(df, df.where("vec_id < 0")).count() == 0
    assert ann_search.nearest(df.where("vec_id < 0"), df).count() == 0
    assert ann_search.nearest(df.where("vec_id = 0"), df.where("vec_id = 0")).count() == 0
