"""Product codes against a plain Lloyd's over Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomery.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int"


def rows(n=400, dims=32):
    rng = random.Random(4)
    out = []
    for i in range(n):
        coarse = rng.random() < 0.5  # many ties
        v = [rng.choice([-0.5, 0.0, 0.25, 0.26]) if coarse else float(np.float32(rng.gauss(0, 0.4))) for _ in range(dims)]
        out.append((i * 3, v, rng.choice([0, 0, 0, 1, 2, None])))
    hot = out[5][1]
    out += [(10_000 + i, hot, 0) for i in range(150)]  # one very common vector
    out += [(12, out[7][1], 1), (12, out[7][1], 1), (12, out[8][1], None)]  # equal ids, repeated rows
    out += [(None, out[9][1], 2), (1, None, 0), (2, [0.1] * (dims - 1) + [math.nan], 0), (4, [math.inf] + [0.1] * (dims - 1), 0), (5, [None] + [0.1] * (dims - 1), 0), (7, [], 0), (100, [0.5] * 16, 0)]
    return out


def expected(table, parts=16, entries=64, rounds=2):
    good = [r for r in table if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    dims = len(good[0][1])
    good = [r for r in good if len(r[1]) == dims]
    w = dims // parts
    x = [[[math.floor(256 * c) for c in r[1][p * w : p * w + w]] for p in range(parts)] for r in good]
    books = [[v[p] for v in x[:entries]] for p in range(parts)]

    def near(part, p):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), j) for j, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            of = [near(v[p], p)[1] for v in x]
            for j in set(of):
                mine = [v[p] for v, k in zip(x, of) if k == j]
                books[p][j] = [sum(c) // len(mine) for c in zip(*mine)]
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    found = [[near(v[p], p) for p in range(parts)] for v in x]
    out = [(r[0], "".join(f"{j:02x}" for _, j in f), sum(d for d, _ in f), r[2]) for r, f in zip(good, found)]
    return [(i, c, e, sum(o[2] for o in out if o[3] == lab), sha) for i, c, e, lab in out]


@pytest.mark.parametrize("tree_rows", [70, 16_384])
def test_codes_equal_plain_rounds(spark, tree_rows):
    table = rows()
    df = spark.createDataFrame(table, SCHEMA).repartition(5)
    got = vector_codes.vector_codes(df, tree_rows=tree_rows).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
    assert [t for _, t in got.dtypes] == ["bigint", "string", "bigint", "bigint", "string"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, expected(table)))


def test_few_rows_empty_table_and_clashing_columns(spark):
    table = rows(9, 16)[:9]
    df = spark.createDataFrame(table, SCHEMA)
    for c in ("code", "error", "v", "i", "part", "entry", "k", "total", "label_of_", "vector_"):
        df = df.withColumn(c, F.lit("x"))
    got = vector_codes.vector_codes(df)
    assert got.columns == ["vec_id", "label", "v", "i", "part", "entry", "k", "total", "label_of_", "vector_", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(repr, map(tuple, got.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()))) == sorted(map(repr, expected(table)))
    assert got.first()["part"] == "x"
    none = vector_codes.vector_codes(df.where("vec_id < 0"))
    assert none.columns == got.columns and none.dtypes == got.dtypes and none.count() == 0
    with pytest.raises(Exception, match="after scaling"):
        vector_codes.vector_codes(spark.createDataFrame([(1, [1e30] * 16, 0)], SCHEMA)).collect()
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.vector_codes(spark.createDataFrame([(1, [0.1] * 17, 0)], SCHEMA))


@pytest.mark.parametrize("seed", range(6))
def test_tree_assigns_like_brute_force_and_mostly_by_subtrees(seed):
    rng = np.random.default_rng(seed)
    n = [1, 15, 16, 33, 500, 4000][seed]
    spread = [2, 3, 6, 40, 60, 300][seed]
    points = rng.integers(-spread, spread + 1, (n, 4))
    book = rng.integers(-spread, spread + 1, (64, 4))
    book[10] = book[3]  # two equal entries: the first wins
    apart = ((points[:, None] - book[None]) ** 2).sum(2)
    tree = vector_codes.Tree(points)
    want = apart.argmin(1)
    assert (tree.nearest(book) == want).all()
    totals = tree.totals(book)
    assert totals[:, 0].tolist() == np.bincount(want, minlength=64).tolist()
    assert all((totals[j, 1:] == points[want == j].sum(0)).all() for j in range(64))
    near = vector_codes.Tree(np.concatenate([rng.normal(50 * book[j], 3, (300, 4)).astype(np.int64) for j in range(8)]))
    start, end, _, place, _ = near.assign(50 * book)
    if seed > 2:  # clusters well apart: whole subtrees go to one entry
        assert (end - start).sum() > 4 * len(place) and len(start) < (end - start).sum() / 8


def test_query_against_its_own_plain_version(spark, tmp_path):
    table = [r for r in rows(300, 64) if r[1] is None or len(r[1]) in (0, 64)]
    spark.createDataFrame(table, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = vector_codes.query(spark, str(tmp_path))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, expected(table)))
