"""Periodic runs against a plain search of every lag."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from loomery.llm import periodic_runs
from tests.llm import fixtures


def plain_runs(w, least=12):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((a, b - a, q) for (a, b), q in found.items())


def expected(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = plain_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    return (
        doc_id, len(runs), best[0], best[1], best[2], 1000 * best[1] // best[2] if runs else None,
        hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
        hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest(),
    )


def texts(n):
    rng = random.Random(8)
    out = [(i, t) for i, t, *_ in fixtures.rows() if not t or len(t) < 20_000]
    for i in range(100, 100 + n):
        w = [f"w{rng.randrange(rng.choice([1, 2, 5, 40, 400]))}" for _ in range(rng.randrange(0, 220))]
        at = rng.randrange(len(w) + 1)
        out.append((i, "\n ".join(w[:at] + w[at : at + 7] * rng.randrange(1, 6) + w[at:])))
    return out + [(50_001, "　a\x85 b\x1c " * 20), (50_002, "é 漢 " * 9), (50_003, "a " * 3000)]


def test_query_equals_brute_force(spark, tmp_path):
    rows = texts(400)
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = periodic_runs.query(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert [t for c, t in got.dtypes if "sha" not in c] == ["bigint"] * 6
    want = [expected(*r) for r in rows]
    assert sum(zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows) > 15 and sum(r[1] > 1 for r in want) > 15
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


@pytest.mark.parametrize("alphabet", [1, 2, 3, 60])
def test_runs_and_counts_of_all_lags(alphabet):
    rng = np.random.default_rng(alphabet)
    for n in (0, 1, 2, 11, 12, 13, 40, 333, 700):
        w = rng.integers(0, alphabet, n)
        w[n // 3 :] = w[n // 3 : n // 3 + max(1, n // 9)].repeat(9)[: n - n // 3] if alphabet == 60 and n > 40 else w[n // 3 :]
        codes = np.unique(w, return_inverse=True)[1]
        for least in (2, 5, 12):
            assert periodic_runs.runs_of(codes, least) == plain_runs(w.tolist(), least)
        if n > 1:
            want = [0] + [int((w[q:] == w[:-q]).sum()) for q in range(1, n // 2 + 1)]
            assert periodic_runs.lag_matches(codes, n // 2).tolist() == want


def test_long_texts_are_not_compared_at_every_lag(monkeypatch):
    """A text of one word has one run; its other lags have no matches of their own and aren't scanned. A scan skips."""
    seen = []
    plain_scan = periodic_runs.scan
    monkeypatch.setattr(periodic_runs, "scan", lambda codes, lag, least: seen.append(lag) or plain_scan(codes, lag, least))
    assert periodic_runs.runs_of(np.zeros(50_000, np.int64)) == [(0, 50_000, 1)] and seen == [1]
    assert periodic_runs.runs_of(np.arange(60_000) % 7_001) == [(0, 60_000, 7_001)]
    codes = np.unique(np.random.default_rng(3).zipf(1.3, 30_000) % 5_000, return_inverse=True)[1]
    codes[9_000:21_000] = codes[9_000:13_000].tolist() * 3
    assert (9_000, 12_000, 4_000) in [(s - s % 9_000 if abs(s - 9_000) < 3 else s, n - n % 12_000 if 0 <= n - 12_000 < 6 else n, p) for s, n, p in periodic_runs.runs_of(codes)]


def test_real_outputs_and_clashing_columns(spark):
    docs = fixtures.documents(spark, extra=True)
    got = periodic_runs.periodic_runs(docs)
    assert got.columns == [c for c in docs.columns if c not in ("text", "n_words")] + ["n_words", "runs", "collapsed"]
    rows = {r["doc_id"]: r for r in got.collect()}
    assert rows[12]["runs"][0].asDict() == {"start": 0, "length": 300, "period": 1} and rows[12]["collapsed"] == "spam"
    assert rows[7]["runs"] == [] and rows[7]["collapsed"] == "" and rows[9]["n_words"] == 0
    assert rows[6]["collapsed"] == " ".join(fixtures.prose(2, 200).split()) and rows[6]["kept"] == "x"
    assert periodic_runs.periodic_runs(fixtures.documents(spark, empty=True)).count() == 0
