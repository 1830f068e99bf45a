"""Every registered query with SQL against DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from loomery.plans import catalogue

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return c


def plain(x):
    if isinstance(x, float):
        return round(x, 5)
    return [plain(y) for y in x] if isinstance(x, (list, tuple)) else x


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, db, name):
    got = catalogue.queries()[name](spark, DATA)
    rows = got.collect()
    if name not in catalogue.oracle_sql():
        assert got.columns
        return
    want = db.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    order = sorted(names)
    a = sorted((repr([plain(r[c]) for c in order]) for r in rows))
    b = sorted((repr([plain(r[names.index(c)]) for c in order]) for r in want.fetchall()))
    assert a == b
