import hashlib
import re

from pyspark.sql import functions as F

from loomery.llm.exact_dedup import deduplicated, exact_dedup

from tests.llm.fixtures import documents, rows


def brute():
    groups = {}
    for i, text, *_ in rows():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), i is None, i))
    return {k: (min(v)[2], len(v)) for k, v in groups.items()}


def check(found):
    want = brute()
    got = sorted((r["id"] is None, r["id"] or 0, r["keep_id"], r["group_size"]) for r in found.collect())
    assert got == sorted((i is None, i or 0, *want[re.sub(r"[\x20\x09-\x0D]", "", t or "")]) for i, t, *_ in rows())


def test_equals_brute_force(spark):
    check(exact_dedup(documents(spark, extra=True)))


def test_digest(spark):
    r = exact_dedup(spark.createDataFrame([(1, "a b\nc")], "doc_id long, text string")).first()
    assert bytes(r["digest"]) == hashlib.sha256(b"abc").digest()


def test_verification_resolves_clashes(spark):
    """With a digest of one byte nearly all texts clash, and the result is the same."""
    check(exact_dedup(documents(spark), digest=lambda text: F.encode((F.length(text) % 2).cast("string"), "UTF-8")))


def test_rows_that_stay(spark):
    got = sorted(r["doc_id"] or 0 for r in deduplicated(documents(spark)).collect())
    assert got == [0, 3, 4, 5, 8, 10, 11, 12, 13, 14, 15] or got == [0, 3, 4, 5, 9, 10, 11, 12, 13, 14, 15]


def test_empty_table(spark):
    assert exact_dedup(documents(spark, empty=True)).count() == 0
    assert deduplicated(documents(spark, empty=True)).count() == 0
