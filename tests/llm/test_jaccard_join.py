import random
import re

import pytest

from loomery.llm import jaccard_join as J

from tests.llm.fixtures import documents, prose, rows


def sets_of(pairs):
    out = {}
    for i, text in pairs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        out[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return out


def brute(sets):
    part = {i: i for i in sets}

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                part[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_odd_rows(spark):
    pairs = {(i, t) for i, t, *_ in rows() if i is not None}
    want = brute(sets_of(pairs))
    got = J.jaccard_components(documents(spark, extra=True)).collect()
    assert len(got) == len(rows())
    for r in got:
        if r["id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == want[r["id"]]


@pytest.mark.parametrize("seed", [1, 2])
def test_random_edits_with_a_common_passage(spark, seed):
    """Chains of edits near the threshold, one passage in every text, and many exact copies."""
    rng = random.Random(seed)
    passage = prose(99, 60)
    texts = []
    for base in range(12):
        words = prose(base + 10 * seed, rng.choice([6, 20, 60, 150])).split()
        for _ in range(8):
            words = list(words)
            for _ in range(max(1, len(words) // 40)):
                words[rng.randrange(len(words))] = f"edit{rng.random():.4f}"
            texts.append(" ".join(words) + (" " + passage if base % 3 == 0 else ""))
    texts += [texts[0]] * 20 + ["a b", "a b", "b a"]
    rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want = brute(sets_of(enumerate(texts)))
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in J.jaccard_components(df).collect()}
    assert got == want


def test_one_of_each_and_empty(spark):
    df = spark.createDataFrame([(3, "x y z q r s t"), (5, "X y z q r s t"), (9, "other words that are not the same"), (None, "x y z q r s t")], "doc_id long, text string")
    assert sorted(r["doc_id"] or 0 for r in J.one_of_each(df).collect()) == [0, 3, 9]
    assert J.jaccard_components(documents(spark, empty=True)).count() == 0


def test_null_id_in_front_of_a_near_copy(spark):
    words = prose(7, 80).split()
    text, near = " ".join(words), " ".join(words[:78] + ["one", "two"])
    df = spark.createDataFrame([(None, text), (5, text), (7, near)], "doc_id long, text string").coalesce(1)
    assert sorted((r["id"] or 0, r["component_id"] or 0) for r in J.jaccard_components(df).collect())[1:] == [(5, 5), (7, 5)]


def test_rows_repeated_over_many_tasks(spark):
    """The same rows in each of several tasks keep their places in the prefix."""
    words = prose(5, 80).split()
    near = words[:76] + ["one", "two", "three", "four"]
    texts = [(1, " ".join(words)), (2, " ".join(near)), (3, prose(6, 80))]
    df = spark.createDataFrame(texts * 6, "doc_id long, text string").repartition(6)
    want = brute(sets_of(texts))
    assert {(r["id"], r["n_shingles"], r["component_id"]) for r in J.jaccard_components(df).collect()} == {(i, *v) for i, v in want.items()}


def test_a_large_group_and_a_word_of_1024_letters(spark):
    """Five hundred near copies of one text, many of them too far from each other; and words that a weak hash can't tell apart."""
    rng = random.Random(9)
    base = prose(3, 70).split()
    texts = []
    for _ in range(500):
        words = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 4])):
            words[rng.randrange(len(words))] = f"edit{rng.random():.6f}"
        texts.append(" ".join(words[: rng.choice([70, 70, 70, 66, 60])]))
    thue = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    texts += [thue, thue.translate(str.maketrans("ab", "ba"))]
    want = brute(sets_of(enumerate(texts)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in J.jaccard_components(df).collect()}
    assert got == want


def test_ids_with_two_texts_and_text_ids(spark):
    a, b = prose(21, 90), prose(22, 90)
    rows_ = [("x", a), ("x", b), ("y", a + " end"), ("z", b + " end"), (None, b)]
    got = J.jaccard_components(spark.createDataFrame(rows_, "doc_id string, text string")).collect()
    assert sorted((r["id"], r["component_id"]) for r in got if r["id"]) == [("x", "x"), ("x", "x"), ("y", "x"), ("z", "x")]
