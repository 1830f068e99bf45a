import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loomery.llm import packing, sharding, source_mix

from tests.llm.fixtures import documents, rows


def test_shards_are_exact_and_repeatable(spark):
    runs = [sorted(map(tuple, sharding.shard(documents(spark, extra=True), 4).select("shard", "slot", "doc_id").collect()), key=str) for _ in range(2)]
    by = defaultdict(list)
    for shard, slot, _ in runs[0]:
        by[shard].append(slot)
    assert sorted(map(len, by.values())) == [4, 4, 4, 5]
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert Counter(x[2] for x in runs[0]) == Counter(r[0] for r in rows())


def test_shards_of_a_table_are_uniform(spark, tmp_path):
    spark.range(0, 4000, 1, 5).write.parquet(f"{tmp_path}/t")
    got = sharding.shard(spark.read.parquet(f"{tmp_path}/t"), 8).toPandas()
    assert got.groupby("shard").size().tolist() == [500] * 8
    assert abs(got[["id", "shard", "slot"]].corr().values - np.eye(3)).max() < 0.06
    again = sharding.shard(spark.read.parquet(f"{tmp_path}/t"), 8).toPandas()
    assert got.sort_values("id").values.tolist() == again.sort_values("id").values.tolist()


def test_matrix_has_exact_margins():
    m = sharding.communication_matrix([10, 0, 7, 23], sharding.shard_sizes(40, 6), 1)
    assert m.sum(axis=1).tolist() == [10, 0, 7, 23] and m.sum(axis=0).tolist() == sharding.shard_sizes(40, 6) and (m >= 0).all()


def test_empty_tables(spark):
    empty = documents(spark, empty=True)
    assert sharding.shard(empty, 3).count() == 0
    assert source_mix.mix_sources(empty).count() == 0
    assert packing.pack_documents(empty).count() == 0


def test_water_fill():
    assert source_mix.water_fill([100, 100], [1, 3], 3) == [50, 150]
    assert source_mix.water_fill([10, 190], [3, 1], 3) == [30, 170]
    assert source_mix.water_fill([0, 0], [1, 2], 3) == [0, 0]


def test_mix_comes_near_its_targets(spark):
    got = source_mix.mix_sources(documents(spark, extra=True)).toPandas()
    assert len(got) == len(rows()) and (got.taken <= 3 * got["size"]).all()
    for _, g in got.groupby(got.source.fillna("?")):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= max(g["size"].max() / 2, 1)
    assert abs(got.groupby(got.source.fillna("?")).target.first().sum() - got["size"].sum()) < 1e-6
    many = source_mix.mixed(documents(spark)).count()
    assert many == got.epochs.sum()


def check_packed(pieces, capacity):
    by = defaultdict(list)
    for p in pieces:
        by[p["sequence_id"]].append((p["offset"], p["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_pieces_hold_the_tokenizers_ids(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = packing.pack_documents(documents(spark, extra=True)).collect()
    want = []
    for i, text, *_ in rows():
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], dtype="<u4")
        want += [(i, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes())) for k in range(0, len(ids), 2048)]
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == Counter(want)
    assert check_packed(got, 2048) <= -(-sum(w[3] for w in want) // 2048) + 1


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 40), max_size=20))
def test_plan_places_each_piece_once(histogram):
    pieces, ranks = [], defaultdict(list)
    for length, first, n, sequence, offset in packing.best_fit_plan(histogram, 32):
        ranks[length] += range(first, first + n)
        pieces += [{"sequence_id": sequence + k, "offset": offset, "length": length} for k in range(n)]
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in histogram.items()}
    check_packed(pieces, 32)


@pytest.mark.parametrize("text", ["", "it's I'LL Don'T 3.14 a　b", "ÀÉ ß ſ İx Straße ΑΣ", "x<|startoftext|>y", "é éx", "日本 ７ ½ ²", "\x0b\x0ca\x1cb _ __ 'sx"])
def test_words_give_the_tokenizers_ids(text):
    import pyarrow as pa

    path = public_tokenizers.path("word_bpe_49k.json")
    ids, _ = packing.WordTokens(path).texts(pa.array([text]), 0)
    assert ids.tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids + [0]


def odd_words():
    """Words of all kinds in texts that share many of them: plain, with marks, other scripts, special tokens, long ones."""
    rng = np.random.default_rng(3)
    stock = ["it's", "I'LL", "Straße", "ÀÉÿ", "x<|endoftext|>y", "<|", "日本", "a\x00b", "\x00", "3.14", "--", "\u200b", "\u3000", "e\u0301x", "İx", "ΑΣ", "q" * 300, "ж" * 200]
    letters = list("abcdefghijklmnopqrstuvwxyzäöñ")
    stock += ["".join(rng.choice(letters, rng.integers(1, 12))) + str(rng.choice(["", ".", ",", "'s", "7"])) for _ in range(400)]
    return ["", " \n ", *[" ".join(rng.choice(stock, rng.integers(1, 60))) for _ in range(120)], " a\t\x0bB  "]


@pytest.mark.parametrize("cache, at_once", [(250_000, 1 << 20), (50, 100), (1, 1)])
def test_words_in_one_string_give_the_tokenizers_ids(monkeypatch, cache, at_once):
    """Whatever is remembered, forgotten, or cut between two calls; and long words aren't kept."""
    import pyarrow as pa

    monkeypatch.setattr(packing, "_CACHE", cache)
    monkeypatch.setattr(packing, "_AT_ONCE", at_once)
    path = public_tokenizers.path("word_bpe_49k.json")
    tokens, tokenizer, texts = packing.WordTokens(path), Tokenizer.from_file(path), odd_words()
    for some in (texts[:1], texts[:3], texts[3:80], texts[40:], texts[:2]):
        ids, counts = tokens.texts(pa.array(some), 0)
        want = [tokenizer.encode(x, add_special_tokens=False).ids + [0] for x in some]
        assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    assert max(map(len, [*tokens.known, *tokens.older])) <= 64


def test_a_part_goes_through_the_model_once(monkeypatch):
    """Work on words follows the parts that are new, not the words of each slice: ten slices of one kind cost the model one."""
    import pyarrow as pa

    tokens = packing.WordTokens(public_tokenizers.path("word_bpe_49k.json"))
    calls = Counter()

    class Counted:
        def __init__(self, inner):
            self.inner = inner

        def encode(self, word, **options):
            calls[word] += 1
            return self.inner.encode(word, **options)

        def ids(self, parts):
            calls.update(parts)
            return self.inner.ids(parts)

    tokens.tokenizer, tokens.pairs = Counted(tokens.tokenizer), Counted(tokens.pairs)
    words = ["alpha,", "Beta.", "gamma", "日本", "ж" * 5, "alpha;"]
    monkeypatch.setattr(packing, "_CACHE", 9)  # full after the first slice: the rest come from what was known before
    for k in range(10):
        tokens.texts(pa.array([" ".join(words)]), 0)
    assert calls["日本"] == calls["ж" * 5] == calls["alpha"] == 1 and max(calls.values()) == 1


def test_pairs_of_many_words_merge_as_in_the_tokenizers_model():
    import pyarrow as pa

    path = public_tokenizers.path("word_bpe_49k.json")
    tokens, rng = packing.WordTokens(path), np.random.default_rng(8)
    words = ["".join(rng.choice(list(letters), rng.integers(1, 64))) for letters in ("ab", "aaan", "etaoinshr", "abcdefghijklmnopqrstuvwxyzéßñ", "!?.-'") for _ in range(200)]
    words += ["a", "é", "aaaaaaaa", "ananananas", "the", "'" * 64]
    ids, counts = tokens.pairs.ids(words)
    want = [[x.id for x in tokens.tokenizer.model.tokenize("".join(tokens.letters[b] for b in w.encode()))] for w in words]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    # a model of another kind goes word by word, with the same ids
    texts = pa.array([" ".join(words)])
    ids, counts = tokens.texts(texts, 0)
    plain = packing.WordTokens(path)
    plain.pairs = None
    assert [x.tolist() for x in plain.texts(texts, 0)] == [ids.tolist(), counts.tolist()]

    class Other:
        def to_str(self):
            return '{"model": {"type": "WordPiece"}}'

    assert packing.BytePairs.of(Other(), tokens.letters) is None


def test_digests_are_those_of_the_ids(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = documents(spark, extra=True).select("doc_id", "text")
    ids = packing.tokenised(docs, path, capacity=16).collect()
    crcs = packing.tokenised(docs, path, capacity=16, crc=True)
    assert crcs.columns == ["doc_id", "piece", "start", "length", "ids_crc32"]
    want = [(r["doc_id"], r["piece"], r["start"], r["length"], zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes())) for r in ids]
    assert Counter(map(tuple, crcs.collect())) == Counter(want)


def test_draws_beyond_numpys_range_follow_the_exact_law():
    """The walk from the mode against numpy's own draws, by their moments, and at the edges."""
    rng = np.random.default_rng(5)
    big = [sharding._hypergeometric(rng, 3 * 10**9, 10**11, 100) for _ in range(20_000)]
    p = 3 / 103
    assert abs(np.mean(big) - 100 * p) < 0.05 and abs(np.var(big) - 100 * p * (1 - p)) < 0.12
    skew = np.mean(((np.array(big) - np.mean(big)) / np.std(big)) ** 3)
    assert abs(skew - (1 - 2 * p) / np.sqrt(100 * p * (1 - p))) < 0.08
    assert sharding._hypergeometric(rng, 0, 10**12, 5) == 0 and sharding._hypergeometric(rng, 10**12, 0, 5) == 5
    m = sharding.communication_matrix([10**10, 5, 3 * 10**9], sharding.shard_sizes(13 * 10**9 + 5, 7), 2)
    assert m.sum(axis=0).tolist() == sharding.shard_sizes(13 * 10**9 + 5, 7) and m.sum(axis=1).tolist() == [10**10, 5, 3 * 10**9] and (m >= 0).all()


def test_a_capped_source_gives_no_fourth_epoch(spark):
    df = spark.createDataFrame([(i, "" if i % 3 == 0 else "w " * 10, "a" if i < 30 else "b") for i in range(300)], "doc_id long, text string, source string")
    got = source_mix.mix_sources(df, weights=(9, 1)).toPandas()
    assert got[got.source == "a"].epochs.max() == 3


def test_rows_without_ids_and_equal_rows_are_documents_of_their_own(spark):
    """A third of the ids is null, one row is there 200 times, one id has many texts: targets are met to half a document, and again alike."""
    table = [(None, f"w{i} " * 20, "a") for i in range(300)] + [(i, "v " * 20, "a") for i in range(100)]
    table += [(None, "copy " * 30, "b")] * 200 + [(5, f"x{i} " * 10, "b") for i in range(60)] + [(7, "y " * 40, None)] * 90 + [(i, "z", None) for i in range(50)]
    taken = []
    for parts in (1, 7):
        df = spark.createDataFrame(table, "doc_id long, text string, source string").repartition(parts)
        got = source_mix.mix_sources(df, weights=(1, 4, 2)).toPandas()
        assert len(got) == len(table) and (got.taken <= 3 * got["size"]).all()
        for _, g in got.groupby(got.source.fillna("?")):
            assert abs(g.taken.sum() - g.target.iloc[0]) <= g["size"].max() / 2 + 1e-6
        taken.append(sorted(map(repr, got[["doc_id", "text", "source", "taken"]].fillna("-").values.tolist())))
        assert source_mix.mixed(df, weights=(1, 4, 2)).count() == got.epochs.sum()
    assert taken[0] == taken[1]
    assert ((got.groupby(got.source.fillna("?")).taken.nunique()) >= 2).any()


def test_rows_of_the_matrix_are_drawn_alone_and_follow_the_law():
    """Each row by itself is that of the whole matrix; over seeds, counts have the moments of a uniform permutation's, and all partitions are alike."""
    counts, sizes = [30, 0, 50, 7, 13, 20], sharding.shard_sizes(120, 5)
    upto = np.concatenate([[0], np.cumsum(counts)])
    draws = np.array([sharding.communication_matrix(counts, sizes, seed) for seed in range(3000)])
    assert (draws.sum(axis=2) == counts).all() and (draws.sum(axis=1) == sizes).all()
    assert (sharding.matrix_row(upto, 4, sizes, 17) == draws[17][4]).all()
    n, good = np.array(counts)[:, None], np.array(sizes)[None]
    mean = n * good / 120
    var = mean * (1 - good / 120) * (120 - n) / 119
    assert np.allclose(draws.mean(axis=0), mean, atol=0.15) and np.allclose(draws.var(axis=0), var, rtol=0.15, atol=0.02)
    # chi-square of one cell against the hypergeometric law
    from math import comb

    law = np.array([comb(24, k) * comb(96, 20 - k) / comb(120, 20) for k in range(21)])
    seen = np.bincount(draws[:, 5, 2], minlength=21)
    some = law * 3000 > 5
    assert ((seen - 3000 * law)[some] ** 2 / (3000 * law)[some]).sum() < 2.5 * some.sum()


def test_slots_are_uniform(spark):
    """Over seeds, the place of one row is uniform over shards and slots: chi-square."""
    df = spark.range(0, 24, 1, 3).withColumnRenamed("id", "doc_id")
    seen = np.zeros((4, 6))
    for seed in range(24):
        for r in sharding.shard(df, 4, seed=seed).where("doc_id in (0, 9, 23)").collect():
            seen[r["shard"], r["slot"]] += 1
    assert ((seen - 3) ** 2 / 3).sum() < 60  # 23 degrees of freedom


def test_partitions_that_change_are_found_out(spark, tmp_path):
    spark.range(0, 100, 1, 2).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    fewer = df.where("id % 2 = 0 or rand() < 2")
    assert sharding.shard(fewer, 3).count() == 100
    import random

    flip = F.udf(lambda x: random.random() < 0.5, "boolean").asNondeterministic()
    with pytest.raises(Exception, match="counted|out of bounds"):
        sharding.shard(df.where(flip("id")), 3).collect()
