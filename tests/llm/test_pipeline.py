"""The pipeline against plain Python on a small table."""

import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from loomery.llm.source_mix import water_fill

from tests.llm.fixtures import SCHEMA, documents
from tests.llm.test_jaccard_join import brute, sets_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages_equal_brute_force(spark, tmp_path):
    documents(spark).where("doc_id is not null").write.parquet(f"{tmp_path}/documents.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs.collect()
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS

    # quality: short, repetitive and navigation texts go, whole prose stays as it is
    assert sorted(r["doc_id"] for r in seen["quality_rules"]) == [1, 2, 3, 4, 5, 6, 6, 11, 14, 15]
    before = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()}
    assert all(r["text"] == before[r["doc_id"]] and r["n_chars"] == len(r["text"]) for r in seen["quality_rules"])

    # exact: of equal texts the longest, then the smallest id
    groups = {}
    for r in seen["quality_rules"]:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r["text"]), []).append((-len(r["text"]), r["doc_id"]))
    assert sorted(r["doc_id"] for r in seen["exact_dedup"]) == sorted(min(g)[1] for g in groups.values())

    # near: the smallest id of each component
    want = brute(sets_of({(r["doc_id"], r["text"]) for r in seen["exact_dedup"]}))
    assert sorted(r["doc_id"] for r in seen["jaccard_join"]) == sorted(i for i, (_, c) in want.items() if i == c)

    # mix: each source's words come near its target
    sizes = Counter()
    for r in seen["jaccard_join"]:
        sizes[r["source"]] += len(WORD.findall(r["text"]))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = dict(zip(names, water_fill([sizes[s] for s in names], [1 + i % 3 for i in range(len(names))], 3)))
    taken, longest = Counter(), Counter()
    for r in seen["source_mix"]:
        n = len(WORD.findall(r["text"]))
        taken[r["source"]] += n
    for r in seen["jaccard_join"]:
        longest[r["source"]] = max(longest[r["source"]], len(WORD.findall(r["text"])))
    assert all(abs(taken[s] - targets[s]) <= longest[s] / 2 for s in names)

    # packing: every token of every taken row
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = Counter()
    for r in seen["source_mix"]:
        ids = np.array(tokenizer.encode(r["text"], add_special_tokens=False).ids + [0], dtype="<u4")
        pieces.update((r["doc_id"], k // 2048, zlib.crc32(ids[k : k + 2048].tobytes())) for k in range(0, len(ids), 2048))
    assert Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in seen["packing"]) == pieces
    assert len({(r["sequence_id"], r["offset"]) for r in seen["packing"]}) == len(seen["packing"])


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_other_columns(spark, tmp_path):
    """Columns with names of the operators' own change nothing."""
    documents(spark).write.parquet(f"{tmp_path}/plain/documents.parquet")
    documents(spark, extra=True).write.parquet(f"{tmp_path}/more/documents.parquet")
    plain, more = (Counter(tuple(r[c] for c in ("doc_id", "piece", "length", "ids_crc32")) for r in corpus_pipeline.run(spark, f"{tmp_path}/{x}").collect()) for x in ("plain", "more"))
    assert plain == more
