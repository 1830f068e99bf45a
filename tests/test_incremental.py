"""Results that grow in batches, merged extracts, trees, fallbacks and counters."""

import pytest
from pyspark.sql import functions as F

from loomery.operators import fallback as B
from loomery.operators import incremental as I
from loomery.operators import runs as R
from loomery.operators import tree as T
from loomery.sources.results import Results


def hashed(df):
    return df.withColumn("hash", F.sha1(F.encode("text", "UTF-8")))


def test_a_cut_run_goes_on_and_a_repeated_one_writes_nothing(spark, tmp_path):
    rows = hashed(spark.range(300).select("id", F.concat(F.lit("t"), "id").alias("text")))
    store = Results(spark, f"{tmp_path}/r", "id long", "value string, parts array<struct<a:int,b:string>>")
    calls = []

    def compute(todo):
        calls.append(todo.count())
        if len(calls) == 3:
            raise RuntimeError("cut")
        return todo.select("id", "hash", F.upper("text").alias("value"), F.array(F.struct(F.lit(1).alias("a"), F.lit("x").alias("b"))).alias("parts"))

    with pytest.raises(RuntimeError):
        store.fill(rows, compute, 60)
    done = store.current().count()
    assert done == sum(calls[:2]) > 0
    assert store.fill(rows, compute, 60) > 0 and sum(calls) - calls[2] == 300  # nothing is computed twice
    assert {r["id"]: r["value"] for r in store.current().collect()} == {i: f"T{i}" for i in range(300)}
    n = len(calls)
    assert store.fill(rows, compute, 60) == 0 and len(calls) == n
    changed = hashed(spark.range(300).select("id", F.when(F.col("id") < 5, "new").otherwise(F.concat(F.lit("t"), "id")).alias("text")))
    assert store.fill(changed, compute, 60) == 1 and calls[-1] == 5
    (tmp_path / "r/generation=0/batch-00000099-torn").mkdir()  # a batch without its mark isn't there
    before = {tuple(r[:3]) for r in store.current().collect()}
    store.compact()
    assert {tuple(r[:3]) for r in store.current().collect()} == before and store.batches().count() == 300
    assert not (tmp_path / "r/generation=0").exists() and store.fill(changed, compute, 60) == 0
    assert Results(spark, f"{tmp_path}/none", "id long", "value string").current().count() == 0


def test_vectors_of_long_texts_are_pooled_and_failed_ones_tried_again(spark, tmp_path):
    texts = spark.createDataFrame([("a", "x" * 25), ("b", "short"), ("c", " "), ("d", None), ("e", "bad" + "y" * 20)], "id string, text string")
    store = Results(spark, str(tmp_path), "id string", "vector array<double>")
    seen = []

    def embed(ok):
        def run(pieces):
            seen.append(sorted((r["id"], r["piece"], len(r["text"])) for r in pieces.collect()))
            return pieces.select("id", "piece", F.array(F.length("text").cast("double"), F.col("piece").cast("double")).alias("vector"), (F.lit(ok) | ~F.col("text").startswith("bad")).alias("ok"))

        return run

    I.embed_missing(texts, store, embed(False), "id", 10, 2)
    assert seen[0] == [("a", 0, 10), ("a", 1, 10), ("a", 2, 9), ("b", 0, 5), ("e", 0, 10), ("e", 1, 10), ("e", 2, 7)]
    assert {r["id"]: r["vector"] for r in store.current().collect()} == {"a": [pytest.approx(29 / 3), 1.0], "b": [5.0, 0.0]}
    I.embed_missing(texts, store, embed(True), "id", 10, 2)
    assert [x[0] for x in seen[1]] == ["e"] * 3 and {r["id"] for r in store.current().collect()} == {"a", "b", "e"}


def test_only_blank_summaries_are_filled(spark, tmp_path):
    rows = spark.createDataFrame([(1, "text", " own "), (2, "text two", None), (3, "text three", " "), (4, "", None), (5, None, "")], "id long, text string, summary string")
    store, calls = Results(spark, str(tmp_path), "id long", "summary string"), []

    def summarise(todo):
        calls.append(sorted(r["id"] for r in todo.collect()))
        return todo.select("id", "hash", F.concat(F.lit("about "), "text").alias("summary"))

    want = {1: " own ", 2: "about text two", 3: "about text three", 4: None, 5: ""}
    for _ in range(2):
        assert {r["id"]: r["summary"] for r in I.fill_blank(rows, store, summarise, "id").collect()} == want
    assert calls == [[2, 3]]


def test_merged_extracts_replace_their_tasks_only(spark, tmp_path):
    kind = "task string, key string, o int, v string"
    spark.createDataFrame([("a", "k1", 1, "x"), ("a", "k2", 2, "y"), ("a", None, 3, "z"), ("b", "k1", 1, "b")], kind).write.partitionBy("task").parquet(f"{tmp_path}/x")
    for _ in range(2):
        old = spark.read.parquet(f"{tmp_path}/x").select("task", "key", "o", "v")
        I.merge_extracts(old.where("key is not null or task = 'b'"), spark.createDataFrame([("a", "k2", 9, "Y"), ("a", "k3", 10, "new")], kind), f"{tmp_path}/x", "task", "key", "o")
        got = sorted((r["task"], r["key"], r["v"]) for r in spark.read.parquet(f"{tmp_path}/x").collect())
        assert got == [("a", "k1", "x"), ("a", "k2", "Y"), ("a", "k3", "new"), ("b", "k1", "b")]
        spark.catalog.clearCache()


def test_trees(spark):
    entries = spark.createDataFrame([(" B  b ", "s", "L2", "1", 1), ("a", None, "L2", "2", 2), ("A", "", "L2", "3", 3), ("x", "", "zz", None, 4), ("y", "", None, "5", 5), ("", "", "L1", "6", 6), ("k", "", "L1", "7", 7)], "title string, summary string, level string, document_id string, ordinal int")
    levels = spark.createDataFrame([("L2", 0), ("L1", 1), ("L3", 2)], "level string, place int")
    got = [(r["group"], r["behind"], [c["title"] for c in r["children"]]) for r in T.catalogue_tree(entries, levels).collect()]
    assert got == [("L2", False, ["a", "A", "B b"]), ("L1", False, ["k"]), ("zz", True, ["x"]), ("其他", True, ["y"])]
    titles = spark.createDataFrame([("d1", "t2"), ("d1", "t1"), ("d2", "t1"), ("d9", "u"), ("d1", "t2")], "dataset string, title string")
    categories = spark.createDataFrame([("d1", "C1", 1), ("d2", "C1", 1), ("d3", "C0", 0)], "dataset string, category string, place int")
    lines = T.tree_lines(T.grouped_titles(titles, categories)).orderBy("behind", F.asc_nulls_last("place"), "group", F.asc_nulls_first("title"))
    assert [r["line"] for r in lines.collect()] == ["├── C0", "├── C1", "│   ├── t1", "│   └── t2", "└── d9", "    └── u"]
    assert [tuple(r) for r in T.exported(entries).orderBy("title").limit(1).collect()] == [("", "")]


def test_fallbacks(spark):
    files = spark.createDataFrame([("/r1/extract_uniq/t/state.json",), ("/r2/extract_uniq/t_extract.json",), ("/abs/f",), ("rel",)], "path string")
    tasks = spark.createDataFrame([("t",), ("u",)], "slug string").withColumn("c", B.names(F.col("slug")))
    assert [tuple(r) for r in B.first_existing(tasks, "slug", "c", files, ("/r1", "/r2")).collect()] == [("t", "/r2/extract_uniq/t_extract.json", "/r2")]
    mixed = spark.createDataFrame([("k", ["", None, "no", "/abs/f", "rel"]), ("l", ["rel"]), ("m", [])], "k string, c array<string>")
    assert sorted((r["k"], r["path"]) for r in B.first_existing(mixed, "k", "c", files).collect()) == [("k", "/abs/f"), ("l", "rel")]
    kind = "ordinal long, doc_id string, id string, title string, text_path string"
    catalogue = spark.createDataFrame([(0, "a", None, "A", "f"), (1, "", "b", None, None), (2, None, None, "C", "gone"), (3, "a", None, "A2", "f")], kind)
    extracts = spark.createDataFrame([(0, "x", "X", "f")], "ordinal long, doc_id string, title string, text_path string")
    texts = spark.createDataFrame([("f", "text")], "path string, text string")
    got = sorted(map(tuple, B.corpus_documents(catalogue, extracts, texts).collect()), key=str)
    assert got == [("a", "A2", "text", "stage_fill_info"), ("b", "b", None, "stage_fill_info"), ("doc:3", "C", None, "stage_fill_info")]
    for none in (None, catalogue.limit(0)):
        assert [tuple(r) for r in B.corpus_documents(none, extracts, texts).collect()] == [("x", "X", "text", "extracts")]


def test_counters_come_with_the_one_job(spark, tmp_path):
    rows = spark.createDataFrame([("page", True, None, None), ("page", None, None, None), ("entry", None, None, None), ("document", None, True, False), ("document", None, True, True), ("document", None, None, None)], "kind string, from_cache boolean, downloaded boolean, reused boolean")
    jobs = []
    got = R.observed(rows, R.crawl_counters(), lambda df: jobs.append(1) or df.write.parquet(f"{tmp_path}/out"))
    again = spark.read.parquet(f"{tmp_path}/out").agg(*[c.alias(n) for n, c in R.crawl_counters().items()]).first().asDict()
    assert got == again and got["files_downloaded"] == 1 and got["files_reused"] == 1 and got["pages_from_cache"] == 1 and jobs == [1]
    ranked = spark.createDataFrame([(1, 1), (2, 5), (3, None), (None, 2)], "place_a int, place_b int")
    assert R.displacements(ranked).first().asDict() == {"n": 2, "same": 1, "total": 3, "most": 3, "only_a": 1, "only_b": 1}
