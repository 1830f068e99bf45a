import random

import pytest
from pyspark.sql import functions as F

from loomery.operators import articles as A
from loomery.operators import merge as M
from loomery.operators import pages as P
from loomery.operators import rollups as R
from loomery.operators import search as S
from loomery.operators.metadata import query_metadata
from loomery.operators.packing import greedy_batches
from loomery.streaming import state

from tests.test_text_and_clauses import LAW

EDGE = [("a", "L1", 2020, ["x", "Y"], 1.5, 1), ("b", "L1", None, [], None, 2), ("c", None, 2021, None, 2.0, 3)]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, "id string, level string, year int, tags array<string>, score double, n int")


@pytest.mark.parametrize(
    "filters,ids",
    [
        ([{"field": "level", "op": "=", "value": None}], "c"),
        ([{"field": "level", "op": "!=", "value": "L1"}], "c"),
        ([{"field": "tags", "op": "in", "value": "x"}], "a"),
        ([{"field": "tags", "op": "contains", "value": "y"}], "a"),
        ([{"field": "level", "op": "contains", "value": "l"}], "ab"),
        ([{"field": "year", "op": ">", "value": 2019}], "ac"),
        ([{"field": "year", "op": ">", "value": "x"}], ""),
        ([{"field": "missing", "op": "=", "value": None}], "abc"),
        ([{"field": "level", "op": "in", "value": ["L1", None]}], "abc"),
        ([], "abc"),
    ],
)
def test_filters(edge, filters, ids):
    got = query_metadata(edge, select=["id"], filters=filters, order_by=[{"field": "id"}], limit=0, ordinal="n")
    assert "".join(r["id"] for r in got.collect()) == ids


def test_unknown_operator_lets_rows_pass(edge):
    with pytest.warns(UserWarning):
        assert query_metadata(edge, filters=[{"field": "id", "op": "like", "value": "z"}]).count() == 3


def test_aggregates(edge):
    aggs = [{"func": "count", "field": "*"}, {"func": "sum", "field": "tags", "as": "s"}, {"func": "avg", "field": "score", "as": "m"}, {"func": "median", "field": "score", "as": "x"}]
    got = {r["level"]: r for r in query_metadata(edge, select=["id"], group_by=["level"], aggregates=aggs, ordinal="n").collect()}
    assert (got["L1"]["count_*"], got["L1"]["s"], got["L1"]["m"], got["L1"]["x"], got["L1"]["id"]) == (2, 0, 1.5, None, "a")
    assert got[None]["id"] == "c"


def test_articles(spark):
    df = spark.createDataFrame([("d", LAW), ("e", "没有条文"), ("f", ""), ("g", None)], "doc_id string, text string")
    got = A.split_articles(df).orderBy("doc_id", "index").collect()
    law = [r for r in got if r["doc_id"] == "d"]
    assert [r["article_no"] for r in law] == ["全文", "第一条", "第二条", "第三条", "第一条"]
    assert [r["article_id"] for r in law] == [f"d-article-{i}" for i in range(1, 6)]
    assert all(LAW[r["start"] :].startswith(r["article_no"]) for r in law[1:])
    assert [(r["article_no"], r["text"]) for r in got if r["doc_id"] == "e"] == [("全文", "全文\n没有条文")]
    heads = A.headings(df.where("doc_id = 'd'")).orderBy("start").collect()
    assert [r["title"] for r in heads] == ["第一章 总则", "第二章 罚则"] and heads[1]["end"] == len(LAW)
    arts = A.split_articles(df)
    ctx = A.provision_context(arts, spark.createDataFrame([("d-article-2",)], "article_id string"), 0)
    assert sorted((r["role"], r["article_id"]) for r in ctx.collect()) == [("neighbor", "d-article-1"), ("neighbor", "d-article-3"), ("target", "d-article-2")]
    assert A.document_range(arts.where("doc_id = 'd'"), first=2, last=3).count() == 2


def test_search(spark):
    title = "中国人民银行公告〔2023〕第3号 关于测试"
    rows = [(1, title, "正文 银行卡"), (2, "支付清算管理条例", "正文"), (3, "监管问答", "银行卡 收单")]
    df = spark.createDataFrame(rows, "doc_id int, norm_title string, norm_text string")
    got = S.keyword_search(df, "银行卡").collect()
    assert {r["doc_id"] for r in got} == {1, 3}
    from loomery.functions import text as X

    e = df.select(F.col("doc_id").alias("rank"), "norm_title", F.col("norm_title").alias("title"), X.tokenize(F.col("norm_title")).alias("tokens"), X.extract_docno(F.col("norm_title")).alias("doc_no"), X.year_prefix(F.col("norm_title")).alias("year"), X.first_keyword(F.col("norm_title")).alias("doctype"), X.keyword_list(F.col("norm_title")).alias("agency"), F.lit("x.pdf").alias("best_path"))
    best = S.fuzzy_search(e, "中国人民银行公告〔2023〕第3号", 1).first()
    assert best["rank"] == 1 and best["score"] > 100


def test_merges(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), (None, 3, "z")], "k string, o int, v string")
    new = spark.createDataFrame([("b", 9, "Y"), ("c", 10, "C")], "k string, o int, v string")
    got = M.merge_by_key(old, new, "k", "o").orderBy("place").collect()
    assert [(r["k"], r["v"]) for r in got] == [("a", "x"), ("b", "Y"), ("c", "C"), (None, "z")]
    rows = [("R", 1, ["a", "b"], "First", "A"), ("R", 2, ["b", "c"], " ", None), ("S", 3, None, None, "C")]
    df = spark.createDataFrame(rows, "k string, n int, tags array<string>, summary string, level string")
    got = {r["k"]: r for r in M.catalogue_merge(df, "k", "n", ["tags"], ["summary"], ["level"]).collect()}
    assert (got["R"]["tags"], got["R"]["summary"], got["R"]["level"]) == (["a", "b", "c"], "First", None) and got["S"]["tags"] == []
    df = spark.createDataFrame([("k", 1, "ab"), ("k", 2, "b"), ("k", 3, "c"), ("k", 4, None)], "k string, n int, r string")
    assert M.reasons_merge(df, "k", "n", "r").first()["r"] == "ab; c"
    q = spark.createDataFrame([("abcd",), ("zzzz",)], "query string")
    t = spark.createDataFrame([("abcde",), ("abxx",)], "title string")
    assert [tuple(r)[:2] for r in M.close_titles(q, t).collect()] == [("abcd", "abcde")]


@pytest.mark.parametrize("seed", range(3))
def test_greedy_dedupe_equals_the_loop(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice([None, "", "n1", "N1 ", "n2", "n3"]), rng.choice(["t1", "t2", "t3", "t4", "t5"]), rng.choice([None, "p1", "p2", "p3", "p4"])) for i in range(40)]
    seen, want = {}, {}
    for i, no, title, path in rows:
        no = (no or "").strip().lower()
        keys = [("n", no) if no else ("t", title)] + ([("p", path)] if path else [])
        hits = [seen[k] for k in keys if k in seen]
        want[i] = hits[0] if hits else None
        if not hits:
            seen.update((k, i) for k in keys)
    df = spark.createDataFrame(rows, "rank int, doc_no string, title string, path string")
    assert {r["rank"]: r["duplicate_of"] for r in M.greedy_dedupe(df, "rank").collect()} == want


def test_greedy_batches(spark):
    df = spark.createDataFrame([("g", i, n) for i, n in enumerate([10, 10, 50, 5, 5, 5, 5, 5, 5])] + [(None, 1, 99)], "g string, i int, n int")
    got = sorted((r["i"], r["batch"]) for r in greedy_batches(df, "g", "i", "n", 5, 30).where("g is not null").collect())
    assert [b for _, b in got] == [0, 0, 1, 2, 2, 2, 2, 2, 3]


def test_pages(spark):
    html = '<html><title> T </title><nav><a href="/n">N</a></nav><table><tr><td>1</td><td><a href="detail1.html">公告甲</a> (2021年9月30日公布)</td><td>自2022年1月1日起施行</td><td><a href="a.doc">word版</a>, <a href="a.pdf">pdf版</a></td></tr></table><p>Body</p><p>Body</p><script>x()</script></html>'
    df = spark.createDataFrame([(1, "http://example.com/list/index.html", html), (2, None, None)], "page_id long, url string, html string")
    e = P.listing_entries(df).first()
    assert (e["serial"], e["title"], e["remark"]) == (1, "公告甲", "(2021年9月30日公布) 自2022年1月1日起施行")
    assert e["urls"] == [f"http://example.com/list/{x}" for x in ("detail1.html", "a.doc", "a.pdf")]
    main = {r["page_id"]: r for r in P.main_block(df).collect()}
    assert main[1]["title"] == "T" and main[1]["main"].endswith("Body") and "x()" not in main[1]["main"] and main[2]["main"] == ""


def test_rollups(spark):
    kinds = [["html", "doc"], ["html", "application/pdf"], ["html"], ["application/vnd.openxmlformats-officedocument.wordprocessingml.document"]]
    df = spark.createDataFrame([(k,) for k in kinds], "k array<string>")
    assert [r[0] for r in df.select(R.preferred_type(F.col("k"))).collect()] == ["doc", "pdf", "html", "doc"]


def test_upsert_and_stream(spark, tmp_path):
    rows = [(1, 1, "a", True), (1, 2, None, False), (2, 3, "b", None)]
    df = spark.createDataFrame(rows, "k int, t int, v string, f boolean")
    want = [(1, "a", True, 2), (2, "b", False, 3)]
    assert sorted(map(tuple, state.upsert(df, "k", "t", ["v"], ["f"]).collect())) == want
    df.repartition(3).write.parquet(f"{tmp_path}/in")
    q = (
        spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        .writeStream.foreachBatch(state.upsert_into(f"{tmp_path}/state", "k", "t", ["v"], ["f"]))
        .option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    last = max(int(p.name[2:]) for p in (tmp_path / "state").glob("v=*"))
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/state/v={last}").collect())) == want
    s = spark.createDataFrame([("x", 1, 1), ("x", 2, 5), ("x", 3, 1), ("x", 4, 2)], "task string, at int, wanted int")
    assert [r["serial"] for r in state.serials(s, "at", "wanted").orderBy("at").collect()] == [1, 5, 6, 2]


def test_serials_of_one_large_task(spark):
    """One task, null, has all rows, and nearly all of them take the maximum plus 1."""
    df = spark.range(200_000).select(F.lit(None).cast("long").alias("task"), F.col("id").alias("at"), F.when(F.col("id") % 3 > 0, F.col("id") % 50).alias("wanted"))
    want, used, top = {}, set(), None
    for i in range(200_000):
        s = i % 50 if i % 3 and i % 50 not in used else 1 if top is None else top + 1
        used.add(s)
        top = s if top is None else max(top, s)
        want[i] = s
    assert {r["at"]: r["serial"] for r in state.serials(df, "at", "wanted").collect()} == want


def test_reachable_raises_where_rounds_end(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(4)], "src long, dst long")
    assert M.reachable(edges, [0], rounds=5).count() == 5
    with pytest.raises(ValueError):
        M.reachable(edges, [0], rounds=2)
