"""Examples of reading, extraction, results and page texts, in the language of their documents."""

from pyspark.sql import functions as F

from loomery.functions import pagetext
from loomery.operators import extraction as E
from loomery.operators import merge as M
from loomery.operators import pages as P
from loomery.operators import predicates as D
from loomery.operators import reading as R
from loomery.operators import results as S
from loomery.operators import rollups
from loomery.operators import search
from loomery.sources.readers import decode_bytes

LAW = "前言\n第一章 总则 第九章\n第一条 甲。\n第二章 分则\n第二条 乙。\n第一节 细则\n第三条 丙。\n第三章 附则\n第四条 丁。"


def test_structure_and_ranges(spark):
    docs = spark.createDataFrame([("a", LAW), ("b", "第一条 甲"), ("c", None), ("d", "")], "doc_id string, text string")
    rows = R.structured(docs)
    got = [(r["doc_id"], r["label"], r["article_no"]) for r in rows.orderBy("doc_id", "index").collect()]
    # the second chapter has a section: what is before it isn't shown; a heading on the line of a heading is part of it
    assert got == [("a", "全文", "全文"), ("a", "第一章 总则 第九章", "第一条"), ("a", "第二章 分则 第一节 细则", "第三条"), ("a", "第三章 附则", "第四条"), ("b", "全文", "第一条")]
    no = lambda df: [r["article_no"] for r in df.where("doc_id = 'a'").orderBy("index").collect()]
    assert no(R.in_range(rows, "chapter", index=2)) == ["第三条"] and no(R.in_range(rows, "chapter", title="附则")) == ["第四条"]
    assert no(R.in_range(rows, "section", section="第一节")) == ["第三条"]
    assert no(R.in_range(rows, "articles", first=2, last=4)) == ["第一条", "第三条"] and no(R.in_range(rows, "articles", ids=["a-article-2"])) == ["第一条"]
    assert R.plain_text(R.in_range(rows, "articles", first=4, last=5)).where("doc_id = 'a'").first()["text"].startswith("第三条\n丙。")


def test_parts_contents_and_sentences(spark):
    docs = spark.createDataFrame([(1, "x", "一。二的例外；三"), (2, "y", "无")], "doc_id long, title string, text string")
    assert R.parts(docs, {"meta"}, ["title"]).columns == ["doc_id", "title"] and R.parts(docs, {"all"}, ["title"]).columns == ["doc_id", "title", "text"]
    wanted = spark.createDataFrame([(0, "2-article-1"), (1, "2"), (2, "1:x"), (3, "9")], "ordinal long, id string")
    assert [r["doc_id"] for r in R.contents(docs, wanted, 1, 1).collect()] == [2] and [r["doc_id"] for r in R.contents(docs, wanted, 2, 1).collect()] == [1]
    articles = docs.select("doc_id", F.lit(0).alias("index"), F.lit("a").alias("article_id"), "text")
    assert [(r["doc_id"], r["sentence"]) for r in R.first_sentence(articles, ("例外",)).collect()] == [(1, "二的例外")]


def test_candidates_and_status(spark):
    docs = spark.createDataFrame(
        [(1, "支付条例", 0, "pdf", "支付条例.pdf", "a", False), (1, "支付条例", 1, "doc", "附件1", "b", False), (1, "支付条例", 2, "html", "支付条例（全文）", "c", False), (1, "支付条例", 3, "text", "x", "d", True), (1, "支付条例", 4, "html", "支付条列", "", False), (2, None, 0, "word", "附表", "e", None)],
        "entry_id long, entry_title string, place int, type string, title string, path string, preferred boolean",
    )
    got = {(r["entry_id"], r["place"]): (r["rank"], r["priority"]) for r in E.candidates(docs).collect()}
    assert got == {(1, 3): (1, 0.0), (1, 0): (2, 3022.0), (1, 2): (3, 2011.0), (1, 1): (4, 28.5), (2, 0): (1, 29.5)}
    attempts = spark.createDataFrame([(1, 0, "pdf", "", "broken", True), (1, 1, "html", "x", None, False), (2, 0, "pdf", None, "scan", True), (3, 0, "html", " ", None, False), (4, 0, "html", None, "gone", False)], "entry_id long, rank int, type string, text string, error string, requires_ocr boolean")
    entries = spark.range(1, 6).withColumnRenamed("id", "entry_id")
    assert {r["entry_id"]: (r["status"], r["requires_ocr"]) for r in E.statuses(entries, attempts).collect()} == {1: ("success", True), 2: ("needs_ocr", True), 3: ("empty", False), 4: ("error", False), 5: ("no_source", False)}


def test_pages_and_types(spark):
    text = "很长的一页文字，超过十二个字符。\f短\f\f"
    df = spark.createDataFrame([(1, text), (2, "短\f短"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: (list(r["p"]), list(r["o"])) for r in df.select("doc_id", E.pages(F.col("text")).alias("p"), E.pages_for_ocr(F.col("text")).alias("o")).collect()}
    assert got == {1: (["很长的一页文字，超过十二个字符。", "短"], [1]), 2: (["短", "短"], []), 3: ([], [])}
    kinds = spark.createDataFrame([(["password"],), (["x", " DOCM"],), ([None, ""],), (["text/html; charset=utf-8"],)], "t array<string>")
    assert [r[0] for r in kinds.select(rollups.preferred_type(F.col("t"))).collect()] == ["password", "doc", "unknown", "html"]
    assert decode_bytes("éa".encode("utf-16-le")) == "éa" and decode_bytes("漢字".encode("gb18030") + b"a") == "漢字a" and decode_bytes("漢".encode("gb18030") + b"a") is not None and decode_bytes(None) is None


def test_page_texts(spark):
    raw = "打印本页\n标题\n标题\n\n\n正文\n特此通知\n特此通知\n网站地图\n"
    assert spark.createDataFrame([(raw,)], "x string").select(pagetext.page_text(F.col("x"))).first()[0] == "标题\n\n正文\n\n特此通知\n\n特此通知"
    html = "<ul><li><a href='a.doc'>甲</a><a href='a.doc'>甲</a><a href='b.html'>第2页</a><a href='javascript:void(0)'>首页</a></li></ul>"
    links = P.links(spark.createDataFrame([(1, "http://h/l/i.html", html)], "page_id long, url string, html string"))
    assert [(r["url"], r["type"]) for r in P.attachments(links).collect()] == [("http://h/l/a.doc", "word")]
    assert [(r["url"], r["role"]) for r in P.pagination(links, "http://h/l/i.html").collect()] == [("http://h/l/b.html", None)]


def test_results(spark):
    df = spark.createDataFrame([("前面的文字" * 30 + "处罚 罚款规定" + "后面" * 90,), ("",), (None,)], "t string")
    first, *rest = [r[0] for r in df.select(S.snippet(F.col("t"), ["罚款规定", "前"])).collect()]
    assert "罚款规定" in first and len(first) <= 180 and rest == ["", ""]
    articles = spark.createDataFrame([(1, "l", "责令 罚款"), (2, "l", "银行"), (3, "m", "处罚")], "id long, law_id string, text string")
    vectors = spark.createDataFrame([(2, 0.5)], "id long, score double")
    got = {r["id"]: r["match_type"] for r in S.fused_hits("处 罚款", articles, vectors).collect()}
    assert got[2] == "vector" and 1 in got
    matches = spark.createDataFrame([(0, "a", "第一条", None, "x"), (1, "a", "第一条", "T", "x y"), (2, None, "第一条", None, "z"), (3, "b", "", "B", "q")], "ordinal long, id string, clause string, title string, reason string")
    titles = spark.createDataFrame([("a", "目录")], "id string, title string")
    assert sorted((r["id"] or "", r["title"], r["reason"]) for r in S.merge_matches(matches, titles).collect()) == [("", None, "z"), ("a", "目录", "x; x y")]


def test_anchored_substrings_and_close_titles(spark):
    texts = spark.createDataFrame([(1, "aa one two three four five six bb seven"), (2, "one two three four five six"), (3, "tiny"), (3, "tiny"), (4, None)], "id long, text string")
    needles = spark.createDataFrame([("n1", "a one two three four five six b"), ("n2", "iny"), ("n3", "a one two three four five six c"), ("n4", None)], "n string, needle string")
    got = sorted((r["id"], r["n"]) for r in M.substring_join(texts, "text", needles, "needle").collect())
    assert got == [(1, "n1"), (3, "n2"), (3, "n2")]
    q = spark.createDataFrame([("支付管理办法",), ("完全不同",)], "query string")
    t = spark.createDataFrame([("支付管理办法（试行）",), ("支付结算办法",), ("理",)], "title string")
    import difflib

    best = max(("支付管理办法（试行）", "支付结算办法"), key=lambda x: (difflib.SequenceMatcher(None, "支付管理办法", x).ratio(), x))
    assert [(r["query"], r["title"]) for r in M.close_titles(q, t, 0.7).collect()] == [("支付管理办法", best)]


def test_chains_have_no_cap(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(130)], "src long, dst long")
    assert M.reachable(edges.coalesce(1), [0]).count() == 131


def test_stored_postings(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"word{i % 7} thing {'rare' if i == 3 else 'common'}") for i in range(50)], "doc_id long, text string")
    search.save_postings(search.postings(docs), f"{tmp_path}/p", 8)
    terms = ["rare", "thing", "thing", "word2"]
    stored = search.bm25_postings(search.read_postings(spark, f"{tmp_path}/p", terms, 8), search.lengths(docs), terms)
    plain = {r["id"]: round(r["score"], 9) for r in search.bm25(docs, terms).collect()}
    assert {r["id"]: round(r["score"], 9) for r in stored.collect()} == plain and len(plain) == 50


def test_filters(spark):
    d = "struct<url:string,type:string,title:string,remark:string,local_path:string,downloaded:boolean>"
    df = spark.createDataFrame([(1, "x", None, [("u", "HTML", "t", None, "p", True)]), (2, "x", "已废止", []), (3, None, None, [("u", "pdf", "废止决定", None, None, False)]), (4, None, None, None)], f"entry_id long, title string, remark string, documents array<{d}>")
    assert [r[0] for r in df.where(D.html_only(F.col("documents"))).select("entry_id").collect()] == [1]
    assert [r[0] for r in df.where(D.abolished(F.col("title"), F.col("remark"), F.col("documents"))).select("entry_id").collect()] == [2, 3]
    assert D.as_filters({"a": [1], "b": "x", "date_range": {}, "c": None}) == [{"field": "a", "op": "in", "value": [1]}, {"field": "b", "op": "=", "value": "x"}]
