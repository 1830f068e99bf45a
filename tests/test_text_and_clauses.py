from datetime import date

import pytest
from pyspark.sql import functions as F

from loomery.functions import clauses as C
from loomery.functions import text as X
from loomery.functions import urls as U
from loomery.operators import clauses as K

LAW = "前言\n第一章 总则\n第一条 为了规范…。\n第二条 本法所称支付，是指…；但另有规定的除外。\n第二章 罚则\n第三条 依照第一条规定处罚。"
BODY = "中国人民银行关于加强银行卡收单业务外包管理的通知\n第三条 第一款 收单机构应当按照下列要求开展外包管理：\n（一）建立健全外包管理制度并明确责任。\n（二）落实风险评估机制。\n第二款 外包合作应当依法合规。"


@pytest.fixture
def one(spark):
    return lambda value, column: spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


def test_numbers(spark):
    cases = [("十", 10), ("一百零五", 105), ("一万二千", 12000), ("12", 12), ("二〇二三", 3), ("十二万", 20010), ("1十", None), ("", None), (None, None), ("二百、五", 205), ("两", 2)]
    df = spark.createDataFrame([(t, i) for i, (t, _) in enumerate(cases)], "t string, i int")
    assert [r[0] for r in df.orderBy("i").select(C.number(F.col("t"))).collect()] == [v for _, v in cases]


def test_numbers_back(spark):
    cases = [(0, "零"), (2, "二"), (10, "十"), (15, "十五"), (105, "一百零五"), (110, "一百一十"), (1010, "一千零一十"), (10005, "一万五"), (100000001, "一亿零一")]
    df = spark.createDataFrame(cases, "n long, t string")
    assert [r[0] for r in df.orderBy("n").select(C.chinese(F.col("n"))).collect()] == [t for _, t in cases]


def test_references(spark):
    cases = {"第八条，第三款": (8, 3, "款", None), "第四点，第五项": (4, None, None, 5), "第三条第一款（二）项": (3, 1, "款", 2), "中国人民银行公告 第三条第一（一）项": (3, None, None, 1), "第三条，第一，第二项": (3, 1, None, 2), "无": None}
    df = spark.createDataFrame([(k,) for k in cases], "k string")
    got = {r["k"]: r["r"] and tuple(r["r"]) for r in df.select("k", C.reference(X.norm_text("k")).alias("r")).collect()}
    assert got == cases


def look_up(spark, text, *clauses):
    docs = spark.createDataFrame([("d", text)], "doc_id string, text string")
    asked = spark.createDataFrame([(i, "d", c) for i, c in enumerate(clauses)], "ref long, doc_id string, clause string")
    return [r for r in K.find_clauses(docs, asked).orderBy("ref").collect()]


def test_slices(spark):
    (r,) = look_up(spark, "前言\n一、第一部分要求\n具体内容A\n二、第二部分要求\n具体内容B\n", "第二条")
    assert r["error"] is None and "第二部分" in r["article_text"] and "第一部分" not in r["article_text"]
    (r,) = look_up(spark, "八、外国银行境内分行参照本通知执行。\n\n本通知自2023年12月20日起实施。", "第八条")
    assert "参照本通知执行" in r["article_text"] and "12月20日" not in r["article_text"]
    second, first, item, none, no_paragraph, no_item, invalid = look_up(spark, BODY, "第三条，第二款", "第三条，第一款", "第三条（二）", "第九条", "第三条，第五款", "第三条（九）", None)
    assert second["paragraph_text"] == "第二款 外包合作应当依法合规。" and second["error"] is None
    # a paragraph is looked for at the starts of lines
    assert "收单机构" in first["paragraph_text"] and first["error"] == "paragraph_not_found"
    assert item["item_text"].startswith("（二）落实风险评估机制。")
    assert [x["error"] for x in (none, no_paragraph, no_item, invalid)] == ["article_not_found", "paragraph_not_found", "item_not_found", "invalid_clause_reference"]


def test_policies(spark):
    policies = spark.createDataFrame([("t", "html", "a.html", "第一条 甲"), ("t", "pdf", "b.pdf", "没有"), ("u", "pdf", "c.pdf", None)], "title string, type string, path string, text string")
    asked = spark.createDataFrame([(1, "t", "第一条"), (2, "t", "第七条"), (3, "v", "第一条"), (4, "u", "第一条"), (5, "", "第一条")], "ref long, title string, clause string")
    got = {r["ref"]: (r["path"], r["error"]) for r in K.find_in_policies(policies, asked).collect()}
    assert got == {1: ("a.html", None), 2: (None, "article_not_found"), 3: (None, "policy_not_found"), 4: (None, "document_unavailable"), 5: (None, "missing_title")}


def test_outline_and_keys(spark):
    docs = spark.createDataFrame([(1, BODY)], "doc_id long, text string")
    assert [(r["level"], r["number"], r["article"], r["paragraph"]) for r in K.outline(docs).orderBy("line").collect()] == [("article", 3, 1, None), ("item", 1, 1, None), ("item", 2, 1, None), ("paragraph", 2, 1, 1)]
    assert [r["level"] for r in K.outline(docs, bracketed_items=False).orderBy("line").collect()] == ["article", "paragraph"]
    keys = {
        "关于测试：第三条，第一款": [("关于测试", "第三条 第一款")],
        "《甲》第三条，第一款，第二款\n《乙》第一条": [("甲", "第三条 第一款"), ("甲", "第三条 第二款"), ("乙", "第一条")],
        "办法第二条": [("办法", "第二条")],
        "": [],
    }
    got = {k: [] for k in keys}
    for r in K.clause_keys(spark.createDataFrame([(k,) for k in keys], "key string")).orderBy("key", "n").collect():
        got[r["key"]].append((r["title"], r["clause"]))
    assert got == keys


def test_features(spark):
    df = spark.createDataFrame([("中国人民银行公告〔2023〕第 3 号　关于测试管理办法（试行）", ""), ("银发（98）12号", "已废止"), (None, None)], "t string, r string")
    n = X.norm_text("t")
    got = df.select(n.alias("n"), "r").select(X.extract_docno(F.col("n")), X.first_keyword(F.col("n")), X.keyword_list(F.col("n")), X.tokenize(F.col("n")), X.is_current(F.col("n"), F.col("r")), X.year_prefix(F.col("n"))).collect()
    assert tuple(got[0])[:3] == ("公告[2023]第3号", "管理办法", "中国人民银行") and got[0][4] and got[0][5] == "20"
    assert got[1][0] == "银发[2098]12号" and not got[1][4]
    assert got[2][0] is None


def test_scalars(spark):
    df = spark.createDataFrame([("a。b关键；c", "2024年2月30日", "x" * 25)], "s string, d string, c string")
    r = df.select(X.find_sentence(F.col("s"), ("关键",)).alias("f"), X.parse_date(F.col("d")).alias("none"), X.parse_date(F.lit("发布 2024-1-9")).alias("day"), F.transform(X.chunks(F.col("c"), 10, 2), F.length).alias("n"), F.size(X.chunks_with_tail(F.col("c"), 10, 2)).alias("m"), X.occurrences(F.lit("aaaa"), "aa").alias("o"), X.similarity(F.lit("abcd"), F.lit("abce")).alias("sim")).first()
    assert (r["f"], r["none"], r["day"], r["n"], r["m"], r["o"], r["sim"]) == ("b关键", None, date(2024, 1, 9), [10, 10, 9], 4, 2, 0.75)


def test_best_path_and_urls(spark):
    docs = [[("html", "a.html"), ("pdf", "b.pdf"), ("PDF", "c.pdf")], [("html", None)], []]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, d array<struct<type:string,local_path:string>>")
    assert [r[0] for r in df.orderBy("i").select(X.best_path(F.col("d"))).collect()] == ["b.pdf", None, None]
    urls = ["http://x/中 文/a.PDF?x=1", "https://x/a.docx#y", "ftp://x/a.zip", "http://x/", "a/b.xyz"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [tuple(r) for r in df.select(U.document_type(F.col("u")), U.downloadable(F.col("u"))).collect()] == [("pdf", True), ("word", True), ("archive", False), ("html", True), ("other", True)]
