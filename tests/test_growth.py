"""Work that grows no faster than its rows, and results that don't hang on the order of rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from loomery.operators import clauses as K
from loomery.operators import elements as EL
from loomery.operators import extraction as E
from loomery.operators import listings as L
from loomery.operators import titles as T
from loomery.plans import page_queries
from loomery.plans.search_queries import _rounded
from loomery.streaming import entries as S


def joined_rows(df):
    """The most rows that a join of the plan, as it ran, has made."""
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        if p.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        elif p.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(p.plan())
        if "Join" in p.nodeName() and p.metrics().contains("numOutputRows"):
            most = max(most, p.metrics().apply("numOutputRows").value())
        kids = p.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    return most


def test_a_question_meets_the_lines_of_its_article(spark):
    text = "\n".join(f"第{i}条 甲\n第一款 乙" for i in range(1, 101))
    docs = spark.createDataFrame([("d", text)], "doc_id string, text string")
    asked = spark.createDataFrame([(i, "d", f"第{i}条") for i in range(1, 101)], "ref long, doc_id string, clause string")
    found = K.find_clauses(docs, asked)
    assert [r["article_text"] for r in sorted(found.collect(), key=lambda r: r["ref"])] == [f"第{i}条 甲\n第一款 乙" for i in range(1, 101)]
    assert joined_rows(found) <= 400  # 20,000 lines times questions before


def test_a_heading_with_spaces_in_its_number_ends_no_article(spark):
    docs = spark.createDataFrame([("d", "第一条 甲\n第 二 十 条 乙\n丙\n第三条 丁\n特此公告。\n戊")], "doc_id string, text string")
    asked = spark.createDataFrame([(1, "d", "第一条"), (2, "d", "第二十条"), (3, "d", "第三条")], "ref long, doc_id string, clause string")
    got = {r["ref"]: r["article_text"] for r in K.find_clauses(docs, asked).collect()}
    assert got == {1: "第一条 甲\n第 二 十 条 乙\n丙", 2: "第 二 十 条 乙\n丙", 3: "第三条 丁"}


def test_numbered_titles_meet_few_others(spark):
    numbers = range(100_000, 102_000)
    needles = spark.createDataFrame([(f"客户{i}号管理条例",) for i in numbers], "needle string")
    texts = spark.createDataFrame([(f"客户{i}号管理条例 附则",) for i in numbers], "text string")
    found = T.contained(needles, texts)
    assert {(r["needle"], r["text"]) for r in found.collect()} == {(f"客户{i}号管理条例", f"客户{i}号管理条例 附则") for i in numbers}
    assert joined_rows(found) <= 10_000


def test_plans_of_clauses_by_title_stay_small(spark):
    entries = spark.createDataFrame([(i, f"客户{i}号管理条例", i) for i in range(20)], "entry long, title string, ordinal long")
    docs = spark.createDataFrame([(i, 0, "text", "a.txt", "第一条 甲\n第一款 （一）乙（二）丙") for i in range(20)], "entry long, at int, type string, path string, text string")
    asked = spark.createDataFrame([(1, "客户1号管理条例", "第一条，第一款（二）"), (2, "客户2号管理条例 附则", "第一条"), (3, "客户3号治理条例", "第一条")], "ref long, title string, clause string")
    found = T.clauses_by_title(asked, entries, docs)
    assert {r["ref"]: (r["entry"], r["kind"], r["item_text"], r["error"]) for r in found.collect()} == {1: (1, "exact", "（二）丙", None), 2: (2, "partial", None, None), 3: (3, "close", None, None)}
    size = len(found._jdf.queryExecution().optimizedPlan().toString())
    assert size < 80_000, size  # each stage that ends writes the plan for the driver's listeners


def test_questions_of_clauses_are_not_broadcast(spark):
    entries = spark.createDataFrame([(1, "甲条例", 1)], "entry long, title string, ordinal long")
    docs = spark.createDataFrame([(1, 0, "text", "a.txt", "第一条 甲")], "entry long, at int, type string, path string, text string")
    asked = spark.createDataFrame([(1, "甲条例", "第一条")], "ref long, title string, clause string")
    found = T.clauses_by_title(asked.repartition(4), entries, docs)
    assert [r["article_text"] for r in found.collect()] == ["第一条 甲"]
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_titles_are_compared_only_if_a_request_needs_it(spark, monkeypatch):
    monkeypatch.setattr(T, "closest", lambda *_: pytest.fail("all titles are looked through for no request"))
    entries = spark.createDataFrame([(1, "甲条例", 1), (2, "乙条例", 2)], "entry long, title string, ordinal long")
    asked = spark.createDataFrame([(1, "甲条例"), (2, "乙条例 附则")], "ref long, title string")
    assert {(r["ref"], r["kind"], r["entry"]) for r in T.first_match(asked, entries).collect()} == {(1, "exact", 1), (2, "partial", 2)}


def test_elements_of_a_page_grow_with_it(spark):
    row = "<tr><td>{0}</td><td><a href='{0}.html'>甲乙丙丁{0}</a></td><td><a href='{0}.doc'>下载</a></td></tr>"
    pages = spark.createDataFrame([(n, "http://h/l/i.html", "<table>" + "".join(row.format(i) for i in range(n)) + "</table>") for n in (300, 600)], "page_id long, url string, html string")
    size = {r["page_id"]: r["n"] for r in EL.parsed(pages).select("page_id", F.length(F.to_json(F.struct("els"))).alias("n")).collect()}
    assert size[600] < 2.2 * size[300]  # nearly four times before


def test_a_long_text_before_a_link_is_as_tidy_as_all_of_it(spark):
    texts = ["甲乙 " * 1000, "下载word版 " * 300 + "甲", "甲" * 100 + "-" * 3000, "甲" * 100 + "-" * 3000 + "pdf下载", "甲" * 240 + "下载 wps" * 200, "：  甲" * 700, "附件 下载" * 900, "乙" * 1500 + "\x1c丙", "a\x1cb", "甲" * 199 + " 乙" * 600, " ", "pdf"]
    rows = [(i, [t[j : j + n] for j in range(0, len(t), n)]) for i, t in enumerate(texts) for n in (3, 500)]
    part = F.struct(F.lit(None).cast("string").alias("text"), F.lit(0).alias("a"), F.size("texts").alias("b"), F.lit(True).alias("above"))
    full = L._tidy(F.translate(F.array_join("texts", " "), "\x1c", " "))
    got = spark.createDataFrame(rows, "i long, texts array<string>").select("i", L._tidy_part(part).alias("part"), full.alias("full")).collect()
    assert len(got) == len(rows) and all(r["part"] == r["full"] for r in got), [r for r in got if r["part"] != r["full"]]


def test_nothing_is_sliced_from_all_elements_of_a_page(spark):
    shown = [str(x) for x in (L.table_entries(), L.list_entries(), L.card_entries(), L.label(F.col("a")))]
    assert not any("slice(els" in x or "slice(texts" in x for x in shown)


def test_pages_of_listings_are_not_put_into_one_task(spark):
    assert page_queries.listing_layouts(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_items_are_found_once(spark):
    assert str(L._once(F.col("xyz"), lambda x: x["k"])).count("xyz") == 1
    rows = spark.sql("select array(struct('b' as k, 1 as v), struct('a' as k, 2 as v), struct('b' as k, 3 as v), struct(null as k, 4 as v)) as xyz")
    assert [x["v"] for x in rows.select(L._once(F.col("xyz"), lambda x: x["k"]).alias("o")).first()["o"]] == [1, 2]


@pytest.mark.parametrize("always", [False, True])
def test_a_batch_of_snapshots_is_no_stream(spark, always):
    rng = random.Random(5)
    rows, want = [], []
    for task in ("t", "u", None):
        last = set()
        for snapshot in range(12):
            now = set(last) if rng.random() < 0.3 else {f"e{i}" for i in range(8) if rng.random() < 0.5}
            rows += [(task, snapshot, e) for e in now] * 2 + [(task, snapshot, None)]
            if snapshot < 11 and (len(now) != len(last) or (always and now != last)):
                want.append((task or "", snapshot, len(now), len(now) - len(last), sorted(now - last), sorted(last - now)))
                last = now
    rng.shuffle(rows)
    out = S.snapshot_history(spark.createDataFrame(rows, "task string, snapshot long, entry_id string"), always)
    assert sorted((r[0] or "", *r[1:]) for r in out.collect()) == sorted(want)
    assert "TransformWithState" not in out._jdf.queryExecution().toString()


def test_sorted_runs():
    rows = [(random.Random(i).randrange(50), str(i)) for i in range(1000)]
    assert list(S.in_order(iter(rows), lambda r: r, held=64)) == sorted(rows)
    assert list(S.in_order(iter(rows[:5]), lambda r: r)) == sorted(rows[:5])


def test_equal_ranks_have_one_answer(spark):
    rows = [(1, 7, "html", "", "failed", False), (1, 7, "pdf", "", None, True), (1, 7, "html", "", None, False)]
    entries = spark.createDataFrame([(1,)], "entry_id long")
    schema = "entry_id long, rank long, type string, text string, error string, requires_ocr boolean"
    turned = [rows[i:] + rows[:i] for i in range(3)]
    assert {E.statuses(entries, spark.createDataFrame(r, schema).coalesce(1)).first()["status"] for r in turned} == {"needs_ocr"}


def test_rounding_keeps_the_sign_of_zero(spark):
    values = [-0.000001, 0.000004, -0.000005, 1.234565, 1e300, float("nan"), None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").select(_rounded(F.col("x"), 5)).collect()]
    assert math.copysign(1, got[0]) == -1 and got[:3] == [0, 0, -0.00001] and got[3] == round(1.234565 * 1e5) / 1e5 and got[4] == 1e300 and math.isnan(got[5]) and got[6] is None
