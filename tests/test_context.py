"""Paragraphs of paged texts against a line-by-line loop; provisions and citations against loops."""

import random
import re

import pytest

from loomery.operators import articles as A
from loomery.operators import context as X
from loomery.operators import pdftext as P

LAW = "前言\n第一章 总则\n第一条 为了规范…。\n第二条 本法所称支付，是指…；但另有规定的除外。\n第二章 罚则\n第三条 依照第一条规定处罚。"


def loop(text):
    """A document, a line at a time."""
    pages = text.split("\f")
    top, bottom = {}, {}
    for page in pages:
        lines = [x.strip() for x in page.split("\n") if x.strip()]
        for part, count in ((lines[:3], top), (lines[-3:], bottom)):
            for line in part:
                if len(line) <= 60:
                    count[line] = count.get(line, 0) + 1
    running = {x for c in (top, bottom) for x, n in c.items() if n >= 2}
    out, now, blank = [], [], False

    def alnum(c):
        return c.isalnum() and not ("㐀" <= c <= "䶿" or "一" <= c <= "鿿")

    def flush():
        text = now[0] if now else ""
        for line in now[1:]:
            if text.endswith("-") and line[0].isalpha():
                text = text.rstrip("-") + line
            else:
                text += (" " if alnum(text[-1]) and alnum(line[0]) else "") + line
        if text:
            out.append(text)
        now.clear()

    for page in pages:
        for line in (x.strip() for x in page.split("\n")):
            if not line:
                blank = bool(now) or blank
            elif line in running or any(re.match(p, line) for p in P.PAGE_NUMBERS):
                continue
            else:
                if blank and now and (now[-1][-1] in P.ENDS or len(now[-1]) <= 20 and not set(now[-1]) & set(P.NOT_IN_HEADINGS)):
                    flush()
                blank = False
                now.append(line)
    flush()
    return "\n".join(out)


def test_paragraphs_equal_the_loop(spark):
    rng = random.Random(5)
    words = ["Header", "word", "wrap-", "---", "中文行", "结束。", "end.", "第 3 页", "- 4 -", "3/9", "Page 2 / 3", "a long line of text that is no heading at all", "（括号）", "12", "", "", " ", "é", "x)"]
    texts = ["\f".join("\n".join(rng.choice(words) for _ in range(rng.randrange(0, 12))) for _ in range(rng.randrange(1, 5))) for _ in range(120)]
    texts += ["Page Header\n\nParagraph line one\nline two\n\nPage Footer\n- 1 -\n\fPage Header\n\n第二段第一行\n继续内容\n\nPage Footer\n", "", None, "\f\f", "x" * 300 + "\n" + "y" * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["text"] for r in P.paragraphs(df).collect()}
    assert got == {i: loop(t or "") for i, t in enumerate(texts)}
    # the heading-like line before a blank ends its paragraph, as do sentence ends
    assert got[120].splitlines()[-1] == "第二段第一行继续内容" and "Header" not in got[120]


def plain_context(sections, whole, request):
    """The context of one request by hand; sections are (id, no, text)."""
    most = request.get("max_length", 2000)
    out, seen, used = [], set(), 0
    hit = next((i for i, s in enumerate(sections) if s[0] == request["article_id"]), 0)
    todo = [("target", sections[hit])]
    if request.get("include_neighbors", True):
        r = max(1, request.get("neighbor_range", 1))
        todo += [("neighbor", s) for i, s in enumerate(sections) if i != hit and abs(i - hit) <= r]
    for role, (needles, name) in X.ROLES.items():
        if not request.get(f"include_{role}s", True):
            continue
        said = lambda t: next((s.strip() for s in re.split(r"[。；;]\s*", t) if any(n in s for n in needles)), None)
        article = next((s for s in sections if said(s[2])), None)
        if article:
            todo.append((role, article))
        elif said(whole):
            todo.append((role, (request["article_id"], name, said(whole))))
    for role, (aid, no, text) in todo:
        if (aid, role) in seen:
            continue
        if most > 0:
            text = text[:most]
            if used >= most:
                continue
            text = text[: most - used]
        seen.add((aid, role))
        used += len(text)
        out.append((role, aid, no, text))
    return out


def test_roles_within_one_budget(spark):
    docs = {"d": LAW, "e": "没有条文，但有例外。依照第三方意见。", "f": "第一条 甲。第二条 乙，依照第一条。第三条 丙。"}
    df = spark.createDataFrame(list(docs.items()), "doc_id string, text string")
    sections = {}
    for r in A.split_articles(df).orderBy("doc_id", "index").collect():
        sections.setdefault(r["doc_id"], []).append((r["article_id"], r["article_no"], r["text"]))
    rng = random.Random(2)
    asked = []
    for ref in range(60):
        d = rng.choice(list(docs))
        request = {"article_id": f"{d}-article-{rng.randrange(1, 7)}"}
        for name, values in (("max_length", [5, 20, 40, 0, 300]), ("neighbor_range", [0, 1, 2]), ("include_neighbors", [True, False]), ("include_definitions", [True, False]), ("include_exceptions", [True, False]), ("include_references", [True, False])):
            if rng.random() < 0.5:
                request[name] = rng.choice(values)
        asked.append((ref, d, request))
    names = ["article_id", "include_neighbors", "neighbor_range", "include_definitions", "include_exceptions", "include_references", "max_length"]
    kind = "ref int, doc_id string, article_id string, include_neighbors boolean, neighbor_range int, include_definitions boolean, include_exceptions boolean, include_references boolean, max_length int"
    requests = spark.createDataFrame([(ref, d, *[q.get(n) for n in names]) for ref, d, q in asked] + [(99, "gone", "x", *[None] * 6)], kind)
    got = {}
    for r in X.provisions(df, requests).orderBy("ref", "place").collect():
        got.setdefault(r["ref"], []).append((r["role"], r["article_id"], r["article_no"], r["text"]))
    want = {ref: plain_context(sections[d], docs[d], q) for ref, d, q in asked}
    assert got == {k: v for k, v in want.items() if v}
    assert {role for found in got.values() for role, *_ in found} == {"target", "neighbor", "definition", "exception", "reference"}
    assert any(no == "引用相关" for found in got.values() for _, _, no, _ in found)


def test_citations_and_what_they_cite(spark):
    text = LAW + "\n第四条 违反第三条、第二条的，依照第九条处理。\n第五条 根据第四条。"
    a = A.split_articles(spark.createDataFrame([("d", text), ("e", "没有")], "doc_id string, text string"))
    rows = {r["index"]: r for r in a.where("doc_id = 'd'").collect()}
    number = {i: r["article_no"] for i, r in rows.items()}
    cites = [(number[r["index"]], r["cited"] is not None and number[r["cited"]], r["number"]) for r in X.citations(a).collect()]
    assert sorted(cites, key=str) == sorted([("第三条", "第一条", 1), ("第四条", "第三条", 3), ("第四条", "第二条", 2), ("第四条", False, 9), ("第五条", "第四条", 4)], key=str)
    five = next(i for i, no in number.items() if no == "第五条")
    targets = spark.createDataFrame([(1, "d", five)], "ref int, doc_id string, index int")
    got = sorted((r["distance"], number[r["index"]]) for r in X.cited_articles(a, targets, 3).collect())
    assert got == [(1, "第四条"), (2, "第三条"), (2, "第二条"), (3, "第一条")]
    within = X.with_citations(a, targets, 3, 20).orderBy("distance").collect()
    assert [r["role"] for r in within][:1] == ["target"] and sum(len(r["text"]) for r in within) == 20


@pytest.mark.parametrize("n", [1])
def test_one_document_with_nearly_all_articles(spark, n):
    """Roles are found per document; many requests for one document don't multiply its articles."""
    text = "".join(f"第{i}条 内容{i}。" for i in range(1, 400)) + "第400条 本法所称内容，是指文字。"
    docs = spark.createDataFrame([("d", text)], "doc_id string, text string")
    asked = spark.range(3000).selectExpr("id as ref", "'d' as doc_id", "concat('d-article-', id % 400 + 1) as article_id")
    rows = X.provisions(docs, asked)
    counts = {r["role"]: r["count"] for r in rows.groupBy("role").count().collect()}
    assert counts["target"] == 3000 and counts["definition"] == 3000 and counts["neighbor"] == 6000 - 15
