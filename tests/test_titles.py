"""Inexact titles against the loop over all of them."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from loomery.functions.text import fold
from loomery.operators import titles as T
from loomery.plans import title_queries

COMMON = "关于进一步做好支付结算管理工作的通知"
RARE = [chr(0x4E00 + 37 * i) for i in range(500)]


def plain_matches(title, keys, cutoff=0.75):
    q = fold(title)
    if not q:
        return None, []
    if q in keys:
        return "exact", [q]
    partial = [k for k in keys if q in k or k in q]
    if partial:
        return "partial", partial
    return "close", difflib.get_close_matches(q, list(keys), n=1, cutoff=cutoff)


def check(spark, requests, entries, cutoff=0.75):
    keys = {}
    for entry, title, ordinal in sorted(entries, key=lambda e: e[2]):
        if fold(title):
            keys.setdefault(fold(title), []).append(entry)
    want = []
    for ref, title in requests:
        kind, found = plain_matches(title, keys, cutoff)
        want += [(ref, kind, i, entry) for i, entry in enumerate(e for k in keys if k in found for e in keys[k])]
    r = spark.createDataFrame(requests, "ref long, title string").repartition(3)
    e = spark.createDataFrame(entries, "entry long, title string, ordinal long").repartition(4)
    got = {}
    for x in sorted(T.title_matches(r, e, cutoff).collect(), key=lambda x: (x["ref"], x["place"])):
        got.setdefault(x["ref"], []).append((x["kind"], x["entry"]))
    assert sorted(want) == sorted((ref, k, i, e) for ref, found in got.items() for i, (k, e) in enumerate(found))
    return want


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("cutoff", [0.75, 0.5])
def test_the_cascade_equals_the_loop(spark, seed, cutoff):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice(RARE[:60] + list("的通知（2023）")) for _ in range(n))
    entries = [(i, rng.choice(["", COMMON[:6], "中国人民银行"]) + word(rng.randrange(1, 14)), i) for i in range(120)]
    entries += [(200, entries[3][1], 500), (201, entries[3][1], 2), (202, "", 3), (203, None, 4), (204, "　 ", 5), (205, "知", 6), (206, COMMON * 5 + word(3), 7), (207, "A😀b" * 9, 8), (208, "ab" * 300, 9)]
    requests = [(1, None), (2, ""), (3, " 　"), (4, "完全没有" + "龘"), (5, COMMON * 5 + "尾"), (6, "A😀c" * 9), (7, "ba" * 290 + "zz"), (8, "通"), (9, entries[3][1]), (10, entries[3][1])]
    for i in range(80):
        t = list(rng.choice(entries[:120])[1])
        for _ in range(rng.randrange(0, 4)):
            at = rng.randrange(len(t) + 1)
            t[at : at + rng.randrange(2)] = [rng.choice(RARE[:60])] * rng.randrange(2)
        requests.append((100 + i, "".join(t)))
        if rng.random() < 0.2:
            requests.append((300 + i, "".join(t) + word(3)))
    kinds = {k for _, k, *_ in check(spark, requests, entries, cutoff)}
    assert kinds == {"exact", "partial", "close"}


def test_few_candidates_among_many_titles_that_share_words(spark):
    rng = random.Random(1)
    titles = sorted({COMMON[: rng.randrange(4, 9)] + "".join(rng.choice(RARE) for _ in range(8)) + "的通知" for _ in range(10_000)})
    asked = [t[:-5] + rng.choice(RARE) + t[-4:] for t in titles[::200]]
    df, q = spark.createDataFrame([(t,) for t in titles], "title string"), spark.createDataFrame([(t,) for t in asked], "query string")
    candidates = T.close_candidates(q, df, 0.75).count()
    assert candidates < 0.02 * len(titles) * len(asked)
    got = {r["query"]: (r["title"], r["ratio"]) for r in T.closest(q, df).collect()}
    for t in asked[:12]:
        best = difflib.get_close_matches(t, titles, n=1, cutoff=0.75)
        assert [got[t][0]] == best and got[t][1] == pytest.approx(difflib.SequenceMatcher(None, best[0], t).ratio())


def test_containment_meets_few_texts(spark):
    texts = [f"{COMMON}{RARE[i % 500]}{RARE[(i * 7) % 500]}{i}" for i in range(3000)]
    needles = [t[8:] for t in texts[::100]] + ["没有的", COMMON[:3]]
    n, t = spark.createDataFrame([(x,) for x in needles], "needle string"), spark.createDataFrame([(x,) for x in texts], "text string")
    got = sorted(map(tuple, T.contained(n, t).collect()))
    assert got == sorted((x, y) for x in needles for y in texts if x in y)
    assert T.contained(n.limit(0), t).count() == 0 and T.contained(n, t.limit(0)).count() == 0


def test_query_equals_the_loop(spark):
    data = "/root/testdata/sf0.001"
    entries, requests = title_queries.titles_and_requests(spark, data)
    e, r = [tuple(x) for x in entries.collect()], [tuple(x) for x in requests.collect()]
    keys = {}
    for entry, title, _ in sorted(e, key=lambda x: x[2]):
        if fold(title):
            keys.setdefault(fold(title), []).append(entry)
    want = set()
    for ref, title in r:
        kind, found = plain_matches(title, keys)
        want |= {(ref, kind, x) for k in found for x in keys[k]}
    got = title_queries.title_cascade(spark, data).collect()
    assert len(got) == len(want) and {tuple(x) for x in got} == want and {k for _, k, _ in want} == {"exact", "partial", "close"}


TITLE = "中国人民银行公告〔2023〕第3号 关于测试"
BODY = "中国人民银行关于加强银行卡收单业务外包管理的通知\n第三条 第一款 收单机构应当开展外包管理：\n（一）建立制度。\n（二）落实风险评估机制。\n第二款 外包合作应当依法合规。"


def test_clauses_by_title(spark):
    entries = spark.createDataFrame([(1, TITLE, 1), (2, TITLE, 2), (3, "部门规章 金融控股公司监督管理办法", 3), (4, "零散制度示例政策", 4)], "entry long, title string, ordinal long")
    docs = spark.createDataFrame(
        [(1, 0, "text", "a.txt", BODY), (1, 1, "html", "a.html", "第三条 网页"), (1, 2, None, "a.pdf", "第三条 附件\n第五条 只在附件"), (3, 0, "pdf", "c.pdf", None), (2, 0, "text", "b.txt", "第九条 后来的")],
        "entry long, at int, type string, path string, text string",
    )
    asked = [
        (1, TITLE, "第三条，第二款"), (2, "公告[2023]第3号 关于测试", "第三条（二）"), (3, "中国人民银行公告〔2022〕第3号 关于测验", "第三条"), (4, TITLE, "第五条"), (5, TITLE, "第九条"),
        (6, "金融控股公司", "第一条"), (7, "零散制度示例政策", "第一条"), (8, "", "第一条"), (9, TITLE, "附件"), (10, "没有这个", "第一条"), (11, TITLE, "第三条，第七款"), (12, " ", "第一条"), (13, None, "第一条"),
    ]
    got = {r["ref"]: r for r in T.clauses_by_title(spark.createDataFrame(asked, "ref long, title string, clause string"), entries, docs).collect()}
    assert [got[i]["error"] for i in range(1, 14)] == [None, None, None, None, "article_not_found", "document_unavailable", "document_unavailable", "missing_title", "invalid_clause_reference", "policy_not_found", "paragraph_not_found", "policy_not_found", "missing_title"]
    assert [got[i]["kind"] for i in (1, 2, 3, 6, 10)] == ["exact", "partial", "close", "partial", None]
    assert got[1]["paragraph_text"] == "第二款 外包合作应当依法合规。" and got[2]["item_text"].startswith("（二）落实") and got[1]["entry"] == 1
    assert (got[1]["path"], got[4]["path"], got[4]["article_text"]) == ("a.txt", "a.pdf", "第五条 只在附件")


def test_text_paths(spark):
    kind = "entry long, title string, ordinal long, text_path string, documents array<struct<type:string,local_path:string>>"
    entries = spark.createDataFrame([(1, TITLE, 1, "gone.txt", [("html", "a.html"), ("text", "there")]), (2, TITLE, 2, "b.txt", None), (3, "另一个", 3, None, [(None, "c.MD")]), (4, "第三个", 4, None, None)], kind)
    files = spark.createDataFrame([("there",), ("b.txt",), ("c.MD",), ("a.html",)], "path string")
    asked = spark.createDataFrame([(1, TITLE), (2, "另一"), (3, "第三个"), (4, "没有")], "ref long, title string")
    assert sorted(map(tuple, T.text_paths(asked, entries, files).collect())) == [(1, "there"), (2, "c.MD")]
