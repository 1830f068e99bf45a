"""Nodes of nested JSON, white lists and paths against recursive loops."""

import json
import random

from pyspark.sql import functions as F

from loomery.functions.text import fold
from loomery.operators import nested as N
from loomery.sources import readers


def tree(rng, depth):
    if depth == 0 or rng.random() < 0.2:
        return rng.choice(["x", " spaced ", "", None, 3, True, "支付结算管理办法"])
    if rng.random() < 0.4:
        return [tree(rng, depth - 1) for _ in range(rng.randrange(4))]
    keys = ["title", "id", "document_id", "summary", "policies", "entries", "ids", "policy_titles", "other", "children"]
    return {k: rng.choice(["t1", "t2", " t3", "", 7, None, False]) if k in keys[:4] and rng.random() < 0.8 else tree(rng, depth - 1) for k in rng.sample(keys, rng.randrange(1, 6))}


def plain_nodes(x, found):
    if isinstance(x, dict):
        if isinstance(x.get("title"), str):
            i = x.get("id") or x.get("document_id")
            s = x.get("summary")
            key = (x["title"], i.strip() if isinstance(i, str) and i.strip() else None, s.strip() if isinstance(s, str) and s.strip() else None)
            found.setdefault(key)
        for k in sorted(x):
            plain_nodes(x[k], found)
    elif isinstance(x, list):
        for y in x:
            plain_nodes(y, found)
    return found


def plain_names(x, ids, titles):
    if isinstance(x, str):
        if x.strip():
            ids.add(x.strip())
            titles.add(fold(x))
    elif isinstance(x, list):
        for y in x:
            plain_names(y, ids, titles)
    elif isinstance(x, dict):
        if isinstance(x.get("id"), str) and x["id"].strip():
            ids.add(x["id"].strip())
        if isinstance(x.get("title"), str) and x["title"].strip():
            titles.add(fold(x["title"]))
        for k in N.WHITELIST_KEYS:
            if k in x:
                plain_names(x[k], ids, titles)
    return ids, titles


def test_nodes_and_names_equal_the_recursion(spark):
    rng = random.Random(11)
    trees = [tree(rng, 6) for _ in range(60)] + [{"policy_titles": ["（甲）", {"id": "9", "title": "乙", "x": {"title": "no"}}]}, [], "alone", 5]
    deep = "z"
    for _ in range(70):
        deep = {"title": "deep", "children": [deep]} if rng.random() < 0.5 else [deep]
    df = spark.createDataFrame([(i, json.dumps(t)) for i, t in enumerate([*trees, deep])] + [(900, "no json {"), (901, None)], "id long, json string")
    got = {}
    for r in sorted(N.catalogue_nodes(df).collect(), key=lambda r: (r["id"], r["place"])):
        got.setdefault(r["id"], []).append((r["title"], r["node_id"], r["summary"]))
    want = {i: list(plain_nodes(t, {})) for i, t in enumerate([*trees, deep])}
    assert got == {i: w for i, w in want.items() if w} and got[len(trees)] == [("deep", None, None)]
    ids, titles = set(), set()
    for t in trees:
        plain_names(t, ids, titles)
    names = {(r["kind"], r["name"]) for r in N.whitelist_names(df.where(f"id < {len(trees)}")).collect()}
    assert names == {("id", i) for i in ids} | {("title", t) for t in titles if t}


def test_white_list_follows_duplicates(spark):
    kind = "entry long, id string, title string, duplicates array<struct<id:string,title:string>>"
    rows = [(1, "a:1", "全名支付结算管理办法", None), (2, "a:2", "其他", [("b:9", "x")]), (3, "a:3", "其他", [(None, "关于（甲）的事")]), (4, "a:4", "短名", []), (5, "a:5", "含短名的", None), (6, None, None, [(None, None)]), (7, "ID", "x", None)]
    names = spark.createDataFrame([("title", fold(t)) for t in ("支付结算管理办法", "短名", "关于(甲)的事")] + [("id", "b:9"), ("id", "ID"), ("id", None)], "kind string, name string")
    got = N.whitelisted_entries(spark.createDataFrame(rows, kind), names)
    assert sorted(r["entry"] for r in got.collect()) == [1, 2, 3, 4, 7] and got.columns == ["entry", "id", "title", "duplicates"]
    assert N.whitelisted_entries(spark.createDataFrame(rows, kind), names.limit(0)).count() == 0


def test_paths_of_the_state_schema_there_and_back(spark, tmp_path):
    state = {"task": "t", "entries": [{"serial": 1, "title": "a", "text_path": "texts/a.txt", "documents": [{"url": "http://x/p", "local_path": "downloads/a.pdf"}, {"url": "path", "path": ""}, {"url": None}]}, {"serial": 2, "entry": {"title": "b", "documents": [{"localPath": "kept", "local_path": "/else/b"}]}}, {"serial": 3, "documents": None}], "meta": {"state_file": "s.json", "note": "texts/n"}}
    (tmp_path / "t_state.json").write_text(json.dumps(state), "utf-8")
    rows = spark.read.schema(readers.STATE).json(str(tmp_path), multiLine=True)
    whole = N.absolute_paths(rows, "/data/root/")
    first = whole.first()
    assert first["entries"][0]["text_path"] == "/data/root/texts/a.txt" and first["entries"][0]["documents"][0]["local_path"] == "/data/root/downloads/a.pdf"
    assert first["entries"][0]["documents"][1]["path"] == "" and first["entries"][0]["documents"][0]["url"] == "http://x/p" and first["entries"][2]["documents"] is None
    assert first["entries"][1]["entry"]["documents"][0]["local_path"] == "/else/b" and first["entries"][1]["entry"]["documents"][0]["localPath"] == "kept"
    assert first["meta"] == {"state_file": "/data/root/s.json", "note": "texts/n"} and whole.schema == rows.schema
    back = N.relative_paths(whole, "/data/root")
    assert back.schema == rows.schema and back.collect() == rows.collect()
    odd = spark.createDataFrame([("/data/root/a/../b//c",), ("/data/rootless/x",), ("/data/root/../other",), ("rel",), (None,), ("/data/root",)], "path string")
    assert [r[0] for r in N.relative_paths(odd, "/data/root").collect()] == ["b/c", "/data/rootless/x", "/data/root/../other", "rel", None, "."]
    assert N.rewritten(odd.withColumn("n", F.lit(1)), ("none",), F.upper).columns == ["path", "n"]
