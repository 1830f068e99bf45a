import json

from loomery.sources import readers, sinks


def test_entries(spark, tmp_path):
    flat = {"serial": 3, "title": "甲", "remark": None, "documents": [{"url": "u", "type": "PDF", "title": "t", "localPath": "x.pdf"}]}
    wrapped = {"entry": {"serial": 1, "title": "乙", "documents": []}, "text_path": "y.txt"}
    (tmp_path / "some-Task_state.json").write_text(json.dumps({"entries": [flat, wrapped, {"title": "丙"}]}, ensure_ascii=False))
    got = readers.entries(spark, str(tmp_path)).orderBy("ordinal").collect()
    assert [r["entry_id"] for r in got] == ["some_task:3", "some_task:1", "some_task:3"]
    assert got[0]["documents"][0]["local_path"] == "x.pdf" and got[1]["documents"][0]["local_path"] == "y.txt" and got[2]["documents"] == []


def test_texts_and_decoding(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for name, data in (("a/1.txt", "正文".encode()), ("2.txt", "正文".encode("gb18030")), ("3.txt", "正文".encode("utf-16")), ("4.md", b"no")):
        (tmp_path / name).write_bytes(data)
    assert [r["text"] for r in readers.texts(spark, str(tmp_path)).collect()] == ["正文"] * 3


def test_traces_and_embeddings(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"trace_id": "a", "seq": 1, "ts": 5, "event": "trace_start", "payload": {"x": 1}}\nnot json\n')
    got = readers.traces(spark, f"{tmp_path}/t.jsonl").collect()
    assert [(r["event"], r["raw"]) for r in got] == [("trace_start", None), ("parse_error", "not json")]
    (tmp_path / "e.jsonl").write_text('{"id": "a", "hash": "h", "vector": [0.0, 1.0]}\n{"id": "b", "hash": "h", "vector": [0.0, 0.0]}\n{"id": "c", "hash": "h", "vector": [1.0]}\n')
    assert [r["id"] for r in readers.embeddings(spark, f"{tmp_path}/e.jsonl").collect()] == ["a"]


def test_whitelist_names_and_sink(spark, tmp_path):
    assert readers.whitelist('{"policy_ids": ["a:1"], "policies": ["t", {"title": "u", "id": "b:2"}]}') == (["a:1", "b:2"], ["t", "u"])
    df = spark.createDataFrame([("x.pdf", 1), ("x.pdf", 2), ("y", 3)], "name string, i int")
    assert sorted(r["name"] for r in sinks.unique_names(df, "name", "i").collect()) == ["x.pdf", "x_2.pdf", "y"]
    rows = spark.createDataFrame([("t1", 2, "b"), ("t1", None, "a"), ("t2", 1, "c")], "task string, serial int, title string")
    sinks.write_by_task(rows, f"{tmp_path}/s")
    assert spark.read.parquet(f"{tmp_path}/s").count() == 3


def test_old_states_and_caches(spark, tmp_path):
    import json

    (tmp_path / "old").mkdir()
    (tmp_path / "old" / "a.json").write_text(json.dumps(["http://x/a.pdf", {"url": "http://x/b", "name": "乙"}, {"url": "http://x/c.doc", "name": "乙"}, {"name": "no url"}]))
    (tmp_path / "old" / "b.json").write_text(json.dumps({"http://x/d.pdf": "丁", "http://x/e": None}))
    got = sorted((r["title"], r["entry_id"], [(d["url"], d["type"], d["title"]) for d in r["documents"]]) for r in readers.legacy_entries(spark, str(tmp_path / "old")).collect())
    assert got == [
        ("", None, [("http://x/a.pdf", "pdf", "http://x/a.pdf")]),
        ("", None, [("http://x/e", "html", "http://x/e")]),
        ("丁", "title::丁", [("http://x/d.pdf", "pdf", "丁")]),
        ("乙", "title::乙", [("http://x/b", "html", "乙"), ("http://x/c.doc", "word", "乙")]),
    ]
    (tmp_path / "u").mkdir()
    (tmp_path / "u" / "t_uniq_state.json").write_text(json.dumps({"entries": [], "meta": {"dedupe": {"task": "t", "source_state_file": "t.json", "unique_entry_count": 3, "generated_at": "x"}}}))
    (tmp_path / "u" / "s_uniq_state.json").write_text(json.dumps({"entries": []}))
    assert [(r["task"], r["unique"], r["generated_at"]) for r in readers.unique_states(spark, str(tmp_path / "u")).collect()] == [("t", 3, None)]
    for name, text in (("items", json.dumps({"items": {"a": {"hash": "h", "vector": [1, 2]}, "b": {"vector": [0, 0]}}})), ("map", json.dumps({"a": {"hash": "h", "vector": [1, 2]}})), ("lines", '{"article_id": "a", "hash": "h", "vector": [1, 2]}\n{"article_id": "b", "vector": [1]}\nbroken\n')):
        (tmp_path / f"{name}.json").write_text(text)
        assert [(r["id"], r["hash"], r["vector"]) for r in readers.embeddings(spark, str(tmp_path / f"{name}.json")).collect()] == [("a", "h", [1.0, 2.0])], name
