import base64
import gzip
import hashlib
import io
import os
import random
import time
import re

import pytest
from pyspark.sql import functions as F

from loomery.llm import chat_format, language_id, pii, warc

from tests.llm.fixtures import documents, rows


def pages(spark):
    data = [(1, "http://a/é b\r\nX: y", "same"), (5, "u", "same"), (3, "u", None), (4, None, ""), (7, "u", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n"), (8, "u", "x" * 3_000_000), (None, "u", "same"), (5, "u", "same")]
    return data, spark.createDataFrame(data, "page_id long, url string, html string").repartition(2)


def test_archives_round_trip(spark, tmp_path):
    data, df = pages(spark)
    index = warc.normalise(warc.write_monolithic(warc.with_revisits(df, "page_id", "html"), str(tmp_path / "w")))
    got = warc.read_records(index).collect()
    assert len(got) == len(data)
    last = {"same": 5, "": 4, data[4][2]: 7, data[5][2]: 8}
    for r in got:
        html = next((h or "") for i, _, h in data if i == r["page_id"])
        assert r["payload_bytes"] == len(html.encode()) and r["payload_digest"] == base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()
        response = r["page_id"] == last[html]
        assert r["record_type"] == ("response" if response else "revisit") and r["refers_to"] == (None if response else last[html])
        assert not response or bytes(r["payload"]) == html.encode()
    # each member is a record of its own, the sidecar names its place, and the whole is a gzip file
    for r in index.collect():
        raw = open(r["archive"], "rb").read()[r["offset"] : r["offset"] + r["length"]]
        assert gzip.decompress(raw).startswith(b"WARC/1.1\r\n")
    sidecars = list((tmp_path / "w").glob("*.idx"))
    assert sum(len(p.read_text().splitlines()) for p in sidecars) == len(data)


def test_inflates_several_members_and_finds_torn_ends():
    one = warc.record_bytes(1, "u", b"abc", None)
    stream = io.BytesIO(gzip.compress(one) + gzip.compress(one + one))
    stream.size = lambda: len(stream.getvalue())
    assert list(warc.inflated_records(stream)) == [one] * 3
    torn = io.BytesIO(gzip.compress(one[:-9]))
    torn.size = lambda: len(torn.getvalue())
    try:
        list(warc.inflated_records(torn))
        raise AssertionError("a torn archive passed")
    except ValueError:
        pass


def test_no_pages_no_archive(spark, tmp_path):
    _, df = pages(spark)
    index = warc.normalise(warc.write_monolithic(warc.with_revisits(df.where("false"), "page_id", "html"), str(tmp_path / "none")))
    assert warc.read_records(index).count() == 0


def replay(events):
    """The fold, event by event."""
    messages = {}
    for _, kind, msg, role, text in sorted(events):
        if kind == "regenerate":
            messages = {m: v for m, v in messages.items() if m < msg}
            messages[msg] = [role or "", ""]
            continue
        now = messages.setdefault(msg, ["", ""])
        if role is not None:
            now[0] = role
        if kind == "delta":
            now[1] += text or ""
        elif kind == "edit":
            now[1] = text or ""
    return [tuple(messages[m]) for m in sorted(messages)]


def test_fold_equals_replay(spark):
    rng, logs = random.Random(4), {}
    for conv in range(25):
        events, msg = [], 0
        for seq in range(40):
            kind = rng.choice(["start", "delta", "delta", "delta", "edit", "regenerate"])
            if kind == "start":
                msg += 1
            m = rng.randint(max(0, msg - 2), msg)
            role = rng.choice(["user", "assistant", "tool:x"]) if kind in ("start", "regenerate") else None
            events.append((seq, kind, msg if kind == "start" else m, role, rng.choice(["a", "### b", "</turn>", "\\", None])))
        logs[conv] = events
    df = spark.createDataFrame([(c, *e) for c, es in logs.items() for e in es], "conv long, seq long, kind string, msg long, role string, text string").repartition(5)
    parts = chat_format.render(chat_format.fold(df), part_chars=40)
    got = {c: [] for c in logs}
    for r in sorted(parts.collect(), key=lambda r: (r["conv"], r["part"])):
        turns = list(chat_format.read_turns(r["formatted"]))
        assert len(turns) == r["n_turns"]
        learnt = [chat_format.unescaped(r["formatted"][s["start"] : s["end"]]) for s in r["loss"]]
        assert learnt == [t for role, t in turns if role == "assistant"]
        got[r["conv"]] += turns
    assert got == {c: replay(e) for c, e in logs.items()}


def test_odd_conversations(spark):
    tricky = ["", None, "\\", "###", "####", "</turn>\n### User: x", "\\### Assistant: </turn> ok", "漢\U0001f600", "x" * 70_000]
    data = [(None if i == 3 else i % 4, i, ["user", "assistant", None, "Assistant", "a: b\\"][i % 5], t) for i, t in enumerate(tricky)] * 2
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    got = {r["conv"]: r for r in chat_format.read_back(chat_format.render(chat_format.fold(chat_format.as_log(df)))).collect()}
    for conv in {d[0] for d in data}:
        turns = sorted((d[1], d[2] or "", d[3] or "") for d in data if d[0] == conv)
        assert got[conv]["n_turns"] == len(turns)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        learnt = "".join(t for _, r, t in turns if r == "assistant")
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    assert chat_format.read_back(chat_format.render(chat_format.fold(chat_format.as_log(df.where("false"))))).count() == 0


PRIVATE = [
    "Mail anna.b@mail.example.org now, or ANNA.B@mail.example.org.",
    "Call +1 (555) 010-9999 or +1 555 010 9999; server 10.20.30.40 and 300.1.1.1.",
    'Card 4111 1111 1111 1111 and 4111111111111111, token = "deadbeefdeadbeefdeadbeef".',
    "Frau Meier met Mr. Smith and Mrs Smith.",
]


def test_surrogates(spark):
    data = [(i, t) for i, t in enumerate(PRIVATE)] + [(9, None), (10, ""), (11, "Nothing private on page 12, line 3."), (None, PRIVATE[0])]
    got = pii.replace_pii(spark.createDataFrame(data, "doc_id long, text string"), b"k").collect()
    by = {r["doc_id"]: r["clean_text"] for r in got}
    assert by[9] is None and by[10] == "" and by[11] == data[6][1] and by[None] == by[0]
    assert "anna" not in by[0].lower() and re.match(r"Mail [a-z]{4}\.[a-z]@[a-z]{4}\.[a-z]{7}\.org now, or [A-Z]{4}\.[A-Z]@", by[0])
    first, second = re.findall(r"\S+@\S+\.org", by[0])
    assert first.lower() == second.lower()
    one, two = re.search(r"Call (\+1 \(\d{3}\) \d{3}-\d{4}) or (\+1 \d{3} \d{3} \d{4});", by[1]).groups()
    assert re.sub(r"\D", "", one) == re.sub(r"\D", "", two) != "15550109999" and "300.1.1.1" in by[1] and "10.20.30.40" not in by[1]
    card = re.search(r"Card ([\d ]{19}) and (\d{16}),", by[2])
    assert card[1].replace(" ", "") == card[2] != "4111111111111111" and pii._luhn(card[2][:-1]) == card[2][-1]
    assert re.search(r'token = "[0-9a-f]{24}"', by[2]) and "deadbeef" not in by[2]
    names = re.match(r"Frau (\w+) met Mr\. (\w+) and Mrs (\w+)\.", by[3]).groups()
    assert len(set(names)) == 3 and not {"Meier", "Smith"} & set(names)


def test_national_phones_and_full_names(spark):
    phones = ["555-010-9999", "030 1234567", "0171-2345678", "01 42 68 53 00", "020 7946 0958", "8 (495) 123-45-67", "1-800-555-0199", "612 34 56 78"]
    plain = ["On 01.02.2020, 2020-01-15 and 01-12-2020 at 08:30, pages 100-200 of 1 000 000, about 3.05 and 12 13 14 15."]
    names = ["Mrs Anna Schmidt came. Schmidt left, ANNA stayed.", "Frau Meier-Schulz und Mr O'Neil; O’Neil's car, Herr Dr. Hans von Berg.", "Mr 田中 spoke, Г-жа Анна Петрова and Mr Παπαδόπουλος too. Smith didn't.", "Mr Smith and Mrs Smith: Smith's hat. smith"]
    data = list(enumerate([f"Call {p} now." for p in phones] + ["Fax: 12 34 56"] + plain + names))
    got = {r["doc_id"]: r["clean_text"] for r in pii.replace_pii(spark.createDataFrame(data, "doc_id long, text string"), b"k4").collect()}
    for i, p in enumerate(phones):
        assert p not in got[i] and re.sub(r"\d", "0", got[i]) == re.sub(r"\d", "0", data[i][1])
    assert got[8] != data[8][1] and got[9] == plain[0]
    one, two, three, four = (got[i] for i in range(10, 14))
    first, last, again, upper = re.fullmatch(r"Mrs (\S+) (\S+) came\. (\S+) left, (\S+) stayed\.", one).groups()
    assert last == again and upper == first.upper() and not {first, last} & {"Anna", "Schmidt"}
    assert not re.search("Meier|Schulz|Neil|Hans|Berg", two) and re.search(r"; (\S+)'s car", two)[1] == re.search(r"Mr (\S+);", two)[1] and " von " in two
    a, b, c, d = re.fullmatch(r"Mr (\S+) spoke, Г-жа (\S+) (\S+) and Mr (\S+) too\. Smith didn't\.", three).groups()
    assert all(map(re.fullmatch, ("[\u4e00-\u9fff]{2}", "[А-я]+", "[А-я]+", "[\u0370-\u03ff]+"), (a, b, c, d))) and not {a, b, c, d} & {"田中", "Анна", "Петрова", "Παπαδόπουλος"}
    he, she, his = re.fullmatch(r"Mr (\S+) and Mrs (\S+): (\S+)'s hat\. smith", four).groups()
    assert she == his != he


def test_collisions_are_resolved(spark):
    """There are 100 addresses of this form, and half of them are in use."""
    data = [(i, f"ip {i // 10}.{i % 10}.1.1") for i in range(0, 100, 2)]
    got = pii.replace_pii(spark.createDataFrame(data, "doc_id long, text string"), b"k2").collect()
    new = [r["clean_text"] for r in got]
    assert len(set(new)) == len(new) and not set(new) & {t for _, t in data}


def test_a_used_up_format_gets_wider(spark):
    """All addresses of this form are in use, so that each candidate of the exact format is an entity."""
    real = [f"{i // 10}.{i % 10}.1.{j}" for i in range(100) for j in range(10)] + [f"{a}.{b}.{c}.{d}" for a in range(10) for b in range(10) for c in range(10) for d in range(10)]
    secret = "token = ----------------"
    data = list(enumerate([" ".join(real[k : k + 250]) for k in range(0, len(real), 250)])) + [(None, secret), (None, "")]
    got = pii.replace_pii(spark.createDataFrame(data, "doc_id long, text string"), b"k3").collect()
    new = {}
    for r in got:
        if r["doc_id"] is not None:
            new.update(zip(data[r["doc_id"]][1].split(" "), r["clean_text"].split(" ")))
    assert len(new) == 10_000 and len(set(new.values())) == len(new) and not set(new.values()) & set(real)
    assert all(re.fullmatch(r"\d{1,3}(\.\d{1,3}){3}", x) for x in new.values())
    assert sorted(r["clean_text"] for r in got if r["doc_id"] is None)[1] not in (secret, "")


def test_language_of_odd_rows(spark):
    learn = spark.createDataFrame([(i, t, lang) for i in range(40) for lang, t in (("xx", "baba dede fifi gogo " * 20), ("yy", "ströß kräft pflüg " * 20))], "id long, text string, lang string")
    docs = spark.createDataFrame([(1, "Baba, fifi! dede"), (2, "KRÄFT ströß"), (3, None), (4, "123 ... ²"), (5, ""), (6, "gogo baba " * 40_000)], "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(docs, learn).collect()}
    assert [got[i][0] for i in range(1, 7)] == ["xx", "yy", "und", "und", "und", "xx"]
    assert all(0 <= s <= 1 for _, s in got.values())
    assert language_id.identify(documents(spark, extra=True), learn).count() == len(rows())
    assert language_id.identify(documents(spark, empty=True), learn).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(docs, learn.where("false")).collect()} == {"und"}


def test_phrases_equal_greedy_parsing():
    """Of whole texts, though they are parsed in blocks; in periodic ones the blocks' own parses never meet the real one."""
    rng = random.Random(1)
    sample = "".join(rng.choice("abcd ") for _ in range(300))
    parser = language_id.CrossParser({"x": sample})
    texts = ["".join(rng.choice("abcde ") for _ in range(n)) for n in (1, 7, 200, 2500)] + ["a" * 5000, "ab" * 3000, "q" * 3000, sample * 20]
    for text, got in zip(texts, parser.phrases(texts)[:, 0]):
        count, match = 1, ""
        for c in text:
            if match + c in sample:
                match += c
            else:
                count, match = count + 1, c if c in sample else ""
        assert got == count


def test_sparse_tables_step_like_dense_ones():
    rng = random.Random(7)
    samples = {x: "".join(rng.choice(letters) for _ in range(2000)) for x, letters in (("a", "abc "), ("b", "abdefghij "), ("c", "xyzäöü "), ("d", "q"))}
    dense, sparse = language_id.CrossParser(samples), language_id.CrossParser(samples, dense=0)
    assert dense.owner is None and sparse.owner is not None
    texts = ["".join(rng.choice("abcdefxyzqä ") for _ in range(n)) for n in (1, 30, 3000)] + ["a" * 3000, "", "q" * 2500, samples["b"] * 3, "漢"]
    assert (dense.phrases(texts) == sparse.phrases(texts)).all()


def test_scripts_of_thousands_of_letters_take_little_memory():
    """Samples of full size of Chinese, Japanese, Korean and English: the tables are a fraction of what a dense one would be, and tell the
    languages apart."""
    rng = random.Random(3)
    scripts = {"zh": [chr(0x4E00 + i) for i in range(3000)], "ja": [chr(0x3041 + i) for i in range(80)] + [chr(0x4E00 + 3 * i) for i in range(900)], "ko": [chr(0xAC00 + 7 * i) for i in range(1500)], "en": list("abcdefghijklmnopqrstuvwxyz")}
    words = {x: ["".join(rng.choices(letters, k=rng.randrange(1, 4))) for _ in range(4000)] for x, letters in scripts.items()}
    text = lambda x, n: " ".join(rng.choices(words[x], weights=[1 / (i + 1) for i in range(4000)], k=n))
    samples = {x: text(x, 20_000)[:40_000] for x in scripts}
    began = time.time()
    parser = language_id.CrossParser(samples)
    assert time.time() - began < 60 and parser.owner is not None
    held = sum(a.nbytes for a in (parser.table, parser.owner, parser.end, parser.code))
    assert held < 60 << 20  # four workers below 250 MB
    names, scores = parser.predict([text(x, 60) for x in scripts for _ in range(5)] + ["漢字", "", None])
    assert names[:20] == [x for x in scripts for _ in range(5)] and names[21:] == ["und", "und"] and (scores[:20] > 0.1).all()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables here")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    got = language_id.query(spark, "/root/testdata/sf0.01").join(docs, "doc_id").where("held_out and lang is not null and lang_pred <> 'und'")
    right, n = got.selectExpr("count_if(lang = lang_pred)", "count(1)").first()
    assert n > 150 and right >= 0.97 * n


def test_documents_without_ids_keep_their_own_choices(spark):
    """Most rows have no id, and formats so dense that entities need further candidates: no row gathers another's choices."""
    table = [(None if i % 3 else i, f"call {i % 10}{i // 10 % 10}-{i // 100 % 10}55-01{i % 7}{i % 9}, host 10.0.0.{i % 250}; mail a{i % 26}@b{i % 10}.org") for i in range(600)] + [(None, "no data")] * 50 + [(None, None)]
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(4)
    got = pii.replace_pii(df, b"k")
    rows = got.collect()
    assert len(rows) == len(table) and sum(r["clean_text"] is None for r in rows) == 1
    with_ids = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(table)], "doc_id long, text string")
    assert sorted(r["clean_text"] or "" for r in rows) == sorted(r["clean_text"] or "" for r in pii.replace_pii(with_ids, b"k").collect())
    chosen = pii.choices(df.select("text"), b"k")
    if chosen is not None:
        marks = pii._marks(df.where("text is not null").select(F.xxhash64("text").alias("row"), "text"), b"k").join(chosen, "mark")
        assert marks.groupBy("row").agg(F.countDistinct("mark").alias("n")).agg(F.max("n")).first()[0] <= 3


def test_columns_with_names_of_their_own(spark):
    """Names that the operators use themselves, of the wrong type."""
    names = ("row", "row_", "mark", "choices_", "text_", "clean_text", "html_", "best", "digest", "conv", "msg", "seq", "kind", "part", "way", "n", "id", "key")
    more = lambda df: df.select("*", *[F.lit("z").alias(c) for c in names if c not in df.columns])
    data = list(enumerate(PRIVATE)) + [(9, None), (None, "")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    plain = {(r["doc_id"], r["clean_text"]) for r in pii.replace_pii(df, b"k").collect()}
    assert {(r["doc_id"], r["clean_text"]) for r in pii.replace_pii(more(df), b"k").collect()} == plain
    assert pii.replace_pii(more(df).where("false"), b"k").count() == 0
    crowded = spark.createDataFrame([(i, f"ip 1.1.{i // 10}.{i % 10} and 2.2.{i // 10}.{i % 10}") for i in range(100)], "doc_id long, text string")
    assert pii.replace_pii(more(crowded), b"k").count() == 100
    talk = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b")], "conv_id long, turn long, role string, text string")
    a, b = (chat_format.read_back(chat_format.render(chat_format.fold(chat_format.as_log(x)))).collect() for x in (talk, more(talk)))
    assert a == b
    _, web = pages(spark)
    odd = warc.with_revisits(more(web), "page_id", "html")
    assert odd.count() == web.count()


@pytest.mark.parametrize("used", [2000, 5000])
def test_dense_formats_get_distinct_surrogates(spark, used):
    """Of the 10,000 addresses of four digits a part is in use, so that many candidates clash."""
    rng = random.Random(used)
    real = rng.sample([f"{a}.{b}.{c}.{d}" for a in range(10) for b in range(10) for c in range(10) for d in range(10)], used)
    data = list(enumerate(" ".join(real[k : k + 200]) for k in range(0, used, 200)))
    got = [x for r in pii.replace_pii(spark.createDataFrame(data, "doc_id long, text string"), b"k5").collect() for x in r["clean_text"].split(" ")]
    assert len(got) == len(set(got)) == used and not set(got) & set(real)


def test_a_domain_keeps_one_surrogate(spark):
    real = [f"{a}@shop.example" for a in "abcdefghijklmnopqrstuvwxyz"]
    got = pii.replace_pii(spark.createDataFrame([(1, " ".join(real))], "doc_id long, text string"), b"k6").first()["clean_text"].split(" ")
    assert len(set(got)) == 26 and len({x.split("@")[1] for x in got}) == 1 and not set(got) & set(real)


def test_the_log_of_the_query_is_edited_and_regenerated(spark):
    talk = spark.createDataFrame([(c, t, "user", f"text {c} {t} " * 40) for c in range(10) for t in range(4)], "conv_id long, turn long, role string, text string")
    log = chat_format.as_log(talk)
    kinds = {r["kind"] for r in log.select("kind").distinct().collect()}
    assert kinds == {"start", "delta", "edit", "regenerate"}
    for conv, events in groups(log.collect()).items():
        assert [t for _, t in replay([(e["seq"], e["kind"], e["msg"], e["role"], e["text"]) for e in events])] == [f"text {conv} {t} " * 40 for t in range(4)]


def groups(rows):
    out = {}
    for r in rows:
        out.setdefault(r["conv"], []).append(r)
    return out
