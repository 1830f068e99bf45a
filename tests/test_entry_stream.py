"""Keyed state of entries: the given cases over a restarted stream, and random logs against a loop."""

import random

import pytest

from loomery.streaming import entries as E

URL = "http://example.com/"


def doc(url, kind="html", title="", downloaded=False, path=None):
    return (url, kind, title, downloaded, path)


CASES = [
    ("t", 1, 1, "公告一", "", [doc(URL + "detail.html")]),
    ("t", 2, 5, "公告一更新", "已更新", [doc(URL + "detail.html")]),
    ("t", 3, 1, "公告二", "", [doc(URL + "another.html")]),
    ("t", 4, 2, "公告三", "", [doc(URL + "third.html")]),
]


class Loop:
    """The same rules over dictionaries, an entry at a time."""

    def __init__(self):
        self.entries, self.files = {}, {}

    def put(self, serial, title, remark, documents):
        name = next((self.files[d[0]] for d in documents or [] if d[0] and d[0] in self.files), None)
        if name is None:
            urls = [d[0] for d in documents or [] if d[1] == "html" and d[0] is not None] + [d[0] for d in documents or [] if d[0]]
            name = urls[0] if urls else "title::" + title + (f"::{remark}" if remark else "") if title else f"serial::{serial}"
        used = {e["serial"] for e in self.entries.values()}
        if name not in self.entries:
            s = serial if serial and serial > 0 and serial not in used else max(used, default=0) + 1
            self.entries[name] = {"serial": s, "title": title or "", "remark": remark or "", "documents": {}}
        else:
            self.entries[name] |= {k: v for k, v in (("title", title), ("remark", remark)) if v is not None}
        for url, kind, t, done, path in documents or []:
            if url:
                old = self.entries[name]["documents"].setdefault(url, (kind, "", False, None))
                self.entries[name]["documents"][url] = (old[0] if kind is None else kind, t or old[1], bool(done) or old[2], path or old[3])
                self.files[url] = name


def test_given_cases_over_a_restarted_stream(spark, tmp_path):
    for i, row in enumerate(CASES):  # a file, a run of the stream and a restart for each
        spark.createDataFrame([row], E.INPUT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(E.INPUT).parquet(f"{tmp_path}/in")
        E.run_stream(E.entry_changes(stream), f"{tmp_path}/out", f"{tmp_path}/check")
        assert spark.read.parquet(f"{tmp_path}/out").where("kind = 'entry'").count() == i + 1
    log = spark.read.parquet(f"{tmp_path}/out")
    got = [(r["serial"], r["title"], r["remark"]) for r in E.latest_entries(log).orderBy("serial").collect()]
    assert got == [(1, "公告一更新", "已更新"), (2, "公告二", ""), (3, "公告三", "")]
    assert [(r["total"], r["diff"]) for r in log.where("kind = 'history'").orderBy("seq").collect()] == [(1, 1), (2, 1), (3, 1)]  # none where the number stays
    assert [r["seq"] for r in log.orderBy("seq").collect()] == list(range(1, log.count() + 1))
    renumbered = E.latest_entries(E.entry_changes(spark.createDataFrame(CASES, E.INPUT), renumber=True))
    assert sorted(r["serial"] for r in renumbered.collect()) == [1, 2, 3]


@pytest.mark.parametrize("seed", range(2))
def test_random_logs_equal_the_loop(spark, seed):
    rng = random.Random(seed)
    rows, loops = [], {}
    for i in range(400):
        task = rng.choice(["a", "a", "a", "b", None])
        documents = rng.choice([None, []]) if rng.random() < 0.2 else [doc(rng.choice([None, "", *[f"u{j}" for j in range(60)]]), rng.choice(["html", "pdf", None]), rng.choice(["", None, f"t{i}"]), rng.choice([True, False, None]), rng.choice([None, "", f"p{i}"])) for _ in range(rng.randrange(1, 4))]
        entry = (rng.choice([None, 0, -1, *range(1, 40)]), rng.choice([None, "", f"T{rng.randrange(30)}", f"T{i}"]), rng.choice([None, "", "r"]), documents)
        if not entry[1] and entry[0] is None and not any(d[0] or d[1] == "html" and d[0] is not None for d in documents or []):
            continue
        rows.append((task, i, *entry))
        loops.setdefault(task, Loop()).put(*entry)
    got = E.latest_entries(E.entry_changes(spark.createDataFrame(rows, E.INPUT).repartition(3))).collect()
    want = [(task, name, e["serial"], e["title"], e["remark"], [(u, *d) for u, d in e["documents"].items()]) for task, loop in loops.items() for name, e in loop.entries.items()]
    assert sorted(map(repr, want)) == sorted(repr((*r[:5], [tuple(d) for d in r["documents"]])) for r in got)


@pytest.mark.parametrize("always", [False, True])
def test_history_of_snapshots(spark, tmp_path, always):
    rng = random.Random(3)
    shots = {("a", s): {f"e{rng.randrange(12)}" for _ in range(rng.randrange(6, 12))} for s in range(1, 9)} | {("b", 1): {"x"}, ("b", 2): {"y"}, ("b", 3): set(), ("b", 4): {"z"}}
    want = []
    for task in "ab":
        recorded: set = set()
        for (t, s), now in sorted(shots.items()):
            last = s == max(x for y, x in shots if y == task)
            if t == task and not last and (len(now) != len(recorded) or always and now != recorded):
                want.append((task, s, len(now), len(now) - len(recorded), sorted(now - recorded), sorted(recorded - now)))
                recorded = now
    rows = [(t, s, e) for (t, s), now in shots.items() for e in [*now, None, *list(now)[:1]]]
    kind = "task string, snapshot long, entry_id string"
    got = E.snapshot_history(spark.createDataFrame(rows, kind).repartition(3), always).collect()
    assert sorted(map(tuple, got)) == want
    for s in range(1, 9):  # as a stream, each snapshot in two files
        for half in (0, 1):
            part = [r for r in rows if r[1] == s][half::2]
            if part:
                spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        if s in (2, 8):
            E.run_stream(E.snapshot_history(stream, always), f"{tmp_path}/out", f"{tmp_path}/check")
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == want
