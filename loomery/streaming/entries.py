"""Entries of crawled listings as keyed state: upserts, serials, documents, and the history of their number.

State belongs to a task. Entries, documents, known URLs and serials in use are map states, so that a row reads
and writes the few keys that it names, and nothing is rewritten as a whole. What comes out is a log of changes, numbered within the
task; `latest_entries` folds it. A task's rows go through one task of Spark in order, as each serial depends on all
before it; tasks are spread.

Defined cases: a null title or remark leaves what is there; an entry without URLs, title and serial is named by all that it holds; a
row without documents is an entry without documents; rows that are repeated after a failure are seen once, as state and
output are committed together. Equal ordinals keep the order of their rows' text.
"""

from __future__ import annotations

import heapq
import json
import pickle
import re
import tempfile
import unicodedata
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loomery.sources.checkpoints import cut, ensure_checkpoint_dir

#: Rows of a task that are held in memory while they are sorted.
HELD = 10_000
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DOCUMENTS = "array<struct<url:string,type:string,title:string,downloaded:boolean,local_path:string>>"
INPUT = f"task string, ordinal long, serial long, title string, remark string, documents {DOCUMENTS}"
CHANGES = "task string, seq long, ordinal long, kind string, entry_id string, added boolean, serial long, title string, remark string, url string, type string, downloaded boolean, local_path string, total long, diff long"
SNAPSHOTS = "task string, snapshot long, entries_total long, entries_diff long, added array<string>, removed array<string>"


def entry_id(row: Row) -> str:
    """What names an entry that no known URL names: its first page, its first document, its title and remark, its serial, or all of it."""
    documents = row["documents"] or []
    for d in documents:
        if d["url"] is not None and d["type"] == "html":
            return d["url"]
    for d in documents:
        if d["url"]:
            return d["url"]
    if row["title"]:
        return "::".join(["title", row["title"], *([row["remark"]] if row["remark"] else [])])
    if row["serial"] is not None:
        return f"serial::{row['serial']}"
    whole = json.dumps([d.asDict() for d in documents] + [row["remark"]], ensure_ascii=False, sort_keys=True)
    return re.sub(r"[^\w-]", "_", unicodedata.normalize("NFKC", whole)).strip("_")


def _spilled(rows: list) -> Iterator:
    with tempfile.TemporaryFile() as f:
        for row in rows:
            pickle.dump(row, f)
        n = len(rows)
        del rows[:]
        yield None  # written
        f.seek(0)
        for _ in range(n):
            yield pickle.load(f)


def in_order(rows: Iterator, key, held: int = HELD) -> Iterator:
    """The rows sorted, of which `held` are in memory: more go to temporary files as sorted runs, which are merged."""
    runs, part = [], []
    for row in rows:
        part.append(row)
        if len(part) >= held:
            part.sort(key=key)
            runs.append(_spilled(part))
            next(runs[-1])
    part.sort(key=key)
    yield from heapq.merge(*runs, part, key=key)


class EntryUpserts(StatefulProcessor):
    """An entry with a known URL is that URL's; its title and remark are replaced and its serial stays. A new one gets the serial that it asks for if
    that is free, else the largest plus 1; with `renumber`, as for a listing's snapshot, its number in order of appearance."""

    def __init__(self, renumber: bool = False) -> None:
        self.renumber = renumber

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getValueState("counts", "highest long, total long, recorded long, seq long")
        self.entries = handle.getMapState("entries", "entry_id string", "serial long, title string, remark string")
        self.urls = handle.getMapState("urls", "url string", "entry_id string")
        self.serials = handle.getMapState("serials", "serial long", "entry_id string")
        self.documents = handle.getMapState("documents", "entry_id string, url string", "type string, title string, downloaded boolean, local_path string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        highest, total, recorded, seq = self.counts.get() if self.counts.exists() else (0, 0, 0, 0)
        empty = dict.fromkeys(c.split()[0] for c in CHANGES.split(", "))
        for row in in_order(rows, lambda r: (r["ordinal"], repr(r))):
            documents = [d for d in row["documents"] or [] if d is not None]
            name = next((self.urls.getValue((d["url"],))[0] for d in documents if d["url"] and self.urls.containsKey((d["url"],))), None)
            name = entry_id(row) if name is None else name
            added = not self.entries.containsKey((name,))
            if added:
                wanted = None if self.renumber else row["serial"]
                serial = wanted if wanted and wanted > 0 and not self.serials.containsKey((wanted,)) else (total if self.renumber else highest) + 1
                self.serials.updateValue((serial,), (name,))
                highest, total = max(highest, serial), total + 1
                entry = (serial, row["title"] or "", row["remark"] or "")
            else:
                serial, title, remark = self.entries.getValue((name,))
                entry = (serial, title if row["title"] is None else row["title"], remark if row["remark"] is None else row["remark"])
            self.entries.updateValue((name,), entry)
            seq += 1
            yield Row(**{**empty, "task": key[0], "seq": seq, "ordinal": row["ordinal"], "kind": "entry", "entry_id": name, "added": added, "serial": entry[0], "title": entry[1], "remark": entry[2]})
            for d in documents:
                if not d["url"]:
                    continue
                place = (name, d["url"])
                old = self.documents.getValue(place) if self.documents.containsKey(place) else (d["type"], "", False, None)
                new = (old[0] if d["type"] is None else d["type"], d["title"] or old[1], bool(d["downloaded"]) or old[2], d["local_path"] or old[3])
                self.documents.updateValue(place, new)
                self.urls.updateValue((d["url"],), (name,))
                seq += 1
                yield Row(**{**empty, "task": key[0], "seq": seq, "ordinal": row["ordinal"], "kind": "document", "entry_id": name, "url": d["url"], "type": new[0], "title": new[1], "downloaded": new[2], "local_path": new[3]})
        if total != recorded:
            seq += 1
            yield Row(**{**empty, "task": key[0], "seq": seq, "kind": "history", "total": total, "diff": total - recorded})
        self.counts.update((highest, total, total, seq))

    def close(self) -> None:
        pass


class SnapshotHistory(StatefulProcessor):
    """Listings (task, snapshot, entry_id) that follow one another: when a later snapshot begins, the one before is compared with the
    last that was recorded, and recorded if its number of entries differs (or, with `always`, if its entries do). A null
    entry_id only says that the snapshot is there, and so closes the one before."""

    def __init__(self, always: bool = False) -> None:
        self.always = always

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", "snapshot long, total long, recorded long")
        self.seen = handle.getMapState("seen", "entry_id string", "snapshot long, recorded boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        now, total, recorded = self.now.get() if self.now.exists() else (None, 0, 0)
        for row in in_order(rows, lambda r: (r["snapshot"], r["entry_id"] or "")):
            if now is not None and row["snapshot"] < now:
                raise ValueError(f"task {key[0]}: snapshot {row['snapshot']} comes after {now}")
            if now is not None and row["snapshot"] > now:
                out = self._closed(key[0], now, total, recorded)
                if out is not None:
                    yield out
                    recorded = total
                total = 0
            now = row["snapshot"]
            if row["entry_id"] is None:
                continue
            last, known = self.seen.getValue((row["entry_id"],)) if self.seen.containsKey((row["entry_id"],)) else (None, False)
            if last != now:
                self.seen.updateValue((row["entry_id"],), (now, known))
                total += 1
        self.now.update((now, total, recorded))

    def _closed(self, task: str, now: int, total: int, recorded: int) -> Row | None:
        added, removed, gone = [], [], []
        for (name,), (last, known) in self.seen.iterator():
            if last == now and not known:
                added.append(name)
            elif last != now:
                (removed if known else gone).append(name)
        for name in gone:
            self.seen.removeKey((name,))
        if total == recorded and not (self.always and (added or removed)):
            return None
        for name in added:
            self.seen.updateValue((name,), (now, True))
        for name in removed:
            self.seen.removeKey((name,))
        return Row(task=task, snapshot=now, entries_total=total, entries_diff=total - recorded, added=sorted(added), removed=sorted(removed))

    def close(self) -> None:
        pass


def _keyed(rows: DataFrame, processor: StatefulProcessor, schema: str) -> DataFrame:
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)  # map states need it
    rows.sparkSession.streams.active  # in a batch, too, stores need the coordinator that comes with the session's first look at its streams
    return rows.groupBy("task").transformWithState(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="None")


def entry_changes(entries: DataFrame, renumber: bool = False) -> DataFrame:
    """The log of changes that a batch or stream of entries (task, ordinal, serial, title, remark, documents) makes."""
    return _keyed(entries.select("task", "ordinal", "serial", "title", "remark", "documents"), EntryUpserts(renumber), CHANGES)


def snapshot_history(listings: DataFrame, always: bool = False) -> DataFrame:
    """The recorded differences of a batch or stream of listings (task, snapshot, entry_id)."""
    rows = listings.select("task", "snapshot", "entry_id")
    return _keyed(rows, SnapshotHistory(always), SNAPSHOTS) if rows.isStreaming else _whole_history(rows, always)


def _whole_history(listings: DataFrame, always: bool) -> DataFrame:
    """What SnapshotHistory gives for all listings at once. A snapshot that isn't recorded is as the last recorded one is, in number (or, with
    `always`, in entries), so that the one before tells whether a snapshot is recorded; each entry then looks at its own neighbours alone."""
    rows = cut(listings.distinct())
    order = W.partitionBy("task").orderBy("snapshot")  # a row for each snapshot
    totals = rows.groupBy("task", "snapshot").agg(F.count("entry_id").alias("total"))
    closed = totals.withColumns({"next": F.lead("snapshot").over(order), "last": F.lag("total", 1, 0).over(order)}).where("next is not null")
    kept = closed if always else closed.where("total <> last")
    kept = cut(kept.select("task", "snapshot", "total", F.row_number().over(order).alias("n"), (F.col("total") - F.lag("total", 1, 0).over(order)).alias("diff")))
    at = kept.select(F.col("task").alias("k_task"), F.col("snapshot").alias("k_snapshot"), "n")
    held = rows.where("entry_id is not null").join(at, F.col("task").eqNullSafe(F.col("k_task")) & (F.col("snapshot") == F.col("k_snapshot")))
    own = W.partitionBy("task", "entry_id").orderBy("n")
    near = held.select("task", "entry_id", "n", F.lag("n").over(own).alias("before"), F.lead("n").over(own).alias("after"))
    came = F.when(F.coalesce(F.col("before") != F.col("n") - 1, F.lit(True)), F.struct(F.col("n").alias("c_n"), F.lit(True).alias("came")))
    went = F.when(F.coalesce(F.col("after") != F.col("n") + 1, F.lit(True)), F.struct((F.col("n") + 1).alias("c_n"), F.lit(False).alias("came")))
    changes = near.select(F.col("task").alias("c_task"), "entry_id", F.explode(F.array_compact(F.array(came, went))).alias("c")).select("c_task", "entry_id", "c.*")
    names = lambda when: F.sort_array(F.collect_list(F.when(when, F.col("entry_id"))))
    lists = changes.groupBy("c_task", "c_n").agg(names(F.col("came")).alias("added"), names(~F.col("came")).alias("removed"))
    out = kept.join(lists, kept["task"].eqNullSafe(F.col("c_task")) & (F.col("n") == F.col("c_n")), "left")
    none = F.array().cast("array<string>")
    out = out.select("task", "snapshot", F.col("total").alias("entries_total"), F.col("diff").alias("entries_diff"), F.coalesce("added", none).alias("added"), F.coalesce("removed", none).alias("removed"))
    return out.where((F.col("entries_diff") != 0) | (F.size("added") > 0) | (F.size("removed") > 0))


def latest_entries(changes: DataFrame) -> DataFrame:
    """(task, entry_id, serial, title, remark, documents) as the log leaves them; documents in order of their first change."""
    entries = changes.where("kind = 'entry'").groupBy("task", "entry_id").agg(F.max_by(F.struct("serial", "title", "remark"), "seq").alias("e"))
    each = changes.where("kind = 'document'").groupBy("task", "entry_id", "url").agg(F.min("seq").alias("first"), F.max_by(F.struct("type", "title", "downloaded", "local_path"), "seq").alias("d"))
    ordered = F.array_sort(F.collect_list(F.struct("first", "url", "d")))
    of = each.groupBy(F.col("task").alias("t"), F.col("entry_id").alias("i")).agg(F.transform(ordered, lambda x: F.struct(x["url"].alias("url"), x["d"]["type"].alias("type"), x["d"]["title"].alias("title"), x["d"]["downloaded"].alias("downloaded"), x["d"]["local_path"].alias("local_path"))).alias("documents"))
    out = entries.join(of, F.col("task").eqNullSafe(F.col("t")) & (F.col("entry_id") == F.col("i")), "left")
    return out.select("task", "entry_id", "e.*", F.coalesce("documents", F.array().cast(DOCUMENTS)).alias("documents"))


def run_stream(changes: DataFrame, table_path: str, checkpoint: str) -> None:
    """Appends what a streaming query of changes gives to a Parquet table until the source has no more; started again with the same
    checkpoint it goes on where it was."""
    ensure_checkpoint_dir(changes.sparkSession)
    query = changes.writeStream.format("parquet").option("path", table_path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
