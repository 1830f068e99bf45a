"""Greedy batching in order, however many rows a group has.

Where a batch ends depends on where it began, and so on all rows before. But a batch has few rows: of the rows that a task holds of a group, the first
batch that begins there begins at one of the first `most`. Each task says for each of these beginnings how many batches begin and
what is left open at its end; these summaries, a few for each task, are folded in order, and then each task knows what was open when its rows
began, and numbers them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.sources.checkpoints import cut

_SUMMARY = "task int, at int, group string, sizes array<bigint>, counts array<bigint>, rows array<bigint>, totals array<bigint>, n bigint"


def _key(value) -> str | None:
    return None if value is None else repr(value)


def _joins(rows: int, total: int, size: int, most: int, budget: int) -> bool:
    return rows < most and total + size <= budget


def _summary(sizes: list[int], most: int, budget: int) -> tuple[list[int], list[int], list[int]]:
    """For a batch that begins at each of the first rows: how many batches begin from there on, and the rows and total of the last, open one."""
    n = len(sizes)
    counts, rows, totals = [0] * n, [0] * n, [0] * n
    for i in range(n - 1, -1, -1):
        r, t, j = 1, sizes[i], i + 1
        while j < n and _joins(r, t, sizes[j], most, budget):
            r, t, j = r + 1, t + sizes[j], j + 1
        counts[i], rows[i], totals[i] = (1, r, t) if j == n else (1 + counts[j], rows[j], totals[j])
    return counts[:most], rows[:most], totals[:most]


def _segments(batches: Iterator[pa.RecordBatch], group: str, size: str) -> Iterator[tuple[str | None, list[int]]]:
    """The sizes of each group of a task's rows, which come in order."""
    now, sizes = object(), []
    for batch in batches:
        for g, s in zip(batch.column(group).to_pylist(), batch.column(size).to_pylist()):
            g = _key(g)
            if g != now:
                if sizes:
                    yield now, sizes
                now, sizes = g, []
            sizes.append(s)
    if sizes:
        yield now, sizes


def greedy_batches(df: DataFrame, group: str, order: str, size: str, most: int, budget: int) -> DataFrame:
    """(group, order, size, batch): rows in order; a batch ends before it has more than `most` rows or
    `budget` in sizes, and a row above the budget stands alone. Batches are numbered from 0 in each group; a null group is one, and a null
    size counts as 0. Rows of equal order keep no certain order among themselves."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slim = df.select(group, order, F.coalesce(F.col(size).cast("long"), F.lit(0)).alias(size))
    dealt = cut(slim.repartitionByRange(tasks, group, order).sortWithinPartitions(group, order).withColumn("__task", F.spark_partition_id()))

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of a task's first and last group alone: others have all their rows here."""
        task = None

        def noted() -> Iterator[pa.RecordBatch]:
            nonlocal task
            for b in batches:
                if len(b):
                    task = b.column("__task")[0].as_py()
                yield b

        def row(at: int, g: str | None, sizes: list[int]) -> dict:
            counts, rows, totals = _summary(sizes, most, budget)
            return {"task": task, "at": at, "group": g, "sizes": sizes[:most], "counts": counts, "rows": rows, "totals": totals, "n": len(sizes)}

        first = last = None
        for segment in _segments(noted(), group, size):
            first, last = first or segment, segment
        if first:
            out = [row(0, *first)] + ([row(1, *last)] if last is not first else [])
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("task", pa.int32()), ("at", pa.int32()), ("group", pa.string()), *[(c, pa.list_(pa.int64())) for c in ("sizes", "counts", "rows", "totals")], ("n", pa.int64())]))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What is open, and which number comes next, where a task's rows of a group begin."""
        now, rows, total, number = object(), 0, 0, -1
        for batch in batches:
            out = []
            for s in batch.to_pylist():
                if s["group"] != now:
                    now, rows, total, number = s["group"], most, budget + 1, -1
                out.append((s["task"], s["at"], rows, total, number))
                e = 0
                while e < min(s["n"], most) and _joins(rows, total, s["sizes"][e], most, budget):
                    rows, total, e = rows + 1, total + s["sizes"][e], e + 1
                if e < s["n"]:
                    number, rows, total = number + s["counts"][e], s["rows"][e], s["totals"][e]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in range(5)], names=["task", "at", "rows", "total", "number"])

    told = dealt.mapInArrow(summaries, _SUMMARY).repartition("group").sortWithinPartitions("group", "task", "at").mapInArrow(fold, "task long, at long, rows long, total long, number long")
    # only the first group of a task may have begun in one before: a row for each task at most
    begun = {r["task"]: (r["rows"], r["total"], r["number"]) for r in told.where("at = 0").collect()}
    sent = df.sparkSession.sparkContext.broadcast(begun)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, total, at = object(), 0, 0, -1
        first = True
        for batch in batches:
            out = np.empty(len(batch), np.int64)
            for i, (g, s) in enumerate(zip(batch.column(group).to_pylist(), batch.column(size).to_pylist())):
                g = _key(g)
                if g != now:
                    now, rows, total, at = g, most, budget + 1, -1
                    if first:
                        rows, total, at = sent.value[batch.column("__task")[0].as_py()]
                        first = False
                if _joins(rows, total, s, most, budget):
                    rows, total = rows + 1, total + s
                else:
                    rows, total, at = 1, s, at + 1
                out[i] = at
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (group, order, size)), pa.array(out)], names=[group, order, size, "batch"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema)
    return dealt.mapInArrow(number, f"{types}, batch long")
