"""Periodic runs of words, by counting how many words agree at each lag.

A run is a stretch of consecutive words with smallest period q (words q apart are identical), at
least max(min_length, 2 q) long, that no neighbouring word extends. Such a run is an island of at least
max(min_length - q, q) matches in a row between the text and itself q words later, so a lag with fewer
matches in all has none. The matches are counted exactly for all lags at once: words are split into
heavy ones, whose 0/1 vectors go through an FFT autocorrelation (the spectra are summed, so that one inverse
transform serves them all), and light ones, of which all pairs' differences are counted. The threshold
balances both, so that n words cost about n^1.5 and never n^2.

Lags are then taken in ascending order. A run of period p is one island at each multiple of p, with
the same extent, and no run of its own there; its matches are taken off those lags' counts first, exactly.
Only lags that keep enough matches are scanned, and a scan looks at an eighth of a run's least
length at a time before it compares word by word.

Each text is a row's own work inside one task (Arrow batches); rows don't meet, so nothing is
shuffled. Memory is that of one batch plus some arrays over one text's words.

Defined cases: null, empty and blank texts have no words, no runs and an empty collapsed text; equal
rows get equal results; an empty table gives an empty result; other columns pass through, null or not, and those
named n_words, runs and collapsed are replaced. Words are those between the six ASCII characters of
white space, compared byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.llm.common import fresh, words

_PAIRS = 1 << 20  # differences held at once
_OUT_BYTES = 4 << 20
#: A pair's difference costs about as much as five steps of a transform.
_PAIR_COST = 5


def lag_matches(codes: np.ndarray, most: int) -> np.ndarray:
    """For each lag from 0 to most, how many words are identical to the one that many places later (0 for lag 0)."""
    n = len(codes)
    size = 1 << int(n + most).bit_length()
    order = np.argsort(codes, kind="stable")
    ends = np.cumsum(np.bincount(codes))
    times = np.diff(ends, prepend=0)
    heavy = times * times * _PAIR_COST > size * np.log2(size)
    found = np.zeros(most + 1, np.int64)
    if heavy.any():
        power = np.zeros(size // 2 + 1)
        ones = np.zeros(size)
        for code in np.flatnonzero(heavy):
            at = order[ends[code] - times[code] : ends[code]]
            ones[at] = 1
            wave = np.fft.rfft(ones)
            power += wave.real**2 + wave.imag**2
            ones[at] = 0
        found += np.rint(np.fft.irfft(power, size)[: most + 1]).astype(np.int64)
    behind = np.repeat(np.where(heavy, 0, ends), times) - np.arange(n) - 1  # equal words after each, in order of words
    behind[behind < 0] = 0
    until = np.cumsum(behind)
    first = 0
    while first < n and until[-1]:
        last = max(first + 1, int(np.searchsorted(until, (until[first - 1] if first else 0) + _PAIRS, "right")))
        many = behind[first:last]
        left = np.repeat(np.arange(first, last), many)
        step = np.arange(len(left)) - np.repeat(np.cumsum(many) - many, many) + 1
        apart = order[left + step] - order[left]
        found += np.bincount(apart[apart <= most], minlength=most + 1)
        first = last
    found[0] = 0
    return found


def _islands(hit: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each stretch of at least `least` true values."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    long = end - start >= least
    return start[long], end[long]


def scan(codes: np.ndarray, lag: int, least: int) -> list[tuple[int, int]]:
    """Islands (start, end) of at least `least` matches in a row at a lag."""
    n = len(codes) - lag
    step = max(1, least // 8)
    if step == 1:
        return list(zip(*(x.tolist() for x in _islands(codes[:n] == codes[lag:], least))))
    at = np.arange(0, n, step)
    found = []
    for a, b in zip(*_islands(codes[at] == codes[at + lag], least // step)):
        low, high = max(0, (int(a) - 1) * step), min(n, int(b) * step + 1)
        found += [(low + s, low + e) for s, e in zip(*(x.tolist() for x in _islands(codes[low:high] == codes[low + lag : high + lag], least)))]
    return found


def runs_of(codes: np.ndarray, min_length: int = 12) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    most = len(codes) // 2
    if len(codes) < min_length or most < 1:
        return []
    left = lag_matches(codes, most)
    lags = np.arange(most + 1)
    least = np.maximum(np.maximum(min_length - lags, lags), 1)
    found: dict[tuple[int, int], int] = {}
    for lag in np.flatnonzero(left >= least).tolist():
        if not lag or left[lag] < least[lag]:
            continue
        for a, b in scan(codes, lag, int(least[lag])):
            if (a, b + lag) not in found:
                found[a, b + lag] = lag
                many = np.arange(2 * lag, min(b + lag - a, most + 1), lag)
                left[many] -= b + lag - a - many
    return sorted((a, b - a, lag) for (a, b), lag in found.items())


def _text(parts: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by one space."""
    if not runs:
        return b" ".join(parts)
    edge = np.zeros(len(parts) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return b" ".join([parts[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)])


def periodic_runs(docs: DataFrame, text_col: str = "text", min_length: int = 12) -> DataFrame:
    """The rows with n_words, runs (an array of start, length and period, by start, then period) and collapsed: the
    words without those that repeat a run's first period. The text itself goes unless it has another of those names."""
    text = fresh(docs, "text_")
    keep = [c for c in docs.columns if c != text_col and c.lower() not in ("n_words", "runs", "collapsed")]
    slim = docs.select(*[F.col(f"`{c}`") for c in keep], F.encode(F.col(f"`{text_col}`"), "UTF-8").alias(text))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, size, rows = 0, 0, []
            column = batch.column(text)
            for i in range(len(column)):
                parts = (column[i].as_py() or b"").split()  # bytes split at ASCII white space alone
                known: dict[bytes, int] = {}
                found = runs_of(np.array([known.setdefault(w, len(known)) for w in parts], np.int64), min_length) if len(parts) >= min_length else []
                rows.append((len(parts), [{"start": s, "length": n, "period": p} for s, n, p in found], _text(parts, found)))
                size += len(rows[-1][2]) + 24 * len(found)
                if size >= _OUT_BYTES or i + 1 == len(column):
                    made = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], kind), pa.array([r[2] for r in rows], pa.binary()).cast(pa.string())]
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(first, len(rows)) for c in keep), *made], names=[*keep, "n_words", "runs", "collapsed"])
                    first, size, rows = i + 1, 0, []

    types = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in slim.schema if f.name in keep)
    return slim.mapInArrow(run, f"{types}n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def planted(text: Column, doc_id: Column) -> Column:
    """The texts that the query searches: a tenth of the documents, chosen by the CRC of the id, repeats a stretch of its
    words up to its end; a null id leaves its text as it is."""
    h = F.crc32(F.encode(doc_id.cast("string"), "UTF-8"))
    g = F.floor(h / 10)

    def again(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, (a + F.pmod(i - a, p)).cast("int")))), " ")

    once = F.transform(F.array(words(text)), again)[0]  # as a variable, the words are split once and not for each word
    return F.when((h % 10 == 0) & (F.size(words(text)) > 0), once).otherwise(text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = periodic_runs(docs.withColumn("text", planted(F.col("text"), F.col("doc_id"))))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
