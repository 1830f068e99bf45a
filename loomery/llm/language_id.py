"""Language identification by cross-parsing entropy.

A suffix automaton of labelled text per language gives, from any place of a text, the longest
match that the language's sample holds. A text is parsed greedily into such matches, and the language
that needs the fewest phrases, normalised by the bits that one phrase costs and by the
text's length, wins. All texts of a batch step through all automata at once, as lanes of
arrays. A lane is a block of a text; where a phrase goes over the end of its block, the next block is
gone through again from there, so that the phrases are those of the whole text. While the automata's states times the letters of all
samples are few, their steps are one dense table. With scripts of thousands of letters they are a hashed table of edges, whose size is
that of the edges alone.

The sample that is learnt is bounded: at most `train_chars` characters for each language,
in windows of at most `window` characters at a seeded place of some `train_docs` seeded
documents. Everything else covers all rows and whole texts.

Defined cases: null texts and those without a letter are `und` with score 0; ties go to the
first language by code point; no labelled text at all makes every row `und`; repeated rows
get equal results; an empty table gives an empty result; other columns pass through, and
those named lang_pred and score are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.llm.common import fresh

_OTHER = re.compile(r"[\W\d_]+")
_BLOCK = 1024
_SLICE_CHARS = 4 << 20


def plain(text: str | None) -> str:
    """Lower case, with one space for whatever isn't a letter."""
    return _OTHER.sub(" ", text.lower()).strip() if text else ""


def suffix_automaton(text: str) -> list[dict[str, int]]:
    """The transitions of each state; state 0 is the root."""
    step: list[dict[str, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        now = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = now
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[now] = q
            else:
                clone = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = clone
                    p = link[p]
                link[q] = link[now] = clone
        last = now
    return step


class CrossParser:
    """The automata of all languages as one table of steps, for arrays of states. A step that isn't there ends a phrase (a negative entry) and
    starts at the root."""

    def __init__(self, samples: dict[str, str], dense: int = 32 << 20):
        self.languages = sorted(samples)
        self.bits = np.array([np.log2(max(2, len(samples[x]))) for x in self.languages])
        letters = sorted(set("".join(samples.values())))
        width = len(letters) + 1  # code 0: a character that no sample has
        self.code = np.zeros(0x110000, dtype=np.int32)
        for i, c in enumerate(letters, 1):
            self.code[ord(c)] = i
        steps = [[{int(self.code[ord(c)]): to for c, to in out.items()} for out in suffix_automaton(samples[x])] for x in self.languages]
        self.owner = None
        if sum(map(len, steps)) * width <= dense:
            self._dense(steps, width)
        else:
            self._sparse(steps, width)

    def _dense(self, steps: list[list[dict[int, int]]], width: int) -> None:
        tables, self.roots, at = [], [], 0
        for step in steps:
            table = np.zeros((len(step), width), dtype=np.int32)
            root = np.full(width, at, dtype=np.int32)
            for c, to in step[0].items():
                root[c] = at + to * width
            table[:] = ~root
            for s, out in enumerate(step):
                for c, to in out.items():
                    table[s, c] = at + to * width
            tables.append(table.ravel())
            self.roots.append(at)
            at += table.size
        self.table = np.concatenate(tables) if tables else np.zeros(0, np.int32)

    def _sparse(self, steps: list[list[dict[int, int]]], width: int) -> None:
        """Edges in a table by hash of state and code, at most half full; states are numbered through."""
        self.width, self.roots, keys, values, at = width, [], [], [], 0
        self.end = np.empty((len(steps), width), dtype=np.int32)
        for k, step in enumerate(steps):
            keys += [(at + s) * width + c for s, out in enumerate(step) for c in out]
            values += [at + to for out in step for to in out.values()]
            self.end[k] = ~at
            for c, to in step[0].items():
                self.end[k, c] = ~(at + to)
            self.roots.append(at)
            at += len(step)
        self.shift = 63 - int(max(1, len(keys))).bit_length()
        self.owner = np.full(1 << (64 - self.shift), -1, dtype=np.int64)
        self.table = np.zeros(len(self.owner), dtype=np.int32)
        left, to = np.array(keys, dtype=np.int64), np.array(values, dtype=np.int32)
        cell = self._cell(left)
        while len(left):  # those that find their cell free, one for each, and the others one cell further
            cell, first = (x[np.argsort(cell, kind="stable")] for x in (cell, np.arange(len(left))))
            left, to = left[first], to[first]
            put = (self.owner[cell] < 0) & np.concatenate([[True], cell[1:] != cell[:-1]])
            self.owner[cell[put]], self.table[cell[put]] = left[put], to[put]
            left, to, cell = left[~put], to[~put], (cell[~put] + 1) & (len(self.owner) - 1)

    def _cell(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(self.shift)).astype(np.int64)

    def step(self, lang: int | np.ndarray, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        if self.owner is None:
            return self.table[state + code]
        key = state.astype(np.int64) * self.width + code
        cell = self._cell(key)
        held = self.owner[cell]
        out = np.where(held == key, self.table[cell], self.end[lang, code])
        on = np.flatnonzero((held != key) & (held >= 0))
        while len(on):  # another edge's cell: look into the next one
            cell[on] = (cell[on] + 1) & (len(self.owner) - 1)
            held = self.owner[cell[on]]
            right = on[held == key[on]]
            out[right] = self.table[cell[right]]
            on = on[(held != key[on]) & (held >= 0)]
        return out

    def _parse(self, grid: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many phrases end in each lane (a column of codes) and the state behind it, by language, from the roots."""
        state = np.repeat(np.array(self.roots, dtype=np.int32)[:, None], len(lengths), axis=1)
        count = np.zeros((len(self.languages), len(lengths)), dtype=np.int32)
        active = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")
        for t, n in enumerate(active.tolist()):
            for k in range(len(self.languages)):
                to = self.step(k, state[k, :n], grid[t, :n])
                ends = to >> 31  # all bits of a step that ended a phrase
                count[k, :n] -= ends
                state[k, :n] = to ^ ends
        return count, state

    def phrases(self, texts: list[str]) -> np.ndarray:
        """For each text and language the number of phrases of the whole text. Blocks of a text are parsed side by side as if a
        phrase started with each; then each is gone through again from the state that the block before really left, until
        both parses are in one state. Where they never are, the next block follows."""
        codes = [self.code[np.frombuffer(t.encode("utf-32-le", "replace"), dtype="<u4")] for t in texts]
        blocks = [(i, c[k : k + _BLOCK]) for i, c in enumerate(codes) for k in range(0, len(c), _BLOCK)]
        out = np.zeros((len(texts), len(self.languages)))
        if not blocks:
            return out
        order = sorted(range(len(blocks)), key=lambda j: -len(blocks[j][1]))
        rank = np.empty(len(blocks), dtype=np.int64)
        rank[order] = np.arange(len(blocks))
        of = np.array([blocks[j][0] for j in order], dtype=np.int64)
        lengths = np.array([len(blocks[j][1]) for j in order], dtype=np.int64)
        grid = np.zeros((lengths[0], len(blocks)), dtype=np.int32)
        for lane, j in enumerate(order):
            grid[: lengths[lane], lane] = blocks[j][1]
        count, end = self._parse(grid, lengths)
        roots = np.array(self.roots, dtype=np.int32)
        # the block behind each, in lanes
        after = np.full(len(blocks), -1, dtype=np.int64)
        same = np.array([blocks[j][0] == blocks[j + 1][0] for j in range(len(blocks) - 1)], dtype=bool)
        after[rank[:-1][same]] = rank[1:][same]
        lane = np.tile(after[after >= 0], len(roots))
        lang = np.repeat(np.arange(len(roots)), int((after >= 0).sum()))
        used = np.zeros(count.shape, dtype=np.int32)  # the state from which a block was gone through last
        used[:, after[after >= 0]] = end[:, after >= 0]
        left = end.copy()  # the state that the real parse leaves
        more = np.zeros(count.shape, dtype=np.int64)  # phrases that the real parse has more
        while len(lane):
            more[lang, lane] = 0
            done, guess, real, t = (lang, lane), roots[lang].copy(), used[lang, lane], 0
            left[done] = end[done]
            while len(lane):
                apart = guess != real
                over = apart & (lengths[lane] <= t)
                left[lang[over], lane[over]] = real[over]
                go = apart & ~over
                lane, lang = lane[go], lang[go]
                to, true = (self.step(lang, x[go], grid[t, lane]) if len(lane) else x[go] for x in (guess, real))
                np.add.at(more, (lang, lane), (to >> 31) - (true >> 31))
                guess, real, t = to ^ (to >> 31), true ^ (true >> 31), t + 1
            lang, lane = done
            behind = after[lane]
            again = (behind >= 0) & (used[lang, behind] != left[lang, lane])
            lang, lane, start = lang[again], behind[again], left[lang[again], lane[again]]
            used[lang, lane] = start
        count = count + more
        for k in range(len(self.languages)):
            out[:, k] = np.bincount(of, weights=count[k], minlength=len(texts)) + (np.bincount(of, minlength=len(texts)) > 0)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, scores = [], np.zeros(len(texts))
        clean = [plain(t) for t in texts]
        cost = self.phrases(clean) * self.bits
        for i, t in enumerate(clean):
            if not self.languages or not any(map(str.isalpha, t)):
                names.append("und")
                continue
            best = int(np.argmin(cost[i]))
            names.append(self.languages[best])
            rest = np.delete(cost[i], best)
            scores[i] = 1.0 if not len(rest) else 1 - cost[i][best] / rest.min()
        return names, scores


def samples(labelled: DataFrame, train_chars: int, train_docs: int, window: int, seed: int) -> dict[str, str]:
    """Bounded text for each language of (id, text, lang)."""
    known = labelled.where("text is not null and lang is not null")
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    rate = F.lit(0.0)
    for lang, n in counts.items():
        rate = F.when(F.col("lang") == lang, min(1.0, 2 * train_docs / n)).otherwise(rate)
    h = F.xxhash64(F.lit(seed), F.col("id").cast("string"))
    drawn = known.where(F.pmod(h, F.lit(1 << 30)) < rate * (1 << 30))
    start = F.pmod(F.shiftright(h, 32), F.greatest(F.lit(1), F.length("text") - window))
    rows = drawn.select("lang", h.alias("h"), F.substring(F.col("text"), (start + 1).cast("int"), F.lit(window)).alias("text")).collect()
    out: dict[str, str] = {}
    for lang in counts:
        parts = dict.fromkeys(plain(r["text"]) for r in sorted((r for r in rows if r["lang"] == lang), key=lambda r: (r["h"], r["text"])))
        text = " ".join(p for p in list(parts)[:train_docs] if p)[:train_chars]
        if text:
            out[lang] = text
    return out


_PARSERS: dict[int, CrossParser] = {}  # of this worker


def identify(docs: DataFrame, labelled: DataFrame, text_col: str = "text", train_chars: int = 40_000, train_docs: int = 100, window: int = 500, seed: int = 3) -> DataFrame:
    """The rows with lang_pred and score. labelled has id, text and lang; docs' own label isn't read."""
    found = docs.sparkSession.sparkContext.broadcast(samples(labelled, train_chars, train_docs, window, seed))
    text = fresh(docs, "text_")
    keep = [c for c in docs.columns if c != text_col and c.lower() not in ("lang_pred", "score")]
    slim = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = hash(tuple(sorted(found.value.items())))
        if mark not in _PARSERS:
            _PARSERS.clear()
            _PARSERS[mark] = CrossParser(found.value)
        parser = _PARSERS[mark]
        for batch in batches:
            texts = batch.column(text).to_pylist()
            at = 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size < _SLICE_CHARS):
                    size += len(texts[to] or "")
                    to += 1
                names, scores = parser.predict(texts[at:to])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(at, to - at) for c in keep), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"])
                at = to

    types = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in slim.schema if f.name in keep)
    return slim.mapInArrow(run, f"{types}lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    learn = docs.where(~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("id"), "text", "lang")
    return identify(docs.select("doc_id", "text"), learn).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
