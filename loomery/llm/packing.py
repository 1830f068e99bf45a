"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Documents longer than a sequence are cut into pieces of full length and a rest; nothing else
is cut. The plan is made over the histogram of piece lengths, not over pieces: at most
`capacity` counts reach the driver, which goes through the lengths from the longest and puts
each count as a whole into the fullest kind of sequence that still has room, splitting a kind
where its count runs out. The plan is a table of ranges: the pieces of length L with ranks a to b
have the sequences from s on, at an offset. Pieces take their slots by joining on their rank
within their length. Ranks are counted in slices of each length (a length may hold most rows), of about
a million rows at most, with offsets from running sums over the slices' counts.

Defined cases: a null or empty text is the separator alone; repeated rows are pieces of their
own; an empty table gives an empty result; a text of any length is tokenised whole; the
input's columns pass through, and the result's replace those of the same name.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomery.llm.byte_pairs import BytePairs
from loomery.llm.common import fresh, written

CAPACITY = 2048
_CACHE = 250_000  # parts of words whose ids a worker remembers; then it starts anew, with these at hand until as many are new
_LONG = 64  # characters; longer parts aren't remembered
_SLICE_BYTES = 2 << 20  # of text tokenised at once
_AT_ONCE = 1 << 20  # characters of words gone through at once


_SIMPLE = re.compile("[\n!-~À-ÖØ-öø-ÿ]*")
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|\n|\0|[^\n\0a-z0-9ß-öø-ÿ]+")


class WordTokens:
    """Ids of words. No token of the vocabulary crosses white space, so a text's ids are those of
    its words. Words of plain letters, digits and marks are lower-cased and parted as the
    tokenizer does, many in one string, and only parts that aren't remembered go through its model, together;
    any other word that isn't remembered goes through the whole tokenizer."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        plain = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 173 or b >= 174]
        others = [b for b in range(256) if b not in plain]
        self.letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}
        self.pairs = BytePairs.of(self.tokenizer, self.letters)
        self.known: dict[str, bytes] = {}  # ids as bytes of int32
        self.older: dict[str, bytes] = {}  # what was known when `known` was full

    def _learn(self, parts: set[str], others: set[str]) -> None:
        """Parts not met before go through the model, other words through the whole tokenizer."""
        known, older = self.known, self.older
        new = []
        for part in parts:
            ids = older.get(part)
            if ids is None:
                new.append(part)
            else:
                known[part] = ids
        slow = [p for p in new if p in others or len(p) > _LONG or not self.pairs]
        for part in slow:
            if part in others:
                ids = self.tokenizer.encode(part, add_special_tokens=False).ids
            else:
                ids = [x.id for x in self.tokenizer.model.tokenize(part.encode().decode("latin-1").translate(self.letters))]
            known[part] = np.array(ids, dtype=np.int32).tobytes()
        if slow:
            new = list(set(new).difference(slow))
        if new:
            ids, counts = self.pairs.ids(new)
            raw, ends = ids.tobytes(), (4 * np.cumsum(counts)).tolist()
            known |= {p: raw[a:b] for p, a, b in zip(new, [0, *ends], ends)}

    def _words(self, lines: str) -> tuple[bytes, np.ndarray]:
        """The ids of a word per line, and how many each has."""
        others: list[str] = []
        if not _SIMPLE.fullmatch(lines) or "<|" in lines:
            words = lines.split("\n")
            for i, word in enumerate(words):
                if not _SIMPLE.fullmatch(word) or "<|" in word:
                    others.append(word)
                    words[i] = "\0"
            lines = "\n".join(words)
        parts = _PARTS.findall(lines.lower())
        if others:
            rest = iter(others)
            parts = [next(rest) if p == "\0" else p for p in parts]
        if len(self.known) >= _CACHE:
            self.older, self.known = self.known, {}
        known = self.known
        known["\n"] = b""  # ends a word
        ids = list(map(known.get, parts))
        holes = [i for i, x in enumerate(ids) if x is None]
        if holes:
            unknown = {parts[i] for i in holes}
            self._learn(unknown, set(others))
            for i in holes:
                ids[i] = known[parts[i]]
            for part in unknown:
                if len(part) > _LONG:
                    del known[part]
        upto = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids))) // 4
        ends = np.array([i for i, p in enumerate(parts) if p == "\n"], dtype=np.int64)
        total = upto[-1:] if len(upto) else np.zeros(1, np.int64)
        return b"".join(ids), np.diff(np.append(upto[ends], total), prepend=0)

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one behind another, and how many each has."""
        lines = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), "\n")[0].as_py()
        flat, lengths, at = [], [], 0
        while at <= len(lines):  # so many characters at once, however many a text has
            to = lines.find("\n", at + _AT_ONCE)
            to = len(lines) if to < 0 else to
            ids, n = self._words(lines[at:to])
            flat.append(ids)
            lengths.append(n)
            at = to + 1
        return np.frombuffer(b"".join(flat), dtype=np.int32), np.concatenate(lengths)

    def texts(self, texts: pa.Array, separator: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with the separator behind it, and how many each has."""
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        flat, lengths = self.words(coded.dictionary)
        flat, lengths = np.append(flat, np.int32(separator)), np.append(lengths, 1).astype(np.int32)
        starts = (np.cumsum(lengths, dtype=np.int64) - lengths).astype(np.int32)
        n_words = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(n_words)
        codes = np.insert(coded.indices.to_numpy(), ends, len(lengths) - 1)
        each = lengths[codes]
        upto = np.cumsum(each, dtype=np.int64)
        at = np.repeat((starts[codes] - (upto - each)).astype(np.int32), each) + np.arange(upto[-1], dtype=np.int32)
        last = ends + np.arange(len(ends))  # where the separators are
        return flat[at], np.diff(upto[last], prepend=0)


def _crcs(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """crc32 of the ids from each end to the next, as little-endian unsigned 32-bit integers."""
    raw = memoryview(ids.astype("<u4").tobytes())
    return pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends.tolist(), ends[1:].tolist())], pa.int64())


_TOKENS: dict[str, WordTokens] = {}  # of this worker, so that later tasks know the words of earlier ones


def tokenised(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, separator: int = 0, text_col: str = "text", crc: bool = False) -> DataFrame:
    """A row per piece: the input's columns but the text, then piece, start, length and ids, or with crc
    their ids_crc32 alone, so that no ids leave the Python worker for it."""
    text = fresh(docs, "text_")
    made = ("piece", "start", "length", "ids_crc32" if crc else "ids")
    keep = [c for c in docs.columns if c != text_col and c.lower() not in made]
    slim = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _TOKENS.get(tokenizer_path) or _TOKENS.setdefault(tokenizer_path, WordTokens(tokenizer_path))
        for whole in batches:
            sizes = np.cumsum(pc.binary_length(whole.column(text)).to_numpy(zero_copy_only=False))
            at = 0
            while at < len(whole):  # slices of some MB
                to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + _SLICE_BYTES)))
                batch = whole.slice(at, to - at)
                at = to
                ids, counts = tokens.texts(batch.column(text), separator)
                n_pieces = -(-counts // capacity)
                rows = np.repeat(np.arange(len(counts)), n_pieces)
                piece = np.arange(len(rows)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
                start = piece * capacity
                length = np.minimum(capacity, counts[rows] - start)
                ends = np.concatenate([[0], np.cumsum(length)])
                last = _crcs(ids, ends) if crc else pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))
                cols = [batch.column(c).take(pa.array(rows)) for c in keep]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), last], names=[*keep, *made])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema if f.name in keep)
    return slim.mapInArrow(run, f"{types + ', ' if types else ''}piece int, start long, length long, {'ids_crc32 long' if crc else 'ids array<int>'}")


def best_fit_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Ranges (length, first rank, count, first sequence, offset) that place every piece. Kinds of
    sequences with equal room are kept as ranges of sequence numbers, never one by one."""
    room: dict[int, list[tuple[int, int]]] = {}  # room left: ranges (first sequence, count)
    spaces = np.zeros(capacity + 1, dtype=bool)
    plan, opened = [], 0
    for length in sorted(histogram, reverse=True):
        rank, todo = 0, histogram[length]
        while todo:
            fits = np.flatnonzero(spaces[length:])
            if not len(fits):  # as many new sequences as are needed, filled with this length
                each = capacity // length
                full, rest = divmod(todo, each)
                for n, per in ((full, each), (1 if rest else 0, rest)):
                    if n:
                        for j in range(per):
                            plan.append((length, rank, n, opened, j * length))
                            rank += n
                        left = capacity - per * length
                        if left:
                            room.setdefault(left, []).append((opened, n))
                            spaces[left] = True
                        opened += n
                break
            space = length + int(fits[0])
            first, n = room[space].pop()
            if not room[space]:
                del room[space]
                spaces[space] = False
            use = min(n, todo)
            if use < n:
                room.setdefault(space, []).append((first + use, n - use))
                spaces[space] = True
            plan.append((length, rank, use, first, capacity - space))
            rank += use
            todo -= use
            if space > length:
                room.setdefault(space - length, []).append((first, use))
                spaces[space - length] = True
    return plan


def pack(pieces: DataFrame, capacity: int = CAPACITY, slices: int | None = None, order: tuple[str, ...] = ()) -> DataFrame:
    """Adds sequence_id and offset to rows that have a length of at most capacity. order: the
    columns that name a row (all by default); rows equal in them take places in any order."""
    spark = pieces.sparkSession
    keep = [c for c in pieces.columns if c.lower() not in ("sequence_id", "offset")]
    names = [f"`{c}`" for c in order or keep]
    slice_, rank, length, at, start = (fresh(pieces, x) for x in ("slice_", "rank_", "of_length_", "at_", "start_"))
    slices = slices or max(64, pieces.count() >> 20)
    df = pieces.select(*[F.col(f"`{c}`") for c in keep]).withColumn(slice_, F.pmod(F.xxhash64(*names), F.lit(slices)).cast("int"))
    counts = written(df.groupBy(F.col("length").alias(length), F.col(slice_).alias(at)).agg(F.count(F.lit(1)).alias("n")), "lengths")
    histogram = dict(counts.groupBy(length).agg(F.sum("n")).collect())
    plan = best_fit_plan(histogram, capacity)
    # the plan of a length, as arrays to look a rank up in: ranges are in the order of their ranks
    ranges: dict[int, tuple[list, list, list]] = {}
    for n, first, _, sequence, offset in plan:
        for to, v in zip(ranges.setdefault(n, ([], [], [])), (first, sequence, offset)):
            to.append(v)
    starts = counts.select(length, at, (F.sum("n").over(W.partitionBy(length).orderBy(at)) - F.col("n")).alias(start))
    ranked = df.withColumn(rank, F.row_number().over(W.partitionBy("length", slice_).orderBy(*names)) - 1)
    ranked = ranked.join(starts, (F.col("length") == F.col(length)) & (F.col(slice_) == F.col(at)))
    ranked = ranked.withColumn(rank, F.col(rank) + F.col(start))

    @F.pandas_udf("struct<sequence_id long, offset long>")
    def place(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        table = shared.value
        n, at = lengths.to_numpy(), ranks.to_numpy()
        seq, off = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
        for one in np.unique(n):
            first, sequence, offset = table[int(one)]
            mine = n == one
            i = np.searchsorted(first, at[mine], side="right") - 1
            seq[mine], off[mine] = sequence[i] + at[mine] - first[i], offset[i]
        return pd.DataFrame({"sequence_id": seq, "offset": off})

    shared = spark.sparkContext.broadcast({n: tuple(np.array(x, dtype=np.int64) for x in r) for n, r in ranges.items()})
    out = ranked.withColumn(rank, place(F.col("length").cast("long"), F.col(rank).cast("long")))
    return out.select(*[F.col(f"`{c}`") for c in keep], F.col(rank)["sequence_id"].alias("sequence_id"), F.col(rank)["offset"].alias("offset"))


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset for each piece."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return pack(written(tokenised(slim, tokenizer_path, crc=True), "pieces"), order=("doc_id", "piece", "length", "ids_crc32"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
