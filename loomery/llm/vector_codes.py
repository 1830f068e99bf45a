"""Product codes of vectors, trained by Lloyd's rounds with the filtering algorithm.

A vector of integers (each component scaled and floored) is cut into equal consecutive parts, and each part
position has a codebook. In every round a partition cuts its rows into chunks and builds a kd-tree over the chunk's
parts, one tree for each position: nodes have a bounding box, a count and the sums of their parts. Going
down a tree, the entries that are nowhere nearest inside a node's box are eliminated; where one entry is left, the
whole subtree is assigned to it by its cached sums. Only what reaches a leaf with several entries is
compared part by part. All is integer arithmetic, so that results don't depend on chunks or on the order of rows.

What a task returns is a count and sums for each entry of each position; these are added up by Spark, and
parts x entries rows reach the driver, a number that doesn't grow with the table. The codebooks that
go back to the tasks have the same bound. Trees are built again in each pass, as a task can't rely on what another one left in
a worker; memory is that of one chunk. Errors of equal labels are summed in each task before the
shuffle and joined back, so that a hot label is a row on one side of an ordinary join.

Defined cases: rows whose vector is null, empty, or holds null or non-finite components take no part, and so do
vectors of another length than that of the first row by id; a length that parts doesn't divide raises, and so do components that
beyond 2^27 in size after scaling would overflow the sums of squares. Null ids come last in order; rows of equal id are ordered by their
vectors and all count. With fewer rows than entries the codebooks are shorter. Null labels are one
label. An empty table gives an empty result. Other columns pass through; those named code, error, label_error and
codebooks_sha256 are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.llm.common import forget, fresh, written

_LEAF = 16
_MOST = 1 << 27


class Tree:
    """A kd-tree over integer points, level by level: level l has 2^l nodes, cut at equal ranks."""

    def __init__(self, points: np.ndarray) -> None:
        n = len(points)
        self.order = np.arange(n)
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # where nodes start, boxes' corners
        depth = max(0, int(n // _LEAF).bit_length() - 1)
        for level in range(depth + 1):
            starts = (n * np.arange((1 << level) + 1)) >> level
            here = points[self.order]
            low, high = np.minimum.reduceat(here, starts[:-1]), np.maximum.reduceat(here, starts[:-1])
            self.levels.append((starts, low, high))
            if level < depth:
                node = np.repeat(np.arange(1 << level), np.diff(starts))
                widest = (high - low).argmax(1)
                self.order = self.order[np.lexsort((here[np.arange(n), widest[node]], node))]
        self.points = points[self.order]
        self.sums = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(self.points, 0)])

    def assign(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, entry) of the stretches of `order` that have one nearest entry as a whole, and (place, entry) of the other points."""
        norm = (book * book).sum(1)
        number = np.arange(len(book))
        nodes, open_ = np.zeros(1, np.int64), np.ones((1, len(book)), bool)
        done = []
        for level, (starts, low, high) in enumerate(self.levels):
            lo, hi = low[nodes], high[nodes]
            to_middle = ((lo + hi)[:, None, :] - 2 * book[None]) ** 2
            best = np.where(open_, to_middle.sum(2), np.iinfo(np.int64).max).argmin(1)
            away = book[None] - book[best][:, None, :]
            # the largest that |x - best|^2 - |x - entry|^2 gets inside the box
            most = 2 * (np.where(away > 0, hi[:, None, :], lo[:, None, :]) * away).sum(2) + norm[best][:, None] - norm[None]
            open_ &= (most > 0) | ((most == 0) & (number[None] <= best[:, None]))
            one = open_.sum(1) == 1
            done.append((starts[nodes[one]], starts[nodes[one] + 1], open_[one].argmax(1)))
            nodes, open_ = nodes[~one], open_[~one]
            if level + 1 < len(self.levels):
                nodes = np.concatenate([2 * nodes, 2 * nodes + 1])
                open_ = np.concatenate([open_, open_])
        start, end, entry = (np.concatenate(x) for x in zip(*done))
        starts = self.levels[-1][0]
        many = starts[nodes + 1] - starts[nodes]
        of = np.repeat(np.arange(len(nodes)), many)
        place = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many) + starts[nodes][of]
        apart = ((self.points[place][:, None, :] - book[None]) ** 2).sum(2)
        return start, end, entry, place, np.where(open_[of], apart, np.iinfo(np.int64).max).argmin(1)

    def totals(self, book: np.ndarray) -> np.ndarray:
        """For each entry, the count and the sums of the points nearest to it."""
        start, end, entry, place, nearest = self.assign(book)
        out = np.zeros((len(book), 1 + book.shape[1]), np.int64)
        np.add.at(out, entry, np.column_stack([end - start, self.sums[end] - self.sums[start]]))
        np.add.at(out, nearest, np.column_stack([np.ones(len(place), np.int64), self.points[place]]))
        return out

    def nearest(self, book: np.ndarray) -> np.ndarray:
        """The nearest entry of each point, in the points' own order."""
        start, end, entry, place, nearest = self.assign(book)
        sorted_ = np.zeros(len(self.points), np.int64)
        many = end - start
        sorted_[np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(start, many)] = np.repeat(entry, many)
        sorted_[place] = nearest
        out = np.empty_like(sorted_)
        out[self.order] = sorted_
        return out


def whole_numbers(vectors: np.ndarray, scale: int) -> np.ndarray:
    scaled = np.floor(scale * vectors.astype(np.float64))
    if scaled.size and np.abs(scaled).max() > _MOST:
        raise ValueError(f"a component is beyond {_MOST} in size after scaling: its squares don't fit")
    return scaled.astype(np.int64)


def _matrix(column: pa.Array, dims: int, scale: int) -> np.ndarray:
    return whole_numbers(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims), scale)


def finite(vector: Column) -> Column:
    """Whether a vector has components, all of them finite numbers."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))


def _chunks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The rows of a partition, so many at a time."""
    held, n = [], 0
    for batch in batches:
        while len(batch):
            held.append(batch.slice(0, rows - n))
            n += len(held[-1])
            batch = batch.slice(len(held[-1]))
            if n == rows:
                yield pa.Table.from_batches(held).combine_chunks()
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


class Codebooks:
    """What training finds: for each part position an array of entries x components."""

    def __init__(self, books: np.ndarray, scale: int, tree_rows: int) -> None:
        self.books, self.scale, self.tree_rows = books, scale, tree_rows
        self.parts, self.entries, self.width = books.shape

    @property
    def dims(self) -> int:
        return self.parts * self.width

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()

    def round(self, vectors: DataFrame) -> Codebooks:
        """One assignment of every part, and each used entry's new place."""
        books, scale, tree_rows = self.books, self.scale, self.tree_rows

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((*books.shape[:2], books.shape[2] + 1), np.int64)
            for chunk in _chunks(batches, tree_rows):
                points = _matrix(chunk.column(0).chunk(0), books.shape[0] * books.shape[2], scale)
                for part, mine in enumerate(np.split(points, len(books), 1)):
                    out[part] += Tree(mine).totals(books[part])
            part, entry = np.nonzero(out[:, :, 0])
            for k in range(out.shape[2]):
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(np.full(len(part), k), pa.int32()), pa.array(out[part, entry, k], pa.int64())], names=["part", "entry", "k", "total"])

        found = vectors.mapInArrow(sums, "part int, entry int, k int, total long").groupBy("part", "entry", "k").agg(F.sum("total").alias("total"))
        totals = np.zeros((*books.shape[:2], books.shape[2] + 1), np.int64)
        for r in found.collect():  # at most parts x entries x (width + 1)
            totals[r["part"], r["entry"], r["k"]] = r["total"]
        count = totals[:, :, :1]
        return Codebooks(np.where(count > 0, totals[:, :, 1:] // np.maximum(count, 1), books), scale, tree_rows)

    def encode(self, rows: DataFrame, vector: str) -> DataFrame:
        """The rows without their vector, with code (two hex digits for each part) and error."""
        keep = [c for c in rows.columns if c != vector and c.lower() not in ("code", "error")]
        books, scale, tree_rows, dims = self.books, self.scale, self.tree_rows, self.dims

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for chunk in _chunks(batches, tree_rows):
                points = _matrix(chunk.column(vector).chunk(0), dims, scale)
                codes, error = np.empty((len(points), len(books)), np.uint8), np.zeros(len(points), np.int64)
                for part, mine in enumerate(np.split(points, len(books), 1)):
                    near = Tree(mine).nearest(books[part])
                    codes[:, part] = near
                    error += ((mine - books[part][near]) ** 2).sum(1)
                digits, each = codes.tobytes().hex(), 2 * len(books)
                made = [pa.array([digits[i : i + each] for i in range(0, len(digits), each)], pa.string()), pa.array(error)]
                yield from pa.table([*(chunk.column(c) for c in keep), *made], names=[*keep, "code", "error"]).to_batches()

        types = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema if f.name in keep)
        slim = rows.select(*[F.col(f"`{c}`") for c in [*keep, vector]])
        return slim.mapInArrow(run, f"{types}code string, error long")


def train(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, tree_rows: int = 16_384) -> Codebooks | None:
    """Codebooks after so many rounds over all rows, from the parts of the rows with the smallest ids. None without rows."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits for each part: 1 to 256 entries")
    good = vectors.where(finite(F.col(f"`{vector_col}`"))).select(F.col(f"`{vector_col}`").alias("v"), F.col(f"`{id_col}`").alias("i"))
    first = good.orderBy(F.col("i").asc_nulls_last(), "v").select("v").limit(1).collect()
    if not first:
        return None
    dims = len(first[0]["v"])
    if dims % parts:
        raise ValueError(f"{dims} components can't be cut into {parts} equal parts")
    good = good.where(F.size("v") == dims)
    start = good.orderBy(F.col("i").asc_nulls_last(), "v").select("v").limit(entries).collect()
    books = whole_numbers(np.array([r["v"] for r in start], np.float64), scale).reshape(len(start), parts, dims // parts).transpose(1, 0, 2)
    found = Codebooks(np.ascontiguousarray(books), scale, tree_rows)
    for _ in range(rounds):
        found = found.round(good.select("v"))
    return found


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", **options) -> DataFrame:
    """The rows without their vector, with code, error, label_error (the error summed over rows of equal label) and codebooks_sha256."""
    made = ("code", "error", "label_error", "codebooks_sha256")
    keep = [c for c in vectors.columns if c != vector_col and c.lower() not in made]
    books = train(vectors, id_col, vector_col, **options)
    if books is None:
        none = [F.lit(None).cast(t).alias(c) for c, t in zip(made, ("string", "long", "long", "string"))]
        return vectors.limit(0).select(*[F.col(f"`{c}`") for c in keep], *none)
    vector = fresh(vectors, "vector_")
    good = vectors.where(finite(F.col(f"`{vector_col}`")) & (F.size(F.col(f"`{vector_col}`")) == books.dims))
    coded = written(books.encode(good.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{vector_col}`").alias(vector)), vector), "vector-codes")
    of = fresh(coded, "label_of_")
    sums = coded.groupBy(F.col(f"`{label_col}`").alias(of)).agg(F.sum("error").alias("label_error"))
    joined = coded.join(sums, F.col(f"`{label_col}`").eqNullSafe(F.col(of)))
    return joined.select(*[F.col(f"`{c}`") for c in [*keep, "code", "error"]], "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    return vector_codes(vectors).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _sql() -> str:
    """Two rounds and a last assignment as plain SQL: every part against every entry of its codebook."""
    steps = []
    for k in range(3):
        steps.append(f"""a{k} AS MATERIALIZED (
  SELECT r, part, min(list_sum(list_transform(list_zip(x, e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT * 64 + entry) AS m
  FROM p JOIN c{k} USING (part) GROUP BY r, part)""")
        if k < 2:
            steps.append(f"""s{k} AS (
  SELECT part, entry, i, sum(y) AS s, count(*) AS n FROM (
    SELECT part, (m % 64)::INTEGER AS entry, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM a{k} JOIN p USING (r, part)) GROUP BY part, entry, i
), n{k} AS (
  SELECT part, entry, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS e FROM s{k} GROUP BY part, entry
), c{k + 1} AS MATERIALIZED (
  SELECT part, entry, coalesce(n{k}.e, c{k}.e) AS e FROM c{k} LEFT JOIN n{k} USING (part, entry))""")
    return f"""
WITH k AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS MATERIALIZED (
  SELECT r, part, v[part * (len(v) // 16) + 1 : (part + 1) * (len(v) // 16)] AS x FROM k, (SELECT unnest(range(16))::INTEGER AS part)
), c0 AS MATERIALIZED (
  SELECT part, (r - 1)::INTEGER AS entry, x AS e FROM p WHERE r <= 64
), {", ".join(steps)}, t AS (
  SELECT r, string_agg(printf('%02x', (m % 64)::INTEGER), '' ORDER BY part) AS code, sum(m // 64)::BIGINT AS error FROM a2 GROUP BY r
), h AS (
  SELECT sha256(string_agg(y, ',' ORDER BY part, entry)) AS codebooks_sha256 FROM (SELECT part, entry, array_to_string(e, ',') AS y FROM c2)
)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
FROM t JOIN k USING (r), h
"""


SQL = _sql()
