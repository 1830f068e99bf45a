"""Approximate nearest neighbours by cosine: an adaptive scan of dimensions within probed lists.

Vectors are scaled to length one and turned by one random rotation, so that every stretch of dimensions holds a
fair share of a distance. They are dealt to lists by their nearest centroid and stored in blocks, dimension by
dimension. A query meets the blocks of the lists that it probes and adds up distances a few columns at a time.
After each, a hypothesis test compares what has been added up, scaled to all dimensions, with the
query's bound: a candidate whose partial distance is too large by more than `sure` standard errors is abandoned.
While many are left, distances come from matrix products; once few are, from those pairs alone. Survivors get
their exact cosine in double precision from the original vectors.

The index is fitted on a bounded sample (`sample_rows` distinct vectors, a quarter of the table at most but for tiny ones): centroids
from one half of it, and from the other half the number of lists to probe, the smallest with which that half's own neighbours are found at `target_recall`. The sample
itself is the one list that every query scans; it gives each query its first bound, which can only be too
wide. All other vectors are in the lists' blocks. Centroids and sample are what is broadcast: at most `max_lists` and
`sample_rows` vectors.

Equal vectors are one entry with their smallest ids: of a group of copies only the k + 1 smallest ids can
be among the k nearest of anything, so that a very common vector is neither a hot key nor a quadratic join. Lists of more than
`list_rows` vectors are split, and the queries that probe them are given to each split.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do those of another
length than the first row's by id, nor rows without an id, which no result could name. Rows of equal id and vector are one row; an id
with several vectors is a candidate, and a query, with each, and never its own neighbour. Ties go to the smaller id. With fewer candidates all are returned; empty tables give an
empty result; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomery.llm.common import written
from loomery.llm.vector_codes import finite

_COLUMNS = 8  # dimensions that are added up between two tests
_SLACK = 1e-5  # of squared distances in single precision
_PAIRS = 1 << 16  # exact cosines at once
_NONE = np.iinfo(np.int64).max


def units(vectors: np.ndarray) -> np.ndarray:
    wide = vectors.astype(np.float64)
    return wide / np.sqrt((wide * wide).sum(1))[:, None]


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision, so that equal rows have equal results."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def adaptive_scan(queries: np.ndarray, columns: np.ndarray, bound: np.ndarray, sure: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (query, candidate, squared distance) whose distance may be within the query's bound. columns has a row for each dimension."""
    dims, n = columns.shape
    so_far = np.zeros((len(queries), n), np.float32)
    pairs = None
    for at in range(0, dims, _COLUMNS):
        to = min(dims, at + _COLUMNS)
        most = bound * (to / dims) * (1 + sure / np.sqrt(to)) ** 2 if to < dims else bound
        most = (most + _SLACK).astype(np.float32)
        if pairs is None:
            mine, theirs = queries[:, at:to], columns[at:to]
            so_far += (mine * mine).sum(1)[:, None] + (theirs * theirs).sum(0)[None] - 2 * (mine @ theirs)
            left = so_far <= most[:, None]
            if to == dims or 16 * np.count_nonzero(left) < left.size:
                pairs = np.nonzero(left)
                so_far = so_far[pairs]
        else:
            q, x = pairs
            so_far = so_far + ((queries[q, at:to] - columns[at:to, x].T) ** 2).sum(1)
            left = so_far <= most[q]
            pairs, so_far = (q[left], x[left]), so_far[left]
    return (*pairs, so_far)


def nearest_ids(queries: np.ndarray, vectors: np.ndarray, ids: np.ndarray, q: np.ndarray, x: np.ndarray, apart: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs, each query's k best (query, cosine, id) by exact cosine, then id. ids has a row of ids for each vector."""
    if not len(q):
        return q, np.zeros(0), np.zeros(0, np.int64)
    order = np.lexsort((apart, q))
    q, x, apart = q[order], x[order], apart[order]
    first = np.searchsorted(q, q)
    end = np.searchsorted(q, q, "right")
    near = apart <= apart[np.minimum(first + k, end) - 1] + _SLACK
    q, x = q[near], x[near]
    score = np.concatenate([cosines(queries[q[i : i + _PAIRS]], vectors[x[i : i + _PAIRS]]) for i in range(0, len(q), _PAIRS)])
    for expand in (False, True):  # entries by their smallest id, then the ids of those left
        if expand:
            q, score, id_ = np.repeat(q, ids.shape[1]), np.repeat(score, ids.shape[1]), ids[x].ravel()
            real = id_ != _NONE
            q, score, id_ = q[real], score[real], id_[real]
        else:
            id_ = ids[x, 0]
        order = np.lexsort((id_, -score, q))
        order = order[np.arange(len(q)) - np.searchsorted(q[order], q[order]) < k]
        q, score, id_ = q[order], score[order], id_[order]
        x = x[order] if not expand else x
    return q, score, id_


@dataclass
class Fitted:
    """What the sample says: all of it has a bounded size."""

    rotation: np.ndarray
    centroids: np.ndarray
    probes: int
    vectors: np.ndarray
    ids: np.ndarray
    numbers: np.ndarray

    def turned(self, vectors: np.ndarray) -> np.ndarray:
        return (units(vectors) @ self.rotation).astype(np.float32)

    def lists(self, turned: np.ndarray) -> np.ndarray:
        """Lists by nearness of their centroid."""
        return np.argsort(-(turned @ self.centroids.T), axis=1, kind="stable")


def fit(vectors: np.ndarray, ids: np.ndarray, numbers: np.ndarray, lists: int, k: int, target_recall: float, rounds: int = 10, seed: int = 5) -> Fitted:
    rng = np.random.default_rng(seed)
    rotation = np.linalg.qr(rng.normal(size=(vectors.shape[1],) * 2))[0]
    unit = units(vectors) @ rotation
    learn, held = unit[::2], unit[1::2]
    lists = max(1, min(lists, len(learn) // 8))
    centroids = learn[rng.permutation(len(learn))[:lists]]
    for _ in range(rounds):
        near = (learn @ centroids.T).argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, learn)
        size = np.sqrt((sums * sums).sum(1))[:, None]
        centroids = np.where(size > 0, sums / np.maximum(size, 1e-300), centroids)
    found = Fitted(rotation, centroids.astype(np.float32), lists, vectors, ids, numbers)
    some = held[:512]
    like = some @ held.T
    like[np.arange(len(some)), np.arange(len(some))] = -2
    top = np.argsort(-like, axis=1)[:, : max(0, min(k, len(held) - 1))]
    if top.size:
        place = np.argsort(found.lists(some.astype(np.float32)), axis=1)
        where = np.take_along_axis(place, (held @ centroids.T).argmax(1)[top], axis=1)
        found.probes = 1 + int(np.quantile(where, target_recall, method="higher"))
    return found


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float32)


def _ids(column: pa.Array, width: int) -> np.ndarray:
    """A row for each entry, filled up at the end."""
    many = np.diff(column.offsets.to_numpy())
    out = np.full((len(column), width), _NONE)
    out[np.repeat(np.arange(len(column)), many), np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)] = column.flatten().to_numpy()
    return out


def usable(vector: Column) -> Column:
    return finite(vector) & F.exists(vector, lambda x: x != 0)


class Index:
    """The blocks of all lists as a written table, and what was fitted."""

    def __init__(self, vectors: DataFrame, id_col: str, vector_col: str, k: int, max_lists: int, list_rows: int, block_rows: int, sample_rows: int, target_recall: float) -> None:
        self.k, self.fitted, self.dims, self.splits = k, None, None, []
        rows = vectors.where(usable(F.col(f"`{vector_col}`")) & F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").alias("v"))
        first = rows.orderBy("id", "v").select(F.size("v").alias("n")).limit(1).collect()
        if not first:
            return
        self.dims = first[0]["n"]
        self.rows = rows.where(F.size("v") == self.dims)
        smallest = self.rows.withColumn("place", F.dense_rank().over(W.partitionBy("v").orderBy("id"))).where(F.col("place") <= k + 1)
        entries = written(smallest.groupBy("v").agg(F.array_sort(F.collect_set("id")).alias("ids")).select("v", "ids", F.monotonically_increasing_id().alias("number")), "ann-entries")
        n = entries.count()
        take = max(min(n, 32), min(sample_rows, -(-n // 4)))
        h = F.pmod(F.xxhash64("v", F.lit(11)), F.lit(1 << 30))
        drawn = entries.where(h <= F.lit(min(1.0, 2 * take / n) * (1 << 30))).orderBy(h, "number").limit(take).toArrow().combine_chunks()
        sample = {c: drawn.column(c).chunk(0) for c in ("v", "ids", "number")}
        self.fitted = fit(_vectors(sample["v"]), _ids(sample["ids"], k + 1), sample["number"].to_numpy(), min(max_lists, round(n**0.5)), k, target_recall)
        self.sent = vectors.sparkSession.sparkContext.broadcast(self.fitted)
        self._fill(entries, list_rows, block_rows)

    def _fill(self, entries: DataFrame, list_rows: int, block_rows: int) -> None:
        """Deals every entry that isn't in the sample to its list and writes the lists' blocks."""
        sent, width = self.sent, self.k + 1

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                batch = batch.filter(pa.array(~np.isin(batch.column("number").to_numpy(), sent.value.numbers)))
                if len(batch):
                    near = (sent.value.turned(_vectors(batch.column("v"))) @ sent.value.centroids.T).argmax(1)
                    yield pa.RecordBatch.from_arrays([pa.array(near, pa.int32()), *batch.columns], names=["list", *batch.schema.names])

        kind = entries.schema["v"].dataType.simpleString()
        dealt = written(entries.mapInArrow(deal, f"list int, v {kind}, ids array<long>, number long"), "ann-lists")
        counts = {r["list"]: r["count"] for r in dealt.groupBy("list").count().collect()}
        self.splits = [-(-counts.get(i, 0) // list_rows) for i in range(len(self.fitted.centroids))]
        of = F.element_at(F.lit(self.splits), F.col("list") + 1)
        placed = dealt.withColumn("split", F.pmod(F.xxhash64("number"), of).cast("int")).drop("number").repartition("list", "split").sortWithinPartitions("list", "split")

        def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []

            def block() -> pa.RecordBatch:
                table = pa.Table.from_batches(held).combine_chunks()
                held.clear()
                vectors = _vectors(table.column("v").chunk(0))
                ids = _ids(table.column("ids").chunk(0), width)
                cells = [sent.value.turned(vectors).T.tobytes(), vectors.tobytes(), ids.tobytes()]
                key = [pa.array([table.column(c)[0].as_py()], pa.int32()) for c in ("list", "split")]
                return pa.RecordBatch.from_arrays([*key, *(pa.array([c], pa.binary()) for c in cells)], names=["list", "split", "columns", "vectors", "ids"])

            for batch in batches:
                key = np.column_stack([batch.column(c).to_numpy() for c in ("list", "split")])
                cuts = [0, *(1 + np.flatnonzero((key[1:] != key[:-1]).any(1))).tolist(), len(batch)]
                for a, b in zip(cuts, cuts[1:]):
                    if held and [held[0].column(c)[0].as_py() for c in ("list", "split")] != key[a].tolist():
                        yield block()
                    while a < b:
                        held.append(batch.slice(a, min(b - a, block_rows - sum(map(len, held)))))
                        a += len(held[-1])
                        if sum(map(len, held)) == block_rows:
                            yield block()
            if held:
                yield block()

        self.blocks = written(placed.mapInArrow(store, "list int, split int, columns binary, vectors binary, ids binary"), "ann-blocks")

    def search(self, queries: DataFrame, id_col: str, vector_col: str, query_rows: int = 256, sure: float = 2.1) -> DataFrame:
        """For each query row (id_col, vector_col) its k nearest rows with another id: query_id, rank, vec_id, score."""
        k, sent, dims = self.k + 1, self.sent, self.dims
        asked = queries.where(usable(F.col(f"`{vector_col}`")) & F.col(f"`{id_col}`").isNotNull() & (F.size(F.col(f"`{vector_col}`")) == dims))
        asked = asked.select(F.col(f"`{id_col}`").cast("long").alias("query_id"), F.col(f"`{vector_col}`").alias("v")).distinct()
        distinct = written(asked.select("v").distinct().select("v", F.monotonically_increasing_id().alias("q")), "ann-queries")
        kind = distinct.schema["v"].dataType.simpleString()

        def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fitted = sent.value
            columns = fitted.turned(fitted.vectors).T.copy()
            for batch in batches:
                for at in range(0, len(batch), query_rows):
                    part = batch.slice(at, query_rows)
                    mine = _vectors(part.column("v"))
                    turned = fitted.turned(mine)
                    apart = np.maximum(2 - 2 * (turned @ columns), 0)
                    bound = np.partition(apart, k - 1, axis=1)[:, k - 1] if apart.shape[1] > k else np.full(len(part), 5, np.float32)
                    q, x = np.nonzero(apart <= bound[:, None] + _SLACK)
                    q, score, id_ = nearest_ids(mine, fitted.vectors, fitted.ids, q, x, apart[q, x], k)
                    cut = np.searchsorted(q, np.arange(len(part) + 1))
                    hits = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.StructArray.from_arrays([pa.array(score), pa.array(id_)], names=["score", "id"]))
                    yield pa.RecordBatch.from_arrays([part.column("q"), part.column("v"), pa.array(bound.astype(np.float32)), hits], names=["q", "v", "bound", "hits"])

        begun = written(distinct.mapInArrow(start, f"q long, v {kind}, bound float, hits array<struct<score:double,id:long>>"), "ann-begun")

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fitted = sent.value
            for batch in batches:
                mine, bound, number = _vectors(batch.column("v")), batch.column("bound").to_numpy(), batch.column("q").to_numpy()
                lists = fitted.lists(fitted.turned(mine))[:, : fitted.probes]
                who = np.repeat(np.arange(len(mine)), lists.shape[1])
                order = np.argsort(lists.ravel(), kind="stable")
                of, who = lists.ravel()[order], who[order]
                ends = [*np.flatnonzero(np.diff(of) > 0) + 1, len(of)]
                a = 0
                for b in ends:
                    for i in range(a, b, query_rows):
                        w = who[i : min(i + query_rows, b)]
                        cells = [number[w].tobytes(), bound[w].tobytes(), mine[w].tobytes()]
                        yield pa.RecordBatch.from_arrays([pa.array([int(of[a])], pa.int32()), *(pa.array([c], pa.binary()) for c in cells)], names=["list", "who", "bounds", "asked"])
                    a = b

        wanted = begun.select("q", "v", "bound").mapInArrow(probe, "list int, who binary, bounds binary, asked binary")
        of = F.element_at(F.lit(self.splits), F.col("list") + 1)
        wanted = wanted.where(of > 0).withColumn("split", F.explode(F.sequence(F.lit(0), of - 1)))
        # not broadcast, as Spark knows binary cells as a few bytes; a list's queries stream past its blocks, which list_rows bounds
        met = wanted.hint("merge").join(self.blocks, ["list", "split"]).select("columns", "vectors", "ids", "who", "bounds", "asked")

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(len(batch)):
                    cell = {c: batch.column(c)[row].as_buffer() for c in batch.schema.names}
                    columns = np.frombuffer(cell["columns"], np.float32).reshape(dims, -1)
                    mine = np.frombuffer(cell["asked"], np.float32).reshape(-1, dims)
                    found = adaptive_scan(sent.value.turned(mine), columns, np.frombuffer(cell["bounds"], np.float32), sure)
                    q, score, id_ = nearest_ids(mine, np.frombuffer(cell["vectors"], np.float32).reshape(-1, dims), np.frombuffer(cell["ids"], np.int64).reshape(-1, k), *found, k)
                    if len(q):
                        yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(cell["who"], np.int64)[q]), pa.array(score), pa.array(id_)], names=["q", "score", "id"])

        hits = met.mapInArrow(scan, "q long, score double, id long").unionByName(begun.select("q", F.explode("hits").alias("hit")).select("q", "hit.score", "hit.id"))
        best = hits.withColumn("place", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "id"))).where(F.col("place") <= k)
        best = best.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("place", "score", "id"))).alias("hits"))  # k at most
        named = asked.hint("merge").join(distinct, "v").select("query_id", "q").hint("merge").join(best, "q")
        others = F.slice(F.filter("hits", lambda x: x["id"] != F.col("query_id")), 1, self.k)
        each = named.select("query_id", F.posexplode(others).alias("rank", "hit"))
        return each.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("hit.id").alias("vec_id"), F.col("hit.score").alias("score"))


def nearest(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, max_lists: int = 1024, list_rows: int = 8192, block_rows: int = 1024, sample_rows: int = 16_384, target_recall: float = 0.97, **options) -> DataFrame:
    """The k nearest rows of vectors for each row of queries: query_id, rank, vec_id, score."""
    index = Index(vectors, id_col, vector_col, k, max_lists, list_rows, block_rows, sample_rows, target_recall)
    if index.fitted is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return index.search(queries, id_col, vector_col, **options)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0))
