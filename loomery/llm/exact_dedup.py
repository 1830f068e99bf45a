"""Exact duplicates by a log-structured merge index of content digests.

A flush turns a batch of rows into sorted runs: each task is a memtable that sorts its own
(digest, length, id) entries and writes them as one Parquet file, without a shuffle. A filter over all
runs (hashed bits and how many entries set each) is probed before a merge: entries whose bit nobody else has set are alone, and
stay where they are. Compaction merges the others to one entry per digest that keeps the
preferred (longest, then smallest) identifier; hot digests are combined in each task before
the shuffle. Digests with several rows are hits, and hits receive byte verification: the
texts of the hits alone (a bounded bitmap of their ids selects them in the scan) are compared
byte for byte; where a digest stands for different texts, its rows are grouped by the text.

Defined cases: a null text counts as empty; null ids are allowed and never preferred over
others; repeated rows are copies of each other; an empty table gives an empty result; very
long texts need no special case; the other columns of the input are not looked at.
DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.llm.common import _flagged, forget, fresh, maybe_in, without, without_space, written

N_BITS = 1 << 26


def normalised(text: Column) -> Column:
    return without_space(F.coalesce(text, F.lit("")))


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


class DigestIndex:
    """An index over one or more flushed batches of (id, text)."""

    def __init__(self, spark: SparkSession, digest: Callable[[Column], Column] = sha256, normal: Callable[[Column], Column] = normalised):
        self.spark, self.digest, self.normal = spark, digest, normal
        self.runs: list[DataFrame] = []
        self.batches: list[DataFrame] = []
        self.merged: DataFrame | None = None
        self.twice: DataFrame | None = None

    def flush(self, ids_and_texts: DataFrame) -> None:
        """Adds a batch (columns id, text) as sorted runs, one for each task."""
        entries = ids_and_texts.select(
            self.digest(self.normal(F.col("text"))).alias("digest"),
            F.length(F.coalesce("text", F.lit(""))).alias("n_points"),
            "id",
        )
        self.runs.append(written(entries.sortWithinPartitions("digest"), "digest-run"))
        self.batches.append(ids_and_texts)
        self.merged = self.twice = None

    def entries(self) -> DataFrame:
        out = self.runs[0]
        for run in self.runs[1:]:
            out = out.unionByName(run)
        return out

    def filters(self) -> DataFrame:
        """(bit): of one filter over all runs the bits that several entries have set. An entry whose bit nobody else has
        set is the only one of its digest."""
        if self.twice is None:
            bits = self.entries().groupBy(self.bit(F.col("digest")).alias("bit")).agg(F.count(F.lit(1)).alias("n"))
            self.twice = written(bits.where("n > 1").select("bit"), "digest-filter")
        return self.twice

    def bit(self, digest: Column) -> Column:
        return F.pmod(F.xxhash64(digest), F.lit(N_BITS))

    def probed(self) -> tuple[DataFrame, DataFrame]:
        """The entries that a merge has to look at, and the others."""
        flagged, flag = _flagged(self.entries(), self.bit(F.col("digest")), self.filters(), N_BITS)
        return flagged.where(F.col(flag)).drop(flag), flagged.where(~F.col(flag)).drop(flag)

    def compact(self) -> DataFrame:
        """One entry per digest over all runs, of those that passed the filters: (digest, keep_id, n_rows)."""
        if self.merged is None:
            best = F.min(F.struct(-F.col("n_points"), F.col("id").isNull(), F.col("id"))).alias("best")
            merged = self.probed()[0].groupBy("digest").agg(best, F.count(F.lit(1)).alias("n_rows"))
            self.merged = written(merged.select("digest", F.col("best.id").alias("keep_id"), "n_rows").sortWithinPartitions("digest"), "digest-level")
        return self.merged

    def members(self) -> DataFrame:
        """(id, digest, keep_id, n_rows) for each flushed row, before verification."""
        several, alone = self.probed()
        found = several.join(self.compact(), "digest").select("id", "digest", "keep_id", "n_rows")
        return found.unionByName(alone.select("id", "digest", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("n_rows")))

    def hit_texts(self) -> DataFrame:
        """(id, n_points, digest, norm) of the rows that may share a digest with another row."""
        texts = self.batches[0]
        for batch in self.batches[1:]:
            texts = texts.unionByName(batch)
        hits = self.members().where("n_rows > 1").select("id")
        found = maybe_in(texts, F.col("id"), hits)
        norm = found.select("id", F.length(F.coalesce("text", F.lit(""))).alias("n_points"), self.normal(F.col("text")).alias("norm"))
        return norm.withColumn("digest", self.digest(F.col("norm")))

    def clashes(self) -> DataFrame:
        """Digests whose rows differ in their bytes. Each task compares its own texts of a
        digest first, so that one text for a digest and task is shuffled."""
        seen = self.hit_texts().groupBy("digest").agg(F.min("norm").alias("least"), F.max("norm").alias("most"))
        return seen.where("least <> most").select("digest")

    def resolve(self) -> DataFrame:
        """(id, digest, keep_id, group_size) for each flushed row, verified."""
        clashes = written(self.clashes(), "digest-clash")
        members = self.members().withColumnRenamed("n_rows", "group_size")
        if clashes.isEmpty():
            forget(clashes)
            return members
        texts = self.hit_texts().join(clashes, "digest", "left_semi")
        best = F.min(F.struct(-F.col("n_points"), F.col("id").isNull(), F.col("id"))).alias("best")
        groups = texts.groupBy("norm").agg(best, F.count(F.lit(1)).alias("group_size")).select("norm", F.col("best.id").alias("keep_id"), "group_size")
        apart = texts.join(groups, "norm").select("id", "digest", "keep_id", "group_size")
        return members.join(clashes, "digest", "left_anti").select("id", "digest", "keep_id", "group_size").unionByName(apart)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **index) -> DataFrame:
    """One row per input row: id, digest (binary), keep_id, group_size, kept."""
    lsm = DigestIndex(docs.sparkSession, **index)
    lsm.flush(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")))
    return lsm.resolve().withColumn("kept", F.col("id").eqNullSafe(F.col("keep_id")))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay; of repeated rows with one id, one. Rows with a null id stay."""
    found = written(exact_dedup(docs, id_col, text_col).where("group_size > 1").select("id", "kept"), "exact-copies")
    left = without(docs, id_col, found.where("not kept").select("id"))
    repeated = written(found.where("kept").groupBy("id").count().where("count > 1").select("id"), "repeated-rows")
    if repeated.isEmpty():
        forget(repeated)
        return left
    norm = fresh(docs, "norm_")
    once = maybe_in(left, F.col(f"`{id_col}`"), repeated).withColumn(norm, F.sha2(normalised(F.col(f"`{text_col}`")), 256))
    keyed = once.where(F.col(f"`{id_col}`").isNotNull()).dropDuplicates([id_col, norm]).unionByName(once.where(F.col(f"`{id_col}`").isNull())).drop(norm)
    flagged, h = _flagged(left, F.col(f"`{id_col}`"), repeated, 1 << 26)
    return flagged.where(~F.col(h)).drop(h).unionByName(keyed)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), r AS (
  SELECT doc_id, sha256(norm) AS text_sha256,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(text) DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM r
"""
