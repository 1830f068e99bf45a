"""Mixing sources to target weights by capped water-filling.

Each source's target is its weight's share of all words, but at most `max_epochs` times what
the source has; what the capped sources leave is shared by weight among the others until none
is above its cap. A target is met by whole repetitions of the source and by a fraction of it:
the documents are put in a seeded order, and those before a cut are taken once more. The order is by a hash of
seed, id and text, so that rows without an id, or of one id, are documents of their own. The cut
is found exactly, in two steps that no hot source can overload: sums over 4096 slices of the
order, then a running sum inside the one slice where the target is reached. Rows that are equal
in id and text have one place in the order; if the cut falls among them, as many of them are taken as come
nearest to the target, numbered by the partition that they are read in.

Only one row per source reaches the driver (weights are given per source, so their number is
taken to be small), and of a cut among equal rows one per partition that has them. Sums are combined in each task before the shuffle.

Defined cases: null or empty texts have size 0 and add nothing; rows with a null source form
one source, last in order; null ids are ordered by their texts; an empty table gives an empty result; the input's columns are kept,
except that the result's size, source_size, target, taken and epochs replace theirs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomery.llm.common import forget, fresh, words, written

_SLICES = 12  # bits


def water_fill(sizes: Sequence[int], weights: Sequence[float], max_epochs: float) -> list[float]:
    """Targets that share sum(sizes) by weight, none above max_epochs times its size."""
    left, open_, targets = sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        for i in open_:
            targets[i] = left * weights[i] / total
        over = {i for i in open_ if targets[i] > max_epochs * sizes[i]}
        if not over:
            break
        for i in over:
            targets[i] = float(max_epochs * sizes[i])
            left -= max_epochs * sizes[i]
        open_ -= over
    return targets


def order_key(id_: Column, text: Column, seed: int) -> Column:
    """60 bits that put documents into a seeded order."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), id_.cast("string"), F.md5(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def mix_sources(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), max_epochs: int = 3, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows with size, source_size, target, taken (words) and epochs (times the row is
    taken). weights repeat over the sources in code-point order, null last."""
    spark = docs.sparkSession
    made = ("size", "source_size", "target", "taken", "epochs")
    key = fresh(docs, "order_key_")
    keep = [c for c in docs.columns if c.lower() not in made]
    sized = docs.withColumn(key, order_key(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), seed)).select(
        *[F.col(f"`{c}`") for c in keep], key, F.size(words(F.col(f"`{text_col}`"))).cast("long").alias("size")
    )
    units = written(sized.groupBy(F.col(f"`{source_col}`").alias("source"), F.col(key).alias("k")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows")), "mix-units")

    totals = sorted(units.groupBy("source").agg(F.sum("size").alias("size")).collect(), key=lambda r: (r.source is None, r.source or ""))
    targets = water_fill([r["size"] for r in totals], [weights[i % len(weights)] for i in range(len(totals))], max_epochs)
    plan = []
    for r, target in zip(totals, targets):
        whole = int(target // r["size"]) if r["size"] else 0
        plan.append((r["source"], r["size"], target, whole, target - whole * r["size"]))
    kind = units.schema["source"].dataType.simpleString()
    schema = f"p_source {kind}, source_size long, target double, whole long, rest double"
    plans = F.broadcast(spark.createDataFrame(plan, schema))

    slice_ = F.shiftright("k", 60 - _SLICES)
    wanted = units.join(plans, F.col("source").eqNullSafe(F.col("p_source")))
    sums = wanted.groupBy("p_source", "rest", slice_.alias("slice")).agg(F.sum("size").alias("size"))
    upto = F.sum("size").over(W.partitionBy("p_source").orderBy("slice"))
    cut_at = sums.withColumn("before", upto - F.col("size")).where("before <= rest and rest < before + size").select(F.col("p_source").alias("c_source"), "slice", "before")
    inside = wanted.join(F.broadcast(cut_at), F.col("p_source").eqNullSafe(F.col("c_source")) & (slice_ == F.col("slice")))
    run = F.col("before") + F.sum("size").over(W.partitionBy("p_source").orderBy("k"))
    # of the equal rows in which the target is reached, as many as come nearest to it
    reached = inside.select("p_source", "k", "rows", "size", "rest", (run - F.col("size")).alias("at")).where("at <= rest and rest < at + size")
    cuts = {r["p_source"]: (r["k"], r["rows"], int((r["rest"] - r["at"]) * r["rows"] / r["size"] + 0.5)) for r in reached.collect()}
    forget(units)
    rows = [(s, n, t, whole, *(cuts.get(s, (-1, 0, 0)) if rest > 0 else (-1, 0, 0))) for s, n, t, whole, rest in plan]
    p_source, whole, cut, equal, first = (fresh(sized, x) for x in ("plan_source_", "whole_", "cut_", "equal_", "first_"))
    cut_plan = F.broadcast(spark.createDataFrame(rows, f"{p_source} {kind}, source_size long, target double, {whole} long, {cut} long, {equal} long, {first} long"))
    out = sized.join(cut_plan, F.col(f"`{source_col}`").eqNullSafe(F.col(p_source)))
    more = F.when((F.col(key) < F.col(cut)) | ((F.col(key) == F.col(cut)) & (F.col(first) >= F.col(equal))), 1).otherwise(0)
    if any(0 < j < m for *_, m, j in rows):
        out, more = _numbered_at_cut(out, key, p_source, cut, first, more)
    epochs = F.col(whole) + more
    return out.select(*[F.col(f"`{c}`") for c in keep], "size", "source_size", "target", (F.col("size") * epochs).alias("taken"), epochs.alias("epochs"))


def _numbered_at_cut(out: DataFrame, key: str, source: str, cut: str, first: str, more: Column) -> tuple[DataFrame, Column]:
    """Equal rows at a cut are numbered: within the partition that they are read in, behind those of partitions before."""
    part, place, before = (fresh(out, x) for x in ("part_", "place_at_cut_", "before_"))
    edge = out.where(F.col(key) == F.col(cut)).withColumn(part, F.spark_partition_id())
    counts = edge.groupBy(F.col(source).alias("e_source"), F.col(part).alias("e_part")).agg(F.count(F.lit(1)).alias("n"))
    starts = counts.withColumn(before, F.sum("n").over(W.partitionBy("e_source").orderBy("e_part")) - F.col("n"))  # a row per partition
    local = edge.withColumn(place, F.row_number().over(W.partitionBy(source, part).orderBy(key)))
    met = local.join(F.broadcast(starts), F.col(source).eqNullSafe(F.col("e_source")) & (F.col(part) == F.col("e_part")))
    taken = F.when(F.col(place) + F.col(before) <= F.col(first), 1).otherwise(0)
    name = fresh(out, "more_")
    both = out.where(F.col(key) != F.col(cut)).withColumn(name, more).unionByName(met.withColumn(name, taken).select(*[F.col(f"`{c}`") for c in out.columns], name))
    return both, F.col(name)


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the input's columns, each row as many times as it is taken."""
    out = mix_sources(docs, **options)
    time = fresh(out, "epoch_")
    many = out.where("epochs > 0").withColumn(time, F.explode(F.sequence(F.lit(1), F.col("epochs").cast("int"))))
    return many.select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(concat_ws(':', '7', doc_id::VARCHAR, md5(coalesce(text, '')))), 1, 15))::BIGINT AS k, row_number() OVER () AS j0
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS n FROM d GROUP BY source
), w AS (
  SELECT source, n, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w, sum(n) OVER () AS total FROM s
), o AS (
  SELECT *, row_number() OVER (ORDER BY n * 1.0 / w, source NULLS LAST) AS j FROM w
), p AS (
  SELECT *, (total - 3 * coalesce(sum(n) OVER (ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS rest_total,
         sum(w) OVER (ORDER BY j ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS rest_w
  FROM o
), c AS (
  SELECT coalesce(min(j), 1 + (SELECT max(j) FROM p)) AS first_open FROM p WHERE (rest_total * w)::DOUBLE / rest_w <= 3 * n
), t AS (
  SELECT source, n, CASE WHEN j < first_open THEN (3 * n)::DOUBLE
    ELSE ((SELECT rest_total FROM p WHERE j = first_open) * w)::DOUBLE / (SELECT rest_w FROM p WHERE j = first_open) END AS target
  FROM p, c
), r AS (
  SELECT *, CASE WHEN n = 0 THEN 0 ELSE floor(target / n)::BIGINT END AS whole FROM t
), e AS (
  SELECT d.*, n, target, whole, target - whole * n AS rest,
         sum(size) OVER (PARTITION BY d.source ORDER BY k, j0) - size / 2.0 AS middle
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
), x AS (
  SELECT source AS cut_source, max(k) FILTER (middle <= rest AND rest > 0) AS cut FROM e GROUP BY source
)
SELECT doc_id, size, n AS source_size, target, size * (whole + CASE WHEN k < coalesce(cut, -1) OR (k = cut AND middle <= rest) THEN 1 ELSE 0 END)::BIGINT AS taken
FROM e JOIN x ON e.source IS NOT DISTINCT FROM x.cut_source
"""
