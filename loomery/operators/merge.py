"""Merging and matching of records: full-outer merges, snapshot differences, cascading look-ups,
substring joins, catalogue merges and de-duplication."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomery.operators.titles import closest
from loomery.sources.checkpoints import cut


def merge_by_key(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """New rows replace old ones in their place, further new rows follow in their order, and rows
    without a key come last. Both have the same columns; adds `place`, which sorts the result."""
    cols = [c for c in old.columns if c != key]
    o = old.select(F.col(key).alias("k"), F.struct(*old.columns).alias("o"))
    n = new.select(F.col(key).alias("k"), F.struct(*new.columns).alias("n"))
    both = o.where("k is not null").join(n.where("k is not null"), "k", "full_outer")
    keyless = o.where("k is null").select("k", "o", F.lit(None).cast(n.schema["n"].dataType).alias("n")).unionByName(n.where("k is null").select("k", F.lit(None).cast(o.schema["o"].dataType).alias("o"), "n"))
    group = F.when(F.col("k").isNull(), 2).when(F.col("o").isNotNull(), 0).otherwise(1)
    at = F.coalesce(F.col(f"o.{order}"), F.col(f"n.{order}"))
    row = F.coalesce("n", "o")
    return both.unionByName(keyless).select(F.col("k").alias(key), *[row[c].alias(c) for c in cols], F.struct(group.alias("group"), at.alias("at")).alias("place"))


def snapshot_diff(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, change) for rows that were added or removed; one join."""
    a = before.select(F.col(key).alias("x")).distinct()
    b = after.select(F.col(key).alias("y")).distinct()
    j = a.join(b, F.col("x").eqNullSafe(F.col("y")), "full_outer").where("x is null or y is null")
    return j.select(F.coalesce("x", "y").alias(key), F.when(F.col("y").isNull(), "removed").otherwise("added").alias("change"))


def lookup_cascade(requests: DataFrame, wanted: str, entries: DataFrame, keys: list[tuple[str, str]], id_col: str) -> DataFrame:
    """(wanted, id, kind): for each request the entry that the first matching kind of key names. keys:
    (kind, column) in order of preference; of entries with one key the smallest id. All kinds are
    one table of keys, joined once."""
    kinds = [entries.select(F.col(c).cast("string").alias("key"), F.lit(i).alias("rank"), F.lit(kind).alias("kind"), F.col(id_col).alias("id")).where("key is not null") for i, (kind, c) in enumerate(keys)]
    table = reduce(DataFrame.unionByName, kinds)
    hit = requests.select(F.col(wanted).cast("string").alias(wanted)).distinct().join(table, F.col(wanted) == F.col("key"), "left")
    best = hit.groupBy(wanted).agg(F.min(F.struct("rank", "id", "kind")).alias("b"))
    return best.select(wanted, "b.id", "b.kind")


def substring_join(texts: DataFrame, text_col: str, needles: DataFrame, needle_col: str, min_length: int = 1, anchor: int = 5) -> DataFrame:
    """Rows of texts with each needle that is a substring. A needle's words stand in the text as they are, but for its
    first and last, which may be parts of words: `anchor` of them, hashed, are an equi key, and what meets is compared
    whole. Needles of fewer words have no anchor and are compared with each text."""
    n = needles.where(F.length(needle_col) >= min_length)
    tokens = F.split(needle_col, " ")
    keyed = n.where(F.size(tokens) >= anchor + 2).withColumn("__anchor", F.xxhash64(*[F.get(tokens, F.lit(i + 1)) for i in range(anchor)]))
    short = n.where(F.size(tokens) < anchor + 2)
    words = F.split(text_col, " ")
    shifted = F.arrays_zip(*[F.slice(words, i + 1, 1 << 30).alias(f"w{i}") for i in range(anchor)])
    hashes = F.array_distinct(F.transform(shifted, lambda z: F.xxhash64(*[z[f"w{i}"] for i in range(anchor)])))
    numbered = texts.withColumn("__row", F.xxhash64(text_col))
    windows = numbered.select("__row", F.explode(hashes).alias("__window"))
    keys = keyed.select("__anchor").distinct()
    met = windows.join(keys, F.col("__window") == F.col("__anchor")).select(F.col("__row").alias("__met"), F.col("__anchor").alias("__key")).distinct()
    # texts are read again for those that have met an anchor, so that windows go without them
    found = numbered.join(met, F.col("__row") == F.col("__met")).join(keyed, F.col("__key") == F.col("__anchor"))
    long = found.where(F.contains(text_col, needle_col)).select(*texts.columns, *needles.columns)
    return long.unionByName(texts.join(short, F.contains(F.col(text_col), F.col(needle_col))).select(*texts.columns, *needles.columns))


def whitelisted(entries: DataFrame, id_col: str, title_col: str, ids: list[str], titles: list[str], min_length: int = 6) -> DataFrame:
    """Entries whose id or title is listed, or whose title has a listed title of some length in it."""
    ok = F.coalesce(F.col(id_col).cast("string").isin(ids), F.lit(False)) | F.coalesce(F.col(title_col).isin(titles), F.lit(False))
    for t in titles:
        if len(t) >= min_length:
            ok = ok | F.coalesce(F.contains(title_col, F.lit(t)), F.lit(False))
    return entries.where(ok)


def catalogue_merge(rows: DataFrame, key: str, ordinal: str, lists: list[str], last_filled: list[str], last: list[str]) -> DataFrame:
    """One row per key: list fields as ordered distinct unions, the last filled value of some fields, the
    last value (null or not) of others."""

    def merged(c: str) -> DataFrame:
        """Each value of a key once, at its first place: what is collected is as long as the result."""
        values = rows.select(key, ordinal, F.posexplode(c).alias("at", "v"))
        first = values.groupBy(key, "v").agg(F.min(F.struct(ordinal, "at")).alias("place"))
        return first.groupBy(F.col(key).alias("__k")).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "v"))), lambda x: x["v"]).alias(c))

    filled = [F.max_by(c, F.when(F.coalesce(F.btrim(F.col(c)) != "", F.lit(False)), F.col(ordinal))).alias(c) for c in last_filled]
    out = rows.groupBy(key).agg(*filled, *[F.max_by(c, ordinal).alias(c) for c in last], F.min(ordinal).alias("place"))
    for c in lists:
        out = out.join(merged(c), F.col(key).eqNullSafe(F.col("__k")), "left").drop("__k").withColumn(c, F.coalesce(c, F.array().cast("array<string>")))
    return out


def reasons_merge(rows: DataFrame, key: str, ordinal: str, reason: str) -> DataFrame:
    """Reasons of a key joined by `; `, each only if what is there doesn't hold it already."""
    # equal reasons after the first add nothing
    rows = rows.groupBy(key, F.coalesce(reason, F.lit("")).alias("__reason")).agg(F.min(ordinal).alias("__first"))
    items = F.array_sort(F.collect_list(F.struct(F.col("__first"), F.col("__reason").alias("r"))))
    fold = F.aggregate(items, F.lit(""), lambda a, x: F.when((x["r"] == "") | F.contains(a, x["r"]), a).when(a == "", x["r"]).otherwise(F.concat(a, F.lit("; "), x["r"])))
    return rows.groupBy(key).agg(fold.alias(reason))


def first_of_each(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


def greedy_dedupe(entries: DataFrame, rank: str, doc_no: str = "doc_no", title: str = "title", path: str = "path") -> DataFrame:
    """(rank, duplicate_of, reason): in rank order an entry is kept unless a kept one before it has its doc_no, or its
    title where neither has a doc_no, or its path. An entry is the duplicate of the one with its doc_no or title, else
    of that with its path.

    Keys of three kinds make one table, (key, rank). In each round the undecided entries that are first of all
    their keys are kept, and the later ones of these keys are gone; what is left is decided in further
    rounds, all keys at once. No component of entries is gathered, and key groups are reduced to their
    minimum before they are shuffled."""
    no = F.lower(F.btrim(F.coalesce(doc_no, F.lit(""))))
    t = F.when((no == "") & (F.coalesce(title, F.lit("")) != ""), F.concat(F.lit("t:"), F.col(title)))
    p = F.when(F.coalesce(F.btrim(path), F.lit("")) != "", F.concat(F.lit("p:"), F.lower(F.btrim(path))))
    n = F.when(no != "", F.concat(F.lit("n:"), no))
    keys = cut(entries.select(F.col(rank).alias("r"), F.explode(F.array_compact(F.array(n, t, p))).alias("key")))
    left, kept_rows = keys, entries.sparkSession.createDataFrame([], f"k {entries.schema[rank].dataType.simpleString()}")
    while True:  # each round decides the first entry that is left, at least
        first = left.groupBy("key").agg(F.min("r").alias("first"))
        marked = left.join(first, "key")
        # an entry is surely kept if it is the first of all its keys
        kept = cut(marked.groupBy("r").agg(F.min("first").alias("least")).where("least = r").select(F.col("r").alias("k")))
        kept_rows = kept_rows.unionByName(kept)
        taken = left.join(kept, F.col("r") == F.col("k"), "left_semi").select("key").distinct()
        gone = left.join(taken, "key", "left_semi").select(F.col("r").alias("g")).distinct()
        left = cut(left.join(gone, F.col("r") == F.col("g"), "left_anti"))
        if left.isEmpty():
            break
    owners = keys.join(kept_rows, F.col("r") == F.col("k"), "left_semi").select(F.col("key").alias("o_key"), F.col("r").alias("owner"))
    hits = keys.join(owners, F.col("key") == F.col("o_key")).where("owner < r")
    best = hits.groupBy("r").agg(F.min(F.struct(F.col("key").startswith("p:").alias("by_path"), "owner", F.left("key", F.lit(1)).alias("kind"))).alias("b"))
    reason = F.when(F.col("b.kind") == "n", "doc_no").when(F.col("b.kind") == "t", "title").when(F.col("b.kind") == "p", "document_path")
    return entries.select(F.col(rank).alias("e")).join(best, F.col("e") == F.col("r"), "left").select(F.col("e").alias(rank), F.col("b.owner").alias("duplicate_of"), reason.alias("reason"))


def reachable(edges: DataFrame, start: list, rounds: int | None = None) -> DataFrame:
    """(node, depth): breadth-first search over (src, dst); each round is a join of the frontier
    and an anti join with what has been seen. It goes on until nothing is new; with `rounds` it raises where they end before."""
    spark = edges.sparkSession
    kind = edges.schema["src"].dataType.simpleString()
    seen = spark.createDataFrame([(s, 0) for s in start], f"node {kind}, depth int")
    frontier = seen
    for depth in count(1):
        if rounds is not None and depth > rounds:
            raise ValueError("paths are longer than the rounds")
        step = frontier.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        frontier = cut(step.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = cut(seen.unionByName(frontier)) if depth % 20 == 0 else seen.unionByName(frontier)
    return seen


def close_titles(queries: DataFrame, titles: DataFrame, cutoff: float = 0.75) -> DataFrame:
    """(query, title, ratio): for each query the title that is most alike by matching blocks, of at least `cutoff`."""
    filled = lambda df, c: df.select(c).where(F.col(c) != "").distinct()
    return closest(filled(queries, "query"), filled(titles, "title"), cutoff)
