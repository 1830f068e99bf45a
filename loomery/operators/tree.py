"""The catalogue as a tree: titles under categories in a configured order, further ones behind, as rows, as nested arrays, and as lines.

As rows and lines nothing is gathered: a row's place is its category's and its title, which a range sort spreads, and the last of a category is
a maximum that joins back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.functions.text import normalize_title

# fixed value: where entries without a level are
OTHERS = "其他"


def catalogue_rows(entries: DataFrame, levels: DataFrame) -> DataFrame:
    """(group, behind, place, title, summary, document_id) of entries (title, summary, level, document_id, ordinal) with a title. levels is (level,
    place); a level that isn't there is behind, by name. Titles sort without case, then by ordinal."""
    title = normalize_title(F.coalesce("title", F.lit("")))
    named = entries.select(title.alias("title"), F.btrim(F.coalesce("summary", F.lit(""))).alias("summary"), F.coalesce("level", F.lit("")).alias("level"), "document_id", "ordinal").where("title <> ''")
    known = levels.groupBy(F.col("level").alias("l_level")).agg(F.min("place").alias("l_place"))
    rows = named.join(known, F.col("level") == F.col("l_level"), "left")
    group = F.when(F.col("l_level").isNull() & (F.col("level") == ""), OTHERS).otherwise(F.col("level"))
    return rows.select(group.alias("group"), F.col("l_level").isNull().alias("behind"), F.col("l_place").alias("place"), "title", "summary", "document_id", F.lower("title").alias("key"), "ordinal")


def catalogue_tree(entries: DataFrame, levels: DataFrame) -> DataFrame:
    """(group, behind, place, children): each level that has entries with its nodes (title, summary, document_id) in order. A level's nodes are
    one row, so that this is for catalogues that are read as one; the rows are the form for others."""
    rows = catalogue_rows(entries, levels)
    nodes = F.array_sort(F.collect_list(F.struct("key", "ordinal", "title", "summary", "document_id")))
    out = rows.groupBy("group", "behind", "place").agg(F.transform(nodes, lambda x: F.struct(x["title"].alias("title"), x["summary"].alias("summary"), x["document_id"].alias("document_id"))).alias("children"))
    return out.orderBy("behind", F.asc_nulls_last("place"), "group")


def grouped_titles(titles: DataFrame, categories: DataFrame) -> DataFrame:
    """(place, behind, group, title): the distinct titles of datasets (dataset, title) by category (dataset, category, place); a category without any is there with a
    null title, and a dataset without a category is a group of its own, behind, by name."""
    held = categories.select(F.col("dataset").alias("c_dataset"), "category", "place")
    order = held.groupBy("category").agg(F.min("place").alias("place"))
    joined = titles.join(held.drop("place"), F.col("dataset") == F.col("c_dataset"), "left")
    rows = joined.select(F.coalesce("category", "dataset").alias("group"), F.col("category").isNull().alias("behind"), "title").distinct()
    placed = rows.join(order, (F.col("group") == F.col("category")) & ~F.col("behind"), "left").select("place", "behind", "group", "title")
    empty = order.join(rows.where("not behind").select(F.col("group").alias("g")).distinct(), F.col("category") == F.col("g"), "left_anti")
    return placed.unionByName(empty.select("place", F.lit(False).alias("behind"), F.col("category").alias("group"), F.lit(None).cast("string").alias("title")))


def tree_lines(grouped: DataFrame) -> DataFrame:
    """(behind, place, group, title, line) of the tree's lines; a null title is the group's own line. The order is behind, place, group, and
    titles with nulls first."""
    groups = grouped.groupBy("behind", "place", "group").agg(F.max("title").alias("last_title"))
    last = groups.agg(F.max(F.struct("behind", F.coalesce("place", F.lit(-1)).alias("p"), "group")).alias("l"))  # one row
    marked = groups.join(F.broadcast(last), (F.col("behind") == F.col("l.behind")) & F.coalesce("place", F.lit(-1)).eqNullSafe(F.col("l.p")) & (F.col("group") == F.col("l.group")), "left")
    marked = marked.select("behind", "place", "group", "last_title", F.col("l").isNotNull().alias("is_last"))
    branch = lambda end: F.when(end, "└── ").otherwise("├── ")
    heads = marked.select("behind", "place", "group", F.lit(None).cast("string").alias("title"), F.concat(branch(F.col("is_last")), "group").alias("line"))
    below = marked.select(F.col("behind").alias("b"), F.col("place").alias("p"), F.col("group").alias("g"), "last_title", "is_last")
    rows = grouped.where("title is not null").join(below, (F.col("behind") == F.col("b")) & F.col("place").eqNullSafe(F.col("p")) & (F.col("group") == F.col("g")))
    leaves = rows.select("behind", "place", "group", "title", F.concat(F.when(F.col("is_last"), "    ").otherwise("│   "), branch(F.col("title") == F.col("last_title")), "title").alias("line"))
    return heads.unionByName(leaves)


def exported(entries: DataFrame) -> DataFrame:
    """(title, summary) of entries, empty where they have none."""
    return entries.select(F.coalesce("title", F.lit("")).alias("title"), F.coalesce("summary", F.lit("")).alias("summary"))
