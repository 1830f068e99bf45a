"""Nested records: nodes harvested from JSON of unknown depth, white lists, and paths rewritten wherever a schema has them."""

from __future__ import annotations

from collections.abc import Callable, Collection
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomery.functions.text import norm_text
from loomery.operators.titles import contained
from loomery.sources.checkpoints import cut

# fixed values: keys under which white lists go on, the shortest title that counts inside of another, keys that hold paths
WHITELIST_KEYS = ("policy_ids", "policy_titles", "policies", "ids", "titles", "entries")
INSIDE_LEAST = 6
PATH_KEYS = ("html_path", "local_path", "path", "source_local_path", "source_path", "source_state_file", "state_file", "text_output_dir", "text_path", "unique_state_file")


def walk(payloads: DataFrame, go_on: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(id, place, kind, node) of every node of payloads (id, json) with one for the whole, parents before children: in each round the objects and
    arrays that are left are opened, all payloads at once, until none is. place is the path of positions, of keys by code
    point; kind is object, array, string or other. go_on(key, kind of the parent) limits which children are followed. What is no JSON has no nodes."""
    whole = payloads.select("id", F.array().cast("array<int>").alias("place"), F.try_parse_json("json").alias("node")).where("node is not null")
    found = None
    for depth in count():
        name = F.schema_of_variant("node")
        kind = F.when(name.startswith("OBJECT"), "object").when(name.startswith("ARRAY"), "array").when(name == "STRING", "string").otherwise("other")
        level = cut(whole.withColumn("kind", kind))
        found = level if found is None else found.unionByName(level)
        if found is not level and depth % 20 == 0:
            found = cut(found)
        nested = level.where(F.col("kind").isin("object", "array"))
        if nested.isEmpty():
            return found
        each = nested.select("id", "place", "kind", "node").lateralJoin(payloads.sparkSession.tvf.variant_explode(F.col("node").outer()))
        children = each if go_on is None else each.where(go_on(F.col("key"), F.col("kind")))
        whole = children.select("id", F.concat("place", F.array(F.col("pos"))).alias("place"), F.col("value").alias("node")).where("node is not null")


def _text(node: Column, key: str) -> Column:
    """A value that is a string; null for others."""
    value = F.try_variant_get(node, f"$.{key}", "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(node, f"$.{key}", "string"))


def catalogue_nodes(payloads: DataFrame, summaries: bool = True) -> DataFrame:
    """(id, place, title, node_id, summary): the distinct objects with a title, at any depth of payloads (id, json), each at its first place. An id is
    `id`, or `document_id` without one; what is blank or no string is null."""
    nodes = walk(payloads).where("kind = 'object'")
    first = F.try_variant_get("node", "$.id", "variant")
    empty = F.coalesce(F.schema_of_variant(first) == "VOID", F.lit(True)) | F.coalesce(F.to_json(first).isin('""', "0", "false", "null", "[]", "{}"), F.lit(False))
    named = F.nullif(F.btrim(F.when(empty, _text(F.col("node"), "document_id")).otherwise(_text(F.col("node"), "id"))), F.lit(""))
    summary = F.nullif(F.btrim(_text(F.col("node"), "summary")), F.lit("")) if summaries else F.lit(None).cast("string")
    rows = nodes.select("id", "place", _text(F.col("node"), "title").alias("title"), named.alias("node_id"), summary.alias("summary")).where("title is not null")
    return rows.groupBy("id", "title", "node_id", "summary").agg(F.min("place").alias("place")).select("id", "place", "title", "node_id", "summary")


def whitelist_names(payloads: DataFrame) -> DataFrame:
    """(kind, name) of white lists (id, json): kind is id or title, titles folded. A string at a place of its own is both; objects have `id` and
    `title`, and go on under some keys."""
    follow = lambda key, kind: (kind == "array") | F.coalesce(key.isin(*WHITELIST_KEYS), F.lit(False))
    nodes = walk(payloads, follow)
    said = F.btrim(F.when(F.col("kind") == "string", F.variant_get("node", "$", "string")))
    own_id = F.when(F.col("kind") == "object", F.btrim(_text(F.col("node"), "id")))
    own_title = F.when(F.col("kind") == "object", F.btrim(_text(F.col("node"), "title")))
    rows = nodes.select(F.coalesce(said, own_id).alias("i"), F.coalesce(said, own_title).alias("t"))
    ids = rows.where("i <> ''").select(F.lit("id").alias("kind"), F.col("i").alias("name"))
    titles = rows.where("t <> ''").select(F.lit("title").alias("kind"), norm_text("t").alias("name"))
    return ids.unionByName(titles).where("name <> ''").distinct()


def whitelisted_entries(entries: DataFrame, names: DataFrame, least: int = INSIDE_LEAST) -> DataFrame:
    """Entries (entry, id, title, duplicates: an array of id and title, and others) that a white list (kind, name) names: by their id, their
    folded title, or a listed title of some length in it, or by one of these of a duplicate. Joins on equal ids, equal titles and rare grams."""
    own = entries.select("entry", F.col("id").cast("string").alias("i"), F.col("title").alias("t"))
    others = entries.select("entry", F.explode("duplicates").alias("d")).select("entry", F.col("d.id").cast("string").alias("i"), F.col("d.title").alias("t"))
    rows = cut(own.unionByName(others).select("entry", "i", norm_text("t").alias("t")))
    ids = names.where("kind = 'id'").select("name")
    titles = names.where("kind = 'title' and name <> ''").select("name").distinct()
    by_id = rows.join(ids, F.col("i") == F.col("name"), "left_semi").select("entry")
    by_title = rows.join(titles, F.col("t") == F.col("name"), "left_semi").select("entry")
    texts = rows.where("t <> ''").select(F.col("t").alias("text")).distinct()
    holding = contained(titles.where(F.length("name") >= least).withColumnRenamed("name", "needle"), texts).select("text").distinct()
    inside = rows.join(holding, F.col("t") == F.col("text"), "left_semi").select("entry")
    hit = by_id.unionByName(by_title).unionByName(inside).select(F.col("entry").alias("hit")).distinct()
    return entries.join(hit, F.col("entry") == F.col("hit"), "left_semi")


def rewritten(df: DataFrame, keys: Collection[str], change: Callable[[Column], Column]) -> DataFrame:
    """The rows with every string under one of the keys changed, at any depth of structs, arrays and maps. Columns without one stay as they are, and
    so does what is null."""

    def has(kind: T.DataType, key: str | None) -> bool:
        if isinstance(kind, T.StructType):
            return any(has(f.dataType, f.name) for f in kind)
        if isinstance(kind, T.ArrayType):
            return has(kind.elementType, None)
        if isinstance(kind, T.MapType):
            return isinstance(kind.valueType, T.StringType) or has(kind.valueType, None)
        return isinstance(kind, T.StringType) and key in keys

    def of(value: Column, kind: T.DataType, key: str | None) -> Column:
        if not has(kind, key):
            return value
        if isinstance(kind, T.StructType):
            fields = [of(value[f.name], f.dataType, f.name).alias(f.name) for f in kind]
            return F.when(value.isNotNull(), F.struct(*fields))
        if isinstance(kind, T.ArrayType):
            return F.transform(value, lambda x: of(x, kind.elementType, None))
        if isinstance(kind, T.MapType):
            if isinstance(kind.valueType, T.StringType):
                return F.transform_values(value, lambda k, v: F.when(k.isin(*keys), change(v)).otherwise(v))
            return F.transform_values(value, lambda k, v: of(v, kind.valueType, None))
        return change(value)

    return df.select(*[of(F.col(f"`{f.name}`"), f.dataType, f.name).alias(f.name) for f in df.schema])


def resolved(path: Column) -> Column:
    """An absolute path without empty parts, dots and parts that are gone up from again."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda a, p: F.when(p == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(p))))
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def relative_paths(df: DataFrame, folder: str, keys: Collection[str] = PATH_KEYS) -> DataFrame:
    """Absolute paths inside of a folder become relative to it; others stay."""
    base = folder.rstrip("/")

    def change(path: Column) -> Column:
        whole = resolved(path)
        inside = path.startswith("/") & (whole.startswith(base + "/") | (whole == (base or "/")))
        return F.when(F.coalesce(inside, F.lit(False)), F.when(whole == base, ".").otherwise(F.substring(whole, F.lit(len(base) + 2), F.length(whole)))).otherwise(path)

    return rewritten(df, keys, change)


def absolute_paths(df: DataFrame, folder: str, keys: Collection[str] = PATH_KEYS) -> DataFrame:
    """Relative paths become absolute in a folder; an empty one stays empty, absolute ones are resolved."""

    def change(path: Column) -> Column:
        return F.when(path == "", path).when(path.startswith("/"), resolved(path)).otherwise(resolved(F.concat(F.lit(folder.rstrip("/") + "/"), path)))

    return rewritten(df, keys, change)
