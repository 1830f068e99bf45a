"""Readers of nested JSON states, extract summaries, text trees, traces and embedding caches."""

from __future__ import annotations

import io
import json
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomery.functions.urls import document_type
from loomery.operators.nested import PATH_KEYS, absolute_paths

DOCUMENT = "struct<url:string,type:string,title:string,downloaded:boolean,local_path:string,localPath:string,path:string>"
ENTRY = f"struct<serial:bigint,title:string,remark:string,text_path:string,documents:array<{DOCUMENT}>>"
STATE = f"entries array<struct<serial:bigint,title:string,remark:string,text_path:string,documents:array<{DOCUMENT}>,entry:{ENTRY}>>, task string, meta map<string,string>"


def entries(spark: SparkSession, path: str, base: str | None = None) -> DataFrame:
    """(task, entry_id, serial, title, remark, documents, ordinal) of state or extract files, rows flat or wrapped
    in `entry`; the extracted text, if there is one, is the first document unless it is among them. With a base, relative
    paths are absolute in it."""
    raw = spark.read.schema(STATE).json(path, multiLine=True).withColumn("file", F.input_file_name())
    if base is not None:
        raw = absolute_paths(raw, base, PATH_KEYS + ("localPath",))
    rows = raw.select("file", "task", F.posexplode("entries").alias("pos", "e"))

    def pick(c: str):
        return F.coalesce(F.col(f"e.entry.{c}"), F.col(f"e.{c}"))

    docs = F.transform(F.coalesce(pick("documents"), F.array().cast(f"array<{DOCUMENT}>")), lambda d: F.struct(d["url"].alias("url"), F.lower(d["type"]).alias("type"), d["title"].alias("title"), F.coalesce(d["downloaded"], F.lit(False)).alias("downloaded"), F.coalesce(d["local_path"], d["localPath"], d["path"]).alias("local_path")))
    rows = rows.select("file", "task", "pos", pick("serial").alias("serial"), pick("title").alias("title"), F.coalesce(pick("remark"), F.lit("")).alias("remark"), F.coalesce(F.col("e.text_path"), F.col("e.entry.text_path")).alias("text_path"), docs.alias("documents"))
    own = F.array(F.struct(F.lit(None).cast("string").alias("url"), F.lit("text").alias("type"), F.col("title"), F.lit(True).alias("downloaded"), F.col("text_path").alias("local_path")))
    known = F.exists("documents", lambda d: F.coalesce(d["local_path"] == F.col("text_path"), F.lit(False)))
    stem = F.regexp_replace(F.regexp_extract("file", "([^/]+)\\.json$", 1), "_(uniq_state|state|extract)$", "")
    task = F.regexp_replace(F.lower(F.btrim(F.coalesce("task", stem))), "[ -]", "_")
    serial = F.coalesce("serial", F.col("pos") + 1)
    return rows.select(task.alias("task"), F.concat_ws(":", task, serial.cast("string")).alias("entry_id"), serial.alias("serial"), "title", "remark", F.when(F.col("text_path").isNull() | known, F.col("documents")).otherwise(F.concat(own, F.col("documents"))).alias("documents"), F.col("pos").alias("ordinal"))


def texts(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """(path, text, n_bytes) of a tree of text files in one of several encodings."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select("path", decode("content").alias("text"), F.col("length").alias("n_bytes"))


# fixed values: encodings in the source's order
ENCODINGS = ("utf-8", "utf-16", "utf-16-le", "utf-16-be", "gb18030", "gbk")


def decode_bytes(data: bytes | None, literal: bool = False) -> str | None:
    """The text in the first encoding that it is valid in. UTF-16 without a mark takes most bytes of even length, GB18030 texts
    among them: it comes last, unless the source's order is taken literally."""
    if data is None:
        return None
    data = bytes(data)
    marked = literal or data[:2] in (b"\xff\xfe", b"\xfe\xff")
    for name in ENCODINGS if marked else ("utf-8", "gb18030", "gbk", "utf-16-le", "utf-16-be"):
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            pass
    return data.decode("utf-8", "ignore")


@F.pandas_udf(T.StringType())
def decode(data: pd.Series) -> pd.Series:
    return data.map(decode_bytes)


def docx(data: bytes) -> tuple[str | None, int | None, str | None]:
    """(text, pages, error) of a DOCX file: its paragraphs' runs."""
    try:
        with zipfile.ZipFile(io.BytesIO(bytes(data))) as z:
            body = ElementTree.fromstring(z.read("word/document.xml"))
            app = z.read("docProps/app.xml").decode("utf-8", "ignore") if "docProps/app.xml" in z.namelist() else ""
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
        return None, None, type(e).__name__
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    text = "\n".join("".join(t.text or "" for t in p.iter(f"{w}t")) for p in body.iter(f"{w}p"))
    pages = re.search(r"<Pages>(\d+)</Pages>", app)
    return text, int(pages[1]) if pages else None, None


_DOCX = T.StructType([T.StructField("text", T.StringType()), T.StructField("pages", T.LongType()), T.StructField("error", T.StringType())])


@F.pandas_udf(_DOCX)
def docx_text(data: pd.Series) -> pd.DataFrame:
    out = pd.DataFrame([docx(x) for x in data], columns=["text", "pages", "error"])
    return out.astype({"pages": "Int64"})


def traces(spark: SparkSession, path: str) -> DataFrame:
    """(trace_id, seq, ts, event, payload, raw): lines that are no JSON become parse_error events."""
    lines = spark.read.text(path)
    v = F.try_parse_json("value")
    get = lambda p, t: F.try_variant_get(F.col("v"), f"$.{p}", t)
    rows = lines.withColumn("v", v)
    return rows.select(get("trace_id", "string").alias("trace_id"), get("seq", "long").alias("seq"), get("ts", "long").alias("ts"), F.when(F.col("v").isNull(), "parse_error").otherwise(get("event", "string")).alias("event"), F.to_json(get("payload", "variant")).alias("payload"), F.when(F.col("v").isNull(), F.col("value")).alias("raw"))


def legacy_entries(spark: SparkSession, path: str) -> DataFrame:
    """(file, ordinal, entry_id, title, documents) of old states: a list of URLs or of objects (url, name), or an object of names by URL. Entries
    of one name are one, with all their documents; a document's name is its URL where it has none."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    items = F.from_json("value", "array<string>")
    listed = raw.where(F.ltrim(F.col("value")).startswith("[")).select("file", F.posexplode(items).alias("at", "x"))
    obj = F.from_json("x", "struct<url:string,name:string>")
    plain = ~F.ltrim(F.col("x")).startswith("{")
    listed = listed.select("file", "at", F.when(plain, F.col("x")).otherwise(obj["url"]).alias("url"), F.when(plain, "").otherwise(F.coalesce(obj["name"], F.lit(""))).alias("name"))
    named = raw.where(F.ltrim(F.col("value")).startswith("{")).select("file", F.explode(F.arrays_zip(F.json_object_keys("value").alias("url"), F.sequence(F.lit(0), F.size(F.json_object_keys("value")) - 1).alias("at"), F.map_values(F.from_json("value", "map<string,string>")).alias("name"))).alias("z"))
    rows = listed.unionByName(named.select("file", "z.at", "z.url", F.coalesce("z.name", F.lit("")).alias("name"))).where("url is not null")
    document = F.struct("at", "url", document_type(F.col("url")).alias("type"), F.coalesce(F.nullif("name", F.lit("")), F.col("url")).alias("title"), F.lit(True).alias("downloaded"))
    # an entry without a name has no documents to name it after when it is made, so that it goes by its serial or is one of all such
    merged = rows.groupBy("file", "name").agg(F.min("at").alias("ordinal"), F.array_sort(F.collect_list(document)).alias("documents"))
    return merged.select("file", "ordinal", F.when(F.col("name") != "", F.concat(F.lit("title::"), "name")).alias("entry_id"), F.col("name").alias("title"), "documents")


def unique_states(spark: SparkSession, path: str) -> DataFrame:
    """(file, task, task_slug, source_state_file, generated_at, original, unique, duplicate) of the state files that say from which one they come."""
    counts = "original_entry_count:bigint,unique_entry_count:bigint,duplicate_entry_count:bigint"
    meta = spark.read.schema(f"meta struct<dedupe:struct<task:string,task_slug:string,source_state_file:string,generated_at:string,{counts}>>").option("pathGlobFilter", "*_uniq_state.json").json(path, multiLine=True)
    d = meta.select(F.input_file_name().alias("file"), "meta.dedupe.*").where("source_state_file is not null")
    return d.select("file", "task", "task_slug", "source_state_file", F.expr("try_cast(generated_at as timestamp)").alias("generated_at"), *[F.col(f"{c}_entry_count").alias(c) for c in ("original", "unique", "duplicate")])


def embeddings(spark: SparkSession, path: str) -> DataFrame:
    """(id, hash, vector) of a cache of embeddings: JSON lines with their ids, or a JSON object of them by id, as it is or under `items`.
    Vectors of less than two numbers or of zeros only are dropped."""
    item = "struct<hash:string,vector:array<double>>"
    lines = spark.read.schema("id string, article_id string, hash string, vector array<double>").json(path).select(F.coalesce("article_id", "id").alias("id"), "hash", "vector")
    whole = spark.read.text(path, wholetext=True)
    inside = F.coalesce(F.get_json_object("value", "$.items"), F.col("value"))
    by_id = whole.select(F.explode(F.from_json(inside, f"map<string,{item}>")).alias("id", "p")).select("id", "p.hash", "p.vector")
    rows = lines.where("id is not null").unionByName(by_id)
    return rows.where("size(vector) >= 2").where(F.exists("vector", lambda x: x != 0))


def corpus(spark: SparkSession, rows: DataFrame, key: str = "doc_id", ordinal: str = "ordinal") -> DataFrame:
    """The last row of each id; combined in each task, so that a hot id is no hot task."""
    last = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), ordinal).alias("__last"))
    return last.select(*[F.col(f"__last.`{c}`").alias(c) for c in rows.columns])


def whitelist(text: str) -> tuple[list[str], list[str]]:
    """(ids, titles) of a white list in JSON: strings, lists, or objects of them at any depth."""
    ids: list[str] = []
    titles: list[str] = []

    def walk(x, to):
        if isinstance(x, str):
            to.append(x.strip())
        elif isinstance(x, list):
            for y in x:
                walk(y, to)
        elif isinstance(x, dict):
            for k, y in x.items():
                walk(y, ids if k in ("policy_ids", "ids", "id") else titles if k in ("policy_titles", "titles", "title", "policies", "entries") else to)

    walk(json.loads(text), titles)
    return sorted(set(filter(None, ids))), sorted(set(filter(None, titles)))
