"""Extraction of entries' texts: candidates, status, summaries, and what can be used again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomery.functions.text import similarity
from loomery.operators.rollups import canonical_type, plain_type, preferred_type

# fixed values: priorities of types, attachments' titles, suffixes of titles, the answer for unclear contents
PRIORITIES = {"docx": 3, "doc": 3, "word": 3, "pdf": 2, "html": 1, "text": 0}
ATTACHMENT = "^\\s*(附件|附表|附录|附图)"
SUFFIX = "(?i)\\.(pdf|docx?|wps|txt)$"
UNCLEAR = "内容不明确，无法摘要"


def comparable_title(title: Column) -> Column:
    """Letters and digits in lower case, without a document's suffix."""
    return F.nullif(F.regexp_replace(F.lower(F.regexp_replace(F.btrim(title), SUFFIX, "")), "[^\\p{L}\\p{N}]", ""), F.lit(""))


def candidates(documents: DataFrame) -> DataFrame:
    """documents (entry_id, entry_title, place, type, title, path, preferred) with priority and rank: the order in which an
    entry's documents are tried. Documents without a path are none."""
    docs = documents.where("coalesce(path, '') <> ''").withColumns({"__a": comparable_title(F.col("entry_title")), "__b": comparable_title(F.col("title"))})
    a, b = F.col("__a"), F.col("__b")
    part = F.contains(a, b) | F.contains(b, a)
    # only titles that are neither equal nor parts of each other go through the ratio
    close = F.coalesce(similarity(F.when((a != b) & ~part, a), F.when((a != b) & ~part, b)), F.lit(0.0)) >= 0.85
    match = F.when(a.isNull() | b.isNull(), 0).when(a == b, 3).when(part, 2).when(close, 1).otherwise(0)
    bonus = F.element_at(F.array(*map(F.lit, (0.0, 0.5, 1.0, 2.0))), F.col("__match") + 1)
    kind = F.lower("type")
    base = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in PRIORITIES.items() for x in kv]), kind), F.lit(-1))
    penalty = F.when((F.coalesce("entry_title", F.lit("")) != "") & (bonus <= 0) & kind.isin("doc", "docx", "word"), -1.0).otherwise(0.0)
    penalty = penalty + F.when(F.coalesce(F.col("title").rlike(ATTACHMENT), F.lit(False)), -0.5).otherwise(0.0)
    docs = docs.withColumn("__match", match).withColumn("priority", 1000.0 * F.col("__match") + 10.0 * base + bonus + penalty)
    order = W.partitionBy("entry_id").orderBy(F.coalesce("preferred", F.lit(False)).desc(), F.desc("priority"), "place")
    return docs.withColumn("rank", F.row_number().over(order)).drop("__a", "__b", "__match")


def statuses(entries: DataFrame, attempts: DataFrame) -> DataFrame:
    """(entry_id, status, requires_ocr, rank, text): attempts are (entry_id, rank, type, text, error, requires_ocr). The first with a
    text is used, or else the first of all; attempts behind the one with a text don't count. Of equal ranks the greatest type, text, error and
    requires_ocr count, whatever the order of the rows."""
    filled = F.coalesce(F.btrim("text"), F.lit("")) != ""
    first = F.min(F.when(filled, F.col("rank"))).over(W.partitionBy("entry_id"))
    tried = attempts.withColumn("__first", first).where("__first is null or rank <= __first")
    pdf_ocr = (F.col("type") == "pdf") & F.coalesce("requires_ocr", F.lit(False))
    used = F.max_by(F.struct("rank", "type", "text", "error", F.coalesce("requires_ocr", F.lit(False)).alias("ocr")), F.struct(filled, -F.col("rank"), "type", "text", "error", "requires_ocr"))
    of = tried.groupBy(F.col("entry_id").alias("__e")).agg(F.max(pdf_ocr).alias("requires_ocr"), used.alias("u"))
    out = entries.select("entry_id").join(of, F.col("entry_id") == F.col("__e"), "left")
    ocr = F.col("u.ocr") & ((F.col("u.type") == "pdf") | F.col("requires_ocr"))
    failed = F.coalesce(F.col("u.error"), F.lit("")) != ""
    status = F.when(F.col("u").isNull(), "no_source").when(failed & ocr, "needs_ocr").when(failed, "error").when(F.coalesce(F.btrim("u.text"), F.lit("")) != "", "success").when(ocr, "needs_ocr").otherwise("empty")
    return out.select("entry_id", status.alias("status"), F.coalesce("requires_ocr", F.lit(False)).alias("requires_ocr"), F.col("u.rank").alias("rank"), F.col("u.text").alias("text"))


def counted(df: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """A map from values to how many rows of the keys have them."""
    each = df.select(*keys, value.alias("__v")).where("__v is not null").groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__n"))
    return each.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("__v", "__n")))).alias(name))


def summary_rollup(entries: DataFrame, pending: DataFrame | None = None) -> DataFrame:
    """Per task of entries (task, serial, status, types, reused, documents): total, success, reused, requires_ocr, ocr_pages and
    counts by status, type and type of documents for OCR. documents are structs (type, requires_ocr, page_count) and count in
    successful entries; pending (task, n) raises the total."""
    status = F.coalesce(F.nullif(F.lower(F.btrim("status")), F.lit("")), F.lit("unknown"))
    rows = entries.withColumn("status", status)
    kind = F.coalesce(canonical_type(F.lower(F.get(F.array_compact(F.transform("types", lambda t: F.nullif(F.btrim(t), F.lit("")))), F.lit(0)))), F.lit("unknown"))
    marked = F.when(F.col("status") == "success", F.filter("documents", lambda d: F.coalesce(d["requires_ocr"], F.lit(False))))
    marked = F.coalesce(marked, F.slice("documents", 1, 0))
    pages = F.aggregate(marked, F.lit(0).cast("long"), lambda a, d: a + F.greatest(F.coalesce(d["page_count"], F.lit(0)), F.lit(0)))
    out = rows.groupBy("task").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "success").alias("success"), F.count_if("reused").alias("reused"), F.sum(F.coalesce(F.size(marked), F.lit(0)).cast("long")).alias("requires_ocr"), F.sum(F.coalesce(pages, F.lit(0))).alias("ocr_pages")
    )
    ocr = rows.select("task", F.explode(F.transform(marked, lambda d: F.coalesce(F.nullif(F.btrim(d["type"]), F.lit("")), F.lit("unknown")))).alias("__t"))
    for part in (counted(rows, ["task"], F.col("status"), "statuses"), counted(rows, ["task"], kind, "types"), counted(ocr, ["task"], F.col("__t"), "ocr_types")):
        out = out.join(part, "task", "left")
    if pending is not None:
        more = pending.select(F.col("task").alias("__t"), F.col("n").alias("__n"))
        out = out.join(more, F.col("task") == F.col("__t"), "left").withColumn("total", F.greatest("total", F.col("success") + F.coalesce("__n", F.lit(0)))).drop("__t", "__n")
    return out


def with_serials(entries: DataFrame, serials: DataFrame) -> DataFrame:
    """Entries whose (task, serial) is listed; tasks without any listed serial stay whole."""
    listed = serials.where("serial is not null").select("task", "serial").distinct()
    tasks = listed.select("task").distinct()
    kept = entries.join(listed, ["task", "serial"], "left_semi")
    return kept.unionByName(entries.join(tasks, "task", "left_anti").select(*kept.columns))


def policy_rollup(entries: DataFrame) -> DataFrame:
    """Per task of entries (task, serial, is_policy, types): policies, their types and serials."""
    p = entries.where("is_policy")
    kinds = counted(p, ["task"], preferred_type(F.col("types")), "types")
    return p.groupBy("task").agg(F.count(F.lit(1)).alias("policies"), F.array_sort(F.collect_set("serial")).alias("serials")).join(kinds, "task", "left")


def reusable(entries: DataFrame, before: DataFrame, files: DataFrame | None = None, force: bool = False) -> DataFrame:
    """entries (entry_id, ...) with reused and text_path: those that succeeded in the run before (entry_id, status, text_path), and
    whose file is there if files (path) are given, aren't extracted again."""
    old = before.where("status = 'success' and text_path is not null").select(F.col("entry_id").alias("__e"), "text_path")
    if files is not None:
        old = old.join(files.select(F.col("path").alias("text_path")).distinct(), "text_path", "left_semi").select("__e", "text_path")
    out = entries.join(old.where(F.lit(not force)), F.col("entry_id") == F.col("__e"), "left")
    return out.withColumn("reused", F.col("__e").isNotNull()).drop("__e")


def with_text_document(documents: Column, path: Column, title: Column) -> Column:
    """An entry's documents (structs url, type, title, local_path) with its text: behind the others, instead of the one with its path or URL
    local-text://path."""
    url = F.concat(F.lit("local-text://"), path)
    mine = lambda d: F.coalesce(d["local_path"] == path, F.lit(False)) | F.coalesce(d["url"] == url, F.lit(False))
    new = F.struct(url.alias("url"), F.lit("text").alias("type"), title.alias("title"), path.alias("local_path"))
    return F.when(path.isNull(), documents).otherwise(F.concat(F.filter(documents, lambda d: ~mine(d)), F.array(new)))


def pages(text: Column) -> Column:
    """The pages between form feeds; empty ones at the end aren't any."""
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, "\\f+$", ""), "\\f"))


def density(page: Column) -> Column:
    """Characters of a page, without white space around its lines."""
    return F.length(F.regexp_replace(page, "(?U)(^|(?<=[\\n\\r]))\\s+|\\s+($|(?=[\\n\\r]))|[\\n\\r]", ""))


def pages_for_ocr(text: Column, least: int = 12) -> Column:
    """The places of pages with fewer characters than `least`, if some page has as many."""
    sizes = F.transform(pages(text), density)
    low = F.filter(F.transform(sizes, lambda n, i: F.when(n < least, i)), lambda i: i.isNotNull())
    return F.when(F.exists(sizes, lambda n: n >= least), low).otherwise(F.array().cast("array<int>"))


def running_lines(docs: DataFrame, edge: int = 3, most: int = 60) -> DataFrame:
    """(doc_id, line, n_pages): headers and footers, lines of up to `most` characters among the first or last `edge` of two pages or more."""
    by_page = docs.select("doc_id", F.posexplode(pages(F.col("text"))).alias("page", "body"))
    lines = F.filter(F.transform(F.split("body", "\\r\\n|\\n|\\r"), lambda x: F.btrim(x)), lambda x: x != "")
    at = by_page.select("doc_id", "page", F.explode(F.array_distinct(F.concat(F.slice(lines, 1, edge), F.slice(F.reverse(lines), 1, edge)))).alias("line"))
    return at.where(F.length("line") <= most).groupBy("doc_id", "line").agg(F.count(F.lit(1)).alias("n_pages")).where("n_pages >= 2")


def summary_text(raw: Column) -> Column:
    """A model's summary: one line, without its label, with one full stop; a fixed answer for unclear contents."""
    line = F.regexp_replace(F.btrim(F.regexp_replace(F.btrim(raw), "[\\n\\r]", " ")), "。+$", "")
    core = F.when(line.startswith("摘要："), F.btrim(F.substring(line, F.lit(4), F.length(line)))).otherwise(line)
    return F.when(F.coalesce(core, F.lit("")) == "", "").when(core == UNCLEAR, f"{UNCLEAR}。").otherwise(F.concat(core, F.lit("。")))


def types_of(*columns: str, documents: str | None = None) -> Column:
    """The types that an entry names, its own first."""
    own = F.array(*[plain_type(F.col(c)) for c in columns])
    return F.array_compact(own if documents is None else F.concat(own, F.transform(documents, lambda d: plain_type(d["type"]))))
