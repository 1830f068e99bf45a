"""Sources with fallbacks: of several names the first that is there, and of several tables the first that has rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: where the summary of a task's unique extracts, or of all of them, may be
UNIQUE_NAMES = ("extract_uniq/{slug}_extract.json", "extract_uniq/extract_{slug}.json", "extract_uniq/{slug}_uniq_state.json", "extract_uniq/{slug}_unique.json", "extract_uniq/{slug}/extract_summary.json", "extract_uniq/{slug}/{slug}_extract.json", "extract_uniq/{slug}/state.json")
ALL_NAMES = ("extract/{slug}_extract.json", "extract/extract_{slug}.json")


def names(slug: Column, patterns: tuple[str, ...] = UNIQUE_NAMES) -> Column:
    """The candidates of a task, best first."""
    return F.array(*[F.replace(F.lit(p), F.lit("{slug}"), slug) for p in patterns])


def first_existing(rows: DataFrame, key: str, candidates: str, files: DataFrame, roots: tuple[str, ...] = ("",)) -> DataFrame:
    """(key, path, root) of rows (key, candidates: an array of paths): the first candidate that is among files (path), as it is if it is absolute, or else under
    the roots in turn, all roots before the next candidate. Rows without any aren't there. A join with the listing of files; nothing is probed."""
    each = rows.select(key, F.posexplode(candidates).alias("at", "name")).where("coalesce(name, '') <> ''")
    prefix = lambda r: F.lit(r.rstrip("/") + "/" if r else "")
    under = F.array(*[F.struct(F.lit(i).alias("turn"), F.lit(r).alias("root"), F.when(F.col("name").startswith("/"), F.col("name")).otherwise(F.concat(prefix(r), "name")).alias("whole")) for i, r in enumerate(roots)])
    tries = each.select(key, "at", F.explode(under).alias("u")).select(key, "at", "u.*")
    there = tries.join(files.select("path").distinct(), F.col("whole") == F.col("path"), "left_semi")
    return there.groupBy(key).agg(F.min_by(F.struct(F.col("whole").alias("path"), "root"), F.struct("at", "turn")).alias("f")).select(key, "f.path", "f.root")


def first_filled(*tables: DataFrame) -> DataFrame:
    """The first of the tables that has a row, or else the last. Only whether there is a row is asked for."""
    return next((t for t in tables if not t.isEmpty()), tables[-1])


def corpus_documents(catalogue: DataFrame | None, extracts: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, title, text, source): the documents of the catalogue (ordinal, doc_id, id, title, text_path), or else those of the extracts (ordinal, doc_id, title,
    text_path), with their text of texts (path, text). In the catalogue an id is doc_id, or id, or `doc:` and the row's number; a
    title falls back to the id. Of several rows with an id the last counts; a document without a file has a null text."""
    if catalogue is not None:
        own = F.coalesce(F.nullif(F.btrim("doc_id"), F.lit("")), F.nullif(F.btrim("id"), F.lit("")), F.concat(F.lit("doc:"), (F.col("ordinal") + 1).cast("string")))
        named = catalogue.select("ordinal", own.alias("doc_id"), "title", "text_path", F.lit("stage_fill_info").alias("source"))
    rows = extracts.select("ordinal", "doc_id", "title", "text_path", F.lit("extracts").alias("source"))
    rows = rows if catalogue is None else first_filled(named, rows)
    last = rows.groupBy("doc_id").agg(F.max_by(F.struct("title", "text_path", "source"), "ordinal").alias("r"))
    docs = last.select("doc_id", F.coalesce(F.nullif("r.title", F.lit("")), "doc_id").alias("title"), F.col("r.text_path").alias("text_path"), F.col("r.source").alias("source"))
    return docs.join(texts.select("path", "text"), F.col("text_path") == F.col("path"), "left").select("doc_id", "title", "text", "source")
