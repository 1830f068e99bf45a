"""Reading documents: articles under their chapters and sections, parts of records, lists of policies, contents by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomery.operators.articles import WHOLE, split_articles

# fixed values: headings of chapters and sections, anywhere in a text and up to the end of the line
CHAPTER = "第\\s*[一二三四五六七八九十百千万两俩壹贰叁肆伍陆柒捌玖0-9]+\\s*章"
SECTION = "第\\s*[一二三四五六七八九十百千万两俩壹贰叁肆伍陆柒捌玖0-9]+\\s*节"


def _heads(docs: DataFrame, heading: str) -> DataFrame:
    """(doc_id, start, title): headings with their offsets; further ones on the line of a heading belong to it."""
    parts = docs.select("doc_id", F.posexplode(F.split("text", f"(?={heading})")).alias("i", "part"))
    in_order = W.partitionBy("doc_id").orderBy("i")
    start = F.coalesce(F.sum(F.length("part")).over(in_order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    title = F.regexp_extract("part", f"^({heading}[^\\n]*)", 1)
    before = F.lag("part").over(in_order)
    new_line = before.isNull() | F.contains(before, F.lit("\n")) | ~before.rlike(f"^{heading}")
    # a line may have been split at further headings: its pieces are the parts up to the first one with a line's end
    ends = F.coalesce(F.sum(F.contains("part", F.lit("\n")).cast("int")).over(in_order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    piece = F.struct("i", F.regexp_extract("part", "^([^\\n]*)", 1).alias("piece"))
    lined = parts.withColumns({"start": start, "head": title, "new_line": new_line, "line": ends})
    rows = lined.where("head <> '' and new_line").select("doc_id", "i", "start", "line")
    whole = lined.groupBy(F.col("doc_id").alias("d"), F.col("line").alias("l")).agg(F.array_sort(F.collect_list(piece)).alias("pieces"))  # a line's own
    met = rows.join(whole, (F.col("doc_id") == F.col("d")) & (F.col("line") == F.col("l")))
    text = F.array_join(F.transform(F.filter("pieces", lambda x: x["i"] >= F.col("i")), lambda x: x["piece"]), "")
    return met.select("doc_id", "start", F.btrim(text).alias("title"))


def structured(docs: DataFrame, chapter: str = CHAPTER, section: str = SECTION) -> DataFrame:
    """(doc_id, chapter_no, chapter, label, index, article_id, article_no, text) of docs (doc_id, text): each article under the last
    chapter before it, and in chapters with sections under the last section, without which it isn't shown."""
    docs = docs.where("coalesce(text, '') <> ''").select("doc_id", "text")
    none = F.lit(None).cast("string")
    marks = [
        split_articles(docs).select("doc_id", "start", F.lit(2).alias("kind"), none.alias("title"), F.struct("index", "article_id", "article_no", "text").alias("a")),
        *[_heads(docs, h).select("doc_id", "start", F.lit(k).alias("kind"), "title") for k, h in enumerate((chapter, section))],
    ]
    rows = marks[1].unionByName(marks[2]).unionByName(marks[0], allowMissingColumns=True)
    order = W.partitionBy("doc_id").orderBy("start", "kind")
    rows = rows.withColumn("chapter_no", F.sum((F.col("kind") == 0).cast("int")).over(order))
    inside = W.partitionBy("doc_id", "chapter_no")
    last = lambda k, w: F.last(F.when(F.col("kind") == k, F.col("title")), ignorenulls=True).over(w)
    rows = rows.withColumn("chapter", F.coalesce(last(0, order), F.lit(WHOLE))).withColumn("section", last(1, inside.orderBy("start", "kind")))
    rows = rows.withColumn("sections", F.max((F.col("kind") == 1).cast("int")).over(inside)).where("kind = 2 and (sections = 0 or section is not null)")
    return rows.select("doc_id", "chapter_no", "chapter", F.concat_ws(" ", "chapter", "section").alias("label"), "a.*")


def in_range(rows: DataFrame, kind: str, *, title: str = "", index: int | None = None, chapter: str = "", section: str = "", first: int | None = None, last: int | None = None, ids: list[str] | None = None) -> DataFrame:
    """Rows of `structured` in a range: chapter (by a part of its title, or the index-th chapter), section (by parts of
    the titles), articles (ordinals from 1, both ends included, or ids). Any other kind is all."""
    label = F.col("label")
    if kind == "chapter" and index:
        named = rows.where("chapter_no > 0")
        nth = F.dense_rank().over(W.partitionBy("doc_id").orderBy("chapter_no"))
        return named.withColumn("__nth", nth).where(F.col("__nth") == index).drop("__nth")
    if kind == "chapter":
        return rows.where(F.contains(label, F.lit(title)))
    if kind == "section":
        return rows.where(F.contains(label, F.lit(chapter)) & F.contains(label, F.lit(section)))
    if kind in ("articles", "article_ids"):
        if ids:
            rows = rows.where(F.col("article_id").isin(ids))
        if kind == "articles":
            rows = rows.where((F.col("index") >= (first or 1) - 1) & (F.lit(last is None) | (F.col("index") <= (last or 0) - 1)))
    return rows


def plain_text(rows: DataFrame) -> DataFrame:
    """(doc_id, text): the articles of a range in order, one below the other."""
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("index", "text"))), lambda a: a["text"]), "\n").alias("text"))


def parts(records: DataFrame, include: set[str], meta: list[str], text: str = "text", outline: DataFrame | None = None, id_col: str = "doc_id") -> DataFrame:
    """A record's parts that are asked for: meta, text, outline (rows of clauses.outline, as an array), or all."""
    every = "all" in include
    out = records.select(id_col, *(meta if every or "meta" in include else []), *([text] if every or "text" in include else []))
    if outline is not None and (every or "outline" in include):
        items = outline.groupBy(F.col("doc_id").alias("__of")).agg(F.array_sort(F.collect_list(F.struct("line", "level", "number", "label"))).alias("outline"))
        out = out.join(items, F.col(id_col) == F.col("__of"), "left").drop("__of")
    return out


def policy_list(entries: DataFrame, listed: DataFrame | None = None, title: str = "title", norm_title: str = "norm_title") -> DataFrame:
    """Policies sorted by their folded title (or else their title); with `listed` (the white list's rows) these only."""
    kept = entries if listed is None else entries.join(listed, "entry_id", "left_semi")
    return kept.orderBy(F.coalesce(F.nullif(F.col(norm_title), F.lit("")), F.col(title)))


def contents(docs: DataFrame, wanted: DataFrame, page: int = 1, page_size: int = 20) -> DataFrame:
    """The page of distinct wanted ids (ordinal, id) and their documents. The id of an article stands for its
    document, which is what is before a colon, or else before a hyphen."""
    law = F.when(F.contains("id", F.lit(":")), F.split_part("id", F.lit(":"), F.lit(1))).otherwise(F.split_part("id", F.lit("-"), F.lit(1)))
    first = wanted.select("ordinal", law.alias("law_id")).groupBy("law_id").agg(F.min("ordinal").alias("ordinal"))
    chosen = first.orderBy("ordinal").offset(max((page - 1) * page_size, 0)).limit(page_size)
    return docs.join(F.broadcast(chosen), F.col("doc_id").cast("string") == F.col("law_id")).drop("law_id")


def joined_contents(docs: DataFrame, most: int = 10_000) -> Column:
    """An aggregate: titles and texts one below the other, cut at a length. docs has ordinal, title and text."""
    items = F.array_sort(F.collect_list(F.struct("ordinal", F.concat_ws("\n", "title", "text").alias("t"))))
    return F.left(F.array_join(F.transform(items, lambda x: x["t"]), "\n\n"), F.lit(most))


def contents_of(rows: DataFrame, key: str, most: int = 10_000) -> DataFrame:
    """(key, text): titles and texts of rows (key, ordinal, title, text), one below the other, cut at a length. What is behind the length is
    left out before anything is gathered, so that a key's row is never longer."""
    shown = rows.select(key, "ordinal", F.concat_ws("\n", "title", "text").alias("t"))
    before = F.coalesce(F.sum(F.length("t") + 2).over(W.partitionBy(key).orderBy("ordinal").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    near = shown.withColumn("before", before).where(F.col("before") < most + 2).withColumn("t", F.left("t", F.lit(most)))
    items = F.array_sort(F.collect_list(F.struct("ordinal", "t")))
    return near.groupBy(key).agg(F.left(F.array_join(F.transform(items, lambda x: x["t"]), "\n\n"), F.lit(most)).alias("text"))


def first_sentence(articles: DataFrame, patterns: tuple[str, ...], text: str = "text") -> DataFrame:
    """(doc_id, article_id, sentence): of each document the first article that has a sentence with one of the patterns."""
    from loomery.functions.text import find_sentence

    hits = articles.withColumn("sentence", find_sentence(F.col(text), patterns)).where("sentence is not null")
    best = hits.groupBy("doc_id").agg(F.min(F.struct("index", "article_id", "sentence")).alias("b"))
    return best.select("doc_id", "b.article_id", "b.sentence")
