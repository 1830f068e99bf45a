"""Articles of documents: splitting, offsets, headings, neighbours and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# fixed values: the heading of an article, anywhere in a text
HEADING = "第\\s*[一二三四五六七八九十百千万两俩壹贰叁肆伍陆柒捌玖0-9]+\\s*条"
CHAPTER = "第[一二三四五六七八九十百千0-9]+章[^\\n]*"
WHOLE = "全文"


def split_articles(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", heading: str = HEADING, whole: str = WHOLE) -> DataFrame:
    """(doc_id, index, article_id, article_no, text, start): a row per section. A heading opens a section
    wherever it stands; a preamble that isn't blank is a section named `whole`. Section ids are ordinal."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    cut = docs.where(t != "").select(F.col(id_col).alias("doc_id"), F.split(t, f"(?={heading})").alias("parts"))
    # a split by look-ahead keeps all characters, so that offsets are running lengths
    rows = cut.select("doc_id", F.posexplode("parts").alias("pos", "part"))
    start = F.coalesce(F.sum(F.length("part")).over(W.partitionBy("doc_id").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    head = F.regexp_extract("part", f"^({heading})", 1)
    rows = rows.withColumn("start", start).withColumn("head", head)
    body = F.regexp_replace(F.substring(F.col("part"), F.length("head") + 1, F.length("part")), "(?U)^\\s+|\\s+$", "")
    rows = rows.withColumn("body", body).where("head <> '' or body <> ''")
    index = F.row_number().over(W.partitionBy("doc_id").orderBy("pos")) - 1
    no = F.when(F.col("head") != "", F.btrim("head")).otherwise(whole)
    text = F.when(F.col("body") != "", F.concat(no, F.lit("\n"), F.col("body"))).otherwise(no)
    return rows.select("doc_id", index.alias("index"), F.concat(F.col("doc_id").cast("string"), F.lit("-article-"), (index + 1).cast("string")).alias("article_id"), no.alias("article_no"), text.alias("text"), "start")


def headings(docs: DataFrame, pattern: str = CHAPTER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, title, start, end): headings at line starts, each ending where the next one starts."""
    lines = docs.select(F.col(id_col).alias("doc_id"), F.length(text_col).alias("total"), F.posexplode(F.split(text_col, "\n")).alias("line_no", "line"))
    w = W.partitionBy("doc_id").orderBy("line_no")
    start = F.coalesce(F.sum(F.length("line") + 1).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    found = lines.withColumn("start", start).where(F.col("line").rlike(f"^\\s*{pattern}"))
    return found.select("doc_id", F.btrim("line").alias("title"), "start", F.lead("start").over(W.partitionBy("doc_id").orderBy("start")).alias("next"), "total").select("doc_id", "title", "start", F.coalesce("next", "total").alias("end"))


def carry_forward(rows: DataFrame, key: str, order: str, value: str, out: str) -> DataFrame:
    """The last non-null value so far, in order."""
    return rows.withColumn(out, F.last(value, ignorenulls=True).over(W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)))


def neighbours(rows: DataFrame, key: str, order: str, distance: int, columns: list[str]) -> DataFrame:
    """Adds prev_n and next_n of columns up to a distance."""
    w = W.partitionBy(key).orderBy(order)
    for c in columns:
        for n in range(1, distance + 1):
            rows = rows.withColumn(f"prev_{n}_{c}", F.lag(c, n).over(w)).withColumn(f"next_{n}_{c}", F.lead(c, n).over(w))
    return rows


def within_budget(rows: DataFrame, key: str, order: list[Column], text: str, budget: int) -> DataFrame:
    """Rows in order until the budget of characters is spent; the last one is cut."""
    before = F.coalesce(F.sum(F.length(text)).over(W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("__before", before).where(F.col("__before") < budget).withColumn(text, F.left(F.col(text), F.lit(budget) - F.col("__before"))).drop("__before")


def document_range(articles: DataFrame, ids: list[str] | None = None, first: int | None = None, last: int | None = None) -> DataFrame:
    """Articles by id, or by ordinal from 1, both ends included; a filter that nothing meets gives nothing."""
    out = articles
    if ids:
        out = out.where(F.col("article_id").isin(ids))
    if first is not None:
        out = out.where(F.col("index") + 1 >= first)
    if last is not None:
        out = out.where(F.col("index") + 1 <= last)
    return out


def provision_context(articles: DataFrame, targets: DataFrame, distance: int = 1, budget: int | None = None) -> DataFrame:
    """(target, role, article_id, text): each target article (article_id) with its neighbours, the target first,
    within a budget of characters per target. A distance of 0 counts as 1."""
    r = max(1, distance)
    t = articles.join(targets.select(F.col("article_id").alias("target")), F.col("article_id") == F.col("target")).select("target", F.col("doc_id").alias("t_doc"), F.col("index").alias("t_index"))
    # neighbours by an equi join on the ordinal, not by a range
    near = t.withColumn("want", F.explode(F.sequence(F.col("t_index") - r, F.col("t_index") + r)))
    rows = articles.join(near, (F.col("doc_id") == F.col("t_doc")) & (F.col("index") == F.col("want")))
    role = F.when(F.col("index") == F.col("t_index"), "target").otherwise("neighbor")
    rows = rows.select("target", role.alias("role"), "article_id", "index", "text")
    if budget:
        rows = within_budget(rows, "target", [F.col("role").desc(), F.col("index")], "text", budget)
    return rows.drop("index")
