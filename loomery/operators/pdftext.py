"""Text of paged documents: running lines and page numbers go, lines that a page's width has wrapped are joined into paragraphs.

Lines are rows. What is on top or at the bottom of two pages is taken out by an anti join; a paragraph ends where there is a blank line
behind a sentence's end or a heading, which a line sees from the one before it; the running number of such ends names the paragraph. One
window over a document's lines, one shuffle by document.

Defined cases: a null or empty text gives an empty one; a document of running lines alone gives an empty text; equal ids are one document only
if their rows are, so ids have to be distinct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# fixed values: lines that are page numbers, the longest running line, marks that end a paragraph, marks that no heading has
PAGE_NUMBERS = (r"^-?\s*[0-9]+\s*-?$", r"^第\s*[0-9]+\s*[页頁]$", r"^第\s*[0-9]+\s*[页頁]\s*/\s*共?\s*[0-9]+\s*[页頁]$", r"^[0-9]+\s*/\s*[0-9]+$", r"(?i)^Page\s*[0-9]+(?:\s*/\s*[0-9]+)?$")
RUNNING_MOST, RUNNING_EDGE = 60, 3
ENDS = ".?!;:。？！；：…)）》」』】"
HEADING_MOST = 20
NOT_IN_HEADINGS = ",.?!；：，。！？:;、"
CJK = "\\u3400-\\u4dbf\\u4e00-\\u9fff\\uf900-\\ufaff\\x{20000}-\\x{2a6df}\\x{2a700}-\\x{2ebef}\\x{30000}-\\x{3134f}"

_JOINED = "\u0000"


def page_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, page, at, line) of docs (doc_id, text): the lines of the pages between form feeds, without white space at their ends."""
    pages = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\\f")).alias("page", "body"))
    lines = pages.select("doc_id", "page", F.posexplode(F.split("body", "\\r\\n|\\n|\\r")).alias("at", "line"))
    return lines.withColumn("line", F.regexp_replace("line", "(?U)^\\s+|\\s+$", ""))


def page_markers(lines: DataFrame, edge: int = RUNNING_EDGE, most: int = RUNNING_MOST) -> DataFrame:
    """(doc_id, line) of lines that are among the first, or among the last, lines with text of pages at least twice."""
    said = lines.where("line <> ''")
    page = W.partitionBy("doc_id", "page")
    up, down = F.row_number().over(page.orderBy("at")), F.row_number().over(page.orderBy(F.desc("at")))
    ends = said.select("doc_id", "line", (up <= edge).alias("top"), (down <= edge).alias("bottom"))
    counts = ends.where(F.length("line") <= most).groupBy("doc_id", "line").agg(F.count_if("top").alias("top"), F.count_if("bottom").alias("bottom"))
    return counts.where("top >= 2 or bottom >= 2").select("doc_id", "line")


def _is_heading(line: Column) -> Column:
    return (F.length(line) <= HEADING_MOST) & ~line.rlike(f"[{NOT_IN_HEADINGS}]")


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of docs (doc_id, text): paragraphs, a line each."""
    lines = page_lines(docs)
    number = F.lit(False)
    for p in PAGE_NUMBERS:
        number = number | F.col("line").rlike(p)
    running = page_markers(lines).select(F.col("doc_id").alias("r_doc"), F.col("line").alias("r_line"))
    kept = lines.where(~number).join(running, F.col("doc_id").eqNullSafe(F.col("r_doc")) & (F.col("line") == F.col("r_line")), "left_anti")
    order = W.partitionBy("doc_id").orderBy("page", "at")
    blanks = F.sum((F.col("line") == "").cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0))
    said = kept.withColumn("blanks", blanks).where("line <> ''")
    said = said.withColumn("last", F.lag("line").over(order)).withColumn("gap", F.col("blanks") > F.lag("blanks").over(order))
    left, right = F.right("last", F.lit(1)), F.left("line", F.lit(1))
    ends = F.col("gap") & (F.contains(F.lit(ENDS), left) | _is_heading(F.col("last")))
    plain = lambda c: c.rlike("[\\p{L}\\p{N}]") & ~c.rlike(f"[{CJK}]")
    between = F.when(F.col("last").isNull(), "").when(ends, "\n").when((left == "-") & right.rlike("\\p{L}"), _JOINED).when(plain(left) & plain(right), " ").otherwise("")
    pieces = said.select("doc_id", F.struct("page", "at", F.concat(between, "line").alias("piece")).alias("p"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["piece"]), "")
    whole = pieces.groupBy(F.col("doc_id").alias("w_doc")).agg(F.regexp_replace(text, f"-*{_JOINED}", "").alias("text"))  # a document's own text
    return docs.select("doc_id").join(whole, F.col("doc_id").eqNullSafe(F.col("w_doc")), "left").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
