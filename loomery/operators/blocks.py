"""The block of a page that holds its document: candidates by id, class and tag, each with the score of its text, and the best of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomery.functions import pagetext as T
from loomery.operators.elements import parsed, says

# fixed values: what names the block of a page's document, and how short a notice may be
MAIN_IDS = ("zoom", "Zoom", "zoomfont", "zoomFont", "ZoomFont", "article", "articleBody", "articleContent", "article_content", "articlecontent", "articleText", "articleDetails", "artibody")
MAIN_CLASSES = ("zoom", "article", "article-body", "article_content", "article-content", "articleContent", "articleText", "TRS_Editor", "TRS_EditorView")
MAIN_TAGS = ("article", "main", "section")
LEAST_CHARS, LEAST_CJK, MOST_LINES = 80, 30, 20


def _candidates() -> Column:
    first = lambda known: F.get(F.filter("els", known), F.lit(0))
    named = [first(_has_id(i)) for i in MAIN_IDS] + [first(_has_class(c)) for c in MAIN_CLASSES] + [first(_is_tag(t)) for t in MAIN_TAGS]
    return F.array_distinct(F.array_compact(F.array(*named)))


def _has_id(name: str):
    return lambda e: e["id"] == name


def _has_class(name: str):
    return lambda e: F.array_contains(e["classes"], name)


def _is_tag(name: str):
    return lambda e: e["tag"] == name


def _text(e: Column) -> Column:
    return T.page_text(says(e, "\n"))


def candidate_blocks(pages: DataFrame) -> DataFrame:
    """(page_id, n, node, depth, tag, text, link_chars, score) of every candidate of pages (page_id, url, html), in the order in which they are
    named. The score is that of the text as prose; a short notice without one has 1 if it is compact and has enough CJK characters, and others 0 or less."""
    rows = parsed(pages.select("page_id", "url", "html"))
    each = rows.select("page_id", "els", "texts", F.posexplode(_candidates()).alias("n", "e"))
    linked = F.aggregate(F.filter(F.slice("els", F.col("e.node") + 2, F.col("e.end") - F.col("e.node")), lambda x: x["href"].isNotNull()), F.lit(0), lambda a, x: a + F.length(says(x)))
    made = each.select("page_id", "n", "e.node", "e.depth", "e.tag", F.explode(F.array(_text(F.col("e")))).alias("text"), linked.alias("link_chars"))
    prose = T.prose_score(F.col("text"))
    lines = F.size(F.filter(F.split("text", "\n"), lambda x: F.btrim(x) != ""))
    cjk = F.length(F.regexp_replace("text", "[^\\u4e00-\\u9fff\\u3400-\\u4dbf\\x{20000}-\\x{2ebe0}]", ""))
    compact = (F.length("text") >= LEAST_CHARS) & (cjk >= LEAST_CJK) & (lines <= MOST_LINES)
    return made.withColumn("score", F.when(prose > 0, prose).when(compact, 1).otherwise(F.least(prose, F.lit(0))).cast("long"))


def main_blocks(pages: DataFrame) -> DataFrame:
    """(page_id, text) of each page: the best candidate's, with the heading before it if it lacks that, or else the body's, or else all text.
    The best has the highest score, then the longest text, then the greatest depth, then the last place."""
    best = candidate_blocks(pages).where("score > 0").groupBy(F.col("page_id").alias("b_page")).agg(F.max_by(F.struct("node", "text"), F.struct("score", F.length("text"), "depth", "n")).alias("b"))
    rows = parsed(pages.select("page_id", "url", "html")).join(best, F.col("page_id") == F.col("b_page"), "left")

    def before(name: str) -> Column:
        found = F.filter("els", lambda e: (e["tag"] == name) & (e["node"] < F.col("b.node")))
        return F.nullif(F.element_at(F.transform(F.slice(found, -1, 1), _text), 1), F.lit(""))

    nearest = [F.when(F.exists("els", lambda e: (e["tag"] == f"h{i}") & (e["node"] < F.col("b.node"))), before(f"h{i}")) for i in range(1, 7)]
    heading = F.when(F.col("b").isNotNull(), F.coalesce(*nearest))
    body = F.get(F.filter("els", _is_tag("body")), F.lit(0))
    rest = F.coalesce(F.when(body.isNotNull(), F.nullif(_text(body), F.lit(""))), _text(F.get("els", F.lit(0))))
    ready = rows.select("page_id", "b", F.explode(F.array(heading)).alias("h"), F.when(F.col("b").isNull(), rest).alias("rest"))
    text = F.when(F.col("h").isNotNull() & ~F.contains("b.text", F.col("h")), F.concat_ws("\n", "h", "b.text")).otherwise(F.col("b.text"))
    return ready.select("page_id", F.when(F.col("b").isNotNull(), text).otherwise(F.col("rest")).alias("text"))
