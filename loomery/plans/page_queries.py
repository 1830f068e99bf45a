"""Queries over web pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomery.functions import text as X
from loomery.functions import pagetext as T
from loomery.functions import urls as U
from loomery.operators import blocks as B
from loomery.operators import listings as L
from loomery.operators import pages as P
from loomery.plans.registry import register
from loomery.sources.tables import table

_PATH = r"regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)', 1)"


@register("url_classify", rf"""
WITH e AS (SELECT page_id, lower(regexp_extract({_PATH}, '\.([A-Za-z0-9]+)$', 1)) AS e, url FROM pages)
SELECT page_id, CASE WHEN e = '' THEN 'html' WHEN e = 'pdf' THEN 'pdf' WHEN e IN ('doc', 'docx', 'wps') THEN 'word' WHEN e IN ('xls', 'xlsx') THEN 'excel'
  WHEN e IN ('zip', 'rar') THEN 'archive' WHEN e = 'txt' THEN 'text' WHEN e IN ('html', 'htm') THEN 'html' ELSE 'other' END AS type,
  regexp_matches(url, '^(https?:|[^:]*$|[^a-z]|[a-z0-9+.-]*[^a-z0-9+.:-])', 'i') AS downloadable FROM e""")
def url_classify(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.document_type(F.col("url")).alias("type"), U.downloadable(F.col("url")).alias("downloadable"))


@register("url_path", rf"""SELECT page_id, {_PATH} AS path, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1)) AS host FROM pages""")
def url_path(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.path(F.col("url")).alias("path"), U.host(F.col("url")).alias("host"))


@register("structured_filename", rf"""
SELECT page_id, 'task_' || lpad(page_id::VARCHAR, 6, '0') || '_' || lpad((page_id % 7)::VARCHAR, 3, '0') ||
  CASE WHEN regexp_extract({_PATH}, '\.([A-Za-z0-9]+)$', 1) <> '' THEN '.' || lower(regexp_extract({_PATH}, '\.([A-Za-z0-9]+)$', 1)) ELSE '.html' END AS name FROM pages""")
def structured_filename(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", U.structured_filename(F.lit("task"), F.col("page_id"), F.col("page_id") % 7, F.col("url")).alias("name"))


@register("safe_name", r"""SELECT page_id, trim(regexp_replace(url, '[^\p{L}\p{N}_-]', '_', 'g'), '_') AS name FROM pages""")
def safe_name(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.safe_name(F.col("url")).alias("name"))


@register("html_title", r"""SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title FROM pages""")
def html_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", P.title(F.col("html")).alias("title"))


@register("html_links")
def html_links(spark, sf_dir):
    return P.links(table(spark, sf_dir, "pages"))


@register("html_main_block")
def html_main_block(spark, sf_dir):
    return P.main_block(table(spark, sf_dir, "pages"))


@register("html_listing_entries")
def html_listing_entries(spark, sf_dir):
    """Every page read as a listing of cards at its site's root: its links to pages and files there."""
    p = table(spark, sf_dir, "pages")
    root = F.concat(F.regexp_extract("url", "^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1), F.lit("/index.html"))
    return L.listing_entries(p.select("page_id", root.alias("url"), "html", F.lit("card").alias("parser")))


@register("page_candidate_blocks")
def page_candidate_blocks(spark, sf_dir):
    """The blocks of each page that may hold its document, with their scores; tests compare them with a recursive search."""
    return B.candidate_blocks(table(spark, sf_dir, "pages"))


@register("page_main_text")
def page_main_text(spark, sf_dir):
    """The text of each page's best block; tests compare it with a recursive search."""
    return B.main_blocks(table(spark, sf_dir, "pages"))


@register("listing_layouts", """
WITH s AS (SELECT s_suppkey AS k, s_nationkey AS page_id, s_name, s_nationkey % 4 AS layout, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS i FROM supplier)
SELECT page_id, CASE layout WHEN 0 THEN k ELSE i END AS serial, s_name AS title,
  CASE layout WHEN 0 THEN '(第' || k || '号) 在用' WHEN 1 THEN '2024-0' || (k % 9 + 1) || '-11' WHEN 2 THEN '' ELSE '2024年' || (k % 9 + 1) || '月3日' END AS remark,
  CASE layout WHEN 2 THEN 1 ELSE 2 END::BIGINT AS n_documents,
  CASE layout WHEN 3 THEN 'http://host/a/f/' ELSE 'http://host/list/f/' END || k || CASE layout WHEN 0 THEN '.doc' WHEN 1 THEN '.pdf' WHEN 2 THEN '.xlsx' ELSE '.pdf' END AS last_url,
  CASE layout WHEN 1 THEN s_name || ' 2024-0' || (k % 9 + 1) || '-11' WHEN 3 THEN '说明' || k ELSE s_name END AS last_title,
  CASE layout WHEN 0 THEN 'word' WHEN 2 THEN 'excel' ELSE 'pdf' END AS last_type FROM s""")
def listing_layouts(spark, sf_dir):
    """A page for each nation's suppliers, in one of four layouts by a column of the row."""
    layout, k = F.col("s_nationkey") % 4, F.col("s_suppkey").cast("string")
    cat = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    name, month = F.col("s_name"), (F.col("s_suppkey") % 9 + 1).cast("string")
    row = cat("<tr><td>", k, "</td><td><a href='d/", k, ".html'>", name, "</a> (第", k, "号)</td><td>在用</td><td><a href='f/", k, ".doc'>word版</a></td></tr>")
    item = cat("<li><a href='d/", k, ".html' title='", name, "'>", name, "</a><span class='date'>2024-0", month, "-11</span><a href='f/", k, ".pdf'>下载</a></li>")
    file = cat("<p>", name, "：<a href='f/", k, ".xlsx'>下载</a></p>")
    card = cat("<div><ul><li><a href='d/", k, "/index.html' title='", name, "'>x</a><span class='time'>2024年", month, "月3日</span><p><a href='../f/", k, ".pdf' title='说明", k, "'>附件</a></p></li></ul></div>")
    one = F.when(layout == 0, row).when(layout == 1, item).when(layout == 2, file).otherwise(card)
    # by number, as AQE would put the pages, few bytes that are much work, into one task
    rows = table(spark, sf_dir, "supplier").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "s_nationkey")
    pages = rows.groupBy(F.col("s_nationkey").alias("page_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", one.alias("h")))), lambda x: x["h"]), "\n").alias("h"))
    mod = F.col("page_id") % 4
    html = F.when(mod == 0, cat("<table><tr><th>号</th><th>名</th></tr>", F.col("h"), "</table>")).when(mod == 1, cat("<ul class='a txtlist'>", F.col("h"), "</ul>")).otherwise(F.col("h"))
    pages = pages.select("page_id", F.when(mod == 3, "http://host/a/b/index.html").otherwise("http://host/list/index.html").alias("url"), html.alias("html"), F.when(mod == 3, "card").otherwise("plain").alias("parser"))
    last = F.element_at("documents", -1)
    return L.listing_entries(pages).select("page_id", "serial", "title", "remark", F.size("documents").cast("long").alias("n_documents"), last["url"].alias("last_url"), last["title"].alias("last_title"), last["type"].alias("last_type"))


def _lists(spark, sf_dir):
    """A page for each nation, with a table of its suppliers: number, linked name, file and remark, and links to other pages."""
    row = F.format_string("<tr><td>%d</td><td><a href='d/%d.html'>%s</a></td><td><a href='f/%d.pdf'>附件</a> <b>在用</b></td></tr>", "s_suppkey", "s_suppkey", "s_name", "s_suppkey")
    rows = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("page_id")).agg(F.array_join(F.array_sort(F.collect_list(row)), "").alias("rows"))
    html = F.concat(F.lit("<html><head><title>t</title></head><body><table>"), "rows", F.lit("</table><a href='p2.html'>下一页</a><a href='p2.html'>2</a><a href='/x/p3.html'>3</a><a href='p9.html'>尾页</a></body></html>"))
    return rows.select("page_id", F.lit("http://host/list/p1.html").alias("url"), html.alias("html"))


@register("listing_rows", """
SELECT s_nationkey AS page_id, s_suppkey AS serial, s_name AS title, '在用' AS remark, ['http://host/list/d/' || s_suppkey || '.html', 'http://host/list/f/' || s_suppkey || '.pdf'] AS urls FROM supplier""")
def listing_rows(spark, sf_dir):
    return P.listing_entries(_lists(spark, sf_dir))


@register("page_attachments", """
SELECT s_nationkey AS page_id, 'http://host/list/f/' || s_suppkey || '.pdf' AS url, 'pdf' AS type, '附件' AS text FROM supplier""")
def page_attachments(spark, sf_dir):
    return P.attachments(P.links(_lists(spark, sf_dir))).drop("position")


@register("page_pagination", """
SELECT DISTINCT s_nationkey AS page_id, url, role FROM supplier, (VALUES ('http://host/list/p2.html', 'next'), ('http://host/list/p9.html', 'last')) AS v(url, role)""")
def page_pagination(spark, sf_dir):
    return P.pagination(P.links(_lists(spark, sf_dir)), "http://host/list/p1.html").select("page_id", "url", "role")


@register("page_texts", r"""
SELECT s_suppkey, s_name || chr(10) || chr(10) || 'text' || chr(10) || chr(10) || '特此通知' AS text, CASE WHEN length(s_name) >= 20 THEN length(s_name) WHEN length(s_name) <= 10 THEN -20 ELSE 0 END - 40 AS score FROM supplier""")
def page_texts(spark, sf_dir):
    raw = F.concat(F.lit("\n打印本页\n"), "s_name", F.lit("\n"), "s_name", F.lit("\n\n\n当前所在位置：首页\n\n text \r\ntext\n下载word版\na.pdf\n特此通知\n\n"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", T.page_text(raw).alias("text"))
    return s.select("s_suppkey", "text", T.prose_score(F.col("text")).alias("score"))
