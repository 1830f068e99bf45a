"""Listing entries, links, titles and main text of HTML pages, with the standard library's parser."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomery.functions import urls as U

_VOID = {"br", "img", "meta", "link", "input", "hr", "source", "wbr"}
_SKIP = {"script", "style", "noscript", "template"}
_BLOCK = {"p", "div", "li", "tr", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "ul", "ol", "table", "br", "title", "nav", "header", "footer", "main", "body"}


class _Page(HTMLParser):
    """Collects the title, links with their texts, table rows, and text by block."""

    def __init__(self, base: str):
        super().__init__(convert_charrefs=True)
        self.base, self.title, self.links, self.rows, self.blocks = base, "", [], [], []
        self.stack: list[str] = []
        self.text: list[str] = []
        self.link: tuple[str, list[str]] | None = None
        self.row: dict | None = None

    def flush(self):
        text = re.sub(r"\s+", " ", "".join(self.text)).strip()
        if text:
            self.blocks.append((next((t for t in reversed(self.stack) if t in ("nav", "header", "footer", "main", "article", "title")), "body"), text))
        self.text = []

    def handle_starttag(self, tag, attrs):
        if tag in _BLOCK:
            self.flush()
        if tag not in _VOID:
            self.stack.append(tag)
        if tag == "tr":
            self.row = {"text": [], "links": []}
        if tag in ("td", "th") and self.row is not None:
            self.row["text"].append(" ")
        href = dict(attrs).get("href")
        if tag == "a" and href:
            self.link = (urljoin(self.base, href.strip()), [])

    def handle_endtag(self, tag):
        if tag in _BLOCK:
            self.flush()
        if tag == "a" and self.link:
            done = (self.link[0], re.sub(r"\s+", " ", "".join(self.link[1])).strip())
            self.links.append(done)
            if self.row is not None:
                self.row["links"].append(done)
            self.link = None
        if tag == "tr" and self.row is not None:
            self.rows.append((re.sub(r"\s+", " ", "".join(self.row["text"])).strip(), self.row["links"]))
            self.row = None
        if tag in self.stack:
            while self.stack and self.stack.pop() != tag:
                pass

    def handle_data(self, data):
        if any(t in _SKIP for t in self.stack):
            return
        if self.stack and self.stack[-1] == "title":
            self.title += data
        self.text.append(data)
        if self.link:
            self.link[1].append(data)
        if self.row is not None:
            self.row["text"].append(data)


def parse(html: str | None, url: str | None) -> _Page:
    page = _Page(url or "")
    page.feed(html or "")
    page.close()
    page.flush()
    return page


def _rows(pages: DataFrame, schema: str, make, columns: list[str]) -> DataFrame:
    """A row per thing that a page holds; pages are parsed one at a time in each batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(i, *row) for i, url, html in zip(batch["page_id"], batch["url"], batch["html"]) for row in make(parse(html, url))]
            yield pd.DataFrame(out, columns=["page_id", *columns])

    return pages.select("page_id", "url", "html").mapInPandas(run, f"page_id long, {schema}")


def links(pages: DataFrame) -> DataFrame:
    """(page_id, position, url, text) of each link, made absolute."""
    return _rows(pages, "position long, url string, text string", lambda p: [(k, u, t) for k, (u, t) in enumerate(p.links)], ["position", "url", "text"])


def listing_entries(pages: DataFrame) -> DataFrame:
    """(page_id, serial, title, remark, urls) of table rows with a link: a leading number is the serial, the first link's
    text the title, what else the row says the remark."""

    def make(p: _Page):
        for text, found in p.rows:
            if not found:
                continue
            title = next((t for _, t in found if t), "")
            serial = re.match(r"\d+", text)
            rest = text.replace(title, "", 1)
            rest = rest[serial.end() :] if serial else rest
            for _, t in found[1:]:
                rest = rest.replace(t, "", 1)
            yield (int(serial[0]) if serial else None, title, re.sub(r"[\s,，]+", " ", rest).strip(), [u for u, _ in found])

    return _rows(pages, "serial long, title string, remark string, urls array<string>", make, ["serial", "title", "remark", "urls"])


def main_block(pages: DataFrame) -> DataFrame:
    """(page_id, title, main): text outside of navigation, without consecutive repeats of a line."""

    def make(p: _Page):
        lines = [t for where, t in p.blocks if where not in ("nav", "header", "footer", "title")]
        kept = [t for k, t in enumerate(lines) if not k or t != lines[k - 1]]
        return [(re.sub(r"\s+", " ", p.title).strip(), "\n".join(kept))]

    return _rows(pages, "title string, main string", make, ["title", "main"])


def title(html):
    """The title element by a pattern alone, JVM-side."""
    return F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1)


# fixed values: labels of links to other pages of a list
PAGE_LABELS = ("下一页", "下页", "上一页", "末页", "尾页", "首页", "<", ">", "«", "»", "‹", "›", "<<", ">>")
PAGE_ROLES = {"next": ("下一页", "下页"), "prev": ("上一页", "上页"), "first": ("首页",), "last": ("末页", "尾页")}


def attachments(found: DataFrame) -> DataFrame:
    """(page_id, position, url, type, text) of links (page_id, position, url, text) that lead to documents other than pages, each
    URL of a page once."""
    kind = U.document_type(F.col("url"))
    docs = found.where(U.downloadable(F.col("url"))).withColumn("type", kind).where("type <> 'html'")
    first = docs.groupBy("page_id", "url").agg(F.min(F.struct("position", "type", "text")).alias("f"))
    return first.select("page_id", "f.position", "url", "f.type", "f.text")


def pagination(found: DataFrame, start: str) -> DataFrame:
    """(page_id, position, url, text, role) of links that lead to other pages of the list at `start`: their label is a number or
    names such a page, and they are in its folder. role is the first link's of each kind."""
    label = F.regexp_replace("text", "\\s+", "")
    folder = F.regexp_extract(U.path(F.lit(start)), "^(.*)/", 1)
    pages_ = found.where(label.isin(*PAGE_LABELS) | label.rlike("^(第)?[0-9]+页?$")).where(F.startswith(U.path(F.col("url")), folder))
    first = pages_.groupBy("page_id", "url").agg(F.min(F.struct("position", "text")).alias("f")).select("page_id", "f.position", "url", "f.text")
    role = F.when(F.lit(False), "")
    for name, labels in PAGE_ROLES.items():
        role = role.when(F.btrim("text").isin(*labels), name)
    rows = first.withColumn("role", role.otherwise(None))
    nth = F.row_number().over(W.partitionBy("page_id", "role").orderBy("position"))
    return rows.withColumn("n", nth).withColumn("role", F.when(F.col("n") == 1, F.col("role"))).drop("n")
