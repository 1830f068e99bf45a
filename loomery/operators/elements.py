"""Pages as rows of elements and pieces of text. A page is parsed once, in a small helper around the standard library's parser; what is
chosen from it is chosen by columns: an element's number is its place in the array, its text a slice of the pieces."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_SILENT = {"script", "style", "template"}
#: Characters of siblings before a link that are kept; the sibling that reaches them is whole.
BEFORE = 120

ELEMENT = "struct<node:int,end:int,parent:int,depth:int,tag:string,id:string,classes:array<string>,href:string,url:string,title:string,p0:int,p1:int,item:int,box:int,cell:int,before:string,above:array<int>>"
_FIELDS = [f.split(":", 1)[0] for f in re.findall(r"(\w+:(?:array<string>|\w+))", ELEMENT)]
_KIND = pa.struct([(n, pa.list_(pa.string()) if n == "classes" else pa.list_(pa.int32()) if n == "above" else pa.string() if n in ("tag", "id", "href", "url", "title", "before") else pa.int32()) for n in _FIELDS])


class _Elements(HTMLParser):
    """Elements in document order, each with the range of its descendants and of its pieces of text. Links also know the nearest item, box
    (item or paragraph) and cell that they are in, what their siblings before them say, and where what stands before each of four ancestors
    ends and starts: the number of the piece behind it, then of its first piece, where what is above it ends, and so on. Its text would be most of a page for each link."""

    def __init__(self, base: str) -> None:
        super().__init__(convert_charrefs=True)
        self.base, self.pieces, self.elements, self.open, self.data = base, [], [], [], []
        self._add("[document]", {})

    def _text(self) -> None:
        """What has been read since the last tag or comment is one piece."""
        text, self.data = "".join(self.data).strip(), []
        if text and self.open[-1]["tag"] not in _SILENT:
            self.open[-1]["kids"].append((len(self.pieces), len(self.pieces) + 1))
            self.pieces.append(text)

    def _said(self, a: int, b: int) -> str:
        return re.sub(r"\s+", " ", " ".join(self.pieces[a:b]))

    def _add(self, tag: str, attrs: dict) -> None:
        self._text()
        parent = self.open[-1] if self.open else None
        e = dict.fromkeys(_FIELDS) | {"node": len(self.elements), "parent": parent["node"] if parent else -1, "depth": len(self.open), "tag": tag, "p0": len(self.pieces), "kids": []}
        e |= {"id": attrs.get("id"), "classes": (attrs.get("class") or "").split(), "title": attrs.get("title")}
        if tag == "a" and attrs.get("href") is not None:
            e["href"] = attrs["href"].strip()
            try:
                e["url"] = urljoin(self.base, e["href"])
            except ValueError:
                e["url"] = e["href"]
            nearest = lambda *tags: next((x["node"] for x in reversed(self.open) if x["tag"] in tags), None)
            e |= {"item": nearest("li"), "box": nearest("li", "p"), "cell": nearest("td", "th")}
            said: list[str] = []
            for a, b in reversed(parent["kids"]):
                said[:0] = [self._said(a, b)] if b > a else []
                if len(" ".join(said)) >= BEFORE:
                    break
            e["before"], e["above"] = " ".join(said), [len(self.pieces)]
            for x in self.open[:-5:-1]:
                e["above"].append(x["p0"])
                if x["tag"] in ("body", "html"):
                    break
        self.elements.append(e)
        self.open.append(e)

    def _end(self) -> None:
        self._text()
        e = self.open.pop()
        e["end"], e["p1"] = len(self.elements) - 1, len(self.pieces)
        if self.open:
            self.open[-1]["kids"].append((e["p0"], e["p1"]))
        del e["kids"]

    def handle_starttag(self, tag, attrs):
        self._add(tag, dict(reversed(attrs)))
        if tag in _VOID:
            self._end()

    def handle_startendtag(self, tag, attrs):
        self._add(tag, dict(reversed(attrs)))
        self._end()

    def handle_endtag(self, tag):
        self._text()
        if any(x["tag"] == tag for x in self.open[1:]):
            while self.open[-1]["tag"] != tag:
                self._end()
            self._end()

    def handle_data(self, data):
        self.data.append(data)

    def handle_comment(self, data):
        self._text()

    def all(self, html: str) -> tuple[list[dict], list[str]]:
        self.feed(html)
        self.close()
        while self.open:  # what isn't closed ends with the page
            self._end()
        return self.elements, self.pieces


def parsed(pages: DataFrame) -> DataFrame:
    """The pages (page_id, url, html and others) with `els` and `texts` in place of html. A null page has the document alone."""
    keep = [c for c in pages.columns if c != "html"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):  # a page at a time, as its elements may be far more than its bytes
                els, texts = _Elements(batch.column("url")[i].as_py() or "").all(batch.column("html")[i].as_py() or "")
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, 1) for c in keep), pa.array([els], pa.list_(_KIND)), pa.array([texts], pa.list_(pa.string()))], names=[*keep, "els", "texts"])

    types = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in pages.schema if f.name in keep)
    return pages.select(*keep, "html").mapInArrow(run, f"{types}els array<{ELEMENT}>, texts array<string>")


def span(array: str, kind: str, start: Column, end: Column) -> Column:
    """The items of an array column of this kind from one place to before another, read one by one: inside of a function over items, slice copies
    the whole array each time."""
    return F.when(end > start, F.transform(F.sequence(start, end - 1), lambda i: F.get(array, i))).when(end <= start, F.array().cast(f"array<{kind}>"))


def says(e: Column, between: str = " ") -> Column:
    """The text of an element."""
    return F.array_join(span("texts", "string", e["p0"], e["p1"]), between)


def inside(e: Column) -> Column:
    """The descendants of an element."""
    return span("els", ELEMENT, e["node"] + 1, e["end"] + 1)


def links(elements: Column) -> Column:
    return F.filter(elements, lambda x: F.coalesce(x["href"], F.lit("")) != "")
