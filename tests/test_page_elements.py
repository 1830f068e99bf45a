"""Blocks and listings of pages against a tree that is searched recursively, and the given layouts."""

import re
from html.parser import HTMLParser

import pytest

from loomery.operators import blocks as B
from loomery.operators import listings as L
from loomery.plans import page_queries

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}


class Node:
    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.parent, self.kids = tag, dict(attrs), parent, []

    def walk(self):
        yield self
        for k in self.kids:
            if isinstance(k, Node):
                yield from k.walk()

    def strings(self):
        for k in self.kids:
            if isinstance(k, Node):
                if k.tag not in ("script", "style", "template"):
                    yield from k.strings()
            elif k.strip():
                yield k.strip()


class Tree(HTMLParser):
    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.root = self.now = Node("[document]", {}, None)
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = Node(tag, attrs, self.now)
        self.now.kids.append(node)
        if tag not in VOID:
            self.now = node

    def handle_endtag(self, tag):
        node = self.now
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.now = node.parent

    def handle_data(self, data):
        if self.now.kids and isinstance(self.now.kids[-1], str):
            self.now.kids[-1] += data
        else:
            self.now.kids.append(data)


def plain_text(text):
    from loomery.functions import pagetext as T

    out, blank = [], False
    for raw in text.splitlines():
        line = raw.strip()
        low = line.lower()
        if not line:
            blank = True
        elif line in T.REMOVED_LINES or "下载" in line and ("word" in low or "pdf" in low) or any(p in line for p in T.REMOVED_PARTS) or line.endswith(".pdf"):
            continue
        else:
            if out and out[-1] and any(re.match(p, line) for p in T.BREAK_BEFORE) or blank and out and out[-1]:
                out.append("")
            blank = False
            if not out or out[-1] != line:
                out.append(line)
    return "\n".join(out).strip("\n")


def slow_main(html):
    root = Tree(html or "").root
    nodes = list(root.walk())
    named = [next((n for n in nodes if n.attrs.get("id") == i), None) for i in B.MAIN_IDS]
    named += [next((n for n in nodes if c in (n.attrs.get("class") or "").split()), None) for c in B.MAIN_CLASSES]
    named += [next((n for n in nodes if n.tag == t), None) for t in B.MAIN_TAGS]
    best = None
    for n in dict.fromkeys(x for x in named if x is not None):
        text = plain_text("\n".join(n.strings()))
        lines = [x.strip() for x in text.splitlines() if x.strip()]
        score = sum(len(x) for x in lines if len(x) >= 20) - 20 * sum(len(x) <= 10 for x in lines)
        if score <= 0:
            if len(text) < 80 or len(re.findall("[一-鿿㐀-䶿]", text)) < 30 or len(lines) > 20:
                continue
            score = 1
        depth, up = 0, n.parent
        while up is not None:
            depth, up = depth + 1, up.parent
        if best is None or (score, len(text), depth) >= best[0]:
            best = (score, len(text), depth), n, text
    if best:
        _, node, text = best
        before = nodes[: nodes.index(node)]
        for h in ("h1", "h2", "h3", "h4", "h5", "h6"):
            last = next((n for n in reversed(before) if n.tag == h), None)
            heading = plain_text("\n".join(last.strings())) if last is not None else ""
            if heading:
                return text if heading in text else f"{heading}\n{text}"
        return text
    body = next((n for n in nodes if n.tag == "body"), None)
    text = plain_text("\n".join(body.strings())) if body is not None else ""
    return text or plain_text("\n".join(root.strings()))


LONG = "这是一段足够长的正文内容，用来说明这个页面的主要部分在哪里。"
PAGES = [
    "<html><body><h2>标题甲</h2><div id=zoom><p>" + LONG + "</p><p>短</p></div><div class='article x'>" + LONG * 3 + "</div></body></html>",
    "<h1></h1><h2>二级</h2><div class='TRS_Editor'><p>" + LONG + "<p>" + LONG + "</div><script>x='</p>'</script>",
    "<body>没有候选<br>下载word版<br>打印本页<br>没有候选<p>特此通知</p></body>",
    "<div id=article>" + "".join(f"<p>短句{i}一二三四</p>" for i in range(12)) + "</div><main>" + LONG + "</main>",
    "<div id=article>" + "".join(f"<p>短句{i}</p>" for i in range(40)) + "</div>只有别处",
    "<section><article><h1>里面</h1>" + LONG + "</article></section><article>" + LONG * 9 + "</article>", "", None, "<p>a &lt; b &amp; c</p><!-- x -->d", "<div><p>没关<div id=zoom>" + LONG * 2,
]


def test_main_text_equals_the_recursive_search(spark):
    df = spark.createDataFrame([(i, None, h) for i, h in enumerate(PAGES)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in B.main_blocks(df).collect()}
    assert got == {i: slow_main(h) for i, h in enumerate(PAGES)}
    assert got[0].startswith("标题甲\n") and got[3].startswith("短句") is False


def test_query_equals_the_recursive_search(spark):
    data = "/root/testdata/sf0.001"
    pages = spark.read.parquet(f"{data}/pages.parquet").collect()
    got = {r["page_id"]: r["text"] for r in page_queries.page_main_text(spark, data).collect()}
    assert got == {r["page_id"]: slow_main(r["html"]) for r in pages} and len(got) == len(pages)
    blocks = page_queries.page_candidate_blocks(spark, data).collect()
    assert {r["page_id"] for r in blocks} == set(got) and all(r["score"] >= 0 or r["score"] < 0 for r in blocks)
    entries = page_queries.html_listing_entries(spark, data).collect()
    assert entries and all(r["title"] and r["documents"] for r in entries)


LIST = "http://example.com/list/index.html"
BASE = "http://www.pbc.gov.cn/tiaofasi/144941/144951/index.html"


@pytest.fixture
def entries(spark):
    def read(html, url=LIST, parser=None):
        df = spark.createDataFrame([(1, url, html, parser)], "page_id long, url string, html string, parser string")
        return [r.asDict(recursive=True) for r in L.listing_entries(df).orderBy("serial").collect()]

    return read


def test_table_layout(entries):
    html = "<table><tr><th>序号</th><th>标题</th><th>备注</th><th>下载</th></tr><tr><td>1</td><td><a href='detail1.html'>公告甲</a> (2021年9月30日公布)</td><td>自2022年1月1日起施行</td><td><a href='docs/notice1.doc'>word版</a> <a href='docs/notice1.pdf'>pdf版</a></td></tr><tr><td>x</td><td><a href='y.html'>y</a></td></tr></table>"
    docs = [{"type": t, "url": f"http://example.com/list/{u}", "title": "公告甲"} for t, u in (("html", "detail1.html"), ("word", "docs/notice1.doc"), ("pdf", "docs/notice1.pdf"))]
    assert entries(html) == [{"page_id": 1, "serial": 1, "title": "公告甲", "remark": "(2021年9月30日公布) 自2022年1月1日起施行", "documents": docs}]


def test_list_and_file_layouts(entries):
    html = "<ul class='x txtlist'><li><a href='n1.html' title='标题一'>标题…</a><span class='date'>2024-01-02</span><a href='f.pdf'>下载</a></li><li><a href='n1.html'>again</a></li><li>no</li><li><a href='n2.html'>二</a></li></ul>"
    got = entries(html)
    assert [(e["serial"], e["title"], e["remark"], len(e["documents"])) for e in got] == [(1, "标题一", "2024-01-02", 2), (2, "二", "", 1)]
    html = "<html><body><li>通知1：<a href='doc/notice1.PDF'>下载</a></li><div class='entry'><span>报告全文</span><a href='/files/report.docx'>附件</a></div><a href='index_2.html'>下一页</a></body></html>"
    got = [(e["title"], e["documents"][0]["url"], e["documents"][0]["type"]) for e in entries(html)]
    assert got == [("通知1", "http://example.com/list/doc/notice1.PDF", "pdf"), ("报告全文", "http://example.com/files/report.docx", "word")]
    assert entries(None, None) == [] and entries("", LIST, "card") == []


def test_card_layout(entries):
    html = """<div class="list_box"><div class="list_item"><div class="info"><a href="2024/11/05/notice/index.html" title="关于公开征求意见的通知">关于公开征求意见的通知</a>
      <div class="meta"><span class="date">2024-11-05</span><a href="/tiaofasi/144941/144951/2024/11/notice.pdf">附件下载</a></div></div></div>
      <div class="list_item"><div class="info"><a href="2024/11/03/another/index.html">金融机构管理要求</a><span class="time">2024年11月3日</span></div></div></div>
      <a href="index_2.html">3</a><a href="/else/x.html">else</a><a href="javascript:void(0)">j</a><a href="#top">top</a>"""
    first, second = entries(html, BASE, "card")
    assert (first["title"], first["remark"], first["documents"][0]["type"]) == ("关于公开征求意见的通知", "2024-11-05", "html")
    assert first["documents"][0]["url"].endswith("2024/11/05/notice/index.html") and any(d["url"].endswith("notice.pdf") for d in first["documents"])
    assert (second["title"], second["remark"]) == ("金融机构管理要求", "2024年11月3日")
    (law,) = entries('<div class="info"><a href="/tiaofasi/resource/cms/2018/04/law.doc" title="中华人民共和国某法">x</a></div>', BASE, "card")
    assert law["title"] == "中华人民共和国某法" and law["documents"][0] == {"type": "word", "url": "http://www.pbc.gov.cn/tiaofasi/resource/cms/2018/04/law.doc", "title": "中华人民共和国某法"}
