"""Entries of listing pages in three layouts (tables, lists of texts, files) and as cards, by a column that names the parser.

One plan serves all rows: pages are parsed to elements once, and each layout is an expression over them. Of a page in the plain
layouts the table's entries count, or else the list's, or else its files; a page of cards without any falls back to these.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomery.functions import urls as U
from loomery.functions.text import let
from loomery.operators.elements import ELEMENT, inside, links, parsed, says, span

# fixed values: labels that say nothing, what is cut from labels, file types, labels of other pages, dates
GENERIC = ("下载", "查看", "详情", "点击查看", "点击下载", "附件", "word", "pdf", "doc", "docx", "wps", "xls", "xlsx", "zip", "rar")
GENERIC_PHRASES = (
    r"(?i)下载\s*(?:word|wps|pdf|docx?|xls|xlsx|zip|rar)\s*(?:版)?",
    r"(?i)(?:word|wps|pdf|docx?|xls|xlsx|zip|rar)\s*下载",
    r"(?i)附件\s*(?:下载|查看)",
    r"(?i)点击\s*(?:下载|查看)",
)
GENERIC_MARKS = r"[\s：:（）()【】\[\]<>“”\"'·、，。；,.;!！?？]"
GENERIC_LABEL = r"^(点击)?(查看|下载|附件)?(word|wps|pdf|docx?|xls|xlsx)?(下载|查看)?$"
FILE_TYPES = ("pdf", "word", "excel", "archive")
OTHER_PAGES = ("下一页", "下页", "上一页", "末页", "尾页", "首页")
DATES = r"[0-9]{4}[-/.年][0-9]{1,2}[-/.月][0-9]{1,2}(?:日|号)?", r"[0-9]{4}\s*年\s*[0-9]{1,2}\s*月\s*[0-9]{1,2}\s*日?"

DOCUMENT = "struct<type:string,url:string,title:string>"
ENTRY = f"struct<serial:bigint,title:string,remark:string,documents:array<{DOCUMENT}>>"


def _flat(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, "(?U)\\s+", " "))


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, "(?U)^\\s+|\\s+$", "")


def _without_first(text: Column, part: Column) -> Column:
    """The text with the first occurrence of a part taken out."""
    at = F.position(part, text)
    return F.when((part != "") & (at > 0), F.concat(F.substring(text, F.lit(1), at - 1), F.substring(text, at + F.length(part), F.length(text)))).otherwise(text)


def _bare(text: Column) -> Column:
    out = _flat(text)
    for phrase in GENERIC_PHRASES:
        out = F.regexp_replace(out, phrase, " ")
    out = F.regexp_replace(_flat(out), "([：:])\\s+", "$1")
    for word in GENERIC:
        out = _strip(F.regexp_replace(out, f"(?i){word}$", ""))
    return _strip(F.regexp_replace(out, "[:：\\-—··•·]+$", ""))


def _tidy(text: Column) -> Column:
    return let(_bare(text), lambda out: F.when(F.length(out) > 200, _strip(F.substring(out, 1, 200))).otherwise(out))


#: Of a long text so many pieces and characters are read first.
FIRST_PIECES, FIRST = 200, 800


def _tidy_part(part: Column) -> Column:
    """A text, or that of a range of pieces, made tidy. Of a long range the first characters do if they leave far more than the 200 that are kept: a phrase that is
    cut at their end, or a generic word and a run of marks at the end of all, then lie behind these 200. Otherwise all of it is read."""
    a, b = part["a"], part["b"]

    def joined(end: Column) -> Column:
        text = F.array_join(span("texts", "string", a, end), " ")
        return F.when(part["above"], F.translate(text, "\x1c\x1d\x1e\x1f", "    ")).otherwise(text)

    def of(few: Column) -> Column:
        whole = (b - a <= FIRST_PIECES) & (F.length(few) <= FIRST)
        enough = lambda t: (F.length(t) >= 500) & F.substring(t, 201, 100).rlike("[\\p{L}\\p{N}]")
        return F.when(whole, _tidy(few)).otherwise(let(_bare(F.substring(few, 1, FIRST)), lambda t: F.when(enough(t), _strip(F.substring(t, 1, 200))).otherwise(_tidy(joined(b)))))

    return F.when(part["a"].isNull(), _tidy(part["text"])).otherwise(let(joined(F.least(b, a + FIRST_PIECES)), of))


def _says_nothing(text: Column) -> Column:
    low = F.regexp_replace(F.lower(text), GENERIC_MARKS, "")
    for suffix in ("版", "本"):
        low = F.regexp_replace(low, f"{suffix}$", "")
    return (low == "") | low.isin(*GENERIC) | low.rlike(GENERIC_LABEL)


def label(a: Column) -> Column:
    """What a link is called: of its title, the texts before it, its own and its box's the first that says something, or else the file's name. A text is
    made only once those before it say nothing."""
    title = _strip(F.coalesce(a["title"], F.lit("")))
    has_title = F.coalesce(a["title"], F.lit("")) != ""
    cell = F.get("els", a["cell"])
    row = F.get("els", cell["parent"])
    cells = F.filter(span("els", ELEMENT, row["node"] + 1, F.greatest(cell["node"], row["node"] + 1)), lambda x: x["tag"].isin("td", "th") & (x["p1"] > x["p0"]))
    in_row = F.when(row["tag"] == "tr", let(cells, lambda cs: F.get(cs, F.size(cs) - 1)))
    part = lambda text, start, end, above=False: F.struct(text.cast("string").alias("text"), start.cast("int").alias("a"), end.cast("int").alias("b"), F.lit(above).alias("above"))
    null = F.lit(None)
    text = lambda c: F.array(part(c, null, null))
    of = lambda e: F.array(part(null, e["p0"], e["p1"]))
    lead = F.concat(text(a["before"]), F.transform(F.slice(a["above"], 2, 4), lambda start, i: part(null, start, F.get(a["above"], i), True)))
    ends = F.concat(of(a), of(F.get("els", a["box"])))
    ordered = let(
        in_row,
        lambda c: F.when(has_title & c.isNotNull(), F.concat(of(c), lead, text(title), ends)).when(has_title, F.concat(text(title), lead, ends)).otherwise(F.concat(lead, of(c), ends)),
    )

    def step(found: Column, part: Column) -> Column:
        new = lambda t: F.struct(F.when(~_says_nothing(t), t).alias("said"), F.coalesce(found["other"], t).alias("other"))
        return F.when(found["said"].isNotNull(), found).otherwise(let(_tidy_part(part), lambda t: F.when(F.coalesce(t, F.lit("")) == "", found).otherwise(new(t))))

    best = F.aggregate(ordered, F.struct(null.cast("string").alias("said"), null.cast("string").alias("other")), step)
    file = F.regexp_extract(U.path(a["url"]), "([^/]*)$", 1)
    return let(best, lambda x: F.coalesce(x["said"], x["other"], F.nullif(file, F.lit("")), F.regexp_replace(a["url"], "[^\\p{L}\\p{N}_-]", "_")))


def _label_of(a: Column) -> Column:
    """A link's label, once all are there as a column."""
    return F.get("labels", a["node"])


def _document(kind: Column, url: Column, title: Column) -> Column:
    return F.struct(kind.alias("type"), url.alias("url"), title.alias("title"))


def _entry(serial: Column, title: Column, remark: Column, documents: Column) -> Column:
    return F.struct(serial.cast("long").alias("serial"), title.alias("title"), remark.alias("remark"), documents.alias("documents"))


def _once(items: Column, key) -> Column:
    """Of items with one key the first; none of those without a key. Keys are sorted and not looked up, so that long lists aren't squared."""

    def firsts(its: Column) -> Column:
        keys = F.sort_array(F.filter(F.transform(its, lambda x, i: F.struct(key(x).alias("key"), i.alias("i"))), lambda p: p["key"].isNotNull()))
        places = let(keys, lambda ks: F.sort_array(F.transform(F.filter(ks, lambda p, i: (i == 0) | (p["key"] != F.get(ks, i - 1)["key"])), lambda p: p["i"])))
        return F.transform(places, lambda i: F.get(its, i))

    return let(items, firsts)


def _title_of(a: Column, text: Column) -> Column:
    return F.coalesce(F.nullif(_strip(F.coalesce(a["title"], F.lit(""))), F.lit("")), text)


def _further(within: Column, main: Column) -> Column:
    """The other links of an element that lead to a document of known type, each URL once."""
    others = F.filter(links(within), lambda x: (x["url"] != main) & (U.document_type(x["url"]) != "other"))
    return _once(others, lambda x: x["url"])


def _in_table(tr: Column) -> Column:
    """A row whose first cell is a number and whose second has a link to a page; null for others."""
    return let(F.filter(inside(tr), lambda x: (x["parent"] == tr["node"]) & x["tag"].isin("td", "th")), lambda cells: _of_cells(tr, cells))


def _of_cells(tr: Column, cells: Column) -> Column:
    number = F.regexp_replace(F.regexp_replace(F.regexp_replace(says(F.get(cells, F.lit(0))), "(?U)[\\s\\u3000]+", ""), "^[．.、)]+|[．.、)]+$", ""), "^[(]+|[(]+$", "")
    serial = F.when(number.rlike("^[0-9]+$"), number.try_cast("long"))

    def with_link(second: Column, a: Column) -> Column:
        title = _title_of(a, says(a))
        noted = F.filter(inside(second), lambda x: F.array_contains(x["classes"], "gz_tit2"))
        note = F.nullif(F.when(F.size(noted) > 0, _strip(says(F.get(noted, F.lit(0))))), F.lit(""))
        cell_text = says(second)
        rest = F.when((title != "") & F.contains(cell_text, title), _strip(_without_first(cell_text, title))).otherwise(_strip(cell_text))
        notes = F.transform(F.slice(cells, 3, 1 << 20), lambda c: F.aggregate(F.transform(F.filter(inside(c), lambda x: x["href"].isNotNull()), lambda x: says(x)), says(c), lambda t, part: _strip(_without_first(t, part))))
        remark = _strip(F.array_join(F.filter(F.concat(F.array(F.coalesce(note, rest)), notes), lambda x: x != ""), " "))

        def named(x: Column) -> Column:
            said = _label_of(x)
            times = (F.length(said) - F.length(F.replace(said, title, F.lit("")))) > 0
            same = (title != "") & (F.startswith(F.ltrim(said), serial.cast("string")) | (times & (F.length(said) > F.length(title) + 5)) | (said == ""))
            return _document(U.document_type(x["url"]), x["url"], F.when(same, title).otherwise(said))

        files = F.transform(_further(inside(tr), a["url"]), named)
        return _entry(serial, title, remark, F.concat(F.array(_document(F.lit("html"), a["url"], title)), files))

    second = F.get(cells, F.lit(1))
    first_link = F.get(F.filter(inside(second), lambda x: x["href"].isNotNull()), F.lit(0))
    good = (F.size(cells) >= 2) & serial.isNotNull() & (F.coalesce(first_link["href"], F.lit("")) != "") & (U.document_type(first_link["url"]) == "html")
    return F.when(F.coalesce(good, F.lit(False)), with_link(second, first_link))


def table_entries() -> Column:
    return F.array_compact(F.transform(F.filter("els", lambda e: e["tag"] == "tr"), _in_table))


def _numbered(entries: Column) -> Column:
    return F.transform(entries, lambda e, i: e.withField("serial", (i + 1).cast("long")))


def _in_list(item: Column) -> Column:
    return let(F.get(F.filter(inside(item), lambda x: x["href"].isNotNull()), F.lit(0)), lambda a: _of_item(item, a))


def _of_item(item: Column, a: Column) -> Column:
    title = _title_of(a, says(a))
    dated = F.get(F.filter(inside(item), lambda x: (x["tag"] == "span") & F.array_contains(x["classes"], "date")), F.lit(0))
    remark = F.coalesce(says(dated), F.lit(""))
    files = F.transform(_further(inside(item), a["url"]), lambda x: _document(U.document_type(x["url"]), x["url"], _label_of(x)))
    return F.when(F.coalesce(a["href"], F.lit("")) != "", _entry(F.lit(0), title, remark, F.concat(F.array(_document(F.lit("html"), a["url"], title)), files)))


def list_entries() -> Column:
    """Items of lists of class txtlist with a link, each page once."""
    lists = F.filter("els", lambda e: (e["tag"] == "ul") & F.array_contains(e["classes"], "txtlist"))
    items = F.flatten(F.transform(lists, lambda u: F.filter(inside(u), lambda e: (e["parent"] == u["node"]) & (e["tag"] == "li"))))
    found = F.array_compact(F.transform(items, _in_list))
    return _numbered(_once(found, lambda e: e["documents"][0]["url"]))


def file_entries() -> Column:
    """Links to files, each URL once."""
    found = _once(F.filter(links(F.col("els")), lambda a: U.document_type(a["url"]).isin(*FILE_TYPES)), lambda a: a["url"])
    made = F.transform(found, lambda a: F.struct(_label_of(a).alias("said"), a["url"].alias("url")))
    return _numbered(F.transform(made, lambda x: _entry(F.lit(0), x["said"], F.lit(""), F.array(_document(U.document_type(x["url"]), x["url"], x["said"])))))


def _folder(path: Column) -> Column:
    folder = F.regexp_extract(path, "^(.*)/[^/]*$", 1)
    return F.when((folder == "") & F.startswith(path, F.lit("/")), "/").otherwise(folder)


def _of_listing(url: Column) -> Column:
    """Whether a URL is in the folder of the page, or, of a page index_2.html, in the folder above."""
    page, path = U.path(F.col("url")), U.path(url)
    folder = _folder(page)
    above = F.regexp_replace(_folder(folder), "/+$", "")
    several = F.regexp_extract(page, "([^/]*)$", 1).rlike("(?i)^index(?:[_-]?[0-9]+)\\.html$") & (folder != "") & (above != "") & (above != folder)
    return F.startswith(path, folder) | (several & ((path == above) | F.startswith(path, F.concat(above, F.lit("/")))))


def _containers(a: Column) -> Column:
    up = lambda e: F.get("els", e["parent"])
    item = F.get("els", a["item"])
    return F.array_distinct(F.array_compact(F.array(item, up(a), up(up(a)), up(up(up(a))))))


def _date(text: Column) -> Column:
    return reduce(F.coalesce, [F.nullif(F.regexp_extract(text, d, 0), F.lit("")) for d in DATES])


def _remark(a: Column, title: Column) -> Column:
    """A date, or else a short text, near a link: its containers' own parts first, then a container's whole text."""

    def near(c: Column) -> Column:
        own = F.filter(inside(c), lambda e: (e["parent"] == c["node"]) & e["tag"].isin("span", "div", "p") & ~F.exists(inside(e), lambda x: x["tag"] == "a"))
        rest = lambda e, most: F.struct(_strip(F.replace(_flat(says(e)), title, F.lit(""))).alias("text"), F.lit(most).alias("most"))
        return F.concat(F.transform(own, lambda e: rest(e, 40)), F.array(rest(c, 80)))

    texts = F.filter(F.flatten(F.transform(_containers(a), near)), lambda x: x["text"] != "")
    firsts = _once(texts, lambda x: x["text"])
    good = F.get(F.filter(firsts, lambda x: _date(x["text"]).isNotNull() | (F.length(x["text"]) <= x["most"])), F.lit(0))
    return F.coalesce(_date(good["text"]), good["text"], F.lit(""))


def _card(a: Column) -> Column:
    """The entry of a link, whether or not one before it has it as a document; null for links that are no entries."""
    url = F.regexp_extract(a["url"], "^([^#]*)", 1)
    path, kind = U.path(url), U.document_type(url)
    base = F.regexp_extract(path, "([^/]*)$", 1)
    page = U.path(F.col("url"))
    page_base = F.regexp_extract(page, "([^/]*)$", 1)
    title = _title_of(a, _flat(says(a)))
    folder = _folder(page)
    above = F.when(page_base.rlike("(?i)^index(?:[_-]?[0-9]+)\\.html$"), F.nullif(F.regexp_replace(_folder(folder), "/+$", ""), F.lit("")))
    good = (
        ~F.lower(a["href"]).rlike("^(javascript:|void\\()")
        & ~says(a, "").isin(*OTHER_PAGES)
        & (path != page)
        & ~F.startswith(F.lower(base), F.lit("index_"))
        & (kind != "other")
        & ((kind != "html") | (_of_listing(url) & ~F.coalesce((path == above) | (path == F.concat(above, F.lit("/index.html"))), F.lit(False))))
        & (title != "")
        & (title != page_base)
    )
    near = F.flatten(F.transform(_containers(a), lambda c: links(inside(c))))
    others = F.filter(near, lambda x: (x["node"] != a["node"]) & (U.document_type(x["url"]) != "other") & ~((U.document_type(x["url"]) == "html") & _of_listing(x["url"])))
    files = F.transform(_once(others, lambda x: x["url"]), lambda x: _document(U.document_type(x["url"]), x["url"], _label_of(x)))
    return F.when(good, _entry(F.lit(0), title, _remark(a, title), F.concat(F.array(_document(kind, url, title)), files)))


def card_entries() -> Column:
    """Links to pages of the listing and to files, in order; what is a document of an entry before isn't an entry itself."""
    found = F.array_compact(F.transform(links(F.col("els")), _card))
    none = F.struct(F.array().cast("array<string>").alias("seen"), F.array().cast(f"array<{ENTRY}>").alias("out"))

    def fold(acc: Column, e: Column) -> Column:
        taken = F.array_contains(acc["seen"], e["documents"][0]["url"])
        urls = F.transform(e["documents"], lambda d: d["url"])
        return F.when(taken, acc).otherwise(F.struct(F.concat(acc["seen"], urls).alias("seen"), F.concat(acc["out"], F.array(e.cast(ENTRY))).alias("out")))

    return _numbered(F.aggregate(found, none, fold)["out"])


def listing_entries(pages: DataFrame) -> DataFrame:
    """(page_id, serial, title, remark, documents) of pages (page_id, url, html, parser), where parser is `card` or anything else. A null or
    empty page has no entries."""
    rows = parsed(pages.select("page_id", "url", "html", "parser"))
    rows = rows.withColumn("labels", F.transform("els", lambda e: F.when(F.coalesce(e["href"], F.lit("")) != "", label(e))))
    some = lambda entries: F.when(F.size(entries) > 0, entries)
    kind = f"array<{ENTRY}>"
    cards = rows.withColumn("cards", F.when(F.col("parser") == "card", card_entries().cast(kind)))
    plain = cards.withColumn("rows", F.when(F.coalesce(F.size("cards"), F.lit(0)) <= 0, table_entries().cast(kind)))
    listed = plain.withColumn("items", F.when(F.size("rows") == 0, list_entries().cast(kind)))
    files = listed.withColumn("files", F.when(F.size("items") == 0, file_entries().cast(kind)))
    found = files.select("page_id", F.explode(F.coalesce(*[some(F.col(c)) for c in ("cards", "rows", "items", "files")])).alias("e"))
    return found.select("page_id", "e.*")
