"""Scalar text functions over columns."""

from __future__ import annotations

import difflib
import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: word lists and patterns of the entry model
STOPWORDS = ("关于", "有关", "的", "通知", "公告", "决定", "规定", "办法", "细则", "实施", "印发", "进一步", "试行", "意见", "答复", "解读", "发布")
DOCTYPES = ("管理办法", "实施细则", "暂行规定", "规定", "细则", "办法", "通知", "决定", "公告", "意见")
AGENCIES = ("中国人民银行", "中国证券监督管理委员会", "中国银行保险监督管理委员会", "中国银行业监督管理委员会", "国家外汇管理局", "国务院", "中国证监会", "中国银保监会", "国家统计局")
TITLE_EXCLUDED = ("废止", "停止执行", "停止施行", "停止实施", "终止执行", "终止施行", "终止实施", "失效", "作废", "停止使用")
REMARK_EXCLUDED = ("已废止", "已失效", "停止执行", "停止施行", "停止实施", "停止使用", "终止执行", "终止施行", "终止实施", "作废")
DOCNO = r"(银发|银办发|公告|令|会发|财金|发改|证监|保监|银保监|人民银行令|中国人民银行令)[〔\[\(]?\s*(\d{2,4})\s*[〕\]\)]?\s*(第?\s*\d+\s*号)?"
TYPE_PRIORITY = {"text": 5, "txt": 5, "pdf": 4, "docx": 3, "doc": 3, "word": 3, "html": 2}
FOLDED = str.maketrans({"（": "(", "）": ")", "〔": "[", "〕": "]", "【": "[", "】": "]", "《": '"', "》": '"', "“": '"', "”": '"', "‘": "'", "’": "'"})


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body over a value that is found once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold(text: str | None) -> str:
    """NFKC, plain brackets and quotes, single spaces."""
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", text).translate(FOLDED)).strip() if text else ""


@F.pandas_udf(T.StringType())
def norm_text(text: pd.Series) -> pd.Series:
    """`fold` on a column; Spark has no NFKC of its own."""
    return text.map(fold)


def any_of(text: Column, needles: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | F.contains(text, F.lit(n))
    return F.coalesce(out, F.lit(False))


def tokenize(norm: Column, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """Runs of CJK or of letters and digits of folded text, without stop words."""
    found = F.regexp_extract_all(norm, F.lit("[\\u4e00-\\u9fff]+|[a-zA-Z0-9]+"), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(*stopwords)) if stopwords else found


def tokenize_terms(text: Column) -> Column:
    """Lower-case runs of letters and digits, or single CJK characters."""
    return F.regexp_extract_all(F.lower(text), F.lit("[A-Za-z0-9]+|[\\u4e00-\\u9fff]"), F.lit(0))


def extract_docno(norm: Column) -> Column:
    """Head, bracketed year (two digits become 20xx) and number of folded text; null without."""
    head, year, tail = (F.regexp_extract(norm, f"(?i){DOCNO}", i) for i in (1, 2, 3))
    full = F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)
    return F.when(head != "", F.concat(head, F.lit("["), full, F.lit("]"), F.replace(tail, F.lit(" "), F.lit(""))))


def year_prefix(text: Column) -> Column:
    """The century of the first four-digit year, as the entry model keeps it; empty without."""
    return F.regexp_extract(text, "(19|20)[0-9]{2}", 1)


def year_full(text: Column) -> Column:
    return F.regexp_extract(text, "(19|20)[0-9]{2}", 0)


def first_keyword(text: Column, keywords: tuple[str, ...] = DOCTYPES) -> Column:
    out = F.lit(None).cast("string")
    for k in reversed(keywords):
        out = F.when(F.contains(text, F.lit(k)), k).otherwise(out)
    return out


def keyword_list(text: Column, keywords: tuple[str, ...] = AGENCIES, most: int = 3, sep: str = "、") -> Column:
    """The first `most` keywords that are in the text, in the list's order; null without."""
    hits = F.filter(F.array(*[F.when(F.contains(text, F.lit(k)), k) for k in keywords]), lambda x: x.isNotNull())
    return F.when(F.size(hits) > 0, F.array_join(F.slice(hits, 1, most), sep))


def is_current(norm_title: Column, norm_remark: Column) -> Column:
    return ~(any_of(norm_title, TITLE_EXCLUDED) | any_of(norm_remark, REMARK_EXCLUDED))


def best_path(documents: Column) -> Column:
    """Path of the document with the best type, first of equals; documents are structs with type and local_path."""
    def priority(kind: Column) -> Column:
        out = F.lit(0)
        for k, v in TYPE_PRIORITY.items():
            out = F.when(F.lower(kind) == k, v).otherwise(out)
        return out

    ranked = F.transform(documents, lambda d, i: F.struct((-priority(d["type"])).alias("p"), i.alias("i"), d["local_path"].alias("path")))
    return F.get(F.filter(F.array_sort(ranked), lambda x: F.coalesce(x["path"] != "", F.lit(False))), F.lit(0))["path"]


def jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def occurrences(text: Column, needle: str) -> Column:
    """How often the needle occurs, without overlaps."""
    return F.floor((F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))) / F.lit(len(needle))).cast("long")


def snippet(text: Column, needle: str, before: int = 60, after: int = 120) -> Column:
    """Text around the first occurrence; null without one."""
    at = F.instr(text, needle)
    start = F.greatest(at - before, F.lit(1))
    return F.when(at > 0, F.substring(text, start, at + after - start))


def find_sentence(text: Column, needles: tuple[str, ...], ends: str = "[。；;]\\s*") -> Column:
    """The first sentence that has one of the needles; null without."""
    return F.get(F.filter(F.split(text, ends), lambda s: any_of(s, needles)), F.lit(0))


def chunks(text: Column, size: int, overlap: int) -> Column:
    """Overlapping pieces; the last one is that which reaches the end."""
    step = size - overlap
    n = F.greatest(F.lit(1), F.ceil((F.length(text) - overlap) / step).cast("int"))
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * step + 1, F.lit(size))))


def chunks_with_tail(text: Column, size: int, overlap: int) -> Column:
    """Overlapping pieces as one is started at every step, even if the piece before reached the end."""
    step = size - overlap
    n = F.greatest(F.lit(1), F.ceil(F.length(text) / step).cast("int"))
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * step + 1, F.lit(size))))


def normalize_title(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, "(?U)\\s+", " "))


def safe_name(text: Column) -> Column:
    """Letters, digits, - and _ stay; the rest becomes _, trimmed. Expects NFKC text."""
    return F.btrim(F.regexp_replace(text, "[^\\p{L}\\p{N}_-]", "_"), F.lit("_"))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.btrim(text)), "[ -]", "_")


def parse_date(text: Column) -> Column:
    """A date out of 2024-01-31, 2024/1/31, 2024.1.31 or 2024年1月31日; null if there is none such day."""
    pattern = "([0-9]{4})[-/.年]([0-9]{1,2})[-/.月]([0-9]{1,2})"
    y, m, d = (F.regexp_extract(text, pattern, i) for i in (1, 2, 3))
    return F.when(y != "", F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")) if hasattr(F, "try_to_date") else F.when(y != "", F.to_date(F.try_to_timestamp(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), F.lit("yyyy-MM-dd"))))


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-blocks ratio of two strings."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)], dtype="float64")


def cjk_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^\\u4e00-\\u9fff]", ""))


def cosine(a: Column, b: Column) -> Column:
    """Cosine over the common prefix; a norm of zero counts as 1."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)

    def dot(p: Column, q: Column) -> Column:
        return F.aggregate(F.zip_with(p, q, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, z: s + z)

    def norm(p: Column) -> Column:
        root = F.sqrt(dot(p, p))
        return F.when(root == 0, 1.0).otherwise(root)

    return dot(x, y) / (norm(x) * norm(y))
