"""Functions of URLs and file names. parse_url gives null for URLs with spaces or CJK, so that patterns are used."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: document types by extension
EXTENSIONS = {"pdf": ("pdf",), "word": ("doc", "docx", "wps"), "excel": ("xls", "xlsx"), "archive": ("zip", "rar"), "html": ("htm", "html"), "text": ("txt",)}


def path(url: Column) -> Column:
    return F.regexp_extract(url, "^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)", 1))


def extension(url: Column) -> Column:
    return F.lower(F.regexp_extract(path(url), "\\.([A-Za-z0-9]+)$", 1))


def document_type(url: Column) -> Column:
    """By extension; html without one, other if it is unknown."""
    ext = extension(url)
    out = F.when(ext == "", "html")
    for kind, names in EXTENSIONS.items():
        out = out.when(ext.isin(*names), kind)
    return out.otherwise("other")


def downloadable(url: Column) -> Column:
    """http, https or no scheme."""
    scheme = F.lower(F.regexp_extract(url, "^([a-zA-Z][a-zA-Z0-9+.-]*):", 1))
    return scheme.isin("", "http", "https")


def structured_filename(task: Column, serial: Column, index: Column, url: Column) -> Column:
    ext = extension(url)
    return F.concat(task, F.format_string("_%06d_%03d", serial, index), F.when(ext != "", F.concat(F.lit("."), ext)).otherwise(".html"))


def same_folder(url: Column, base: str) -> Column:
    return F.startswith(url, F.lit(base.rsplit("/", 1)[0] + "/"))
