"""The text of pages: lines that belong to no document, blank lines, and how much of a text is prose."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: lines of pages that aren't the document's, and lines before which there is a blank one
REMOVED_LINES = ("中国人民银行规章", "中国人民银行发布", "打印本页", ">", "|")
REMOVED_PARTS = ("所在位置", "政府信息公开", "政　　策", "行政规范性文件", "法律声明", "联系我们", "加入收藏", "网站地图", "最佳分辨率", "京公网安备", "京ICP备", "网站标识码", "网站主办单位")
BREAK_BEFORE = (r"^(本通知|本办法|本规定|本细则|本规则|本意见|本通告)自.+(实施|施行|执行)", r"^特此通知")


def _not_text(line: Column) -> Column:
    low = F.lower(line)
    download = F.contains(line, F.lit("下载")) & (F.contains(low, F.lit("word")) | F.contains(low, F.lit("pdf")))
    named = reduce(lambda a, b: a | b, [F.contains(line, F.lit(p)) for p in REMOVED_PARTS])
    return line.isin(*REMOVED_LINES) | download | named | line.endswith(".pdf")


def page_text(text: Column) -> Column:
    """The lines of a page's text that are its document's: repeats of the line before are out, blank lines are single, and one
    stands before a closing line."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\\r\\n|\\n|\\r"), lambda x: F.regexp_replace(x, "(?U)^\\s+|\\s+$", ""))
    kept = F.filter(lines, lambda x: ~_not_text(x))
    pairs = F.arrays_zip(kept.alias("line"), F.concat(F.array(F.lit("")), kept).alias("before"))
    closing = lambda x: reduce(lambda a, b: a | b, [x.rlike(p) for p in BREAK_BEFORE])
    shown = F.transform(
        F.filter(pairs, lambda z: z["line"].isNotNull()),
        lambda z: F.when(closing(z["line"]) & (z["before"] != ""), F.concat(F.lit("\n"), z["line"])).when((z["line"] != "") & (z["line"] == z["before"]), F.lit(None).cast("string")).otherwise(z["line"]),
    )
    return F.regexp_replace(F.regexp_replace(F.array_join(shown, "\n"), "\n{3,}", "\n\n"), "^\n+|\n+$", "")


def prose_score(text: Column) -> Column:
    """Characters in lines of 20 or more, less 20 for each line of up to 10."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\\r\\n|\\n|\\r"), lambda x: F.regexp_replace(x, "(?U)^\\s+|\\s+$", "")), lambda x: x != "")
    return F.aggregate(lines, F.lit(0).cast("long"), lambda a, x: a + F.when(F.length(x) >= 20, F.length(x)).when(F.length(x) <= 10, -20).otherwise(0))
