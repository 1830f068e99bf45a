"""Numbers and references of clauses (article, paragraph, item), as expressions over columns.

Numbers follow the source's conventions: of digits behind one another the last counts, and each unit
multiplies the digit before it alone, so that 十二万 is 10 + 2 * 10000.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomery.functions.text import let

# fixed values: digits, units, a clause's number, marks behind a list number, last lines of a document, separators
DIGITS = {"零": 0, "〇": 0, "○": 0, "Ｏ": 0, "一": 1, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9, "壹": 1, "贰": 2, "叁": 3, "肆": 4, "伍": 5, "陆": 6, "柒": 7, "捌": 8, "玖": 9, "两": 2, "俩": 2}
UNITS = {"十": 10, "拾": 10, "百": 100, "佰": 100, "千": 1000, "仟": 1000, "万": 10000}
NUMBER = "[一二三四五六七八九十百千万零〇0-9两俩壹贰叁肆伍陆柒捌玖]"
MARKS = r"(?:、|\\.|．|﹒|:|：|·|•)"
FINAL = (r"^(本通知|本办法|本规定|本细则|本规则|本意见|本通告|本方案|本决定|本措施|本指南|本公告)自.+(实施|施行|执行|印发|公布|发布)", r"^特此(通知|公告|通告|说明)")
SEPARATORS = "，,、;；。　 \n\r\t"
KEY_EDGES = " ，,、;；。：:　\n\r\t"
CONNECTORS = "及和与或跟其"


def number(text: Column) -> Column:
    """一百零五 is 105; null for anything that isn't a number."""
    factor = F.create_map(*[F.lit(x) for u, n in UNITS.items() for x in (u, n)])

    def term(x: Column) -> Column:
        return F.greatest(F.coalesce(F.regexp_extract(x, "([0-9]).$", 1).try_cast("long"), F.lit(0)), F.lit(1)) * F.try_element_at(factor, F.right(x, F.lit(1)))

    def summed(coded: Column) -> Column:
        last = F.coalesce(F.regexp_extract(coded, "([0-9])$", 1).try_cast("long"), F.lit(0))
        return F.aggregate(F.transform(F.regexp_extract_all(coded, F.lit("[0-9]*[十百千万]"), F.lit(0)), term), last, lambda a, x: a + x)

    def of(t: Column) -> Column:
        coded = F.translate(F.regexp_replace(t, "[、 \\t]", ""), "".join(DIGITS) + "拾佰仟", "".join(map(str, DIGITS.values())) + "十百千")
        known = t.rlike("^[" + "".join(DIGITS) + "".join(UNITS) + "、 \\t]+$")
        return F.when(t.rlike("^[0-9]+$"), t.try_cast("long")).when(known, let(coded, summed))

    return let(F.btrim(text), of)


def _below_10000(n: Column) -> Column:
    """A group of four digits, without zeros at its ends."""
    figure = lambda power: F.substring(F.lit("零一二三四五六七八九"), (F.floor(n / power) % 10 + 1).cast("int"), F.lit(1))
    written = F.concat(*[x for power, unit in ((1000, "千"), (100, "百"), (10, "十"), (1, "")) for x in (figure(power), F.lit(unit))])
    short = F.regexp_replace(F.regexp_replace(F.regexp_replace(written, "零[千百十]", "零"), "零+", "零"), "^零|零$", "")
    return let(short, lambda s: F.when(n < 20, F.regexp_replace(s, "^一十", "十")).otherwise(s))


def chinese(n: Column) -> Column:
    """105 is 一百零五. A zero stands for a whole group of four digits that is nil, not for zeros at a group's front."""

    def of(n: Column) -> Column:
        group = lambda power: F.floor(n / 10**power) % 10_000

        def part(power: int, name: str) -> Column:
            skipped = (F.floor(n / 10 ** (power + 8)) > 0) & (group(power + 4) == 0) if power < 8 else F.lit(False)
            return let(group(power), lambda g: F.when(g > 0, F.concat(F.when(skipped, "零").otherwise(""), _below_10000(g), F.lit(name))).otherwise(""))

        return F.when(n == 0, "零").otherwise(F.concat(*[part(power, name) for power, name in ((12, "兆"), (8, "亿"), (4, "万"), (0, ""))]))

    return let(n.cast("long"), of)


def ways(n: Column) -> Column:
    """The ways to write n, without spaces."""
    return F.array_compact(F.array(n.cast("string"), chinese(n), F.when(n == 2, "两"), F.when(n == 2, "俩")))


def final_line(plain: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.btrim(plain).rlike(p) for p in FINAL])


def _behind(text: Column, pattern: str) -> Column:
    """What stands behind the first match, without separators in front."""
    rest = F.regexp_extract(text, f"(?s)^.*?{pattern}(.*)$", 1)
    return F.regexp_replace(F.btrim(rest), f"^[{SEPARATORS}]+", "")


def article(plain: Column) -> Column:
    """The number of the article that a folded reference names; null without."""
    return number(F.regexp_extract(plain, f"第\\s*({NUMBER}+)\\s*[条点]", 1))


def reference(plain: Column) -> Column:
    """Struct (article, paragraph, unit, item) of a folded reference such as 第八条,第三款; null without an article. What is named several
    times is a variable, so that a plan doesn't hold it as often."""

    def item(tail: Column) -> Column:
        return F.coalesce(number(F.regexp_extract(tail, f"\\(\\s*({NUMBER}+)\\s*\\)", 1)), number(F.regexp_extract(tail, f"第\\s*({NUMBER}+)\\s*[项目]", 1)))

    def parts(n: Column, rest: Column) -> Column:
        with_unit = F.regexp_extract(rest, f"^第\\s*({NUMBER}+)\\s*[款段]", 1)
        bare = F.regexp_extract(rest, f"^第\\s*({NUMBER}+)(?=$|[{SEPARATORS}])", 1)
        unit = F.nullif(F.regexp_extract(rest, f"^第\\s*{NUMBER}+\\s*([款段])", 1), F.lit(""))
        tail = F.when(with_unit != "", _behind(rest, f"第\\s*{NUMBER}+\\s*[款段]")).when(bare != "", _behind(rest, f"第\\s*{NUMBER}+")).otherwise(rest)
        paragraph = number(F.when(with_unit != "", with_unit).otherwise(bare))
        return F.struct(n.alias("article"), paragraph.alias("paragraph"), unit.alias("unit"), let(tail, item).alias("item"))

    head = f"第\\s*{NUMBER}+\\s*[条点]"
    return let(plain, lambda p: let(article(p), lambda n: F.when(n.isNotNull(), let(_behind(p, head), lambda rest: parts(n, rest)))))


def item_text(text: Column, item: Column) -> Column:
    """The part of a text from an item's mark, (二) or 第二项, to the next mark; null without."""
    mark = f"[(（]\\s*{NUMBER}+\\s*[)）]|第\\s*{NUMBER}+\\s*[项目]"
    shown = F.regexp_replace(text, "\\x00", "")
    parts = F.slice(F.split(F.regexp_replace(shown, f"({mark})", "\u0000$1"), "\u0000"), 2, 1 << 30)
    of = lambda p: number(F.regexp_extract(p, f"^[(（第]\\s*({NUMBER}+)", 1))
    return F.btrim(F.get(F.filter(parts, lambda p: of(p) == item), F.lit(0)), F.lit(" \n\t\r　"))
