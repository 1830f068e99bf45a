"""Personal data: detection, and surrogates in its place.

Mail addresses, phone numbers, IPv4 addresses, card numbers, secrets and titled names are found
in whole texts. Each distinct entity gets a surrogate drawn from a keyed hash: digits for
digits, letters for letters of the same case and script, octets of as many digits, card numbers as (in)valid as before,
names from a list of the same gender and script (in scripts without a list, letters for letters). Phones are found behind a
plus, with an area code in brackets, in the usual national groupings, and in any grouping behind a word like `Tel:`. A titled name has up to
three words, with hyphens and apostrophes, and each is an entity: wherever else in the document it stands with a capital, it is replaced
alike (as the last titled mention before it, where two genders share it). Initials and particles (`von`) stay. An entity is one whatever its format: a phone number written
in two ways gets one surrogate, in the format of each mention.

Collision checks: entities are compared as keyed hashes, in one table over all rows, so that no
personal data is written anywhere. Where two entities have one surrogate, or a surrogate is
itself an entity of the corpus, all but the first take their next candidate, until all
differ. Candidates of the exact format come first; where they are used up, as short formats can be
dense, further ones have a wider format of the same type (more digits or letters, octets of any length, secrets of any characters).
Only documents that hold such an entity are joined with their choices.

Defined cases: null stays null; texts without an entity are returned unchanged; repeated rows
get equal results; null ids are allowed (their candidates are chosen like others'); an empty table gives an empty
result; texts of any length are searched whole; other columns pass through, and clean_text and n_entities
replace columns of these names.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.llm.common import forget, fresh, maybe_in, written

CANDIDATES = 6  # made with the entities; more are made for those that need them
EXACT = 24  # candidates of the exact format, before wider ones

# fixed values: titles, and surrogate names by script and gender
TITLES = {"f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Г-жа"), "m": ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Г-н")}
NAMES = {
    ("latin", "f"): ("Alma", "Berta", "Clara", "Dora", "Elena", "Flora", "Greta", "Hanna", "Irma", "Julia", "Klara", "Laura", "Marta", "Nora", "Olga", "Paula"),
    ("latin", "m"): ("Anton", "Bruno", "Carlo", "Dario", "Emil", "Felix", "Georg", "Hugo", "Ivo", "Jonas", "Karl", "Luis", "Marco", "Nils", "Oskar", "Pablo"),
    ("cyrillic", "f"): ("Алла", "Вера", "Галина", "Дарья", "Елена", "Зоя", "Ирина", "Лариса"),
    ("cyrillic", "m"): ("Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл"),
}

_PATTERN = re.compile(
    r"(?P<secret>(?:(?i:token|secret|password|passwd|api[_-]?key|access[_-]?key)\s*[=:]\s*)[\"']?(?P<value>[A-Za-z0-9+/_-]{16,}={0,2})[\"']?)"
    r"|(?P<email>[\w+-]+(?:\.[\w+-]+)*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})"
    r"|(?P<ip>(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.]*\d))"
    r"|(?P<card>(?<![\d+])\d(?:[ -]?\d){12,18}(?!\d))"
    r"|(?P<phone>(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?)\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\d))"
    r"|(?P<national>(?<![\w+])(?<!\d[./-])(?:"
    r"(?:1[ .-])?\d{3}(?P<s>[ .-])\d{3}(?P=s)\d{4}"
    r"|(?:\+?\d{1,3}[ .-]?)?\(\d{2,5}\)[ .-]?\d{2,4}(?:[ .-]\d{2,4}){1,3}"
    r"|[78][ -]\d{3}[ -]\d{3}[ -]\d{2}[ -]\d{2}"
    r"|0\d{1,4}(?: ?[/-] ?| )\d{5,8}(?![ -]\d)"
    r"|0\d{1,4}(?: ?[/-] ?|[ .])\d{2,4}(?P<t>[ .-])\d{2,8}(?:(?P=t)\d{2,8}){0,4}"
    r"|\d{3} \d{2} \d{2} \d{2}|\d{2} \d{3} \d{2} \d{2}"
    r")(?!\w|[./-]\d))"
    r"|(?P<called>\b(?i:tel|telefon|telephone|téléphone|teléfono|phone|mobile|mobil|handy|fax|тел)(?:\.:?|:) ?(?P<number>\(?\d[\d ./()-]{4,16}\d)(?!\w))"
)
_PHONE_DIGITS = {"national": range(9, 16), "called": range(6, 16)}
_LETTER = r"(?:[^\W\d_][\u0300-\u036f]*)"
_CAPITAL = r"(?:[^\W\d_a-zа-яё][\u0300-\u036f]*)"
_JOINED = rf"(?:[-'’](?!s\b){_LETTER}+)"
_WORD = rf"(?:{_CAPITAL}{_LETTER}+{_JOINED}*|{_CAPITAL}{_JOINED}+)"
_BETWEEN = rf"(?:{_CAPITAL}\. ?)*(?:(?:von|van|vom|zu|zur|de|del|della|der|den|des|di|da|dos|du|la|le|el|al|bin|ibn|ter|ten|af|av|y) )*"
_TITLE = "|".join(t for x in TITLES.values() for t in x)
_TITLED = re.compile(rf"\b(?P<title>{_TITLE})\.? (?:(?:Dra?|Prof|Doktor|Professor|Ing)\.? )*{_BETWEEN}(?P<name>{_WORD}(?: {_BETWEEN}(?!(?:{_TITLE})\b){_WORD}){{0,2}})")
_NAME_WORD = re.compile(_WORD)
_TOKEN = re.compile(rf"{_LETTER}+{_JOINED}*")
_PIECE = re.compile(rf"{_LETTER}+")
_HINT = re.compile(r"[0-9@]|(?i:token|secret|passw|key)")


def _name(word: str) -> str:
    word = word.replace("’", "'")
    return word.title() if word.isupper() else word


def _names(text: str, taken: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """Spans of the words of titled names, and of their mentions without a title. taken: spans that stay, in order."""
    starts = [x[0] for x in taken]

    def free(a: int, b: int) -> bool:
        i = bisect_right(starts, b - 1)
        return i == 0 or taken[i - 1][1] <= a

    out, known = {}, {}
    for m in _TITLED.finditer(text):
        kind = "name_" + next(g for g, titles in TITLES.items() if m["title"] in titles)
        for w in _NAME_WORD.finditer(text, *m.span("name")):
            if free(*w.span()):
                name = _name(w[0])
                out[w.start()] = (*w.span(), kind, name)
                known.setdefault(name.casefold(), []).append((w.start(), kind, name))
    if not known:
        return []
    for token in _TOKEN.finditer(text):
        whole = _name(token[0]).casefold() in known
        for w in [token] if whole else _PIECE.finditer(text, *token.span()):
            places = known.get(_name(w[0]).casefold())
            if places and not w[0][0].islower() and w.start() not in out and free(*w.span()):
                _, kind, name = places[max(0, bisect_right(places, (w.start(),)) - 1)]
                out[w.start()] = (*w.span(), kind, name)
    last, kept = 0, []
    for x in sorted(out.values()):
        if x[0] >= last:
            kept.append(x)
            last = x[1]
    return kept


def spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical form) of each entity, in order."""
    out = []
    if _HINT.search(text):
        for m in _PATTERN.finditer(text):
            kind = next(k for k in ("secret", "email", "ip", "card", "phone", "national", "called") if m[k] is not None)
            a, b = m.span({"secret": "value", "called": "number"}.get(kind, kind))
            value = text[a:b]
            if kind == "ip" and any(int(x) > 255 for x in value.split(".")):
                continue
            if kind in _PHONE_DIGITS:
                if sum(map(str.isdecimal, value)) not in _PHONE_DIGITS[kind]:
                    continue
                kind = "phone"
            out.append((a, b, kind, value.lower() if kind == "email" else ("+" * value.startswith("+") + re.sub(r"\D", "", value)) if kind in ("card", "phone") else value))
    if _TITLED.search(text):
        out += _names(text, out)
    return sorted(out)


@lru_cache(maxsize=4096)
def _alphabet(block: int, category: str, script: str) -> str:
    """Letters of one script and category in a block of 256 code points."""
    return "".join(c for c in map(chr, range(block << 8, (block + 1) << 8)) if unicodedata.category(c) == category and _script(c) == script)


def _script(c: str) -> str:
    return unicodedata.name(c, "none").split()[0].split("-")[0]


class Surrogates:
    def __init__(self, key: bytes):
        self.key = key

    def mark(self, kind: str, canonical: str) -> bytes:
        """What stands for an entity in tables."""
        return hmac.new(self.key, f"entity|{kind}|{canonical}".encode("utf-8", "replace"), hashlib.sha256).digest()[:16]

    def look(self, kind: str, canonical: str) -> bytes:
        """What stands for what a reader sees: names of both genders look alike."""
        return hmac.new(self.key, f"id|{kind[:4]}|{canonical}".encode("utf-8", "replace"), hashlib.sha256).digest()[:16]

    def _numbers(self, kind: str, canonical: str, attempt: int) -> Iterator[int]:
        block = 0
        while True:
            yield from hmac.new(self.key, f"{attempt}|{block}|{kind}|{canonical}".encode("utf-8", "replace"), hashlib.sha512).digest()
            block += 1

    def _like(self, text: str, numbers: Iterator[int], hexadecimal: bool = False) -> str:
        """Each letter and digit replaced by one of its class and script."""
        out = []
        for c in text:
            n = next(numbers)
            if c.isdecimal():
                out.append(chr(ord(c) - unicodedata.decimal(c) + n % 10))
            elif hexadecimal and c in "abcdef":
                out.append("abcdef"[n % 6])
            elif hexadecimal and c in "ABCDEF":
                out.append("ABCDEF"[n % 6])
            elif "a" <= c <= "z" or "A" <= c <= "Z":
                out.append(chr((97 if c >= "a" else 65) + n % 26))
            elif "а" <= c.lower() <= "я":
                out.append(chr((0x430 if c.islower() else 0x410) + n % 32))
            elif c.isalpha() and _script(c) != "LATIN":
                letters = _alphabet(ord(c) >> 8, unicodedata.category(c), _script(c))
                out.append(letters[n % len(letters)])
            elif c.isalpha():  # letters with accents: a plain one of the same case
                out.append(chr((65 if c.isupper() else 97) + n % 26))
            else:
                out.append(c)
        return "".join(out)

    def candidates(self, kind: str, canonical: str, first: int, end: int) -> list[bytes]:
        return [self.look(kind, self.draw(kind, canonical, i)) for i in range(first, end)]

    def draw(self, kind: str, canonical: str, attempt: int) -> str:
        """The canonical form of the entity's candidate number `attempt`."""
        numbers = self._numbers(kind, canonical, attempt)
        wider = attempt // EXACT  # how many digits or letters more
        if kind == "email":
            local, _, domain = canonical.rpartition("@")
            host, _, top = domain.rpartition(".")
            # one domain stays one domain, whichever candidate an address takes
            return f"{self._like(local + 'x' * wider, numbers)}@{self._like(host, self._numbers('host', host, 0))}.{top}"
        if kind == "ip":
            choice = {1: range(0, 10), 2: range(10, 100), 3: range(100, 256)}
            parts = []
            for x in canonical.split("."):
                values = range(256) if wider else choice[len(x)]
                parts.append(str(values[(next(numbers) * 256 + next(numbers)) % len(values)]))
            return ".".join(parts)
        if kind == "card":
            body = self._like(canonical[:-1], numbers)
            right = _luhn(body)
            last = right if _luhn(canonical[:-1]) == canonical[-1] else str((int(right) + 1 + next(numbers) % 9) % 10)
            return body + last
        if kind == "secret":
            if wider:
                return self._like("xX0x" * (len(canonical) // 4 + 1), numbers)[: len(canonical)] + self._like("x" * wider, numbers)
            return self._like(canonical, numbers, hexadecimal=bool(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", canonical)))
        if kind == "phone":  # behind a plus the first digit, with which each country code starts, stays, and so does a leading 0
            fixed = 2 if canonical.startswith("+") else int(canonical.startswith("0"))
            return canonical[:fixed] + self._like(canonical[fixed:] + "0" * wider, numbers)
        script = _script(canonical[0]).lower()
        more = next(c for c in reversed(canonical) if c.isalpha()).lower() * wider
        if (script, kind[-1]) not in NAMES:
            return self._like(canonical + more, numbers)
        names = NAMES[script, kind[-1]]
        i = next(numbers) * 256 + next(numbers)
        first = names[i % len(names)]
        # lists are short: a family name in the form of the old one keeps names apart
        return first if attempt == 0 else first + self._like((canonical[1:].lower() or "x") + more, numbers)

    def shown(self, kind: str, surrogate: str, mention: str) -> str:
        """The surrogate in the format of a mention."""
        if kind in ("card", "phone"):
            digits = iter(surrogate.lstrip("+"))
            return "".join(next(digits) if c.isdecimal() else c for c in mention) + "".join(digits)
        if kind == "email":
            return "".join(s.upper() if m.isupper() else s for s, m in zip(surrogate, mention)) if len(surrogate) == len(mention) else surrogate
        if kind.startswith("name") and mention.isupper():
            return surrogate.upper()
        return surrogate


def _luhn(body: str) -> str:
    total = sum(sum(divmod(int(d) * (2 if i % 2 == 0 else 1), 10)) for i, d in enumerate(reversed(body)))
    return str(-total % 10)


def _entities(texts: DataFrame, key: bytes) -> DataFrame:
    """(mark, look, candidates): of each distinct entity its marks and those of its first candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, met = Surrogates(key), set()
        for batch in batches:
            rows = []
            for value in batch.column("text"):
                for _, _, kind, canonical in spans(value.as_py() or ""):
                    mark = make.mark(kind, canonical)
                    if mark not in met:
                        if len(met) > 1_000_000:
                            met.clear()
                        met.add(mark)
                        rows.append((mark, make.look(kind, canonical), make.candidates(kind, canonical, 0, CANDIDATES)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.list_(pa.binary()))], names=["mark", "look", "candidates"])

    found = texts.mapInArrow(run, "mark binary, look binary, candidates array<binary>")
    return found.groupBy("mark").agg(F.first("look").alias("look"), F.first("candidates").alias("candidates"))


def _further(texts: DataFrame, key: bytes, wanted: DataFrame) -> DataFrame:
    """(f_mark, further): for entities that have used up their candidates (wanted: mark, made) as many again. They
    are drawn from one text of each, found by its hash, as no table holds the entities themselves."""
    hashed = texts.where("text is not null").select(F.xxhash64("text").alias("row"), "text")
    one = _marks(hashed, key).join(wanted, "mark").groupBy("mark").agg(F.min("row").alias("row"), F.first("made").alias("made"))
    places = written(one.groupBy("row").agg(F.collect_list(F.struct("mark", "made")).alias("need")).withColumnRenamed("row", "n_row"), "further-places")
    holders = maybe_in(hashed, F.col("row"), places.select("n_row")).join(places, F.col("row") == F.col("n_row")).select("text", "need")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Surrogates(key)
        for batch in batches:
            for value, need in zip(batch.column("text"), batch.column("need")):
                made, rows = {x["mark"]: x["made"] for x in need.as_py()}, {}
                for _, _, kind, canonical in spans(value.as_py()):
                    mark = make.mark(kind, canonical)
                    if mark in made and mark not in rows:
                        rows[mark] = make.candidates(kind, canonical, made[mark], 2 * made[mark])
                yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.binary()), pa.array(list(rows.values()), pa.list_(pa.binary()))], names=["f_mark", "further"])

    found = holders.mapInArrow(run, "f_mark binary, further array<binary>").groupBy("f_mark").agg(F.first("further").alias("further"))
    out = written(found, "further")
    forget(places)
    return out


def choices(texts: DataFrame, key: bytes) -> DataFrame | None:
    """(mark, attempt) of the entities that don't take their first candidate; None if all do. Rounds go on until
    none clashes: a wider format always has free candidates."""
    now = written(_entities(texts, key).withColumn("attempt", F.lit(0)), "entities")
    real = now.select(F.col("look").alias("r_look")).distinct()
    changed = False
    while True:
        chosen = now.withColumn("chosen", F.get("candidates", F.col("attempt")))
        first = chosen.groupBy("chosen").agg(F.min("mark").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("chosen", "first")
        twice = chosen.join(first, "chosen").where("mark <> first").select("mark")
        known = chosen.join(real, F.col("chosen") == F.col("r_look")).select("mark")
        bad = written(twice.unionByName(known).distinct().withColumnRenamed("mark", "b_mark"), "clashing")
        if bad.isEmpty():
            forget(bad)
            return now.where("attempt > 0").select("mark", "attempt") if changed else None
        changed = True
        after = now.join(bad, F.col("mark") == F.col("b_mark"), "left").withColumn("attempt", F.col("attempt") + F.col("b_mark").isNotNull().cast("int")).drop("b_mark")
        after = written(after, "entities")
        forget(bad)
        used_up = after.where(F.col("attempt") >= F.size("candidates")).select("mark", F.size("candidates").alias("made"))
        if not used_up.isEmpty():
            more = _further(texts, key, used_up)
            joined = after.join(more, F.col("mark") == F.col("f_mark"), "left")
            longer = written(joined.withColumn("candidates", F.concat("candidates", F.coalesce("further", F.array().cast("array<binary>")))).drop("f_mark", "further"), "entities")
            forget(after, more)
            after = longer
        now = after


def _marks(docs: DataFrame, key: bytes) -> DataFrame:
    """(row, mark) for the distinct entities of each row."""
    row = docs.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Surrogates(key)
        for batch in batches:
            rows, marks = [], []
            for i, value in zip(batch.column("row"), batch.column("text")):
                for mark in {make.mark(k, c) for _, _, k, c in spans(value.as_py() or "")}:
                    rows.append(i.as_py())
                    marks.append(mark)
            yield pa.RecordBatch.from_arrays([pa.array(rows, batch.schema.field("row").type), pa.array(marks, pa.binary())], names=["row", "mark"])

    return docs.mapInArrow(run, f"row {row}, mark binary")


def replace_pii(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows without the text, with clean_text and n_entities."""
    text, other = fresh(docs, "text_"), fresh(docs, "choices_")
    keep = [c for c in docs.columns if c != text_col and c.lower() not in ("clean_text", "n_entities")]
    slim = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias(text))
    chosen = choices(docs.select(F.col(f"`{text_col}`").alias("text")), key)
    if chosen is None:
        slim = slim.withColumn(other, F.lit(None).cast("array<struct<mark:binary,attempt:int>>"))
    else:
        # by the hash of the text: of a hash there are as many choices as its texts have entities, whatever the ids are
        rows = docs.where(F.col(f"`{text_col}`").isNotNull()).select(F.xxhash64(F.col(f"`{text_col}`")).alias("row"), F.col(f"`{text_col}`").alias("text"))
        row = fresh(slim, "row_")
        mine = _marks(rows, key).join(chosen, "mark").groupBy(F.col("row").alias(row)).agg(F.collect_set(F.struct("mark", "attempt")).alias(other))
        slim = slim.join(mine, F.xxhash64(F.col(text)) == F.col(row), "left").drop(row)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Surrogates(key)
        for batch in batches:
            texts, counts = [], []
            for value, some in zip(batch.column(text), batch.column(other)):
                t = value.as_py()
                attempts = {x["mark"]: x["attempt"] for x in some.as_py() or ()}
                found, parts, at = spans(t or ""), [], 0
                for a, b, kind, canonical in found:
                    new = make.draw(kind, canonical, attempts.get(make.mark(kind, canonical), 0) if attempts else 0)
                    parts += [t[at:a], make.shown(kind, new, t[a:b])]
                    at = b
                texts.append("".join([*parts, t[at:]]) if found else t)
                counts.append(len(found))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string()), pa.array(counts, pa.int64())], names=[*keep, "clean_text", "n_entities"])

    types = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in slim.schema if f.name in keep)
    return slim.mapInArrow(run, f"{types}clean_text string, n_entities long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_pii(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), b"a key for tests and queries")
