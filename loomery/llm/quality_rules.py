"""Line-first quality rules.

Each line is judged by itself: punctuation (a large share of marks, or a stub that ends in no
sentence mark), navigation (short items between separators) and boilerplate (fixed phrases).
Lines that fail are removed, and a document that loses more than `max_lost` of its characters
is rejected, as is one that fails the base rules (too short, or mostly repeated three-word
windows). Array functions on each row: no shuffle, no Python.

Defined cases: a null or empty text has no words and fails the base rules; lines without a
word pass and are never duplicates; repeated rows get the same verdict each; an empty table
gives an empty result; the input's other columns are passed through, and where one has the
name of a result column the result replaces it. Three-word windows are compared by a 64-bit
hash within one document.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.llm.common import fresh, without_space, words

SYMBOLS = "#*$%&|<>"
MARKS = "#*$%&|<>!?~^=+_{}[]\\"
SEPARATORS = "|»›•·"
ENDS = r"[.!?…:;][\"'”’»)\]]*$"
PHRASES = ("all rights reserved", "licensed under", "terms of use", "terms of service", "privacy policy", "cookie policy", "lorem ipsum", "enable javascript", "click here", "powered by")


def one_of(chars: str) -> str:
    """A regular expression for one of the characters."""
    return "[" + "".join(f"\\{c}" for c in chars) + "]"


@dataclass(frozen=True)
class LineRules:
    max_marks: float = 0.10  # of a line's characters other than white space
    stub_chars: int = 24  # a shorter line needs a sentence mark at its end
    item_chars: int = 30  # mean characters between separators in navigation
    min_separators: int = 3
    max_lost: float = 0.30  # of a document's characters other than white space
    min_words: int = 50
    max_repeat: float = 0.50
    # a line with phrases fails if they are this share of its characters at least; None: in any line, as in SQL.
    # At 0.10 `privacy policy` fails a line of up to 140 characters, and no paragraph that mentions it.
    phrase_share: float | None = None


def line_fails(line: Column, n: Column, has: dict[str, Column], rules: LineRules = LineRules()) -> Column:
    """Whether a line of n characters besides white space is removed. has: whether the document
    has any mark, any separator, any boilerplate phrase; most have none, and skip that rule."""

    def count(chars: str) -> Column:
        return F.length(line) - F.length(F.regexp_replace(line, one_of(chars), ""))

    n_marks = F.when(has["mark"], count(MARKS)).otherwise(0)
    n_seps = F.when(has["separator"], count(SEPARATORS)).otherwise(0)
    navigation = (n_seps >= rules.min_separators) & (n <= rules.item_chars * (n_seps + 1))
    stub = (n < rules.stub_chars) & ~F.rtrim(line).rlike(ENDS)
    phrase = F.when(has["phrase"], F.lower(line).rlike("|".join(PHRASES))).otherwise(False)
    if rules.phrase_share is not None:
        whole = F.trim(F.lower(line))
        phrase = phrase & (F.length(whole) - F.length(F.regexp_replace(whole, "|".join(PHRASES), "")) >= rules.phrase_share * F.length(whole))
    return (n > 0) & ((n_marks > rules.max_marks * n) | navigation | stub | phrase)


def repeat_words(w: str, n_words: str, df: DataFrame, out: str) -> DataFrame:
    """Adds how many words lie in a three-word window that occurs twice or more in the text."""
    g, s, r = (fresh(df, x) for x in ("windows_", "sorted_", "repeated_"))
    windows = F.transform(F.sequence(F.lit(0), F.col(n_words) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    df = df.withColumn(g, F.when(F.col(n_words) >= 3, windows).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn(s, F.sort_array(g))
    df = df.withColumn(r, F.array_distinct(F.filter(s, lambda x, i: (i > 0) & (x == F.get(s, i - 1)))))

    def covered(at: Column) -> Column:
        return F.size(F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(i, i + 1, i + 2)))))

    few = F.filter(F.sequence(F.lit(0), F.size(g) - 1), lambda i: F.array_contains(F.col(r), F.get(g, i)))
    pairs = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # many repeated windows: equal hashes stand side by side once sorted with their places
    marked = F.filter(F.transform(pairs, lambda p, j: F.when((p["h"] == F.get(s, j - 1)) | (p["h"] == F.get(s, j + 1)), p["i"])), lambda i: i.isNotNull())
    n = F.when(F.size(r) == 0, 0).when(F.size(r) <= 48, covered(few)).otherwise(covered(marked))
    return df.withColumn(out, n.cast("long")).drop(g, s, r)


def quality_rules(docs: DataFrame, text_col: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lost_chars,
    clean_text (the lines that pass) and kept."""
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_chars", "clean_text", "kept"]
    t, w, lines, sizes, fails = (fresh(docs, x) for x in ("text_", "words_", "lines_", "sizes_", "fails_"))
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    df = docs.drop(*[c for c in docs.columns if c.lower() in made and c != text_col])
    df = df.withColumn(t, text).withColumn(w, words(F.col(t))).withColumn("n_words", F.size(w))
    df = repeat_words(w, "n_words", df, "n_repeat_words").drop(w)

    low = fresh(df, "lower_")
    df = df.withColumn(low, F.lower(t))
    flags = {
        "mark": F.col(t).rlike(one_of(MARKS)),
        "separator": F.col(t).rlike(one_of(SEPARATORS)),
        "phrase": reduce(or_, [F.contains(F.col(low), F.lit(p)) for p in PHRASES]),
    }
    has = {k: fresh(df, f"has_{k}_") for k in flags}
    df = df.withColumns({has[k]: v for k, v in flags.items()}).drop(low)
    df = df.withColumn("n_symbols", F.when(F.col(has["mark"]) | F.col(has["separator"]), F.length(t) - F.length(F.regexp_replace(t, one_of(SYMBOLS), ""))).otherwise(0).cast("long"))

    df = df.withColumn(lines, F.split(t, "\n")).withColumn(sizes, F.transform(lines, lambda x: F.length(without_space(x))))
    wordy = fresh(df, "wordy_")
    df = df.withColumn(wordy, F.transform(F.filter(F.arrays_zip(F.col(lines).alias("line"), F.col(sizes).alias("n")), lambda z: z["n"] > 0), lambda z: z["line"]))
    df = df.withColumn("n_dup_lines", (F.size(wordy) - F.size(F.array_distinct(wordy))).cast("long")).drop(wordy)
    # arrays meet by arrays_zip, outside of any lambda: an array named inside of one could be
    # computed anew for each element once projections are collapsed
    flag = {k: F.col(v) for k, v in has.items()}
    judged = F.transform(F.arrays_zip(F.col(lines).alias("line"), F.col(sizes).alias("n")), lambda z: F.struct(z["line"].alias("line"), z["n"].alias("n"), line_fails(z["line"], z["n"], flag, rules).alias("fails")))
    df = df.withColumn(fails, judged)
    df = df.withColumn("clean_text", F.array_join(F.transform(F.filter(fails, lambda z: ~z["fails"]), lambda z: z["line"]), "\n"))

    def total(of: Column) -> Column:
        return F.aggregate(of, F.lit(0).cast("long"), lambda a, x: a + x)

    df = df.withColumn("word_chars", total(F.col(sizes)))
    df = df.withColumn("lost_chars", total(F.transform(fails, lambda z: F.when(z["fails"], z["n"]).otherwise(0))))
    df = df.withColumn("n_words", F.col("n_words").cast("long"))
    df = df.withColumn("base_failed", (F.col("n_words") < rules.min_words) | (F.col("n_repeat_words") > rules.max_repeat * F.col("n_words")))
    df = df.withColumn("kept", ~F.col("base_failed") & (F.col("lost_chars") <= rules.max_lost * F.col("word_chars")))
    # a generator of one row: a condition on the verdict that came below the arrays would compute them
    # anew inside of their own lambdas
    one = fresh(df, "verdict_")
    keep = [c for c in docs.columns if c.lower() not in made or c == text_col]
    df = df.select(*[F.col(f"`{c}`") for c in keep], F.explode(F.array(F.struct(*made))).alias(one))
    return df.select(*[F.col(f"`{c}`") for c in keep], *[F.col(one)[c].alias(c) for c in made])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_chars", "kept")


SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM documents
), w AS (
  SELECT doc_id, text, CASE WHEN body = '' THEN [] ELSE string_split_regex(body, '[\x20\x09-\x0D]+') END AS w, string_split(text, chr(10)) AS lines FROM d
), g AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)
), rep AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1
  ) GROUP BY doc_id
), l AS (
  SELECT doc_id, line, regexp_replace(line, '[\x20\x09-\x0D]', '', 'g') AS bare
  FROM (SELECT doc_id, unnest(lines) AS line FROM w)
), m AS (
  SELECT doc_id, line, length(bare) AS n,
    length(bare) - length(regexp_replace(bare, '[#*$%&|<>!?~^=+_{{}}\[\]\\]', '', 'g')) AS marks,
    length(bare) - length(regexp_replace(bare, '[|»›•·]', '', 'g')) AS seps,
    regexp_matches(rtrim(line, ' '), '[.!?…:;]["''”’»)\]]*$') AS ended,
    regexp_matches(lower(line), '{"|".join(PHRASES)}') AS phrase
  FROM l
), lost AS (
  SELECT doc_id, sum(CASE WHEN n > 0 AND (marks > 0.1 * n OR (seps >= 3 AND n <= 30 * (seps + 1)) OR (n < 24 AND NOT ended) OR phrase) THEN n ELSE 0 END)::BIGINT AS lost,
         (count(*) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0))::BIGINT AS dups
  FROM m GROUP BY doc_id
), b AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dups, 0) AS n_dup_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0) AS lost_chars
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN lost USING (doc_id)
), f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT *, NOT base_failed AND lost_chars <= 0.3 * word_chars AS kept FROM f
"""
