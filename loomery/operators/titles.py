"""Documents found by an inexact title: by equality, else by containment either way, else by the closest title.

All three are equi joins. A text that another one contains has each of its character grams in there, so that one of them, rare by its
bucket's count, is the only key that it needs. For closeness, two texts that match for a share of their
characters have that many characters in common, counted as often as both have them: with all characters in one order, rarest first, the
fronts of the two texts share at least two of them, and pairs of rare characters are the keys. A common gram or character becomes a
key only for texts that have nothing else. What meets is compared exactly.

Defined cases: a null or blank title, or one that is blank when folded, matches nothing; equal titles are compared once
and every entry that has one is found; requests of equal title have equal results. An empty side gives an empty result.
"""

from __future__ import annotations

import difflib
import math
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomery.functions import clauses as C
from loomery.functions.text import let, norm_text
from loomery.operators.clauses import find_clauses
from loomery.operators.membership import maybe_in
from loomery.sources.checkpoints import cut

#: Longer texts meet by single characters of their fronts; the number of pairs grows with the square of the length.
PAIR_LENGTH = 64
#: Sizes of grams: long texts meet by long ones, which few share.
GRAMS = (1, 2, 3, 6, 12, 24)
#: Counts of hashed keys are kept by this many buckets.
BUCKETS = 1 << 14


def _grams(text: Column, size: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.xxhash64(F.substring(text, i, size))))


def _counts(rows: DataFrame, hashes: Column) -> Column:
    """How often hashes occur, by BUCKETS of them: an array whatever the rows are. It orders keys, rare ones first, and decides nothing else."""
    each = rows.select(F.explode(hashes).alias("h")).groupBy(_bucket(F.col("h")).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    found = dict(each.collect())  # BUCKETS rows at most
    return F.split(F.lit(",".join(str(found.get(i, 0)) for i in range(BUCKETS))), ",").cast("array<bigint>")


def _bucket(h: Column) -> Column:
    return F.pmod(h, F.lit(BUCKETS)).cast("int")


def contained(needles: DataFrame, texts: DataFrame, sizes: tuple[int, ...] = GRAMS) -> DataFrame:
    """(needle, text) for needles (needle) that are a substring of texts (text). Both are distinct and not empty. A needle's grams have
    the largest of some sizes (1 is one) that it is as long as."""
    needles, texts = cut(needles), cut(texts)  # each is read several times
    size = reduce(lambda a, n: F.when(F.length("needle") >= n, n).otherwise(a), sorted(sizes), F.lit(1))
    used = sorted(r[0] for r in needles.select(size.alias("n")).distinct().collect())  # as many as sizes at most
    if not used:
        return texts.select(F.lit(None).cast("string").alias("needle"), "text").limit(0)
    held = F.concat(*[F.when(F.length("text") >= n, _grams(F.col("text"), F.lit(n))).otherwise(F.array().cast("array<bigint>")) for n in used])
    counts = _counts(texts, held)
    # grams go with 64-bit hashes of what they are of, and not with the texts; a needle with a gram that no text has is in none
    rated = F.transform(_grams(F.col("needle"), size), lambda h: F.struct(F.get(counts, _bucket(h)).alias("times"), h.alias("gram")))
    keys = cut(needles.select(F.xxhash64("needle").alias("n_id"), F.array_min(rated).alias("key")).where("key.times > 0").select("n_id", "key.gram"))
    # of the texts' grams only those that are some needle's key move
    holders = maybe_in(texts.select(F.xxhash64("text").alias("t_id"), F.explode(held).alias("t_gram")), F.col("t_gram"), keys.select("gram"))
    met = keys.join(holders, F.col("gram") == F.col("t_gram")).select("n_id", "t_id")
    named = met.join(needles.select(F.xxhash64("needle").alias("i"), "needle"), F.col("n_id") == F.col("i")).select("needle", "t_id")
    both = named.join(texts.select(F.xxhash64("text").alias("i"), "text"), F.col("t_id") == F.col("i"))
    return both.where(F.contains("text", F.col("needle"))).select("needle", "text")


def _ratio(cutoff: float):
    @F.pandas_udf(T.DoubleType())
    def ratio(title: pd.Series, query: pd.Series) -> pd.Series:
        matcher = difflib.SequenceMatcher()
        out, last = [], None
        for t, q in zip(title, query):
            if q != last:
                matcher.set_seq2(q)  # its index of characters is kept while the query is the same
                last = q
            matcher.set_seq1(t)
            near = matcher.real_quick_ratio() >= cutoff and matcher.quick_ratio() >= cutoff
            out.append(matcher.ratio() if near else 0.0)
        return pd.Series(out, dtype="float64")

    return ratio.asNondeterministic()  # so that a filter on it isn't moved below the distinct pairs


def close_candidates(queries: DataFrame, titles: DataFrame, cutoff: float) -> DataFrame:
    """(query, title) pairs that may have a ratio of at least cutoff; no pair that has it is missing."""

    queries, titles = cut(queries), cut(titles)
    # each character of a text with its number among equal ones
    nth = lambda cs: F.transform(cs, lambda c, i: F.concat(c, F.size(F.filter(F.slice(cs, F.lit(1), i + 1), lambda x: x == c)).cast("string")))
    tokens = lambda name: let(F.regexp_extract_all(name, F.lit("(?s)."), F.lit(0)), nth)
    counts = _counts(titles, F.transform(tokens("title"), lambda t: F.xxhash64(t)))

    def fronts(df: DataFrame, name: str) -> DataFrame:
        """(s, n, keys) by the least overlap that any partner of admissible length asks for."""
        # cut, as a plan that names the tokens again and again would name all counts as often
        rows = cut(df.select(F.col(name).alias("s"), F.array_sort(F.transform(tokens(name), lambda t: F.struct(F.get(counts, _bucket(F.xxhash64(t))).alias("times"), t.alias("token")))).alias("all")))
        n = F.size("all")
        least = F.ceil(F.round(n * (cutoff / (2 - cutoff)), 9))  # the shortest partner lies inside of the text
        rows = rows.withColumn("front", F.transform(F.slice("all", F.lit(1), F.least(n, n - least + 2).cast("int")), lambda x: x["token"]))
        front = F.col("front")
        two = least >= 2
        ones = F.transform(F.slice(front, F.lit(1), F.greatest(F.lit(1), F.size(front) - F.when(two, 1).otherwise(0))), lambda t: F.xxhash64(t))
        pairs = F.flatten(F.transform(front, lambda t, i: F.transform(F.slice(front, i + 2, F.size(front)), lambda u: F.xxhash64(F.least(t, u), F.greatest(t, u)))))
        by_pairs = two & (n <= PAIR_LENGTH)
        # a text meets partners on both sides of the limit by the keys that both have
        by_ones = ~two | (n > math.floor(PAIR_LENGTH * cutoff / (2 - cutoff)))
        none = F.array().cast("array<bigint>")
        short = F.lit(math.ceil(((2 - cutoff) / cutoff) ** 2))  # longer texts have no partner that may share a single character alone
        by_ones = by_ones | (n <= short)
        return rows.select("s", n.alias("n"), F.array_union(F.when(by_pairs, pairs).otherwise(none), F.when(by_ones, ones).otherwise(none)).alias("keys"))

    q = cut(fronts(queries, "query").select(F.col("s").alias("query"), F.col("n").alias("n_query"), F.explode("keys").alias("key")))
    t = maybe_in(fronts(titles, "title").select(F.col("s").alias("title"), F.col("n").alias("n_title"), F.explode("keys").alias("t_key")), F.col("t_key"), q.select("key"))
    near = q.join(t, (F.col("key") == F.col("t_key")) & (2 * F.least("n_query", "n_title") >= F.lit(cutoff) * (F.col("n_query") + F.col("n_title"))))
    # by number, as AQE would put the pairs, few bytes that are much work, into one task
    tasks = int(titles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return near.select("query", "title").repartition(tasks, "query", "title").distinct()


def closest(queries: DataFrame, titles: DataFrame, cutoff: float = 0.75) -> DataFrame:
    """(query, title, ratio): for each query (query) the title (title) with the highest matching-blocks ratio, of equals the last by
    code point, if it is at least cutoff. Both are distinct and not empty."""
    pairs = close_candidates(queries, titles, cutoff)
    scored = pairs.sortWithinPartitions("query").withColumn("ratio", _ratio(cutoff)("title", "query")).where(F.col("ratio") >= cutoff)
    return scored.groupBy("query").agg(F.max(F.struct("ratio", "title")).alias("m")).select("query", "m.title", "m.ratio")


def title_matches(requests: DataFrame, entries: DataFrame, cutoff: float = 0.75) -> DataFrame:
    """(ref, kind, entry, place) for requests (ref, title) and entries (entry, title, ordinal): all entries whose folded title is the
    request's (exact); without any, all whose title has it inside or is inside of it (partial); without any, those of the closest title (close).
    place orders a request's entries: titles by their first entry, and entries of a title by ordinal."""
    asked = cut(requests.select("ref", norm_text("title").alias("q")).where("q <> ''"))
    rows = cut(entries.select("entry", "ordinal", norm_text("title").alias("key")).where("key <> ''"))
    keys = rows.groupBy("key").agg(F.min("ordinal").alias("first"))
    queries = asked.select("q").distinct()
    exact = queries.join(keys, F.col("q") == F.col("key"), "left_semi").select("q", F.col("q").alias("key"), F.lit("exact").alias("kind"))
    rest = cut(queries.join(keys, F.col("q") == F.col("key"), "left_anti"))
    titles = keys.select("key")
    inside = contained(rest.withColumnRenamed("q", "needle"), titles.withColumnRenamed("key", "text")).select(F.col("needle").alias("q"), F.col("text").alias("key"))
    around = contained(titles.withColumnRenamed("key", "needle"), rest.withColumnRenamed("q", "text")).select(F.col("text").alias("q"), F.col("needle").alias("key"))
    partial = cut(inside.unionByName(around).distinct())
    left = cut(rest.join(partial.select("q").distinct(), "q", "left_anti"))
    found = exact.unionByName(partial.withColumn("kind", F.lit("partial")))
    if not left.isEmpty():  # else no title is looked for among all
        close = closest(left.withColumnRenamed("q", "query"), titles.withColumnRenamed("key", "title"), cutoff)
        found = found.unionByName(close.select(F.col("query").alias("q"), F.col("title").alias("key"), F.lit("close").alias("kind")))
    named = found.join(keys.withColumnRenamed("key", "k"), F.col("key") == F.col("k")).drop("k")
    out = asked.join(named, "q").join(rows.select("entry", "ordinal", F.col("key").alias("r_key")), F.col("key") == F.col("r_key"))
    return out.select("ref", "kind", "entry", F.struct("first", "key", "ordinal").alias("place"))


def first_match(requests: DataFrame, entries: DataFrame, cutoff: float = 0.75) -> DataFrame:
    """(ref, kind, entry): the first entry of each request that has any."""
    best = title_matches(requests, entries, cutoff).groupBy("ref").agg(F.min_by(F.struct("kind", "entry"), "place").alias("m"))
    return best.select("ref", "m.*")


def text_paths(requests: DataFrame, entries: DataFrame, files: DataFrame, cutoff: float = 0.75) -> DataFrame:
    """(ref, path): for requests (ref, title) the first path of a text that is among files (path). Of the entries (entry, title, ordinal,
    text_path, documents) that match, in order, the text_path comes first, then documents of type text or with the suffix of one."""
    local = F.col("d.local_path")
    is_text = F.coalesce(F.lower("d.type").isin("text", "txt"), F.lit(False)) | F.lower(local).rlike("\\.(txt|text|md)$")
    own = entries.select("entry", F.lit(-1).alias("at"), F.col("text_path").alias("path"))
    others = entries.select("entry", F.posexplode("documents").alias("at", "d")).where(is_text).select("entry", "at", local.alias("path"))
    there = own.unionByName(others).where("path <> ''").join(files.select("path").distinct(), "path", "left_semi")
    first = there.groupBy(F.col("entry").alias("e")).agg(F.min_by("path", "at").alias("path"))
    matched = title_matches(requests, entries.select("entry", "title", "ordinal"), cutoff)
    return matched.join(first, F.col("entry") == F.col("e")).groupBy("ref").agg(F.min_by("path", "place").alias("path"))


#: Documents are tried by their declared type in this order, and then all together by what they really are.
TRIES = ({"text"}, {"html"}, {"pdf"}, {"docx", "doc", "word"})
SUFFIXES = {"pdf": "pdf", "docx": "docx", "doc": "doc", "htm": "html", "html": "html", "txt": "text", "text": "text", "md": "text"}
BEST = {"pdf": 5, "docx": 4, "doc": 4, "word": 4, "html": 3, "text": 2, "txt": 2}


def _by(value: Column, known: dict, other: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    return F.coalesce(F.try_element_at(table, value), other)


def clauses_by_title(requests: DataFrame, entries: DataFrame, documents: DataFrame, cutoff: float = 0.75) -> DataFrame:
    """For requests (ref, title, clause): entry and kind of the first entry (entry, title, ordinal) that the title matches, path, type,
    article, paragraph, item, their texts and error. documents is (entry, at, type, path, text); a null text can't be read.

    A matching entry's documents are tried as texts, pages, pdf and word files, then all together; within a try the best kind of
    file that has the article answers. The first try without an error is the result, or else the first one's error."""
    first = cut(first_match(requests.select("ref", "title"), entries, cutoff))
    asked = requests.hint("merge").join(first.withColumnRenamed("ref", "f_ref"), F.col("ref") == F.col("f_ref"), "left").drop("f_ref")
    declared = F.lower("type")
    suffix = F.lower(F.regexp_extract("path", "\\.([^./\\\\]+)$", 1))
    real = _by(suffix, SUFFIXES, F.coalesce(F.nullif(declared, F.lit("")), suffix))
    turns = F.array_compact(F.array(*[F.when(declared.isin(*kinds), i) for i, kinds in enumerate(TRIES)], F.lit(len(TRIES))))
    docs = documents.select("entry", "at", "path", "text", real.alias("type"), _by(real, BEST, F.lit(1)).alias("best"), turns.alias("turns"))
    docs = docs.withColumn("doc_id", F.to_json(F.struct("entry", "at")))
    tries = asked.where("entry is not null").select("ref", F.col("entry").alias("e"), "clause").hint("merge").join(docs.drop("text"), F.col("e") == F.col("entry"))
    tries = cut(tries)
    questions = tries.select("doc_id", "clause").distinct().withColumn("ref", F.to_json(F.struct("doc_id", "clause")))
    needed = docs.hint("merge").join(questions.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "text")
    found = find_clauses(needed, questions.select("ref", "doc_id", "clause")).withColumnRenamed("ref", "question").drop("doc_id")
    each = tries.withColumn("question", F.to_json(F.struct("doc_id", "clause"))).hint("merge").join(found, "question").withColumn("turn", F.explode("turns"))
    fields = ("path", "type", "article", "paragraph", "item", "article_text", "paragraph_text", "item_text", "error")
    # within a turn: documents with the article, best kind first; a document that can't be read before one without it
    none, unread = F.col("article_text").isNull(), F.col("error") == "document_unavailable"
    turn = each.groupBy("ref", "turn").agg(F.min_by(F.struct(*fields), F.struct(none.alias("none"), (~unread).alias("read"), (-F.col("best")).alias("best"), "at")).alias("x"))
    best = turn.groupBy(F.col("ref").alias("b_ref")).agg(F.min_by("x", F.struct(F.col("x.error").isNotNull().alias("failed"), "turn")).alias("x"))
    out = asked.hint("merge").join(best, F.col("ref") == F.col("b_ref"), "left")
    valid = C.article(norm_text("clause")).isNotNull()
    error = (
        F.when(F.coalesce("title", F.lit("")) == "", "missing_title")
        .when(~valid, "invalid_clause_reference")
        .when(F.col("entry").isNull(), "policy_not_found")
        .when(F.col("x").isNull(), "document_unavailable")
        .otherwise(F.col("x.error"))
    )
    ok = ~F.coalesce(error.isin("missing_title", "invalid_clause_reference"), F.lit(False))
    read = F.col("x.article_text").isNotNull()
    shown = [F.when(ok & read, F.col(f"x.{c}")).alias(c) if c in ("path", "type") else F.when(ok, F.col(f"x.{c}")).alias(c) for c in fields[:-1]]
    return out.select("ref", "title", "clause", F.when(ok, F.col("entry")).alias("entry"), F.when(ok, F.col("kind")).alias("kind"), *shown, error.alias("error"))
