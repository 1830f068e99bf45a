"""The context of provisions: neighbours, definitions, exceptions and references of an article within one budget, and the articles that
articles cite.

Which article of a document defines, excepts or refers is found once for each document, however many articles are asked for. Roles
are ranked before the budget is spent.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomery.functions import clauses as C
from loomery.functions.text import find_sentence
from loomery.operators.articles import split_articles, within_budget
from loomery.sources.checkpoints import cut

# fixed values: what the sentences of each role have in them, what such a sentence is called if no article has it, words before a citation
ROLES = {
    "definition": (("本法所称", "本办法所称", "本规定所称"), "定义相关"),
    "exception": (("除外", "但", "除", "不适用"), "例外相关"),
    "reference": (("依照第", "根据第", "参照第"), "引用相关"),
}
CITING = "(依照|根据|参照|按照|适用|违反|本法|本办法|本规定|以及|和|、)\\s*$"


def _spoken(docs: DataFrame, articles: DataFrame, patterns: dict[str, tuple[str, ...]]) -> DataFrame:
    """(doc_id, role, index, article_id, article_no, text): for each role the first article with such a sentence, or else the sentence of
    the whole text, without an article."""
    marks = F.array(*[F.when(F.coalesce(F.btrim(find_sentence(F.col("text"), needles)), F.lit("")) != "", F.lit(role)) for role, needles in patterns.items()])
    hits = articles.select("doc_id", "index", "article_id", "article_no", "text", F.explode(F.array_compact(marks)).alias("role"))
    first = hits.groupBy("doc_id", "role").agg(F.min_by(F.struct("index", "article_id", "article_no", "text"), "index").alias("a"))
    said = [F.struct(F.lit(role).alias("role"), F.lit(ROLES[role][1] if role in ROLES else role).alias("name"), F.btrim(find_sentence(F.col("text"), needles)).alias("sentence")) for role, needles in patterns.items()]
    loose = docs.select(F.col("doc_id").alias("l_doc"), F.explode(F.array(*said)).alias("s")).where("s.sentence <> ''")
    both = loose.join(first, (F.col("l_doc") == F.col("doc_id")) & (F.col("s.role") == F.col("role")), "full_outer")
    whole = F.struct(F.lit(None).cast("int").alias("index"), F.lit(None).cast("string").alias("article_id"), F.col("s.name").alias("article_no"), F.col("s.sentence").alias("text"))
    return both.select(F.coalesce("doc_id", "l_doc").alias("doc_id"), F.coalesce("role", "s.role").alias("role"), F.coalesce("a", whole).alias("a")).select("doc_id", "role", "a.*")


def provisions(docs: DataFrame, requests: DataFrame, neighbor_range: int = 1, max_length: int = 2000, heading: str | None = None, patterns: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """For requests (ref, doc_id, article_id and, null or not, include_neighbors, neighbor_range, include_definitions, include_exceptions,
    include_references, max_length) in docs (doc_id, text): ref, place, role, article_id, article_no and text.

    A request's own value counts before the common one. An article that isn't there is the document's first; a range of 0 is 1; no length,
    or none above 0, is no budget. A document that isn't there, or has no text, has no context. Each role has one entry for an article."""
    options = {"include_neighbors": "boolean", "neighbor_range": "int", "include_definitions": "boolean", "include_exceptions": "boolean", "include_references": "boolean", "max_length": "int"}
    common = {"neighbor_range": neighbor_range, "max_length": max_length}
    missing = [F.lit(None).cast(t).alias(c) for c, t in options.items() if c not in requests.columns]
    asked = requests.select("*", *missing)
    asked = asked.select("ref", "doc_id", F.col("article_id").alias("asked"), *[F.coalesce(F.col(c).cast(t), F.lit(common.get(c, True))).alias(c) for c, t in options.items()])
    wanted = docs.join(asked.select("doc_id").distinct(), "doc_id", "left_semi")
    articles = cut(split_articles(wanted, **({"heading": heading} if heading else {})))
    known = articles.select(F.col("doc_id").alias("k_doc"), "article_id", "index")
    found = asked.join(known, (F.col("doc_id") == F.col("k_doc")) & (F.col("asked") == F.col("article_id")), "left").select(asked["*"], "index")
    one = articles.select("doc_id").distinct()
    target = found.join(one, "doc_id").withColumn("target", F.coalesce("index", F.lit(0)))  # only of documents that have articles
    reach = F.when(F.col("include_neighbors"), F.greatest(F.lit(1), "neighbor_range")).otherwise(0)
    near = target.withColumn("want", F.explode(F.sequence(F.col("target") - reach, F.col("target") + reach)))
    a = articles.select(F.col("doc_id").alias("a_doc"), F.col("index").alias("a_index"), "article_id", "article_no", "text")
    rows = near.join(a, (F.col("doc_id") == F.col("a_doc")) & (F.col("want") == F.col("a_index")))
    is_target = F.col("a_index") == F.col("target")
    first = rows.select("ref", "max_length", F.when(is_target, 0).otherwise(1).alias("rank"), F.col("a_index").alias("at"), F.when(is_target, "target").otherwise("neighbor").alias("role"), "article_id", "article_no", "text")
    spoken = _spoken(wanted, articles, patterns or {role: needles for role, (needles, _) in ROLES.items()})
    flag = {"definition": "include_definitions", "exception": "include_exceptions", "reference": "include_references"}
    rank = reduce(lambda c, r: c.when(F.col("role") == r[1], r[0]), enumerate(flag, 2), F.when(F.lit(False), 0))
    on = reduce(lambda c, r: c | ((F.col("role") == r) & F.col(flag[r])), flag, F.lit(False))
    s = spoken.withColumnRenamed("doc_id", "s_doc").withColumnRenamed("index", "s_index")
    more = target.join(s, F.col("doc_id") == F.col("s_doc")).where(on)
    more = more.select("ref", "max_length", rank.alias("rank"), F.coalesce("s_index", F.lit(0)).alias("at"), "role", F.coalesce("article_id", "asked", F.concat(F.col("doc_id").cast("string"), F.lit("-article-1"))).alias("article_id"), "article_no", "text")
    context = first.unionByName(more)
    limited = F.col("max_length") > 0
    context = context.withColumn("text", F.when(limited, F.left("text", F.col("max_length"))).otherwise(F.col("text")))
    order = W.partitionBy("ref").orderBy("rank", "at")
    spent = F.coalesce(F.sum(F.length("text")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    context = context.withColumn("spent", spent).where(~limited | (F.col("spent") < F.col("max_length")))
    text = F.when(limited, F.left("text", (F.col("max_length") - F.col("spent")).cast("int"))).otherwise(F.col("text"))
    return context.select("ref", (F.row_number().over(order) - 1).alias("place"), "role", "article_id", "article_no", text.alias("text"))


def citations(articles: DataFrame) -> DataFrame:
    """(doc_id, index, cited, number) of articles (doc_id, index, article_no, text) that name others of their document: a heading inside of a sentence
    opens a section of its own, so that the section before it ends with a word that cites. index is the article that
    the sentence began in, cited the first section with that number that isn't itself such a piece, or null."""
    order = W.partitionBy("doc_id").orderBy("index")
    tail = F.lag("text").over(order)
    rows = articles.select("doc_id", "index", C.number(F.regexp_replace(F.regexp_extract("article_no", "第\\s*(.*?)\\s*条", 1), "\\s", "")).alias("number"), F.coalesce(tail.rlike(CITING), F.lit(False)).alias("inside"))
    rows = rows.withColumn("owner", F.last(F.when(~F.col("inside"), F.col("index")), ignorenulls=True).over(order))
    real = rows.where(~F.col("inside") & F.col("number").isNotNull()).groupBy(F.col("doc_id").alias("t_doc"), F.col("number").alias("t_number")).agg(F.min("index").alias("cited"))
    named = rows.where("inside and number is not null").select("doc_id", F.col("owner").alias("index"), "number").distinct()
    out = named.join(real, (F.col("doc_id") == F.col("t_doc")) & (F.col("number") == F.col("t_number")), "left")
    return out.select("doc_id", "index", "cited", "number")


def cited_articles(articles: DataFrame, targets: DataFrame, depth: int = 2) -> DataFrame:
    """(ref, doc_id, index, distance): what the articles of targets (ref, doc_id, index) cite, and what these cite, up to a depth, each once at
    its least distance. A target isn't cited by itself."""
    edges = citations(articles).where("cited is not null").select(F.col("doc_id").alias("e_doc"), F.col("index").alias("e_index"), "cited")
    edges = cut(edges)
    seen = targets.select("ref", "doc_id", "index", F.lit(0).alias("distance")).distinct()
    last = seen
    for d in range(1, depth + 1):
        step = last.join(edges, (F.col("doc_id") == F.col("e_doc")) & (F.col("index") == F.col("e_index"))).select("ref", "doc_id", F.col("cited").alias("index")).distinct()
        last = cut(step.join(seen, ["ref", "doc_id", "index"], "left_anti").withColumn("distance", F.lit(d)))
        seen = seen.unionByName(last)
    return seen.where("distance > 0")


def with_citations(articles: DataFrame, targets: DataFrame, depth: int, budget: int) -> DataFrame:
    """(ref, role, distance, article_id, text): the target, then what it cites by distance, within a budget of characters."""
    rows = targets.select("ref", "doc_id", "index", F.lit(0).alias("distance")).unionByName(cited_articles(articles, targets, depth))
    a = articles.select(F.col("doc_id").alias("a_doc"), F.col("index").alias("a_index"), "article_id", "text")
    named = rows.join(a, (F.col("doc_id") == F.col("a_doc")) & (F.col("index") == F.col("a_index")))
    role = F.when(F.col("distance") == 0, "target").otherwise("cited")
    return within_budget(named.select("ref", role.alias("role"), "distance", "index", "article_id", "text"), "ref", [_c("distance"), _c("index")], "text", budget).drop("index")


def _c(name: str) -> Column:
    return F.col(name)
