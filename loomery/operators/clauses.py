"""Clauses of documents: look-up by reference, outlines, and keys that name several clauses.

Documents become rows of lines, which know the block between two headings that they are in; a clause meets its block's lines
alone, and where its paragraph starts and ends are minima over these. Nothing but the lines asked for is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomery.functions import clauses as C
from loomery.functions.text import norm_text
from loomery.sources.checkpoints import cut

#: Of a policy's documents the first type that has the clause is used.
TYPE_ORDER = {"pdf": 5, "word": 4, "doc": 4, "docx": 4, "html": 3, "text": 2, "txt": 2}


def clause_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line, raw, plain): the lines of texts and their folded form."""
    rows = F.split(F.regexp_replace(F.col(text_col), "\r\n?", "\n"), "\n")
    lines = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(rows).alias("line", "raw"))
    return lines.withColumn("plain", norm_text("raw"))


def _starts(unit: str) -> tuple[Column, Column]:
    """The number of a heading 第N<unit> at a line's start, and whether there is any."""
    plain = F.col("plain")
    return F.regexp_extract(plain, f"^第\\s*((?:{C.NUMBER}\\s*)+){unit}", 1), plain.rlike(f"^第\\s*{C.NUMBER}+\\s*{unit}")


def find_clauses(docs: DataFrame, references: DataFrame) -> DataFrame:
    """Of references (ref, doc_id, clause) in docs (doc_id, text): ref, article, paragraph, item, article_text,
    paragraph_text, item_text and error. A paragraph that isn't found leaves the article as its text. A document's lines meet
    each clause that is asked for once, however many references ask for it."""
    named = references.select("ref", "doc_id", F.explode(F.array(C.reference(norm_text("clause")))).alias("r")).select("ref", F.to_json(F.struct("doc_id", "r")).alias("question"), "doc_id", "r.*")
    answers = _answers(docs, cut(named.drop("ref").distinct().withColumnRenamed("question", "ref")))  # read four times
    return named.select("ref", "question").hint("merge").join(answers.withColumnRenamed("ref", "question"), "question").drop("question")


def _answers(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """Of distinct questions (ref, doc_id, article, paragraph, unit, item) in docs, as find_clauses. No side of a join is broadcast, as Spark takes
    strings for a few bytes, and all of them grow with the questions."""
    # what a line shows is read once, however many questions its document has
    wanted = docs.where("text is not null").hint("merge").join(asked.where("article is not null").select("doc_id").distinct(), "doc_id", "left_semi")
    bare = lambda c: F.regexp_replace(c, "\\s", "")
    shown = {f"n_{unit}": bare(_starts(unit)[0]) for unit in "条款段"} | {f"is_{unit}": _starts(unit)[1] for unit in "条款段"}
    shown |= {"n_bullet": bare(F.regexp_extract("plain", f"^((?:{C.NUMBER}\\s*)+){C.MARKS}", 1)), "is_bullet": F.col("plain").rlike(f"^{C.NUMBER}+\\s*{C.MARKS}"), "is_final": C.final_line(F.col("plain"))}
    questions = asked.where("article is not null").select("*", C.ways(F.col("article")).alias("articles"), F.when(F.col("paragraph").isNotNull(), C.ways(F.col("paragraph"))).alias("paragraphs"))
    lines = clause_lines(wanted).withColumns(shown).drop("plain")
    # a unit lasts from its heading to the next line that opens one of its kind or ends the document, so that lines between two such are a block; a
    # document's lines are gone through once, and meet a question by the block of its heading alone
    upto = W.partitionBy("doc_id").orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    last = lambda when: F.coalesce(F.max(F.when(when, F.col("line"))).over(upto), F.lit(-1))
    kinds = (("a", "n_条", "is_条"), ("b", "n_bullet", "is_bullet"))
    lines = lines.withColumns({f"block_{k}": last(F.col(opens) | F.col("is_final")) for k, _, opens in kinds} | {f"named_{k}": last(F.col(n) != "") for k, n, _ in kinds})
    # a line behind no heading of its block is in no unit
    ins = F.array_compact(F.array(*[F.when((F.col(f"named_{k}") >= 0) & (F.col(f"named_{k}") >= F.col(f"block_{k}")), F.struct(F.lit(k).alias("kind"), F.col(f"block_{k}").alias("block"), F.col(n).alias("number"))) for k, n, _ in kinds]))
    lines = cut(lines.withColumn("in", F.explode(ins)).select("doc_id", "line", "raw", *[c for u in "款段" for c in (f"n_{u}", f"is_{u}")], "in.*"))
    heads = lines.where("number <> ''").select("doc_id", "number", "kind", "line", "block")
    named = questions.select("ref", "doc_id", F.explode("articles").alias("number")).hint("merge").join(heads, ["doc_id", "number"])
    # of both kinds headings count before list numbers, and of these the first
    starts = named.groupBy("ref", "doc_id").agg(F.min(F.struct("kind", F.col("line").alias("start"), "block")).alias("s")).select("ref", "doc_id", "s.*")
    asked_for = starts.hint("merge").join(questions.select("ref", "unit", "paragraphs"), "ref")
    part = lines.drop("number").hint("merge").join(asked_for, ["doc_id", "kind", "block"]).where("line >= start")
    one = W.partitionBy("ref")
    place = F.col("line")

    def first(when: Column) -> Column:
        return F.min(F.when(when, place)).over(one)

    begin = {}
    for unit in "款段":
        begin[unit] = first(F.array_contains("paragraphs", F.col(f"n_{unit}")) & (F.col("unit").isNull() | (F.col("unit") == unit)))
    part = part.withColumns({"p": begin["款"], "q": begin["段"]})
    of_unit = F.when(F.col("p").isNotNull(), F.col("is_款")).otherwise(F.col("is_段"))
    part = part.withColumn("from", F.coalesce("p", "q")).withColumn("to", first((place > F.col("from")) & of_unit))
    inside = F.col("from").isNull() | ((place >= F.col("from")) & (F.col("to").isNull() | (place < F.col("to"))))

    def joined(keep: Column) -> Column:
        rows = F.array_sort(F.collect_list(F.when(keep, F.struct("line", F.regexp_replace("raw", "\\s+$", "").alias("raw")))))
        return F.btrim(F.array_join(F.transform(rows, lambda x: x["raw"]), "\n"), F.lit(" \n\t　"))

    texts = part.groupBy("ref").agg(joined(F.lit(True)).alias("article_text"), joined(inside).alias("paragraph_text"), F.first("from").alias("from"))
    out = asked.hint("merge").join(texts.withColumnRenamed("ref", "t_ref"), F.col("ref") == F.col("t_ref"), "left")
    held = docs.where("text is not null").select(F.col("doc_id").alias("held")).distinct()
    out = out.hint("merge").join(held, F.col("doc_id") == F.col("held"), "left")
    out = out.withColumn("item_text", F.when(F.col("item").isNotNull(), C.item_text(F.col("paragraph_text"), F.col("item"))))
    error = (
        F.when(F.col("article").isNull(), "invalid_clause_reference")
        .when(F.col("held").isNull(), "document_unavailable")
        .when(F.col("article_text").isNull(), "article_not_found")
        .when(F.col("item").isNotNull() & F.col("item_text").isNull(), "item_not_found")
        .when(F.col("item").isNull() & F.col("paragraph").isNotNull() & F.col("from").isNull(), "paragraph_not_found")
    )
    return out.select("ref", "doc_id", "article", "paragraph", "item", "article_text", "paragraph_text", "item_text", error.alias("error"))


def find_in_policies(policies: DataFrame, references: DataFrame) -> DataFrame:
    """As find_clauses, for policies (title, type, path, text) of several documents each and references (ref, title,
    clause): the document of the best type that has the article answers, or else the best one's error."""
    known = policies.select("title").distinct().withColumnRenamed("title", "p_title")
    asked = references.join(known, F.col("title") == F.col("p_title"), "left")
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in TYPE_ORDER.items() for x in kv]), F.lower("type")), F.lit(1))
    best = F.row_number().over(W.partitionBy("title").orderBy(rank.desc(), "path"))
    docs = policies.withColumn("rank", best).withColumn("doc_id", F.concat_ws("\u0000", "title", "path"))
    tries = asked.where("p_title is not null").join(docs.select(F.col("title").alias("d_title"), "doc_id", "rank", "path", "type"), F.col("title") == F.col("d_title"))
    tries = tries.withColumn("try", F.concat_ws("\u0000", "ref", "path"))
    found = find_clauses(docs.select("doc_id", "text"), tries.select(F.col("try").alias("ref"), "doc_id", "clause")).drop("doc_id").withColumnRenamed("ref", "f_ref")
    each = tries.select("ref", "try", "rank", "path", "type").join(found, F.col("try") == F.col("f_ref"))
    answer = F.struct(F.col("article_text").isNull().alias("none"), "rank", "path", "type", "article", "paragraph", "item", "article_text", "paragraph_text", "item_text", "error")
    chosen = each.groupBy(F.col("ref").alias("c_ref")).agg(F.min(answer).alias("x"))
    out = asked.join(chosen, F.col("ref") == F.col("c_ref"), "left")
    ok = F.col("x.article_text").isNotNull()
    error = F.when(F.coalesce(F.btrim("title"), F.lit("")) == "", "missing_title").when(F.col("p_title").isNull(), "policy_not_found").otherwise(F.col("x.error"))
    return out.select("ref", "title", "clause", F.when(ok, F.col("x.path")).alias("path"), F.when(ok, F.col("x.type")).alias("type"), *[F.col(f"x.{c}").alias(c) for c in ("article", "paragraph", "item", "article_text", "paragraph_text", "item_text")], error.alias("error"))


def outline(docs: DataFrame, bracketed_items: bool = True) -> DataFrame:
    """(doc_id, line, level, number, label, article, paragraph): articles, paragraphs and items in order, with the
    ordinals of the article and paragraph that they are in. Without bracketed_items only list numbers are items."""
    lines = clause_lines(docs)
    item = f"^\\(\\s*{C.NUMBER}+\\s*\\)|^{C.NUMBER}+\\s*{C.MARKS}" if bracketed_items else f"^{C.NUMBER}+\\s*{C.MARKS}"
    level = F.when(_starts("条")[1], "article").when(_starts("[款段]")[1], "paragraph").when(F.col("plain").rlike(item), "item")
    marked = lines.withColumn("level", level).where("level is not null and trim(raw) <> ''")
    upto = W.partitionBy("doc_id").orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    inside = W.partitionBy("doc_id", "article").orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    marked = marked.withColumn("article", F.sum((F.col("level") == "article").cast("int")).over(upto)).where("article > 0")
    seen = F.sum((F.col("level") == "paragraph").cast("int")).over(inside)
    shown = C.number(F.regexp_extract("plain", f"^[第(]?\\s*({C.NUMBER}+)", 1))
    return marked.select("doc_id", "line", "level", shown.alias("number"), F.btrim("raw").alias("label"), "article", F.when(seen > 0, seen).alias("paragraph"))


def clause_keys(keys: DataFrame, key: str = "key") -> DataFrame:
    """(key, n, title, clause): the clauses that a key names, as 《title》第三条，第一款 (several times), title：clauses or
    title第三条. What isn't an article is put behind the article, or paragraph, before it."""
    k = F.btrim(key)
    titled = F.arrays_zip(F.regexp_extract_all(k, F.lit("《([^》]+)》"), F.lit(1)).alias("title"), F.slice(F.split(k, "《[^》]+》"), 2, 1 << 30).alias("block"))
    colon = F.regexp_extract(k, "(?s)^(.*)[：:]([^：:]*第[^：:]*)$", 1)
    behind = F.regexp_extract(k, "(?s)^(.*)[：:]([^：:]*第[^：:]*)$", 2)
    edge = lambda c: F.regexp_replace(F.btrim(c), "^[《》\"'：:，,]+|[《》\"'：:，,]+$", "")
    single = F.when(edge(colon) != "", F.array(F.struct(edge(colon).alias("title"), behind.alias("block")))).otherwise(
        F.array(F.struct(edge(F.regexp_extract(k, "(?s)^(.+?)第", 1)).alias("title"), F.regexp_extract(k, "(?s)^.+?(第.*)$", 1).alias("block")))
    )
    blocks = keys.select(F.col(key).alias("key"), F.posexplode(F.when(F.size(titled) > 0, titled).otherwise(single)).alias("at", "b"))
    blocks = blocks.select("key", "at", F.btrim("b.title").alias("title"), F.btrim("b.block").alias("block")).where("title <> '' and block <> ''")
    near = f"[{C.KEY_EDGES}{C.CONNECTORS}]"
    pieces = blocks.select("key", "at", "title", F.posexplode(F.split("block", f"(?<={near})(?=第)")).alias("i", "raw"))
    clause = F.regexp_replace(F.regexp_replace("raw", f"^[{C.KEY_EDGES}]+|[{C.KEY_EDGES}]+$", ""), f"^[{C.CONNECTORS}]+|[{C.CONNECTORS}]+$", "")
    # text before the first 第 of a block belongs to no clause, unless there is no other
    several = F.max("i").over(W.partitionBy("key", "at")) > 0
    pieces = pieces.withColumn("several", several).withColumn("clause", clause).where("clause <> '' and (not several or startswith(raw, '第'))")
    order = W.partitionBy("key", "at").orderBy("i")
    pieces = pieces.withColumn("own", F.col("clause").rlike("[条点]"))
    pieces = pieces.withColumn("article", F.last(F.when(F.col("own"), F.col("clause")), ignorenulls=True).over(order)).withColumn("n_article", F.sum(F.col("own").cast("int")).over(order))
    within = W.partitionBy("key", "at", "n_article").orderBy("i")
    low = ~F.col("own") & F.col("article").isNotNull()
    paragraph = F.last(F.when(low & F.col("clause").rlike("[款段]"), F.concat_ws(" ", "article", "clause")), ignorenulls=True).over(within.rowsBetween(W.unboundedPreceding, -1))
    pieces = pieces.withColumn("base", F.when(low, F.when(F.col("clause").rlike("[项目]"), F.coalesce(paragraph, "article")).otherwise(F.col("article"))))
    pieces = pieces.withColumn("whole", F.when(low, F.concat_ws(" ", "base", "clause")).otherwise(F.col("clause")))
    # a base is named by the clause right behind it
    rows = pieces.withColumn("next", F.lead("base").over(order)).where("next is null or next <> whole")
    return rows.select("key", (F.row_number().over(W.partitionBy("key").orderBy("at", "i")) - 1).alias("n"), "title", F.col("whole").alias("clause"))
