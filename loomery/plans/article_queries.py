"""Queries of sections, headings, neighbours and budgets. Headings are Latin here; CJK ones are in the tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomery.operators import articles as A
from loomery.plans.registry import register
from loomery.sources.tables import table

_LINES = r"""l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents WHERE text IS NOT NULL)"""


@register("sections_split", r"""
WITH p AS (SELECT doc_id, unnest(string_split(text, 'The ')) AS part, unnest(range(len(string_split(text, 'The ')))) AS pos FROM documents WHERE coalesce(text, '') <> ''),
s AS (SELECT doc_id, pos, CASE WHEN pos = 0 THEN '全文' ELSE 'The' END AS article_no, regexp_replace(part, '^\s+|\s+$', '', 'g') AS body, length(part) + CASE WHEN pos = 0 THEN 0 ELSE 4 END AS n FROM p),
o AS (SELECT *, (sum(n) OVER (PARTITION BY doc_id ORDER BY pos) - n)::BIGINT AS start FROM s)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1)::BIGINT AS "index", article_no, length(body)::BIGINT AS n_body, start FROM o WHERE pos > 0 OR body <> ''""")
def sections_split(spark, sf_dir):
    s = A.split_articles(table(spark, sf_dir, "documents"), heading="The ")
    no = F.col("article_no")
    return s.select("doc_id", F.col("index").cast("long").alias("index"), no.alias("article_no"), F.greatest(F.length("text") - F.length(no) - 1, F.lit(0)).cast("long").alias("n_body"), F.col("start").cast("long").alias("start"))


@register("section_offsets", f"""
WITH {_LINES}, o AS (SELECT doc_id, line, line_no, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no) - length(line) - 1 AS start FROM l),
h AS (SELECT doc_id, trim(line) AS title, start::BIGINT AS start FROM o WHERE regexp_matches(line, '^ *The [a-z]+'))
SELECT doc_id, title, start, coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY start), (SELECT length(text) FROM documents d WHERE d.doc_id = h.doc_id))::BIGINT AS "end" FROM h""")
def section_offsets(spark, sf_dir):
    h = A.headings(table(spark, sf_dir, "documents").where("text is not null"), "The [a-z]+")
    return h.select("doc_id", "title", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@register("heading_carry_forward", f"""
WITH {_LINES}, h AS (SELECT doc_id, line_no, CASE WHEN starts_with(line, 'The ') THEN substr(line, 1, 20) END AS head FROM l)
SELECT doc_id, line_no::INT AS line_no, last_value(head IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM h""")
def heading_carry_forward(spark, sf_dir):
    l = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))  # noqa: E741
    l = l.withColumn("head", F.when(F.col("line").startswith("The "), F.substring("line", 1, 20)))  # noqa: E741
    return A.carry_forward(l.select("doc_id", "line_no", "head"), "doc_id", "line_no", "head", "section").drop("head")


@register("context_window", """
SELECT conv_id, turn, lag(role) OVER w AS prev_1_role, lead(role) OVER w AS next_1_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def context_window(spark, sf_dir):
    return A.neighbours(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", 1, ["role"]).drop("role")


@register("context_budget", """
WITH b AS (SELECT conv_id, turn, text, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM conversations)
SELECT conv_id, turn, left(text, (1000 - before)::BIGINT) AS text FROM b WHERE before < 1000""")
def context_budget(spark, sf_dir):
    return A.within_budget(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "conv_id", [F.col("turn")], "text", 1000)


@register("provision_context", """
WITH t AS (SELECT conv_id, turn FROM conversations WHERE role = 'user'),
n AS (SELECT t.conv_id || ':' || t.turn AS target, CASE WHEN c.turn = t.turn THEN 'target' ELSE 'neighbor' END AS role, c.conv_id || ':' || c.turn AS article_id, c.text FROM t JOIN conversations c ON c.conv_id = t.conv_id AND abs(c.turn - t.turn) <= 1)
SELECT target, role, article_id, length(text)::BIGINT AS n FROM n""")
def provision_context(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    a = c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("index"), F.concat_ws(":", "conv_id", "turn").alias("article_id"), "text", "role")
    out = A.provision_context(a.drop("role"), a.where("role = 'user'").select("article_id"))
    return out.select("target", "role", "article_id", F.length("text").cast("long").alias("n"))
