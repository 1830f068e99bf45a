"""Queries of paragraphs, of the context of provisions and of citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomery.operators import articles as A
from loomery.operators import context as X
from loomery.operators import pdftext as P
from loomery.plans.registry import register
from loomery.sources.tables import table

_TURN = r"""'Conversation ' || conv_id || chr(10) || chr(10) || replace(replace(text, '. ', '.' || chr(10) || chr(10)), ' de ', '-' || chr(10) || 'de' || chr(10) || chr(10)) || chr(10) || role || chr(10) || '- ' || turn || ' -' || chr(10)"""


@register("pdf_paragraphs", rf"""
WITH p AS (SELECT conv_id AS doc_id, turn, string_split(regexp_replace({_TURN}, '\r\n?', chr(10), 'g'), chr(10)) AS ls FROM conversations WHERE text IS NOT NULL),
l AS (SELECT doc_id, turn, unnest(range(len(ls))) AS i, regexp_replace(unnest(ls), '^\s+|\s+$', '', 'g') AS line FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, turn ORDER BY i) AS u, row_number() OVER (PARTITION BY doc_id, turn ORDER BY i DESC) AS d FROM l WHERE line <> ''),
h AS (SELECT doc_id, line FROM r WHERE length(line) <= 60 GROUP BY ALL HAVING count(*) FILTER (u <= 3) >= 2 OR count(*) FILTER (d <= 3) >= 2),
k AS (SELECT l.* FROM l ANTI JOIN h ON l.doc_id = h.doc_id AND l.line = h.line WHERE NOT regexp_matches(l.line, '^-?\s*[0-9]+\s*-?$')),
b AS (SELECT *, sum((line = '')::INT) OVER (PARTITION BY doc_id ORDER BY turn, i) AS blanks FROM k),
g AS (SELECT *, lag(line) OVER w AS last, blanks > lag(blanks) OVER w AS gap FROM b WHERE line <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY turn, i)),
s AS (SELECT *, CASE WHEN last IS NULL THEN ''
  WHEN gap AND (contains('.?!;:。？！；：…)）》」』】', right(last, 1)) OR (length(last) <= 20 AND NOT regexp_matches(last, '[,.?!；：，。！？:;、]'))) THEN chr(10)
  WHEN right(last, 1) = '-' AND regexp_matches(left(line, 1), '\p{{L}}') THEN chr(1)
  WHEN regexp_matches(right(last, 1), '[\p{{L}}\p{{N}}]') AND regexp_matches(left(line, 1), '[\p{{L}}\p{{N}}]') THEN ' ' ELSE '' END || line AS piece FROM g),
t AS (SELECT doc_id, regexp_replace(string_agg(piece, '' ORDER BY turn, i), '-*' || chr(1), '', 'g') AS text FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(t.text, '') AS text FROM (SELECT DISTINCT doc_id FROM p) d LEFT JOIN t USING (doc_id)""")
def pdf_paragraphs(spark, sf_dir):
    """A conversation as a document with a page for each turn: a running head, wrapped lines, a role at the bottom and a page number."""
    c = table(spark, sf_dir, "conversations").where("text is not null")
    body = F.replace(F.replace("text", F.lit(". "), F.lit(".\n\n")), F.lit(" de "), F.lit("-\nde\n\n"))
    page = F.concat(F.lit("Conversation "), F.col("conv_id").cast("string"), F.lit("\n\n"), body, F.lit("\n"), "role", F.lit("\n- "), F.col("turn").cast("string"), F.lit(" -\n"))
    docs = c.groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", page.alias("b")))), lambda x: x["b"]), "\f").alias("text"))
    return P.paragraphs(docs)


def _orders_as_law(spark: SparkSession, sf_dir: str, body) -> DataFrame:
    """(doc_id, text): for each customer an article for each order, numbered n, of what `body` says."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    o = o.withColumn("n", F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")))
    one = F.concat(F.lit("第"), F.col("n").cast("string"), F.lit("条 "), body)
    rows = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("n", one.alias("t")))).alias("a"))
    return rows.select(F.col("o_custkey").alias("doc_id"), F.array_join(F.transform("a", lambda x: x["t"]), "\n").alias("text"))


@register("provision_roles", """
WITH o AS (SELECT o_custkey, o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
a AS (SELECT o_custkey AS c, n, '第' || n || '条' AS no, '第' || n || '条' || chr(10) || o_orderkey || ' ' || o_orderpriority || '。' || CASE WHEN n % 4 = 0 THEN '但不适用于旧单。' ELSE '' END || CASE WHEN n % 5 = 2 THEN '本法所称订单，是指记录；' ELSE '' END || CASE WHEN n % 6 = 0 THEN '根据第三方协议。' ELSE '' END AS text FROM o),
q AS (SELECT o_orderkey AS ref, o_custkey AS c, o_orderkey % 9 AS want, CASE o_orderkey % 4 WHEN 0 THEN 40 WHEN 1 THEN 2000 WHEN 2 THEN 90 ELSE 0 END AS most, greatest(1, o_orderkey % 3) AS reach, o_orderkey % 5 <> 0 AS defs, o_orderkey % 7 <> 0 AS near FROM orders),
t AS (SELECT q.*, CASE WHEN a.n IS NULL THEN 1 ELSE a.n END AS target FROM q LEFT JOIN a ON a.c = q.c AND a.n = q.want),
x AS (SELECT ref, most, CASE WHEN a.n = target THEN 0 ELSE 1 END AS k, CASE WHEN a.n = target THEN 'target' ELSE 'neighbor' END AS role, a.* FROM t JOIN a ON a.c = t.c AND (a.n = target OR (near AND abs(a.n - target) <= reach))
  UNION ALL SELECT ref, most, r.k, r.role, a.* FROM t, (VALUES (2, 'definition', 2), (3, 'exception', 4), (4, 'reference', 6)) AS r(k, role, place_n) JOIN a ON a.c = t.c AND a.n = r.place_n WHERE r.k <> 2 OR defs),
l AS (SELECT *, CASE WHEN most > 0 THEN left(text, most) ELSE text END AS short FROM x),
s AS (SELECT *, coalesce(sum(length(short)) OVER (PARTITION BY ref ORDER BY k, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM l)
SELECT ref, (row_number() OVER (PARTITION BY ref ORDER BY k, n) - 1)::INT AS place, role, c || '-article-' || n AS article_id, no AS article_no, CASE WHEN most > 0 THEN left(short, (most - spent)::BIGINT) ELSE short END AS text FROM s WHERE most = 0 OR spent < most""")
def provision_roles(spark, sf_dir):
    """For every order the context of an article of its customer's law, in four roles within the request's own budget."""
    n = F.col("n")
    body = F.concat(F.col("o_orderkey").cast("string"), F.lit(" "), "o_orderpriority", F.lit("。"), F.when(n % 4 == 0, "但不适用于旧单。").otherwise(""), F.when(n % 5 == 2, "本法所称订单，是指记录；").otherwise(""), F.when(n % 6 == 0, "根据第三方协议。").otherwise(""))
    docs = _orders_as_law(spark, sf_dir, body)
    k = F.col("o_orderkey")
    asked = table(spark, sf_dir, "orders").select(
        k.alias("ref"), F.col("o_custkey").alias("doc_id"), F.concat_ws("-article-", F.col("o_custkey").cast("string"), (k % 9).cast("string")).alias("article_id"),
        F.when(k % 4 == 0, 40).when(k % 4 == 2, 90).when(k % 4 == 3, 0).alias("max_length"), (k % 3).alias("neighbor_range"), (k % 5 != 0).alias("include_definitions"), F.when(k % 7 == 0, False).alias("include_neighbors"),
    )
    return X.provisions(docs, asked)


_CITED = """
o AS (SELECT o_custkey AS c, o_orderkey % 12 + 1 AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, count(*) OVER (PARTITION BY o_custkey) AS m FROM orders)"""


@register("article_citations", f"""
WITH {_CITED} SELECT c AS doc_id, (2 * (n - 1))::INT AS "index", CASE WHEN k <= m THEN 2 * (k - 1) END::INT AS cited, k::BIGINT AS number FROM o""")
def article_citations(spark, sf_dir):
    """Which articles cite which; a citation opens a section of its own in the text."""
    return X.citations(A.split_articles(_citing(spark, sf_dir))).select("doc_id", "index", "cited", "number")


def _citing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders_as_law(spark, sf_dir, F.concat(F.lit("按照第"), (F.col("o_orderkey") % 12 + 1).cast("string"), F.lit("条办理。")))


@register("cited_articles", f"""
WITH {_CITED}, e AS (SELECT c, n, k FROM o WHERE k <= m),
d1 AS (SELECT c, k FROM e WHERE n = 1 AND k <> 1), d2 AS (SELECT e.c, e.k FROM d1 JOIN e ON e.c = d1.c AND e.n = d1.k EXCEPT SELECT c, k FROM d1), d3 AS (SELECT * FROM d2 WHERE k <> 1)
SELECT c AS ref, c AS doc_id, (2 * (k - 1))::INT AS "index", 1 AS distance FROM d1 UNION ALL SELECT c, c, (2 * (k - 1))::INT, 2 FROM d3""")
def cited_articles(spark, sf_dir):
    """What the first article of each law cites, and what that cites."""
    a = A.split_articles(_citing(spark, sf_dir))
    targets = a.where("index = 0").select(F.col("doc_id").alias("ref"), "doc_id", "index")
    return X.cited_articles(a, targets, 2)
