"""Queries of the searches. The test tables hold Latin text, so that terms are Latin here."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomery.functions import text as X
from loomery.operators import search as S
from loomery.plans.registry import register
from loomery.sources.tables import table

TERMS = ["thing", "reour", "the", "thing"]

_BM25 = r"""
w AS (SELECT doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[A-Za-z0-9]+|[\x{4e00}-\x{9fff}]') AS words FROM documents),
r AS (SELECT id, len(words) AS dl, len(list_filter(words, lambda x: x = 'reour')) AS t0, len(list_filter(words, lambda x: x = 'the')) AS t1, len(list_filter(words, lambda x: x = 'thing')) AS t2 FROM w),
s AS (SELECT count(*) AS n, avg(dl) AS a, sum((t0 > 0)::INT) AS d0, sum((t1 > 0)::INT) AS d1, sum((t2 > 0)::INT) AS d2 FROM r),
bm AS (SELECT id,
    1 * ln(1 + (n - d0 + 0.5) / (d0 + 0.5)) * t0 * 2.5 / (t0 + 1.5 * (0.25 + 0.75 * dl / a))
  + 1 * ln(1 + (n - d1 + 0.5) / (d1 + 0.5)) * t1 * 2.5 / (t1 + 1.5 * (0.25 + 0.75 * dl / a))
  + 2 * ln(1 + (n - d2 + 0.5) / (d2 + 0.5)) * t2 * 2.5 / (t2 + 1.5 * (0.25 + 0.75 * dl / a)) AS score
  FROM r, s)"""

_VEC = """
q AS (SELECT list_transform(embedding, lambda x: x::DOUBLE) AS q FROM embeddings WHERE vec_id = 0),
ve AS (SELECT vec_id AS id, list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), q) AS score FROM embeddings, q)"""


def _query_vector(spark, sf_dir) -> list[float]:
    return table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()[0]


@register("text_search", r"""
WITH h AS (SELECT doc_id, text, lower(text) AS low FROM documents WHERE contains(lower(coalesce(text, '')), 'thing'))
SELECT doc_id, ((length(low) - length(replace(low, 'thing', ''))) / 5)::BIGINT AS score,
  substr(text, greatest(instr(low, 'thing') - 60, 1), instr(low, 'thing') + 120 - greatest(instr(low, 'thing') - 60, 1)) AS snippet
FROM h ORDER BY score DESC, doc_id LIMIT 20""")
def text_search(spark, sf_dir):
    return S.text_search(table(spark, sf_dir, "documents"), "thing")


@register("keyword_search", r"""
WITH d AS (SELECT doc_id, trim(regexp_replace(split_part(text, chr(10), 1), '\s+', ' ', 'g')) AS title, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS body FROM documents),
h AS (SELECT doc_id, title, contains(title, 'the reour')::INT AS title_exact, contains(title, 'the')::INT + contains(title, 'reour')::INT AS title_hits, contains(body, 'the')::INT + contains(body, 'reour')::INT AS c FROM d)
SELECT doc_id, title, title_exact, title_hits, CASE WHEN title_exact > 0 OR title_hits > 0 THEN title_hits ELSE c END AS content_hits FROM h
WHERE title_exact > 0 OR title_hits > 0 OR c > 0""")
def keyword_search(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    flat = lambda c: F.btrim(F.regexp_replace(c, "\\s+", " "))
    entries = docs.select("doc_id", flat(F.split_part("text", F.lit("\n"), F.lit(1))).alias("norm_title"), flat(F.coalesce("text", F.lit(""))).alias("norm_text"))
    return S.keyword_search(entries, "the reour")


@register("fuzzy_search", r"""
WITH p AS (SELECT p_partkey, p_name, regexp_extract_all(p_name, '[a-zA-Z0-9]+') AS tokens FROM part),
j AS (SELECT p_partkey, p_name, len(list_intersect(tokens, ['part', '17', 'STEEL'])) AS i, len(list_distinct(tokens)) AS n FROM p)
SELECT p_partkey, p_name, round(CASE WHEN n = 0 THEN 0 ELSE 40.0 * i / (n + 3 - i) END, 6) AS score FROM j ORDER BY 40.0 * i / greatest(n + 3 - i, 1) DESC, p_partkey LIMIT 10""")
def fuzzy_search(spark, sf_dir):
    empty = F.lit(None).cast("string")
    part = table(spark, sf_dir, "part")
    entries = part.select("p_partkey", "p_name", F.col("p_name").alias("title"), F.col("p_name").alias("norm_title"), X.tokenize(F.col("p_name")).alias("tokens"), *[empty.alias(c) for c in ("doc_no", "year", "doctype", "agency", "best_path")])
    return S.fuzzy_search(entries, "part 17 STEEL", 10, "p_partkey").select("p_partkey", "p_name", F.round("score", 6).alias("score"))


#: Queries whose features differ: number, part of a number, years, types, agencies, phrases, tokens.
POLICY_QUERIES = ["中国人民银行公告[2017]第17号 关于 STEEL 的管理办法", "国务院 公告[2012] 支付清算 通知 1998", "国家外汇管理局 BRASS 细则 part 7", "银发[07]3号", "part 17 STEEL"]

_AGENCY_SQL = "['" + "', '".join(X.AGENCIES) + "']"
_TYPE_SQL = "['" + "', '".join(X.DOCTYPES) + "']"
_STOP_SQL = "['" + "', '".join(X.STOPWORDS) + "']"


def _features_sql(source: str, plain: str) -> str:
    """Columns that entries and queries have alike."""
    return f"""
  SELECT *, CASE WHEN n.h <> '' THEN n.h || '[' || CASE WHEN length(n.y) = 2 THEN '20' || n.y ELSE n.y END || ']' || replace(n.t, ' ', '') END AS doc_no,
    regexp_extract_all({plain}, '(19|20)[0-9]{{2}}', 1) AS years, list_filter({_TYPE_SQL}, lambda k: contains({plain}, k))[1] AS doctype,
    nullif(array_to_string(list_filter({_AGENCY_SQL}, lambda k: contains({plain}, k))[1:3], '、'), '') AS agency,
    regexp_extract_all({plain}, '[一-鿿]{{2,}}') AS phrases,
    list_filter(regexp_extract_all({plain}, '[一-鿿]+|[a-zA-Z0-9]+'), lambda t: NOT list_contains({_STOP_SQL}, t)) AS tokens
  FROM (SELECT *, regexp_extract({plain}, '{X.DOCNO}', ['h', 'y', 't'], 'i') AS n FROM {source})"""


@register("policy_search_points", f"""
WITH e AS ({_features_sql("""(SELECT p_partkey, title, translate(title, '〔〕', '[]') AS norm_title, best_path FROM (SELECT p_partkey,
    CASE p_size % 5 WHEN 0 THEN '中国人民银行公告〔20' || lpad((p_partkey % 30)::VARCHAR, 2, '0') || '〕第' || p_size || '号 关于 ' || p_type WHEN 1 THEN '国务院关于支付清算的管理办法 19' || lpad((p_partkey % 100)::VARCHAR, 2, '0')
      WHEN 2 THEN '银发〔0' || p_size % 10 || '〕' || p_size || '号 细则' WHEN 3 THEN p_name || ' ' || p_type ELSE '国家外汇管理局、国务院 支付 通知 ' || p_name END AS title,
    CASE p_size % 3 WHEN 0 THEN 'a/' || p_partkey || '.PDF' WHEN 1 THEN 'a.html' END AS best_path FROM part))""", "norm_title")}),
q AS ({_features_sql("(SELECT unnest(range(" + str(len(POLICY_QUERIES)) + "))::INT AS query_id, unnest(['" + "', '".join(POLICY_QUERIES) + "']) AS plain)", "plain")}),
b AS (SELECT q.query_id, e.p_partkey,
  CASE WHEN e.doc_no = q.doc_no THEN 120.0 ELSE 0 END AS points_doc_no,
  CASE WHEN e.doc_no <> q.doc_no AND contains(translate(e.doc_no, '[]', ''), translate(q.doc_no, '[]', '')) THEN 80.0 ELSE 0 END AS points_doc_no_part,
  CASE WHEN list_contains(q.years, e.years[1]) THEN 30.0 ELSE 0 END AS points_year,
  CASE WHEN len(q.years) > 0 AND len(e.years) > 0 AND NOT list_contains(q.years, e.years[1]) THEN -5.0 ELSE 0 END AS points_other_year,
  CASE WHEN e.doctype = q.doctype THEN 15.0 ELSE 0 END AS points_doctype,
  CASE WHEN contains(e.agency, q.agency) OR contains(q.agency, e.agency) THEN 10.0 ELSE 0 END AS points_agency,
  coalesce(list_sum(list_transform(list_filter(q.phrases, lambda p: contains(e.norm_title, p)), lambda p: least(8.0::DOUBLE, 2 + 0.8::DOUBLE * length(p)))), 0)::DOUBLE AS points_phrases,
  CASE WHEN len(e.tokens) = 0 OR len(q.tokens) = 0 THEN 0 ELSE 40.0::DOUBLE * len(list_intersect(e.tokens, q.tokens)) / len(list_distinct(list_concat(e.tokens, q.tokens))) END AS points_tokens,
  CASE WHEN contains(q.plain, e.doc_no) THEN 30.0 ELSE 0 END AS points_doc_no_inside,
  CASE WHEN contains(q.plain, e.doctype) AND contains(e.title, e.doctype) THEN 10.0 ELSE 0 END AS points_doctype_inside,
  CASE WHEN lower(e.best_path) LIKE '%.pdf' THEN 3.0 ELSE 0 END AS points_pdf FROM e, q),
s AS (SELECT *, points_doc_no::DOUBLE + points_doc_no_part + points_year + points_other_year + points_doctype + points_agency + points_phrases + points_tokens + points_doc_no_inside + points_doctype_inside + points_pdf AS score FROM b)
SELECT query_id, p_partkey, row_number() OVER w::INT AS place, round(points_doc_no, 6)::DOUBLE AS points_doc_no, points_doc_no_part::DOUBLE AS points_doc_no_part, points_year::DOUBLE AS points_year, points_other_year::DOUBLE AS points_other_year,
  points_doctype::DOUBLE AS points_doctype, points_agency::DOUBLE AS points_agency, round(points_phrases, 6) AS points_phrases, round(points_tokens, 6) AS points_tokens, points_doc_no_inside::DOUBLE AS points_doc_no_inside,
  points_doctype_inside::DOUBLE AS points_doctype_inside, points_pdf::DOUBLE AS points_pdf, round(score, 6) AS score
FROM s WINDOW w AS (PARTITION BY query_id ORDER BY s.score DESC, p_partkey) QUALIFY row_number() OVER w <= 25""")
def policy_search_points(spark, sf_dir):
    """The 25 best entries of each query with their points by feature; titles are made from parts."""
    n, size = F.col("p_partkey"), F.col("p_size")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    title = (
        F.when(size % 5 == 0, F.concat(F.lit("中国人民银行公告〔20"), two(n % 30), F.lit("〕第"), size, F.lit("号 关于 "), "p_type"))
        .when(size % 5 == 1, F.concat(F.lit("国务院关于支付清算的管理办法 19"), two(n % 100)))
        .when(size % 5 == 2, F.concat(F.lit("银发〔0"), size % 10, F.lit("〕"), size, F.lit("号 细则")))
        .when(size % 5 == 3, F.concat_ws(" ", "p_name", "p_type"))
        .otherwise(F.concat(F.lit("国家外汇管理局、国务院 支付 通知 "), "p_name"))
    )
    path = F.when(size % 3 == 0, F.concat(F.lit("a/"), n, F.lit(".PDF"))).when(size % 3 == 1, "a.html")
    rows = table(spark, sf_dir, "part").select("p_partkey", title.alias("title"), path.alias("best_path")).withColumn("norm_title", X.norm_text("title"))
    norm = F.col("norm_title")
    entries = rows.withColumns({"tokens": X.tokenize(norm), "doc_no": X.extract_docno(norm), "year": X.year_prefix(norm), "doctype": X.first_keyword(norm), "agency": X.keyword_list(norm)})
    found = S.fuzzy_search_all(entries, POLICY_QUERIES, 25, "p_partkey")
    points = [c for c in found.columns if c.startswith("points_")]
    return found.select("query_id", "p_partkey", "place", *[F.round(c, 6).alias(c) for c in [*points, "score"]])


@register("bm25_build", r"""
WITH w AS (SELECT doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[A-Za-z0-9]+|[\x{4e00}-\x{9fff}]') AS words FROM documents)
SELECT id, term, count(*)::BIGINT AS tf, any_value(dl)::BIGINT AS dl FROM (SELECT id, len(words) AS dl, unnest(words) AS term FROM w) GROUP BY id, term""")
def bm25_build(spark, sf_dir):
    return S.postings(table(spark, sf_dir, "documents"))


@register("bm25_search", f"WITH {_BM25} SELECT id, round(score, 6) AS score FROM bm WHERE score > 0")
def bm25_search(spark, sf_dir):
    return S.bm25(table(spark, sf_dir, "documents"), TERMS).select("id", F.round("score", 6).alias("score"))


@register("vector_topk", f"WITH {_VEC} SELECT id, round(score, 5) AS score FROM ve WHERE score > 0 ORDER BY ve.score DESC, id LIMIT 40")
def vector_topk(spark, sf_dir):
    out = S.top(S.vector_scores(table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir)), 40)
    return out.select("id", F.round("score", 5).alias("score"))


_FUSED = f"""WITH {_BM25}, {_VEC},
c AS (SELECT id, 2.0 * score AS score, 'bm25' AS channel FROM (SELECT * FROM bm WHERE score > 0 ORDER BY score DESC, id LIMIT 40)
  UNION ALL SELECT id, score, 'vector' FROM (SELECT * FROM ve WHERE score > 0 ORDER BY score DESC, id LIMIT 40)),
f AS (SELECT id, sum(score) AS score, string_agg(DISTINCT channel, '+' ORDER BY channel) AS match_type FROM c GROUP BY id)"""


def _fused(spark, sf_dir, k):
    docs, vectors = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    words = S.top(S.bm25(docs, TERMS), 40)
    near = S.top(S.vector_scores(vectors, _query_vector(spark, sf_dir)), 40)
    return S.hybrid([("bm25", 2.0, words), ("vector", 1.0, near)], k)


@register("hybrid_fusion", f"{_FUSED} SELECT id, round(score, 5) AS score, match_type FROM f ORDER BY f.score DESC, id LIMIT 20")
def hybrid_fusion(spark, sf_dir):
    return _fused(spark, sf_dir, 20).select("id", F.round("score", 5).alias("score"), "match_type")


@register("hybrid_law_level", f"""{_FUSED}, l AS (SELECT source, max(score) AS score, count(*)::BIGINT AS n FROM f JOIN documents ON doc_id = id GROUP BY source)
SELECT source, round(score, 5) AS score, n FROM l ORDER BY l.score DESC, source LIMIT 20""")
def hybrid_law_level(spark, sf_dir):
    """Hits rolled up to what they belong to."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source")
    out = _fused(spark, sf_dir, 80).join(docs, "id").groupBy("source").agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("n"))
    return out.orderBy(F.desc("score"), "source").limit(20).select("source", F.round("score", 5).alias("score"), "n")


@register("hybrid_post_filter", f"""{_FUSED} SELECT id, round(score, 5) AS score, match_type FROM (SELECT * FROM f ORDER BY score DESC, id LIMIT 20)
SEMI JOIN (SELECT doc_id AS id FROM documents WHERE lang = 'en') USING (id)""")
def hybrid_post_filter(spark, sf_dir):
    """A filter above the limit: it may leave fewer rows than asked for."""
    keep = table(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("doc_id").alias("id"))
    return _fused(spark, sf_dir, 20).join(keep, "id", "left_semi").select("id", F.round("score", 5).alias("score"), "match_type")


def _rounded(x, places: int):
    """A double rounded as a double, as SQL engines do: halves go away from zero, and what is rounded to zero keeps its sign."""
    scaled = F.abs(x) * 10.0**places
    whole = F.floor(scaled)
    near = (whole + (scaled - whole >= 0.5).cast("int")).cast("double")
    return F.when((scaled < 2.0**52), F.signum(x) * near / 10.0**places).otherwise(x)


@register("mean_pool", """
SELECT label, list(v ORDER BY i) AS pooled FROM (
  SELECT label, i, round(avg(x::DOUBLE), 5) AS v FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i
) GROUP BY label""")
def mean_pool(spark, sf_dir):
    at = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(_rounded(F.avg(F.col("x").cast("double")), 5).alias("v"))
    return at.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("p")).select("label", F.transform("p", lambda z: z["v"]).alias("pooled"))
