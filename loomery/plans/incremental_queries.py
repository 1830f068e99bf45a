"""Queries of incremental results, catalogue trees, sources with fallbacks, counters of runs and comparisons of orders."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loomery.operators import fallback as B
from loomery.operators import incremental as I
from loomery.operators import runs as R
from loomery.operators import tree as T
from loomery.operators.predicates import comparable_path
from loomery.plans.registry import register
from loomery.sources.checkpoints import shared_dir
from loomery.sources.results import Results
from loomery.sources.tables import table


@register("incremental_results", """
SELECT doc_id, md5(CASE WHEN doc_id % 7 = 0 THEN text || ' again' ELSE text END) AS value, CASE WHEN doc_id % 7 = 0 THEN 2 ELSE 1 END::BIGINT AS times
FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL""")
def incremental_results(spark, sf_dir):
    """A value of every document, computed in batches; then a run in which every seventh text has changed, a compaction, and a run without any
    change. `times` is how often a document was computed."""
    docs = table(spark, sf_dir, "documents").where("doc_id is not null and text is not null").select("doc_id", "text")
    store = Results(spark, f"{shared_dir(spark)}/results-{uuid.uuid4().hex}", "doc_id long", "value string, times long")
    later = docs.withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" again"))).otherwise(F.col("text")))

    def compute(todo):
        before = store.current().select(F.col("doc_id").alias("b_id"), F.col("times").alias("before"))
        return todo.join(before, F.col("doc_id") == F.col("b_id"), "left").select("doc_id", "hash", F.md5("text").alias("value"), (F.coalesce("before", F.lit(0)) + 1).cast("long").alias("times"))

    for rows in (docs, later):
        hashed = rows.withColumn("hash", F.sha1(F.encode("text", "UTF-8")))
        store.fill(hashed, compute, batch_rows=max(1, docs.count() // 3))
    store.compact()
    store.fill(hashed, compute)
    return store.current().select("doc_id", "value", "times")


@register("pooled_vectors", """
WITH d AS (SELECT doc_id, text, length(text) AS n, greatest(1, ceil((length(text) - 100) / 900.0))::INT AS k FROM documents WHERE trim(coalesce(text, ''), ' ') <> ''),
p AS (SELECT doc_id, substr(text, i * 900 + 1, 1000) AS t FROM (SELECT *, unnest(range(k)) AS i FROM d)),
v AS (SELECT doc_id, length(t)::DOUBLE AS a, (length(t) - length(replace(t, 'e', '')))::DOUBLE AS b, (length(t) - length(replace(t, ' ', '')))::DOUBLE AS c FROM p)
SELECT doc_id, [round(avg(a), 4), round(avg(b), 4), round(avg(c), 4)] AS vector FROM v GROUP BY doc_id""")
def pooled_vectors(spark, sf_dir):
    """Vectors of whole texts as means over overlapping pieces; the hook here counts characters."""
    docs = table(spark, sf_dir, "documents").where("doc_id is not null").select("doc_id", "text")
    store = Results(spark, f"{shared_dir(spark)}/vectors-{uuid.uuid4().hex}", "doc_id long", "vector array<double>")
    count = lambda c: (F.length("text") - F.length(F.replace("text", F.lit(c), F.lit("")))).cast("double")
    embed = lambda pieces: pieces.select("doc_id", "piece", F.array(F.length("text").cast("double"), count("e"), count(" ")).alias("vector"), F.lit(True).alias("ok"))
    I.embed_missing(docs, store, embed, "doc_id", 1000, 100)
    return store.current().select("doc_id", F.transform("vector", lambda x: F.round(x, 4)).alias("vector"))


@register("catalogue_rows", """
WITH e AS (SELECT CASE WHEN p_partkey % 11 = 0 THEN '' ELSE p_name END AS title, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_brand END AS level, p_partkey FROM part),
l AS (SELECT p_brand AS level, min(p_partkey) AS place FROM part WHERE p_brand NOT LIKE '%3' GROUP BY p_brand)
SELECT coalesce(e.level, '其他') AS "group", l.level IS NULL AS behind, l.place, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS title, p_partkey::VARCHAR AS document_id,
  row_number() OVER (PARTITION BY coalesce(e.level, '其他') ORDER BY lower(title), p_partkey) AS n FROM e LEFT JOIN l ON l.level = e.level WHERE title <> ''""".replace("\\\\", "\\"))
def catalogue_rows(spark, sf_dir):
    """Parts as a catalogue under brands in the order of their first part; some brands aren't configured, and some parts have none."""
    p = table(spark, sf_dir, "part")
    entries = p.select(F.when(F.col("p_partkey") % 11 == 0, "").otherwise(F.col("p_name")).alias("title"), F.col("p_type").alias("summary"), F.when(F.col("p_size") % 5 != 0, F.col("p_brand")).alias("level"), F.col("p_partkey").cast("string").alias("document_id"), F.col("p_partkey").alias("ordinal"))
    levels = p.where("p_brand not like '%3'").groupBy(F.col("p_brand").alias("level")).agg(F.min("p_partkey").alias("place"))
    tree = T.catalogue_tree(entries, levels)
    return tree.select("group", "behind", "place", F.posexplode("children").alias("i", "c")).select("group", "behind", "place", "c.title", "c.document_id", (F.col("i") + 1).cast("long").alias("n"))


@register("tree_lines", """
WITH g AS (SELECT DISTINCT CASE WHEN n_nationkey % 7 = 0 THEN n_name ELSE r_name END AS "group", n_nationkey % 7 = 0 AS behind, CASE WHEN n_nationkey % 7 <> 0 THEN 10 - r_regionkey END::INT AS place, s_name AS title
  FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey),
c AS (SELECT DISTINCT r_name AS "group", FALSE AS behind, (10 - r_regionkey)::INT AS place FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey % 7 <> 0),
h AS (SELECT "group", behind, place, max(title) AS last_title FROM (SELECT * FROM g UNION ALL SELECT "group", behind, place, NULL FROM c) GROUP BY ALL),
o AS (SELECT *, row_number() OVER (ORDER BY behind DESC, place DESC NULLS LAST, "group" DESC) = 1 AS is_last FROM h)
SELECT behind, place, "group", NULL AS title, CASE WHEN is_last THEN '└── ' ELSE '├── ' END || "group" AS line FROM o
UNION ALL SELECT g.behind, g.place, g."group", g.title, CASE WHEN is_last THEN '    ' ELSE '│   ' END || CASE WHEN g.title = last_title THEN '└── ' ELSE '├── ' END || g.title
FROM g JOIN o ON o."group" = g."group" AND o.behind = g.behind""")
def tree_lines(spark, sf_dir):
    """Suppliers as titles of nations as datasets, under regions as categories in reverse order; every seventh nation has no category."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    titles = table(spark, sf_dir, "supplier").join(n.select("n_nationkey", "n_name"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("dataset"), F.col("s_name").alias("title"))
    categories = n.where("n_nationkey % 7 <> 0").select(F.col("n_name").alias("dataset"), F.col("r_name").alias("category"), (10 - F.col("r_regionkey")).cast("int").alias("place"))
    return T.tree_lines(T.grouped_titles(titles, categories))


@register("first_existing_paths", """
WITH f AS (SELECT '/r' || (p_partkey % 2 + 1) || '/extract_uniq/' || CASE p_size % 4 WHEN 0 THEN 't' || p_size || '_extract.json' WHEN 1 THEN 'extract_t' || p_size || '.json' WHEN 2 THEN 't' || p_size || '/state.json' ELSE 'x' END AS path FROM part),
c AS (SELECT c_custkey, 't' || (c_custkey % 60) AS slug FROM customer),
n AS (SELECT c_custkey, nth, turn, '/r' || turn || '/extract_uniq/' || replace(pattern, '{s}', slug) AS path, '/r' || turn AS root FROM c, (VALUES (0, '{s}_extract.json'), (1, 'extract_{s}.json'), (2, '{s}_uniq_state.json'), (3, '{s}_unique.json'), (4, '{s}/extract_summary.json'), (5, '{s}/{s}_extract.json'), (6, '{s}/state.json')) AS v(nth, pattern), (VALUES (1), (2)) AS t(turn))
SELECT c_custkey, arg_min(path, nth * 10 + turn) AS path, arg_min(root, nth * 10 + turn) AS root FROM n WHERE path IN (SELECT path FROM f) GROUP BY c_custkey""")
def first_existing_paths(spark, sf_dir):
    """For each customer the first of seven names of its task's summary that is among the files, under the first of two roots."""
    size = F.col("p_size").cast("string")
    kind = F.col("p_size") % 4
    name = F.when(kind == 0, F.concat(F.lit("t"), size, F.lit("_extract.json"))).when(kind == 1, F.concat(F.lit("extract_t"), size, F.lit(".json"))).when(kind == 2, F.concat(F.lit("t"), size, F.lit("/state.json"))).otherwise("x")
    files = table(spark, sf_dir, "part").select(F.concat(F.lit("/r"), (F.col("p_partkey") % 2 + 1).cast("string"), F.lit("/extract_uniq/"), name).alias("path"))
    slug = F.concat(F.lit("t"), (F.col("c_custkey") % 60).cast("string"))
    tasks = table(spark, sf_dir, "customer").select("c_custkey", B.names(slug).alias("candidates"))
    return B.first_existing(tasks, "c_custkey", "candidates", files, ("/r1", "/r2"))


@register("corpus_with_fallback", """
SELECT doc_id, title, text, 'extracts' AS source FROM (
  SELECT 'd' || (o_orderkey % 997) AS doc_id, o_orderpriority AS title, o_orderkey % 500 AS k, row_number() OVER (PARTITION BY o_orderkey % 997 ORDER BY o_orderkey DESC) AS r FROM orders) LEFT JOIN (SELECT doc_id AS i, text FROM documents WHERE doc_id % 2 = 0) ON i = k WHERE r = 1""")
def corpus_with_fallback(spark, sf_dir):
    """An empty catalogue, so that the extracts count, of which the last row of an id does; every second text isn't there."""
    k = F.col("o_orderkey")
    extracts = table(spark, sf_dir, "orders").select(k.alias("ordinal"), F.concat(F.lit("d"), (k % 997).cast("string")).alias("doc_id"), F.col("o_orderpriority").alias("title"), (k % 500).cast("string").alias("text_path"))
    empty = extracts.select("ordinal", "doc_id", F.lit(None).cast("string").alias("id"), "title", "text_path").where("ordinal < 0")
    texts = table(spark, sf_dir, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").cast("string").alias("path"), "text")
    return B.corpus_documents(empty, extracts, texts)


@register("run_counters", """
SELECT count(*) AS pages_total, count(*) FILTER (page_id % 3 <> 0) AS pages_fetched, count(*) FILTER (page_id % 3 = 0) AS pages_from_cache, (SELECT count(*) FROM orders) AS entries_seen,
  (SELECT count(*) FROM lineitem) AS documents_seen, (SELECT count(*) FROM lineitem WHERE l_returnflag <> 'N' AND l_linenumber <> 1) AS files_downloaded, (SELECT count(*) FROM lineitem WHERE l_linenumber = 1) AS files_reused FROM pages""")
def run_counters(spark, sf_dir):
    """Counters of the one job that writes a crawl's rows: pages, orders as entries, line items as documents."""
    no = F.lit(None).cast("boolean")
    rows = table(spark, sf_dir, "pages").select(F.lit("page").alias("kind"), (F.col("page_id") % 3 == 0).alias("from_cache"), no.alias("downloaded"), no.alias("reused"))
    rows = rows.unionByName(table(spark, sf_dir, "orders").select(F.lit("entry").alias("kind"), no.alias("from_cache"), no.alias("downloaded"), no.alias("reused")))
    rows = rows.unionByName(table(spark, sf_dir, "lineitem").select(F.lit("document").alias("kind"), no.alias("from_cache"), (F.col("l_returnflag") != "N").alias("downloaded"), (F.col("l_linenumber") == 1).alias("reused")))
    path = f"{shared_dir(spark)}/crawl-{uuid.uuid4().hex}"
    found = R.observed(rows, R.crawl_counters(), lambda df: df.write.parquet(path))
    return spark.createDataFrame([found], ", ".join(f"{c} long" for c in R.crawl_counters()))


@register("order_displacements", """
WITH a AS (SELECT o_custkey AS k, min(o_orderkey) // 10 AS a, CASE WHEN o_custkey % 9 <> 0 THEN max(o_orderkey) // 10 END AS b FROM orders GROUP BY o_custkey)
SELECT count(*) FILTER (b IS NOT NULL) AS n, count(*) FILTER (a = b) AS same, sum(abs(a - b))::BIGINT AS total, max(abs(a - b))::BIGINT AS most, count(*) FILTER (b IS NULL) AS only_a, 0::BIGINT AS only_b FROM a""")
def order_displacements(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.floor(F.min("o_orderkey") / 10).alias("place_a"), F.floor(F.max("o_orderkey") / 10).alias("b"))
    return R.displacements(o.withColumn("place_b", F.when(F.col("o_custkey") % 9 != 0, F.col("b"))))


@register("compared_choices", """
WITH c AS (SELECT l_orderkey AS k, l_linenumber AS i, l_partkey % 3 AS p, l_suppkey::VARCHAR AS path FROM lineitem WHERE l_orderkey % 13 <> 0),
g AS (SELECT k, (min({'i': i, 'path': path})).path AS first, (min({'p': -p, 'i': i, 'path': path})).path AS best FROM c GROUP BY k),
s AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 10 <> 0 THEN m.path END AS selected FROM orders LEFT JOIN (SELECT l_orderkey, (max({'q': l_quantity, 'l': l_linenumber, 'path': l_suppkey::VARCHAR})).path AS path FROM lineitem GROUP BY l_orderkey) m ON l_orderkey = o_orderkey),
j AS (SELECT s.*, first, best FROM s LEFT JOIN g USING (k))
SELECT count(*) FILTER (selected IS NOT NULL AND first IS NOT NULL) AS total, count(*) FILTER (selected = first) AS as_first, count(*) FILTER (selected = best) AS as_best, count(*) FILTER (selected <> first) AS differing,
  count(*) FILTER (selected IS NULL) AS not_selected, count(*) FILTER (selected IS NOT NULL AND first IS NULL) AS no_candidates FROM j""")
def compared_choices(spark, sf_dir):
    """Orders whose chosen document is the line of the greatest quantity, against the first line and the one of the highest priority."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    path = lambda c: comparable_path(F.concat(F.lit("/any/downloads/"), F.col(c).cast("string")))
    made = l.where("l_orderkey % 13 <> 0").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_list(F.struct(path("l_suppkey").alias("path"), F.col("l_linenumber").alias("place"), (F.col("l_partkey") % 3).alias("priority"))).alias("candidates"))  # an order's lines
    chosen = l.groupBy(F.col("l_orderkey").alias("c")).agg(F.max(F.struct("l_quantity", "l_linenumber", path("l_suppkey").alias("path")))["path"].alias("s"))
    o = table(spark, sf_dir, "orders").select("o_orderkey").join(made, F.col("o_orderkey") == F.col("k"), "left").join(chosen, F.col("o_orderkey") == F.col("c"), "left")
    return R.compared_choices(o.select(F.when(F.col("o_orderkey") % 10 != 0, F.col("s")).alias("selected"), "candidates"))
