"""Queries of lexical and vector search and of fusing and expanding ranked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import fusion, lexical, search, vector_index
from ..sources.files import scratch
from .registry import example, inline, query, table

TERMS_SQL = """
terms AS (
  SELECT item_id AS query_id, list_filter(t, lambda x, i: list_position(list_transform(t, lambda y: lower(y)), lower(x)) = i)[1:6] AS terms
  FROM (SELECT item_id, regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_.]+') AS t FROM benchmark)
)"""


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), search.query_terms(F.col("text")).alias("terms"))


def _bm25_sql(cap: str) -> str:
    return f"""
WITH {TERMS_SQL}, used AS (
  SELECT DISTINCT query_id, unnest(terms) AS term FROM terms
), s AS (
  SELECT count(*) AS n, avg(length(text)) AS avgdl FROM documents
), hits AS (
  SELECT v.term, d.doc_id, length(d.text) AS dl, (length(d.text) - length(replace(d.text, v.term, ''))) // length(v.term) AS tf
  FROM (SELECT DISTINCT term FROM used) v JOIN documents d ON contains(d.text, v.term)
), f AS (
  SELECT term, {cap} AS df FROM hits GROUP BY term
), part AS (
  SELECT h.term, h.doc_id, ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl)) AS p FROM hits h JOIN f USING (term), s
), total AS (
  SELECT query_id, doc_id, round(sum(p), 9) AS raw FROM used JOIN part USING (term) GROUP BY ALL
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, doc_id) AS rank, max(raw) OVER (PARTITION BY query_id) AS best FROM total
)
SELECT query_id, doc_id, round(CASE WHEN best > 0 THEN raw / best ELSE raw END, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10
"""


@query(_bm25_sql("count(*)"))
def bm25_topk(spark, sf_dir):
    return search.bm25(table(spark, sf_dir, "documents").select("doc_id", "text"), _queries(spark, sf_dir), 10)


@query(_bm25_sql("least(count(*), 30)"))
def bm25_topk_capped(spark, sf_dir):
    return search.bm25(table(spark, sf_dir, "documents").select("doc_id", "text"), _queries(spark, sf_dir), 10, df_cap=30)


@query(_bm25_sql("count(*)"))
def bm25_index_topk(spark, sf_dir):
    """The same search in a stored index of all documents, which is built first."""
    index = lexical.build(table(spark, sf_dir, "documents").select("doc_id", "text"), scratch(spark, "lexical"))
    return lexical.bm25(index, _queries(spark, sf_dir), 10)


@query(f"WITH {TERMS_SQL} SELECT query_id, array_to_string(terms, ' ') AS terms FROM terms")
def query_terms(spark, sf_dir):
    return _queries(spark, sf_dir).select("query_id", F.array_join("terms", " ").alias("terms"))


QUESTIONS = "(1, '请问什么是进程的死锁？'), (2, '二叉搜索树的插入操作与 AVL 旋转'), (3, 'TCP 三次握手 tcp 如何建立连接'), (4, '栈'), (5, '介绍一下操作系统内存管理方法'), (6, NULL), (7, '')"


@example(f"""
WITH q(query_id, text) AS (VALUES {QUESTIONS}),
c AS (SELECT query_id, regexp_replace(regexp_replace(trim(text), '\\s+', ' ', 'g'), '{"|".join(sorted((w for w in search.STOP_WORDS if len(w) > 1 or w in search.SEPARATORS), key=lambda w: (-len(w), w)))}', ' ', 'g') AS text FROM q),
p AS (SELECT query_id, regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_.]+|[\\x{{4e00}}-\\x{{9fff}}]{{2,}}') AS parts FROM c),
t AS (SELECT query_id, flatten(list_transform(parts, lambda x: CASE WHEN regexp_matches(x, '^[\\x{{4e00}}-\\x{{9fff}}]') AND length(x) > 4 THEN list_transform(range(1, length(x)), lambda i: substring(x, i, 2)) ELSE [x] END)) AS t FROM p)
SELECT query_id, array_to_string(list_filter(t, lambda x, i: list_position(list_transform(t, lambda y: lower(y)), lower(x)) = i)[1:6], ' ') AS terms FROM t
""")
def query_terms_cjk(spark, sf_dir):
    return inline(spark, QUESTIONS, "query_id, text").select("query_id", F.array_join(search.query_terms(F.col("text")), " ").alias("terms"))


@query("""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (
  SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.e, v.e), 6) AS similarity FROM v q, v WHERE q.vec_id % 100 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM s)
SELECT query_id, vec_id, similarity, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5
""")
def vector_topk(spark, sf_dir):
    """Every hundredth vector as a query, so the batch grows with the table."""
    v = table(spark, sf_dir, "embeddings")
    return search.vector_top_k(v.select("vec_id", "embedding"), v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 5).select("query_id", "vec_id", "similarity", "rank")


@query()
def vector_index_topk(spark, sf_dir):
    """The queries of ``vector_topk`` in a stored index of all vectors; its recall is measured in the tests."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = vector_index.train(v)
    queries = v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    if model is None:
        return search.vector_top_k(v.filter("false"), queries.filter("false"), 5).select("query_id", "vec_id", "similarity", "rank")
    return vector_index.search(vector_index.build(v, model, scratch(spark, "vectors")), model, queries, 5)


@query("""
WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (
  SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.e, v.e), 6) AS similarity FROM v q JOIN v USING (label) WHERE q.vec_id % 100 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM s)
SELECT query_id, vec_id, similarity, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3
""")
def vector_topk_filtered(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return search.vector_top_k(v.select("vec_id", "label", "embedding"), v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label", "embedding"), 3, same="label").select("query_id", "vec_id", "similarity", "rank")


@query("""
WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e, vec_id * 7 % 3600 AS stored_at, 1800 + vec_id // 100 * 11 % 1800 AS asked_at FROM embeddings), s AS (
  SELECT p.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(p.e, v.e), 6) AS similarity
  FROM v p JOIN v ON p.label = v.label AND v.stored_at <= p.asked_at AND p.asked_at - v.stored_at <= 1800 WHERE p.vec_id % 100 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM s)
SELECT query_id, vec_id, similarity, similarity >= 0.88 AS hit FROM r WHERE rank = 1
""")
def semantic_cache_lookup(spark, sf_dir):
    """All vectors as entries; times repeat over the ids, so live entries come from the whole table."""
    v = table(spark, sf_dir, "embeddings").withColumnRenamed("label", "collection")
    entries = v.select("vec_id", "collection", "embedding", (F.col("vec_id") * 7 % 3600).alias("stored_at"))
    probes = v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "collection", "embedding", (F.expr("vec_id div 100") * 11 % 1800 + 1800).alias("asked_at"))
    return search.semantic_cache_lookup(entries, probes)


#: Four routes over the documents as ranked lists: query = lang, key = first doc_id of equal texts.
ROUTES_SQL = """
routes AS (
  SELECT lang AS query_id, 'semantic' AS route, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents
  UNION ALL SELECT lang, 'keyword_bm25', doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars % 97, doc_id) FROM documents
  UNION ALL SELECT lang, 'expanded', doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id DESC) FROM documents
  UNION ALL SELECT lang, 'section_meta', doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars % 31, doc_id) FROM documents
), top AS (SELECT * FROM routes WHERE rank <= 12)"""


def _routes(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("query_id"), "doc_id", "n_chars")
    orders = {"semantic": [F.desc("n_chars"), F.asc("doc_id")], "keyword_bm25": [F.col("n_chars") % 97, F.asc("doc_id")], "expanded": [F.desc("doc_id")], "section_meta": [F.col("n_chars") % 31, F.asc("doc_id")]}
    out = None
    for route, order in orders.items():
        one = search.top_k(d, ["query_id"], order, 12).select("query_id", F.lit(route).alias("route"), F.col("doc_id").alias("key"), "rank")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""
WITH {ROUTES_SQL}, m AS (
  SELECT query_id, doc_id AS key, round(sum(CASE route WHEN 'semantic' THEN 1.5 WHEN 'keyword_bm25' THEN 1.0 WHEN 'expanded' THEN 0.6 ELSE 1.2 END / (20 + rank)), 6) AS score,
    string_agg(route, ', ' ORDER BY route) AS routes, count(*) AS n_routes FROM top GROUP BY ALL
)
SELECT query_id, key, score, routes, n_routes, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank FROM m
""")
def rrf_fusion(spark, sf_dir):
    rows = _routes(spark, sf_dir)
    return fusion.rrf(rows.withColumn("weight", fusion.route_weight(F.col("route"))))


@query(f"""
WITH {ROUTES_SQL}, l AS (
  SELECT query_id, CASE WHEN route = 'semantic' THEN 'original' ELSE route END AS label, doc_id AS key, rank,
    CASE route WHEN 'semantic' THEN 2.0 WHEN 'keyword_bm25' THEN 1.0 WHEN 'expanded' THEN 0.8 ELSE 1.2 END AS w FROM top
), k AS (
  SELECT query_id, greatest(10, least(60, CAST(floor(20 * sqrt(greatest(1, count(*) // count(DISTINCT label))) / 2) AS BIGINT))) AS k FROM l GROUP BY query_id
)
SELECT query_id, key, round(sum(CASE WHEN label = 'original' THEN 1.5 ELSE 1.0 END * w / (k + rank)), 6) AS score, string_agg(label, ', ' ORDER BY label) AS labels
FROM l JOIN k USING (query_id) GROUP BY query_id, key
""")
def rrf_weighted_decomposed(spark, sf_dir):
    rows = _routes(spark, sf_dir)
    flags = {"concept": F.lit(True)}
    rows = rows.withColumn("route_weight", fusion.route_weight(F.col("route"), flags)).withColumn("label", F.when(F.col("route") == "semantic", "original").otherwise(F.col("route")))
    return fusion.weighted_rrf(rows)


@query("""
WITH r AS (SELECT lang AS query_id, source AS section, doc_id AS key, n_chars AS score, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) AS n FROM documents)
SELECT query_id, section, key, score FROM r WHERE n <= 3 OR coalesce(section, '') = ''
""")
def section_topn(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("query_id"), F.col("source").alias("section"), F.col("doc_id").alias("key"), F.col("n_chars").alias("score"))
    return fusion.section_top_n(d, 3)


@query("""
WITH b AS (SELECT lang AS query_id, doc_id, (n_chars % 100) / 100.0 AS rerank_score, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars % 100 DESC, doc_id) AS rank, source FROM documents),
q AS (SELECT query_id || ':' || source AS query_id, doc_id, rerank_score, rank FROM b WHERE rank <= 8),
m AS (SELECT *, greatest(CASE WHEN max_by(rerank_score, -rank) OVER (PARTITION BY query_id) > 0 THEN max_by(rerank_score, -rank) OVER (PARTITION BY query_id) * 0.3 ELSE 0 END, 0.15) AS least_score FROM q),
c AS (SELECT *, count(*) FILTER (WHERE rerank_score >= least_score) OVER (PARTITION BY query_id) AS n FROM m)
SELECT query_id, doc_id, CAST(rerank_score AS DOUBLE) AS rerank_score, CAST(rank AS INTEGER) AS rank FROM c WHERE CASE WHEN n >= 2 THEN rerank_score >= least_score ELSE rank <= 2 END
""")
def rerank_threshold(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("s", F.col("n_chars") % 100)
    d = search.top_k(d, ["lang", "source"], [F.desc("s"), F.asc("doc_id")], 8)
    rows = d.select(F.concat_ws(":", "lang", "source").alias("query_id"), "doc_id", (F.col("s") / 100.0).alias("rerank_score"), "rank")
    return search.rerank_threshold(rows)


CHUNKS_SQL = """
chunks AS (SELECT doc_id, source AS section, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS chunk_index, CAST(floor(length(text) * 0.25) AS BIGINT) AS tokens, text, lang FROM documents),
hits AS (SELECT lang AS query_id, section, chunk_index, row_number() OVER (PARTITION BY lang ORDER BY tokens % 53, doc_id) AS rank FROM chunks)"""


def _chunks(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    w = Window.partitionBy("source").orderBy("doc_id")
    return d.select("doc_id", F.col("source").alias("section"), (F.row_number().over(w) - 1).cast("long").alias("chunk_index"), F.floor(F.length("text") * 0.25).cast("long").alias("tokens"), "text", "lang")


def _hits(chunks):
    w = Window.partitionBy("lang").orderBy(F.col("tokens") % 53, "doc_id")
    return chunks.select(F.col("lang").alias("query_id"), "section", "chunk_index", F.row_number().over(w).alias("rank")).filter("rank <= 10")


@query(f"""
WITH {CHUNKS_SQL}, f AS (
  SELECT query_id, section, min_by(chunk_index, rank) AS anchor FROM hits WHERE rank <= 10 GROUP BY ALL
), n AS (
  SELECT f.query_id, f.section, c.chunk_index, f.anchor, c.tokens, c.chunk_index - f.anchor AS distance FROM f JOIN chunks c ON f.section = c.section AND c.chunk_index BETWEEN f.anchor - 2 AND f.anchor + 2
), t AS (
  SELECT *, sum(tokens) OVER (PARTITION BY query_id, section ORDER BY CASE WHEN distance = 0 THEN 0 WHEN distance > 0 THEN 1 ELSE 2 END, abs(distance) ROWS UNBOUNDED PRECEDING) AS total FROM n
)
SELECT query_id, section, chunk_index, anchor, tokens, distance FROM t WHERE total <= 3000 OR distance = 0
""")
def window_expand(spark, sf_dir):
    chunks = _chunks(spark, sf_dir)
    return fusion.window_expand(_hits(chunks), chunks.select("section", "chunk_index", "tokens"), 2, 3000)


#: Parents are this many consecutive chunks of a source.
PARENT_CHUNKS = 3


@query(f"""
WITH {CHUNKS_SQL}, p AS (SELECT section || ':' || (chunk_index // {PARENT_CHUNKS}) AS parent_id, string_agg(text, '' ORDER BY chunk_index) AS text FROM chunks GROUP BY 1),
h AS (SELECT query_id, h.section || ':' || (h.chunk_index // {PARENT_CHUNKS}) AS parent_id, h.chunk_index, rank, length(c.text) AS n_chars FROM hits h JOIN chunks c ON h.section = c.section AND h.chunk_index = c.chunk_index WHERE rank <= 10),
f AS (SELECT query_id, parent_id, rank, n_chars, row_number() OVER (PARTITION BY query_id, parent_id ORDER BY rank) AS n FROM h),
l AS (SELECT query_id, f.parent_id, rank, CAST(floor(length(p.text) * 0.25) AS BIGINT) AS tokens FROM f JOIN p USING (parent_id) WHERE n = 1 AND length(p.text) > n_chars + 40),
u AS (SELECT *, CAST(sum(tokens) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM l)
SELECT query_id, parent_id, CAST(rank AS INTEGER) AS rank, tokens, used FROM u WHERE used <= 12000
""")
def parent_window(spark, sf_dir):
    """Every source is cut into consecutive parents, and a hit takes the one that holds it."""
    chunks = _chunks(spark, sf_dir).withColumn("parent_id", F.concat_ws(":", "section", F.expr(f"chunk_index div {PARENT_CHUNKS}")))
    hits = _hits(chunks).join(chunks.select("section", "chunk_index", "parent_id", F.length("text").alias("n_chars")), ["section", "chunk_index"]).select("query_id", "rank", "parent_id", "n_chars")
    wanted = chunks.join(hits.select("parent_id").distinct(), "parent_id", "left_semi")
    parents = wanted.groupBy("parent_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))).alias("c")).select("parent_id", F.expr("array_join(transform(c, x -> x.text), '')").alias("text"))
    return fusion.parent_window(hits, parents)


@query(f"""
WITH {TERMS_SQL}, w AS (
  SELECT t.query_id, d.doc_id, list_distinct(list_transform(list_filter(t.terms, lambda x: length(x) >= 2), lambda x: lower(x))) AS l, lower(d.text) AS text, d.doc_id % 2 = 0 AS expanded, t.query_id % 5 = 0 AS is_comparison
  FROM terms t JOIN documents d ON d.doc_id % 40 = t.query_id
), c AS (SELECT *, len(list_filter(l, lambda x: contains(text, x))) / CASE WHEN len(l) > 0 THEN CAST(len(l) AS DOUBLE) END AS cover FROM w)
SELECT query_id, doc_id, CASE WHEN expanded AND NOT is_comparison THEN round(cover, 3) END AS coverage, coalesce(expanded AND NOT is_comparison AND cover < 0.15, false) AS downgraded,
  CAST(CASE WHEN expanded AND NOT is_comparison AND cover < 0.15 THEN 0.5 ELSE 1.0 END AS DOUBLE) AS factor FROM c
""")
def noise_downgrade(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", (F.col("doc_id") % 40).alias("query_id"))
    rows = _queries(spark, sf_dir).join(d, "query_id").withColumn("expanded", F.col("doc_id") % 2 == 0).withColumn("is_comparison", F.col("query_id") % 5 == 0)
    return fusion.noise_downgrade(rows).select("query_id", "doc_id", "coverage", "downgraded", "factor")


EVIDENCE_SQL = """
e AS (
  SELECT lang AS query_id, doc_id AS evidence_id, md5(trim(text)) AS key, source,
    CASE WHEN doc_id % 3 = 0 THEN (n_chars % 100) / 100.0 END AS rerank_score, CASE WHEN doc_id % 3 = 1 THEN (n_chars % 50) / 1000.0 END AS recall_score, (n_chars % 10) / 10.0 AS score,
    doc_id % 5 = 0 AS parent_window, doc_id % 7 = 0 AS hyde, doc_id % 11 = 0 AS downgraded, doc_id % 4 = 0 AS kg_match, CAST(floor(length(text) * 0.25) AS BIGINT) AS tokens
  FROM documents
), b AS (SELECT *, coalesce(rerank_score, recall_score, score, 0) AS base FROM e), s AS (
  SELECT *, round(CAST(CASE WHEN base = 0 THEN 0.01 ELSE base END AS DOUBLE) * CASE WHEN parent_window THEN 1.08::DOUBLE ELSE 1.0 END * CASE WHEN hyde THEN 0.95::DOUBLE ELSE 1.0 END * CASE WHEN downgraded THEN 0.5::DOUBLE ELSE 1.0 END * CASE WHEN kg_match THEN 1.2::DOUBLE ELSE 1.0 END, 6) AS final_score FROM b
), k AS (SELECT *, row_number() OVER (PARTITION BY query_id, key ORDER BY final_score DESC, evidence_id) AS n FROM s), o AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY final_score DESC, key) > 3 AS over FROM k WHERE n = 1
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY over, final_score DESC, key) AS rank FROM o)"""


def _evidence(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    return d.select(
        F.col("lang").alias("query_id"), i.alias("evidence_id"), F.md5(F.trim("text")).alias("key"), "source",
        F.when(i % 3 == 0, (F.col("n_chars") % 100) / 100.0).alias("rerank_score"), F.when(i % 3 == 1, (F.col("n_chars") % 50) / 1000.0).alias("recall_score"), ((F.col("n_chars") % 10) / 10.0).alias("score"),
        (i % 5 == 0).alias("parent_window"), (i % 7 == 0).alias("hyde"), (i % 11 == 0).alias("downgraded"), (i % 4 == 0).alias("kg_match"), F.floor(F.length("text") * 0.25).cast("long").alias("tokens"),
    )


@query(f"WITH {EVIDENCE_SQL} SELECT query_id, evidence_id, key, source, final_score, rank FROM ranked")
def fusion_rank(spark, sf_dir):
    return fusion.fusion_rank(_evidence(spark, sf_dir)).select("query_id", "evidence_id", "key", "source", "final_score", "rank")


@query(f"""
WITH {EVIDENCE_SQL}, p AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ranked)
SELECT query_id, evidence_id, rank, tokens, before + tokens > 4000 AS truncated, CAST(CASE WHEN before + tokens > 4000 THEN 4000 - before ELSE tokens END AS BIGINT) AS used
FROM p WHERE before + tokens <= 4000 OR (before <= 4000 AND 4000 - before > 200)
""")
def source_cap(spark, sf_dir):
    ranked = fusion.fusion_rank(_evidence(spark, sf_dir)).select("query_id", "evidence_id", "rank", "tokens")
    return fusion.token_budget(ranked, 4000).select("query_id", "evidence_id", "rank", "tokens", "truncated", "used")


@example("SELECT n, CAST(rank AS BIGINT) AS rank, CAST(CASE WHEN n < 4 THEN rank WHEN rank % 2 = 1 THEN (rank + 1) // 2 ELSE (n + 1) // 2 + (n // 2 - rank // 2) + 1 END AS BIGINT) AS place FROM (SELECT unnest([1, 3, 4, 5, 8]) AS n) a, (SELECT unnest(range(1, 9)) AS rank) b WHERE rank <= n")
def evidence_interleave(spark, sf_dir):
    rows = inline(spark, "(1), (3), (4), (5), (8)", "n").select("n", F.explode(F.expr("sequence(1L, cast(n as long))")).alias("rank"))
    return rows.select("n", "rank", fusion.interleave(F.col("rank"), F.col("n")).alias("place"))
