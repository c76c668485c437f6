"""Queries of query understanding, retrieval policy and evidence checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fusion, routing, verify
from . import registry
from .registry import example, inline, query, table

QUESTIONS = "(1, '栈和队列的区别', 'a'), (2, '什么是死锁', ''), (3, '用代码实现快速排序 quicksort 的步骤和流程总结以及注意事项清单要点', 'quicksort'), (4, '怎么学操作系统', ''), (5, '给我出几道选择题', ''), (6, '批改我的答案', ''), (7, 'TCP', 'TCP'), (8, '进程与线程、协程的关系', '')"


def _questions(spark):
    rows = inline(spark, QUESTIONS, "id, text, term").withColumn("terms", F.when(F.col("term") == "", F.array("text", "text", "text")).otherwise(F.array("term", "text", "text")))
    return rows, routing.query_flags(F.col("text"), F.col("terms"))


FLAGS_SQL = f"""
q(id, text, term) AS (VALUES {QUESTIONS}), f AS (
  SELECT id, text, regexp_matches(lower(text), '代码|示例|实现|伪代码|算法实现') OR regexp_full_match(term, '[A-Za-z_][A-Za-z0-9_.]{{3,}}') AS code, regexp_matches(text, '习题|练习|题目|选择题|判断题|填空|简答题|出题|题') AS exercise,
    regexp_matches(text, '答案|解析|批改|评分|得分|为什么错|标准答案') AS answer, regexp_matches(text, '步骤|流程|总结|要点|区别|注意事项|清单|对比') AS structured,
    regexp_matches(text, '概念|定义|是什么|什么是|含义|意思|原理|介绍|应用|作用|用途|解释') AS concept, regexp_matches(text, '区别|不同|差异|对比|比较|相同|异同|关系|联系') AS comparison,
    regexp_matches(text, '怎么学|如何学|学习路线|学习路径|复习路线|复习路径|前置知识|重点章节|应该怎么学') AS learning_path, length(text) >= 40 AS long FROM q
)"""


@example(f"WITH {FLAGS_SQL} SELECT id, code, exercise, answer, structured, concept, comparison, learning_path, long FROM f")
def query_flags(spark, sf_dir):
    rows, f = _questions(spark)
    return rows.select("id", *(f[k].alias(k) for k in ("code", "exercise", "answer", "structured", "concept", "comparison", "learning_path", "long")))


@example(f"""
WITH {FLAGS_SQL}, d AS (SELECT id, CASE WHEN learning_path THEN CASE WHEN long THEN 'deep' ELSE 'standard' END WHEN comparison THEN 'standard' WHEN code THEN 'code' WHEN exercise OR answer THEN 'standard' WHEN long AND structured THEN 'deep' ELSE 'standard' END AS depth FROM f)
SELECT id, depth, CASE depth WHEN 'deep' THEN 8 WHEN 'code' THEN 6 ELSE 5 END AS k, CASE depth WHEN 'standard' THEN 'L2' ELSE 'L3' END AS layer, CASE depth WHEN 'deep' THEN 'l3_deep' WHEN 'code' THEN 'l3_code' ELSE 'l2_standard' END AS route_type FROM d
""")
def depth_strategy(spark, sf_dir):
    rows, f = _questions(spark)
    rows = rows.select("id", routing.depth(f).alias("depth")).withColumn("s", routing.strategy(F.col("depth")))
    return rows.select("id", "depth", "s.k", "s.layer", "s.route_type")


@example(f"""
WITH q(id, text, term) AS (VALUES {QUESTIONS})
SELECT id, CASE WHEN regexp_matches(lower(text), '批改|评分|对吗|判断对错|判对错|打分|检查答案|我的回答|我答的|帮我看|批作业|纠错|学生答案|我的答案|题目：') THEN 'grading_agent' WHEN regexp_matches(text, '出题|练习|测试|考考我|刷题|给我出|出几道|来几道|测验|模拟题|真题|选择题|填空题|简答题') THEN 'question_agent'
  WHEN regexp_matches(text, '怎么学|学习路线|推荐路线|学习路径|怎么复习|从哪开始|学习建议|学习规划|备考建议|复习计划|接下来学') THEN 'path_agent' WHEN regexp_matches(text, '什么是|解释|原理|区别|对比|定义|是什么|为什么|如何理解|介绍一下|讲一下|说明|概念|过程|方法|算法|机制|条件|特点') THEN 'knowledge_agent' END AS agent FROM q
""")
def agent_route(spark, sf_dir):
    return _questions(spark)[0].select("id", routing.agent(F.col("text")).alias("agent"))


@example("SELECT * FROM (VALUES (8, '进程与线程、协程的关系|进程的核心概念|线程的核心概念')) t(id, parts)")
def rule_decompose(spark, sf_dir):
    rows, f = _questions(spark)
    rows = rows.select("id", routing.decompose(F.col("text"), f["comparison"]).alias("p")).filter("size(p) > 0")
    return rows.select("id", F.array_join("p", "|").alias("parts"))


@example("""
WITH w(route, flag, weight) AS (VALUES ('semantic', 'concept', 2.0), ('semantic', 'comparison', 2.0), ('semantic', 'default', 1.5), ('keyword_bm25', 'code', 2.0), ('keyword_bm25', 'exercise', 1.5), ('keyword_bm25', 'answer', 1.5), ('keyword_bm25', 'default', 1.0), ('focus', 'default', 1.5),
  ('expanded', 'concept', 0.8), ('expanded', 'default', 0.6), ('code_meta', 'code', 2.5), ('exercise_meta', 'exercise', 2.5), ('answer_meta', 'answer', 2.5), ('concept_meta', 'concept', 1.5), ('concept_meta', 'comparison', 1.5), ('comparison_meta', 'comparison', 2.0), ('structured_meta', 'structured', 2.0),
  ('section_meta', 'default', 1.2), ('formula_meta', 'concept', 1.8), ('formula_meta', 'structured', 1.8), ('table_meta', 'concept', 1.5), ('table_meta', 'structured', 1.5), ('merged_qa_meta', 'exercise', 2.0), ('merged_qa_meta', 'answer', 2.0), ('merged_qa_meta', 'comparison', 1.5)),
r AS (SELECT DISTINCT route FROM w), f AS (SELECT unnest(['code', 'exercise', 'answer', 'concept', 'comparison', 'structured', 'none']) AS flag)
SELECT r.route, f.flag, CAST(coalesce(a.weight, d.weight, 1.0) AS DOUBLE) AS weight FROM r CROSS JOIN f LEFT JOIN w a ON a.route = r.route AND a.flag = f.flag LEFT JOIN w d ON d.route = r.route AND d.flag = 'default'
""")
def route_weights(spark, sf_dir):
    rows = spark.range(1).select(F.explode(F.array(*map(F.lit, fusion.ROUTES))).alias("route")).select("route", F.explode(F.array(*map(F.lit, (*fusion.FLAGS, "none")))).alias("flag"))
    flags = {k: F.col("flag") == k for k in fusion.FLAGS}
    return rows.select("route", "flag", fusion.route_weight(F.concat(F.lit("os:"), F.col("route")), flags).alias("weight"))


@example("""
WITH p(kind, use_rerank, k) AS (VALUES ('exercise', true, 5), ('short', false, 5), ('long', true, 8), ('code', false, 12), ('none', true, 20), ('none', false, 5))
SELECT kind, use_rerank, k, round(0.05::DOUBLE * CASE kind WHEN 'exercise' THEN 2.5 WHEN 'code' THEN 2.5 ELSE 1.5 END / 1.5 * CASE kind WHEN 'exercise' THEN 1.2 WHEN 'short' THEN 0.75 WHEN 'long' THEN 1.1 ELSE 1.0 END, 6) AS threshold,
  CASE WHEN use_rerank THEN greatest(k, least(k * CASE WHEN kind IN ('short', 'code', 'long') THEN 6 ELSE 5 END, 50)) ELSE least(CASE kind WHEN 'short' THEN greatest(k + 4, k * 2) WHEN 'code' THEN greatest(k + 3, k * 2) ELSE k END, 20) END AS coarse_k,
  CAST(least(floor(k * 1.2), CASE WHEN use_rerank THEN 40 ELSE 20 END) AS BIGINT) AS bm25_k, CAST(least(greatest(3, floor(k * 0.8)), CASE WHEN use_rerank THEN 40 ELSE 20 END) AS BIGINT) AS expanded_k, CAST(greatest(3, least(floor(k * 0.6), 10)) AS BIGINT) AS meta_k FROM p
""")
def retrieval_policy(spark, sf_dir):
    rows = inline(spark, "('exercise', true, 5), ('short', false, 5), ('long', true, 8), ('code', false, 12), ('none', true, 20), ('none', false, 5)", "kind, use_rerank, k")
    f = {k: F.col("kind") == k for k in (*routing.MARKERS, "short", "long")}
    threshold, coarse = routing.policy(F.col("k"), F.lit(0.05), F.col("use_rerank"), f)
    ks = {name: routing.route_k(F.col("k"), F.lit(route), F.col("use_rerank")) for name, route in (("bm25_k", "keyword_bm25"), ("expanded_k", "expanded"), ("meta_k", "code_meta"))}
    return rows.select("kind", "use_rerank", "k", F.round(threshold, 6).alias("threshold"), coarse.alias("coarse_k"), *(v.alias(n) for n, v in ks.items()))


@example("SELECT * FROM (VALUES (1, 'ds'), (2, 'net,os'), (3, 'ds,net,os'), (4, 'ds,net,os')) t(query_id, collections)")
def collection_routes(spark, sf_dir):
    words = inline(spark, "('ds', '栈'), ('ds', 'avl'), ('os', '死锁'), ('os', 'rr'), ('net', 'tcp'), ('net', 'tcp/ip')", "collection, word")
    queries = inline(spark, "(1, '栈的定义'), (2, '死锁 与 TCP/IP'), (3, 'arrow xtcp'), (4, 'none')", "query_id, text")
    return routing.collections(queries, words).select("query_id", F.array_join("collections", ",").alias("collections"))


@example("SELECT * FROM (VALUES (1, 'semantic=栈 队列|keyword_bm25=栈 队列|focus=栈 队列|expanded=栈 队列 stack'), (2, 'semantic=x')) t(id, routes)")
def recall_routes(spark, sf_dir):
    rows = spark.sql("SELECT * FROM VALUES (1, '栈 队列', array('栈', '队列'), '栈 队列 stack'), (2, 'x', cast(array() as array<string>), 'x') AS t(id, text, terms, expanded)")
    routes = routing.recall_routes(F.col("text"), F.col("terms"), F.col("expanded"))
    return rows.select("id", F.array_join(F.transform(routes, lambda r: F.concat_ws("=", r["route"], r["text"])), "|").alias("routes"))


SUMMARY_SQL = """
e AS (SELECT source AS query_id, lang AS source, text AS content, CASE WHEN doc_id % 2 = 0 THEN (n_chars % 100) / 100.0::DOUBLE ELSE 0.0 END AS rerank_score, (n_chars % 50) / 500.0::DOUBLE AS recall_score, doc_id FROM documents),
p AS (SELECT *, CASE WHEN rerank_score > 0 THEN rerank_score WHEN recall_score > 0 THEN recall_score ELSE 0.0 END AS ps FROM e),
s AS (SELECT query_id, count(*) AS n, avg(ps) AS avg_score, count(*) FILTER (WHERE rerank_score > 0) AS n_rerank, count(DISTINCT source) AS n_sources, count(*) FILTER (WHERE length(trim(content)) < 50) AS n_thin, sum(length(content)) AS total_length,
  count(DISTINCT trim(substring(content, 1, 120))) AS n_heads, count(*) FILTER (WHERE ps < 0.1) AS low_a, count(*) FILTER (WHERE ps < 0.03) AS low_b FROM p GROUP BY query_id),
c AS (SELECT *, least(1.0, 0.3 + 0.15 * n) AS c1, CASE WHEN n_rerank > 0 THEN avg_score ELSE least(1.0, avg_score / 0.12) END AS share, CASE WHEN n_rerank > 0 THEN low_a ELSE low_b END / n::DOUBLE AS low, avg_score < CASE WHEN n_rerank > 0 THEN 0.3 ELSE 0.048 END AS below, n_sources / n::DOUBLE AS div, n_thin / n::DOUBLE AS thin, total_length AS ctx FROM s),
k AS (SELECT *, CASE WHEN below THEN share ELSE least(1.0, share * (1 - 0.3 * low)) END AS c2, NOT below AND low < 0.8 AS ok2, CASE WHEN n_sources = 1 AND n > 2 THEN div * 0.5 ELSE div END AS c3, NOT (n_sources = 1 AND n > 2) AND div >= 0.2 AS ok3,
  CASE WHEN thin > 0.5 THEN 0.2 WHEN total_length < 200 THEN total_length / 200.0 ELSE least(1.0, 0.5 + total_length / 3000.0) END AS c4, thin <= 0.5 AND total_length >= 200 AS ok4, CASE WHEN n > 1 THEN n_heads / n::DOUBLE ELSE 1.0 END AS c5, least(ctx / 200.0, 1.0) AS c7, ctx >= 200 AS ok7 FROM c),
o AS (SELECT *, (c1 * 0.2 + c2 * 0.2 + c3 * 0.1 + c4 * 0.15 + c5 * 0.05 + 0.5 * 0.05 + c7 * 0.15) / 0.9 AS overall, c5 >= 0.3 AS ok5 FROM k),
v AS (SELECT *, CASE WHEN NOT (ok2 AND ok7) THEN 'hard_fail' WHEN overall >= 0.6 THEN 'pass' WHEN overall >= 0.35 THEN 'soft_fail' ELSE 'hard_fail' END AS verdict FROM o)"""


def _summary(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    e = d.select(F.col("source").alias("query_id"), F.col("lang").alias("source"), F.col("text").alias("content"), F.when(F.col("doc_id") % 2 == 0, (F.col("n_chars") % 100) / 100.0).otherwise(0.0).alias("rerank_score"), ((F.col("n_chars") % 50) / 500.0).alias("recall_score"), F.lit(0.0).alias("score"))
    return verify.summarize(e).withColumns({"n_kg": F.lit(0), "kg_confidence": F.lit(0.0), "context_length": F.col("total_length")})


@query(f"WITH {SUMMARY_SQL} SELECT query_id, round(overall, 6) AS overall, verdict FROM v")
def evidence_verdict(spark, sf_dir):
    return verify.verify(_summary(spark, sf_dir)).select("query_id", "overall", "verdict")


@query(f"""
WITH {SUMMARY_SQL} SELECT query_id, concat_ws(',', CASE WHEN NOT ok2 THEN 'score_quality' END, CASE WHEN NOT ok3 THEN 'source_diversity' END, CASE WHEN NOT ok4 THEN 'content_sufficiency' END, CASE WHEN NOT ok5 THEN 'duplication' END, CASE WHEN NOT ok7 THEN 'final_context' END) AS failed,
  CASE WHEN verdict <> 'pass' AND NOT ok7 THEN 8 WHEN verdict <> 'pass' AND NOT ok3 THEN 7 WHEN verdict <> 'pass' AND NOT ok5 THEN 4 END AS hint_k, CASE WHEN verdict <> 'pass' AND NOT ok2 THEN 0.03::DOUBLE END AS hint_threshold, CASE WHEN verdict <> 'pass' AND NOT ok2 THEN true END AS hint_rerank,
  CASE WHEN verdict <> 'pass' AND (NOT ok4 OR NOT ok7) THEN 6000 END AS hint_tokens FROM v
""")
def retry_hints(spark, sf_dir):
    return verify.verify(_summary(spark, sf_dir)).drop("overall", "verdict")

