"""Queries of conversations, questions, evaluation, feedback and governance."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import dialog, evaluate, govern, questions
from ..sources.files import numbered
from .registry import example, inline, query, table

MESSAGES_SQL = "m AS (SELECT row_number() OVER (ORDER BY conv_id, turn) AS id, conv_id AS conversation_id, turn, role, text FROM conversations)"


def _messages(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return numbered(c.select("conv_id", "turn", "role", "text"), ["conv_id", "turn"], "id").select("id", F.col("conv_id").alias("conversation_id"), "turn", "role", "text")


@query(f"WITH {MESSAGES_SQL} SELECT id, conversation_id, lag(id) OVER (PARTITION BY conversation_id ORDER BY id) AS parent_id FROM m")
def parent_backfill(spark, sf_dir):
    return dialog.backfill_parents(_messages(spark, sf_dir)).select("id", "conversation_id", "parent_id")


@query(f"WITH {MESSAGES_SQL}, l AS (SELECT conversation_id, max(id) AS leaf FROM m GROUP BY 1) SELECT leaf, id, CAST(leaf - id AS INTEGER) AS depth FROM l JOIN m USING (conversation_id) WHERE leaf - id < 5")
def message_chain(spark, sf_dir):
    m = dialog.backfill_parents(_messages(spark, sf_dir))
    return dialog.parent_chain(m, m.groupBy("conversation_id").agg(F.max("id").alias("id")), 5)


@query(f"""
WITH {MESSAGES_SQL}, u AS (SELECT *, lead(role) OVER w AS r, lead(text) OVER w AS t FROM m WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conversation_id ORDER BY id)),
k AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY id DESC) AS n FROM u WHERE role = 'user' AND r = 'assistant')
SELECT conversation_id, row_number() OVER (PARTITION BY conversation_id ORDER BY id) AS pair, substring(text, 1, 200) AS question, substring(t, 1, 200) AS answer FROM k WHERE n <= 6
""")
def turn_pairs(spark, sf_dir):
    return dialog.turn_pairs(_messages(spark, sf_dir))


@example("SELECT * FROM (VALUES (1, 0::BIGINT, 2::BIGINT), (2, 0, 1), (3, 1, 0), (4, 0, 0)) t(id, siblings_order, children)")
def sibling_order(spark, sf_dir):
    m = inline(spark, "(1, 1, null), (2, 1, 1), (3, 1, 1), (4, 1, 2)", "id, conversation_id, parent_id")
    return dialog.child_counts(dialog.sibling_order(m)).select("id", "siblings_order", "children")


@example("SELECT * FROM (VALUES (1, 3), (2, 4)) t(parent_id, leaf)")
def branch_leaf(spark, sf_dir):
    m = dialog.sibling_order(inline(spark, "(1, 1, null), (2, 1, 1), (3, 1, 1), (4, 1, 2)", "id, conversation_id, parent_id"))
    return dialog.branch_leaf(m)


@query(f"WITH {MESSAGES_SQL} SELECT conversation_id, count(*) AS messages, max_by(text, id) FILTER (WHERE role = 'user') AS latest_query, count(*) >= 16 AND count(*) % 16 = 0 AS summary_due FROM m GROUP BY ALL")
def conversation_list(spark, sf_dir):
    return dialog.conversation_list(_messages(spark, sf_dir))


@query(f"""
WITH {MESSAGES_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY id DESC) AS n FROM m)
SELECT conversation_id, row_number() OVER (PARTITION BY conversation_id ORDER BY id) AS place, role, CASE WHEN role = 'assistant' THEN substring(text, 1, 500) ELSE text END AS text FROM k WHERE n <= 12
""")
def history_window(spark, sf_dir):
    return dialog.history_window(_messages(spark, sf_dir))


@example("SELECT n, n >= 16 AND n % 16 = 0 AS due FROM (SELECT unnest([0, 15, 16, 17, 32, 40]) AS n)")
def summary_trigger(spark, sf_dir):
    return inline(spark, "(0), (15), (16), (17), (32), (40)", "n").select("n", dialog.summary_due(F.col("n")).alias("due"))


RAW = "(1, '题目1：\\n类型：选择\\n难度：中等\\n题干：什么是栈\\n答案：A\\n解析：后进先出\\n题目2：\\n题干：队列\\n答案：B')"


@example("SELECT * FROM (VALUES (1, 1, '选择', 1.3::DOUBLE, '什么是栈', 'A', '后进先出'), (1, 2, '简答', 1.0::DOUBLE, '队列', 'B', '')) t(id, number, question_type, difficulty, stem, answer, explanation)")
def question_parse(spark, sf_dir):
    return questions.parse(inline(spark, RAW, "id, raw"))


@example("SELECT 1 AS id, E'题目1：\\n类型：选择\\n题干：什么是栈\\n答案：A\\n\\n题目2：\\n类型：简答\\n题干：队列\\n答案：B' AS text")
def question_render(spark, sf_dir):
    return questions.render(questions.parse(inline(spark, RAW, "id, raw")))


@example("SELECT * FROM (VALUES (1, 0.5::DOUBLE), (2, 0.5::DOUBLE), (3, 0.5::DOUBLE), (4, 0.5::DOUBLE), (5, 0.5::DOUBLE), (6, 0.7::DOUBLE), (7, 0.7::DOUBLE)) t(id, quality_score)")
def question_quality(spark, sf_dir):
    rows = inline(spark, "(1, 'b', 'x', 's1', ''), (2, 'b', 'x', 's2', ''), (3, 'b', 'x', 's3', ''), (4, 'b', 'x', 's4', ''), (5, 'b', 'x', 's5', ''), (6, 'b', 'y', 's6', 'short'), (7, 'b', 'z', 'what is a stack?', 'an explanation of over twenty characters')", "id, batch_id, question_type, stem, explanation")
    return questions.quality(rows, ["what is a stack"]).select("id", "quality_score")


@example("SELECT * FROM (VALUES (1, 4), (1, 2)) t(user_id, id)")
def wrong_questions(spark, sf_dir):
    rows = inline(spark, "(1, 1, 1, true, null), (2, 1, 2, true, 0.9D), (3, 1, 3, true, 0.2D), (4, 1, 4, true, null), (5, 1, 5, false, null)", "id, user_id, created_at, is_wrong, quality_score")
    return questions.wrong_questions(rows, 3).select("user_id", "id")


@example("SELECT * FROM (VALUES (1, 2::BIGINT, false), (2, 0::BIGINT, true)) t(question_id, redo_count, is_wrong)")
def redo_count(spark, sf_dir):
    return questions.redo_counts(inline(spark, "(1, 1, true), (1, 2, false), (1, 3, true), (1, 4, false), (2, 1, false), (2, 2, true)", "question_id, at, is_wrong"))


@example("SELECT * FROM (VALUES (1, '{\"a\": 1}'), (2, '[1, 2]'), (3, NULL)) t(id, json)")
def loose_json(spark, sf_dir):
    rows = spark.createDataFrame([(1, 'text ```json\n{"a": 1}\n``` end'), (2, "answer: [1, 2] done"), (3, "nothing")], "id int, text string")
    return rows.select("id", questions.loose_json(F.col("text")).alias("json"))


@query("""
SELECT lang, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS std, round(min(v), 4) AS min, round(max(v), 4) AS max, round(quantile_cont(v, 0.5), 4) AS p50, round(quantile_cont(v, 0.9), 4) AS p90, count(*) AS n, count(v) AS valid_n, count(*) FILTER (WHERE v IS NULL) AS nan_count
FROM (SELECT lang, CASE WHEN doc_id % 10 <> 0 THEN CAST(n_chars AS DOUBLE) / 1000 END AS v FROM documents) GROUP BY lang
""")
def score_aggregate(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("lang", F.when(F.col("doc_id") % 10 != 0, F.col("n_chars") / 1000).otherwise(F.lit(float("nan"))).alias("v"))
    return evaluate.score_aggregate(d, ["lang"], "v")


@query("""
WITH t AS (SELECT CAST(n_chars AS DOUBLE) AS total_ms, n_chars % 100 / 1.0::DOUBLE AS rrf_ms, n_chars % 37 / 1.0::DOUBLE AS rerank_ms FROM documents), u AS (SELECT 'total_ms' AS stage, total_ms AS ms FROM t UNION ALL SELECT 'rrf_ms', rrf_ms FROM t UNION ALL SELECT 'rerank_ms', rerank_ms FROM t),
r AS (SELECT stage, list_sort(list(ms)) AS v, count(*) AS n, round(avg(ms), 2) AS avg_ms FROM u GROUP BY stage)
SELECT stage, avg_ms, round(v[n // 2 + 1], 2) AS p50_ms, round(v[least(n - 1, CAST(floor(n * 0.95) AS BIGINT)) + 1], 2) AS p95_ms, CASE WHEN stage <> 'total_ms' THEN round(avg_ms / (SELECT avg_ms FROM r WHERE stage = 'total_ms') * 100, 1) END AS pct FROM r
""")
def stage_timing(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("n_chars").alias("total_ms"), (F.col("n_chars") % 100).alias("rrf_ms"), (F.col("n_chars") % 37).alias("rerank_ms"))
    return evaluate.stage_timing(d, ["total_ms", "rrf_ms", "rerank_ms"])


@query("""
WITH p AS (SELECT source AS query_id, 'r' || (doc_id % 5) AS route, sum(1.0::DOUBLE / (20 + n_chars % 30)) AS own FROM documents GROUP BY ALL), q AS (SELECT DISTINCT query_id FROM p), r AS (SELECT DISTINCT route FROM p),
d AS (SELECT route, round(-coalesce(own, 0), 6) AS delta FROM q CROSS JOIN r LEFT JOIN p USING (query_id, route))
SELECT route, round(avg(delta), 6) AS mean_delta, count(*) AS queries, count(DISTINCT delta) AS n_distinct FROM d GROUP BY route
""")
def route_ablation(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return evaluate.route_ablation(d.select(F.col("source").alias("query_id"), F.concat(F.lit("r"), F.col("doc_id") % 5).alias("route"), F.col("doc_id").alias("key"), (1.0 / (20 + F.col("n_chars") % 30)).alias("part")))


FEEDBACK_SQL = "fb AS (SELECT l.doc_id AS id, CASE WHEN quality = 1 THEN 1 ELSE -1 END AS rating, 'agent' || (l.doc_id % 3) AS agent_name, lang AS retrieval_depth, toxic AS evidence_count, (n_chars % 100) / 100.0::DOUBLE AS confidence FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"


def _feedback(spark, sf_dir):
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    return d.select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, 1).otherwise(-1).alias("rating"), F.concat(F.lit("agent"), F.col("doc_id") % 3).alias("agent_name"), F.col("lang").alias("retrieval_depth"), F.col("toxic").alias("evidence_count"), ((F.col("n_chars") % 100) / 100.0).alias("confidence"), F.lit("2024-01-05").cast("timestamp").alias("timestamp"))


@query(f"WITH {FEEDBACK_SQL} SELECT count(*) AS total, count(*) FILTER (WHERE rating > 0) AS positive, count(*) FILTER (WHERE rating < 0) AS negative, round(avg(confidence), 4) AS avg_confidence, round(count(*) FILTER (WHERE rating > 0) / CAST(count(*) AS DOUBLE), 3) AS positive_ratio FROM fb")
def feedback_stats(spark, sf_dir):
    return evaluate.feedback_stats(_feedback(spark, sf_dir), F.lit("2024-01-08").cast("timestamp"))


@query(f"""
WITH {FEEDBACK_SQL}, b AS (SELECT *, agent_name || '|' || retrieval_depth || '|' || CASE WHEN evidence_count > 0 THEN 'has_ev' ELSE 'no_ev' END AS pattern FROM fb WHERE rating < 0), k AS (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY id) AS n FROM b)
SELECT pattern, count(*) AS count, string_agg(CASE WHEN n <= 3 THEN CAST(id AS VARCHAR) END, ',' ORDER BY id) AS samples FROM k GROUP BY pattern ORDER BY count DESC, pattern LIMIT 10
""")
def bad_case_clusters(spark, sf_dir):
    return evaluate.bad_case_clusters(_feedback(spark, sf_dir))


@query(f"""
WITH {FEEDBACK_SQL}, g AS (SELECT CASE WHEN confidence > 0.66 THEN 'high' WHEN confidence > 0.33 THEN 'medium' ELSE 'low' END AS confidence, rating > 0 AS passed, evidence_count > 0 AS has_source, agent_name, retrieval_depth FROM fb),
f AS (SELECT confidence, flag, count(*) AS n FROM (SELECT confidence, unnest([agent_name, retrieval_depth]) AS flag FROM g) GROUP BY ALL), t AS (SELECT confidence, flag, row_number() OVER (PARTITION BY confidence ORDER BY n DESC, flag) AS r FROM f)
SELECT g.confidence, count(*) AS answers, round(avg(CAST(passed AS DOUBLE)), 4) AS pass_rate, round(avg(CAST(has_source AS DOUBLE)), 4) AS source_rate, any_value(t.flag) AS top_flag FROM g LEFT JOIN t ON g.confidence = t.confidence AND r = 1 GROUP BY g.confidence
""")
def governance_stats(spark, sf_dir):
    f = _feedback(spark, sf_dir)
    level = F.when(F.col("confidence") > 0.66, "high").when(F.col("confidence") > 0.33, "medium").otherwise("low")
    return evaluate.governance_stats(f.select(level.alias("confidence"), (F.col("rating") > 0).alias("passed"), (F.col("evidence_count") > 0).alias("has_source"), F.array("agent_name", "retrieval_depth").alias("flags")))


@query("SELECT CASE WHEN grouping(route) = 0 THEN 'route' ELSE 'collection' END AS kind, coalesce(route, collection) AS name, count(*) AS calls, CAST(sum(hits) AS BIGINT) AS hits FROM (SELECT 'r' || (doc_id % 4) AS route, lang AS collection, n_chars AS hits FROM documents) GROUP BY GROUPING SETS ((route), (collection))")
def route_summary(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return evaluate.route_summary(d.select(F.concat(F.lit("r"), F.col("doc_id") % 4).alias("route"), F.col("lang").alias("collection"), F.col("n_chars").alias("hits")))


@query("WITH s AS (SELECT lang AS query_id, doc_id % 7 AS stage, count(*) AS n, round(max(n_chars / 1000.0::DOUBLE), 6) AS max, round(avg(n_chars / 1000.0::DOUBLE), 6) AS avg, round(min(n_chars / 1000.0::DOUBLE), 6) AS min FROM documents GROUP BY ALL) SELECT query_id, stage, n, max, avg, min, n - lag(n) OVER (PARTITION BY query_id ORDER BY stage) AS delta FROM s")
def pipeline_stage_delta(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("query_id"), (F.col("doc_id") % 7).alias("stage"), (F.col("n_chars") / 1000.0).alias("score"))
    return evaluate.stage_deltas(evaluate.score_stats(d))


@query("""
WITH c AS (SELECT lang AS query_id, doc_id AS id, md5(trim(text)) AS text, doc_id % 3 AS tier, n_chars AS score, CAST(floor(length(text) * 0.25) AS BIGINT) AS tokens FROM documents), o AS (SELECT *, row_number() OVER (PARTITION BY query_id, text ORDER BY tier, score DESC, id) AS n FROM c),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, score DESC, id) AS rank FROM o WHERE n = 1), b AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k WHERE rank <= 8)
SELECT query_id, id, CAST(rank AS INTEGER) AS rank, CAST(CASE WHEN before + tokens > 12000 THEN 12000 - before ELSE tokens END AS BIGINT) AS used FROM b WHERE before + tokens <= 12000 OR (before <= 12000 AND 12000 - before > 100)
""")
def eval_contexts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("query_id"), F.col("doc_id").alias("id"), F.md5(F.trim("text")).alias("text"), (F.col("doc_id") % 3).alias("tier"), F.col("n_chars").alias("score"), F.floor(F.length("text") * 0.25).alias("tokens"))
    return evaluate.contexts(d, 8, 12000).select("query_id", "id", "rank", "used")


ANSWERS = """(1, 'knowledge_agent', '核心要点：栈是后进先出的结构，来源：教材一', '栈是后进先出的结构'), (2, 'knowledge_agent', '好的，定义如下，栈是一种线性表，参考教材内容', '栈'), (3, 'grading_agent', '批改完成，请查看下面的结果与说明文字，谢谢大家', ''), (4, 'knowledge_agent', '根据教材第 9 章，核心是递归调用的原理和应用说明', 'none'), (5, 'path_agent', '短', '')"""


@example("SELECT * FROM (VALUES (1, true, 0, false, 0, 'high'), (2, true, 0, true, 0, 'medium'), (3, false, 0, false, 2, 'medium'), (4, true, 1, false, 0, 'low'), (5, false, 0, false, 1, 'low')) t(id, has_source, forged, filler, format_warnings, confidence)")
def governed_answers(spark, sf_dir):
    rows = inline(spark, ANSWERS, "id, agent, answer, evidence").withColumn("outputs", F.array("evidence"))
    a, g, o = F.col("answer"), F.col("agent"), F.col("outputs")
    return rows.select("id", govern.has_source(a, g).alias("has_source"), F.size(govern.forged(a, o)).alias("forged"), govern.filler(a).alias("filler"), govern.format_warnings(a, g).alias("format_warnings"), govern.confidence(a, g, o).alias("confidence"))


@example("SELECT * FROM (VALUES (1, 0, 'high'), (2, 0, 'high'), (3, 0, 'high'), (4, 0, 'high'), (5, 1, 'medium')) t(id, issues, confidence)")
def rule_reflection(spark, sf_dir):
    issues, level = govern.reflection(F.col("answer"), F.col("evidence"))
    return inline(spark, ANSWERS, "id, agent, answer, evidence").select("id", issues.alias("issues"), level.alias("confidence"))


@example("SELECT * FROM (VALUES (1, 'ab,cd,ef'), (2, ''), (3, 'abc')) t(id, parts)")
def fixed_chunks(spark, sf_dir):
    rows = inline(spark, "(1, 'abcdef', 2), (2, '', 2), (3, 'abc', 20)", "id, text, n")
    return rows.select("id", F.array_join(F.when(F.col("n") == 2, govern.fixed_chunks(F.col("text"), 2)).otherwise(govern.fixed_chunks(F.col("text"))), ",").alias("parts"))


@query("SELECT user_id, count(*) AS points, round(100.0::DOUBLE * count(*) FILTER (WHERE value > 50) / count(*), 1) AS rate FROM events GROUP BY user_id")
def study_totals(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(F.count("*").alias("points"), F.round(100.0 * F.count_if(F.col("value") > 50) / F.count("*"), 1).alias("rate"))
