"""Queries of corpus drivers, look-ups, chat and tracking rules, and graph evidence; most over whole tables, with SQL over the same tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import arrivals, corpus, dialog, drivers, evaluate, govern, graph, learning, lookups, questions, retrieval, routing
from ..sources import files
from ..streaming import ingest
from .graph_queries import EDGES_SQL, _edges
from .registry import example, inline, query, table
from .tracing_queries import EVENTS_SQL, STATES_SQL, _category, _effective, _events, _expanded, _registry


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query(r"""
WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g') AS t FROM documents),
b AS (SELECT doc_id, regexp_replace(regexp_replace(nfc_normalize(t), '(?m)[ \t]+$', '', 'g'), '\n{4,}', repeat(chr(10), 3), 'g') AS t FROM a)
SELECT doc_id, md5(coalesce(regexp_replace(t, '^\s+|\s+$', '', 'g'), '')) AS digest FROM b
""")
def markdown_clean(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(drivers.clean_markdown(F.col("text"))).alias("digest"))


@query("SELECT doc_id, lower(source) LIKE '%/questions/%' OR lower(source) LIKE '%\\_408\\_exam.md' ESCAPE '\\' AS exam FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'D:/Bank/Questions/' || doc_id || '.md' WHEN doc_id % 3 = 1 THEN source || '/2024_408_EXAM.md' ELSE source || '/notes.md' END AS source FROM documents)")
def exam_sources(spark, sf_dir):
    i = F.col("doc_id")
    source = F.when(i % 3 == 0, F.concat(F.lit("D:\\Bank\\Questions\\"), i, F.lit(".md"))).when(i % 3 == 1, F.concat("source", F.lit("/2024_408_EXAM.md"))).otherwise(F.concat("source", F.lit("/notes.md")))
    return _docs(spark, sf_dir).select("doc_id", drivers.exam_source(source).alias("exam"))


NOTES = "(1, '２０２４年１月２日 ①first'), (2, '綫性表 12点30分'), (3, 'plain'), (4, ' '), (5, NULL), (6, '1) one\\n2) two')"


@example("SELECT * FROM (VALUES (1, '2024-01-02 [1]first', 'fullwidth,date,list_markers', -3), (2, '线性表 12:30', 'time,simplified', 1), (3, 'plain', '', 0), (4, ' ', '', 0), (5, NULL, '', 0), (6, E'[1] one\\n[2] two', 'list_markers', -2)) t(doc_id, text, changes, char_delta)")
def normalize_log(spark, sf_dir):
    return drivers.normalize(inline(spark, NOTES, "doc_id, text")).select("doc_id", "text", F.array_join("changes", ",").alias("changes"), "char_delta")


ODD = "(1, '正常的一段文字，没有什么特别之处，只是说明而已。'), (2, '░▒▓█▄▀░▒▓█▄▀░▒▓█'), (3, 'good text\\n\\n░▒▓█▄▀\\n\\nabcabcabcabcabc and so on'), (4, NULL)"


@example("SELECT * FROM (VALUES (1, '正常的一段文字，没有什么特别之处，只是说明而已。', ''), (2, '░▒▓█▄▀░▒▓█▄▀░▒▓█', 'full_garbage'), (3, E'good text\\n\\n[乱码段落，已隔离，原文6字符]\\n\\nabc and so on', 'isolated:1,collapsed:12'), (4, '', '')) t(doc_id, text, actions)")
def content_anomalies(spark, sf_dir):
    return drivers.content_anomalies(inline(spark, ODD, "doc_id, text")).select("doc_id", "text", F.array_join("actions", ",").alias("actions"))


@query("""
WITH l AS (SELECT doc_id, length(trim(text)) AS length, len(regexp_extract_all(text, '[一-鿿㐀-䶿]')) AS z, len(regexp_extract_all(text, '[a-zA-Z]')) AS a, length(text) AS whole FROM documents), s AS (SELECT list_sort(list(length)) AS v, count(*) AS n, avg(length) AS mean, stddev_pop(length) AS sd FROM l),
q AS (SELECT v[n // 4 + 1] AS q1, v[3 * n // 4 + 1] AS q3, n, mean, sd FROM s),
o AS (SELECT doc_id, CASE WHEN n >= 4 AND q3 > q1 AND length < q1 - 1.5 * (q3 - q1) THEN 'too_short' WHEN n >= 4 AND q3 > q1 AND length > q3 + 1.5 * (q3 - q1) THEN 'too_long' END AS outlier, round((length - mean) / sd, 2) AS z,
  CASE WHEN whole >= 50 AND z + a > 0 THEN round(2.0 * least(z, a) / (z + a)::DOUBLE, 3) ELSE 0 END AS mix FROM l, q)
SELECT doc_id, outlier, CASE WHEN outlier IS NOT NULL THEN z END AS zscore, CASE WHEN outlier = 'too_short' AND z < -2 THEN 'merge' WHEN outlier = 'too_short' THEN 'inspect' WHEN outlier = 'too_long' AND z > 3 THEN 'split' WHEN outlier = 'too_long' THEN 'tune_chunks' END AS suggestion,
  concat_ws(',', CASE WHEN outlier IS NOT NULL THEN 'length:' || outlier END, CASE WHEN mix > 0.4 THEN 'language_mixed' END) AS actions FROM o
""")
def statistical_anomalies(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", "text").withColumn("actions", F.array().cast("array<string>"))
    return drivers.statistical_anomalies(rows).select("doc_id", "outlier", "zscore", "suggestion", F.array_join("actions", ",").alias("actions"))


@query()
def anomaly_totals(spark, sf_dir):
    return drivers.anomaly_totals(drivers.anomalies(_docs(spark, sf_dir).select("doc_id", "text")))


@query()
def dedup_documents(spark, sf_dir):
    return drivers.dedup(_docs(spark, sf_dir).select("doc_id", "text"))


@query()
def arrivals_dedup(spark, sf_dir):
    """All documents as three arrivals in the order of ids, each checked against a store of those before it; the result is that of ``dedup_documents``."""
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    store = arrivals.Store(spark, files.scratch(spark, "arrivals"), id_type=docs.schema["doc_id"].dataType.simpleString())
    low, high = docs.approxQuantile("doc_id", [1 / 3, 2 / 3], 0.01) or [0, 0]
    i = F.col("doc_id")
    parts = [arrivals.add(store, docs.filter(part)) for part in (i <= low, (i > low) & (i <= high), i > high)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""
WITH f AS (SELECT coalesce(lang, 'unknown') AS category, doc_id // 50 AS part, string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY doc_id, text) AS text FROM documents GROUP BY ALL)
SELECT category || '/part-' || part || CASE WHEN part % 4 = 3 THEN '.pdf' ELSE '.md' END AS source, category, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes,
  CASE WHEN part % 4 = 3 THEN 'unsupported type: pdf' WHEN length(trim(text)) < 10 THEN 'empty' END AS error FROM f
""")
def ingested_files(spark, sf_dir):
    """All documents uploaded as files of up to fifty texts of a language, then read as a stream; files of another type are errors."""
    part = F.floor(F.col("doc_id") / 50).cast("long")
    docs = _docs(spark, sf_dir).select(F.coalesce("lang", F.lit("unknown")).alias("category"), part.alias("part"), F.struct("doc_id", F.coalesce("text", F.lit("")).alias("text")).alias("row"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("row")), lambda r: r["text"]), "\n\n")
    written = docs.groupBy("category", "part").agg(text.cast("binary").alias("content"))
    ext = F.when(F.col("part") % 4 == 3, ".pdf").otherwise(".md")
    folder, store, log = (files.scratch(spark, name) for name in ("uploads", "store", "progress"))
    ingest.upload(written.select(F.concat(F.lit("part-"), "part", ext).alias("filename"), "category", "content"), folder)
    ingest.ingest_stream(spark, folder, store, log).awaitTermination()
    return ingest.files(spark, store).select("source", "category", "n_bytes", "error")


@query("""
WITH c AS (SELECT doc_id, count(*) AS chunks FROM labels GROUP BY 1), d AS (SELECT coalesce(lang, 'unknown') AS category, length(text) AS chars, CASE WHEN n_chars < 40 THEN 'short' END AS error, chunks FROM documents LEFT JOIN c USING (doc_id))
SELECT category, count(*) AS documents, CAST(sum(chars) AS BIGINT) AS chars, count(error) AS errors, CAST(coalesce(sum(chunks), 0) AS BIGINT) AS chunks FROM d GROUP BY ROLLUP (category)
""")
def ingest_totals(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", F.col("lang").alias("category"), "text", F.when(F.col("n_chars") < 40, "short").alias("error"))
    return drivers.ingest_totals(rows, table(spark, sf_dir, "labels").select("doc_id"))


QA = "(1, 1, 'merged_qa', 'whole one', 'stem one', 'B because', 'B', 'a.md', '[x > y]'), (1, 2, 'merged_qa', 'whole two', '', 'since', 'C', 'b.md', ''), (1, 3, 'prose', 'only text', 'q', 'a', 'A', NULL, NULL), (2, 1, 'merged_qa', 'w', 'stem', '', '', 'c.md', NULL)"


@example(f"""
WITH q(query_id, rank, role, text, question, answer, key, source, heading) AS (VALUES {QA}),
t AS (SELECT query_id, rank, '[来源' || rank || ': ' || coalesce(source, 'unknown') || CASE WHEN coalesce(heading, '') <> '' THEN ' | ' || heading ELSE '' END || ']' || chr(10) AS head,
  CASE WHEN role = 'merged_qa' AND question <> '' THEN question || CASE WHEN key <> '' THEN chr(10) || '正确答案：' || key ELSE '' END ELSE text END AS asked,
  CASE WHEN role = 'merged_qa' AND answer <> '' THEN CASE WHEN key <> '' AND NOT starts_with(answer, key) THEN '正确答案：' || key || chr(10) ELSE '' END || answer ELSE text END AS told FROM q)
SELECT query_id, string_agg(head || asked, chr(10) || chr(10) ORDER BY rank) AS questions, string_agg(head || told, chr(10) || chr(10) ORDER BY rank) AS answers FROM t GROUP BY query_id
""")
def role_contexts(spark, sf_dir):
    rows = inline(spark, QA, "query_id, rank, role, text, question, answer, key, source, heading")
    asked = lookups.role_context(rows, lookups.question_text(F.col("role"), F.col("text"), F.col("question"), F.col("key"))).withColumnRenamed("context", "questions")
    told = lookups.role_context(rows, lookups.answer_text(F.col("role"), F.col("text"), F.col("answer"), F.col("key"))).withColumnRenamed("context", "answers")
    return asked.join(told, "query_id")


@query(f"WITH {EVENTS_SQL}, r AS (SELECT DISTINCT kp, 'point ' || kp AS name, CASE kp % 4 WHEN 0 THEN 'data_structure' WHEN 1 THEN 'computer_organization' WHEN 2 THEN 'operating_system' ELSE 'computer_network' END AS category FROM ev) SELECT category, min(kp) AS kp, min_by(name, kp) AS name FROM r WHERE category IN ('data_structure', 'operating_system') GROUP BY category")
def first_point_of_category(spark, sf_dir):
    wanted = inline(spark, "('data_structure'), ('operating_system')", "category")
    return lookups.by_keys(_registry(spark, sf_dir), wanted, ["category"], ["kp"]).select("category", "kp", "name")


@query("SELECT conv_id, turn, role, text FROM conversations WHERE (conv_id, turn) IN (SELECT DISTINCT item_id, item_id % 3 FROM benchmark)")
def messages_by_key(spark, sf_dir):
    wanted = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("conv_id"), (F.col("item_id") % 3).alias("turn"))
    return lookups.by_keys(table(spark, sf_dir, "conversations"), wanted, ["conv_id", "turn"])


@query("SELECT conv_id, arg_max(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id")
def latest_question(spark, sf_dir):
    return lookups.latest_question(table(spark, sf_dir, "conversations"))


@query(f"WITH {EVENTS_SQL} SELECT CASE WHEN event_type LIKE 'qa\\_%' ESCAPE '\\' THEN 'qa' WHEN event_type LIKE 'quiz\\_%' ESCAPE '\\' THEN 'quiz' WHEN event_type LIKE 'grading\\_%' ESCAPE '\\' THEN 'grading' ELSE 'unknown' END AS source, count(*) AS n FROM ev GROUP BY 1")
def event_sources(spark, sf_dir):
    return _events(spark, sf_dir).groupBy(lookups.event_source(F.col("event_type")).alias("source")).agg(F.count("*").alias("n"))


@query(f"WITH {EVENTS_SQL}, f AS (SELECT event_id, unnest(list_distinct([kp, kp // 10, kp])) AS kp FROM ev) SELECT kp, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM f GROUP BY kp")
def events_by_point(spark, sf_dir):
    rows = _events(spark, sf_dir).select("event_id", F.array("kp", F.expr("kp div 10"), "kp").alias("kp_ids"))
    return lookups.fan_out(rows).groupBy("kp").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query(r"SELECT doc_id, trim(regexp_replace(regexp_replace(p, '\.[^.]*$', ''), '^.*/', '')) AS name FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source || '/part ' || doc_id || '.v1.md' ELSE 'plain' || doc_id END AS p FROM documents)")
def source_stems(spark, sf_dir):
    path = F.when(F.col("doc_id") % 2 == 0, F.concat("source", F.lit("/part "), "doc_id", F.lit(".v1.md"))).otherwise(F.concat(F.lit("plain"), "doc_id"))
    return _docs(spark, sf_dir).select("doc_id", lookups.source_stem(path).alias("name"))


@query(f"""
WITH {EVENTS_SQL}, a AS (SELECT event_id, user_id, kp, CASE event_id % 4 WHEN 0 THEN 'knowledge_agent' WHEN 1 THEN 'grading_agent' WHEN 2 THEN 'path_agent' ELSE 'question_agent' END AS agent, CASE WHEN event_id % 5 < 2 THEN 'high' WHEN event_id % 5 < 4 THEN 'low' END AS confidence, event_id % 101 AS score FROM ev WHERE kp % 7 <> 0)
SELECT CASE WHEN agent = 'grading_agent' THEN CASE WHEN score >= 80 THEN 'grading_excellent' WHEN score >= 50 THEN 'grading_pass' ELSE 'grading_fail' END WHEN confidence = 'high' THEN 'qa_high_confidence' ELSE 'qa_low_confidence' END AS event_type, count(*) AS n,
  round(sum(CASE WHEN agent = 'grading_agent' THEN score / 100.0::DOUBLE WHEN confidence = 'high' THEN 1.0 ELSE 0.3 END), 4) AS outcome, round(sum(CASE WHEN agent = 'grading_agent' THEN 1.3 ELSE 1.0 END)::DOUBLE, 4) AS difficulty
FROM a WHERE agent <> 'question_agent' GROUP BY 1
""")
def agent_events(spark, sf_dir):
    e, i = _events(spark, sf_dir), F.col("event_id")
    agent = F.when(i % 4 == 0, "knowledge_agent").when(i % 4 == 1, "grading_agent").when(i % 4 == 2, "path_agent").otherwise("question_agent")
    points = F.when(F.col("kp") % 7 == 0, F.array().cast("array<bigint>")).otherwise(F.array("kp"))
    answers = e.select("user_id", agent.alias("agent"), points.alias("kp_ids"), F.when(i % 5 < 2, "high").when(i % 5 < 4, "low").alias("confidence"), F.concat(F.lit("评分："), i % 101, F.lit("/100")).alias("answer"))
    return lookups.agent_events(answers).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("outcome"), 4).alias("outcome"), F.round(F.sum("difficulty"), 4).alias("difficulty"))


ASKED = "(1, '数据结构的栈'), (2, '计算机组成与网络'), (3, '操作系统'), (4, '网络协议'), (5, 'none'), (6, NULL)"


@example(f"SELECT id, CASE WHEN text LIKE '%数据结构%' THEN 'data_structure' WHEN text LIKE '%组成原理%' OR text LIKE '%计算机组成%' THEN 'computer_organization' WHEN text LIKE '%操作系统%' THEN 'operating_system' WHEN text LIKE '%网络%' THEN 'computer_network' ELSE '' END AS subject FROM (VALUES {ASKED}) t(id, text)")
def subject_names(spark, sf_dir):
    return inline(spark, ASKED, "id, text").select("id", lookups.subject(F.col("text")).alias("subject"))


@query("""
WITH c AS (SELECT source AS query_id, lang, count(*) AS n, min(doc_id) AS first FROM documents WHERE coalesce(lang, '') <> '' GROUP BY ALL), m AS (SELECT query_id, arg_min(lang, (-n, first)) AS category FROM c GROUP BY query_id)
SELECT query_id, category, CASE WHEN length(query_id) % 3 = 0 THEN 'given' WHEN length(query_id) % 3 = 1 THEN '' ELSE category END AS traced FROM m
""")
def main_collection(spark, sf_dir):
    rows = _docs(spark, sf_dir).select(F.col("source").alias("query_id"), F.col("doc_id").alias("rank"), F.col("lang").alias("collection"))
    found, size = lookups.main_collection(rows), F.length("query_id") % 3
    routes = F.when(size == 1, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("")))
    return found.select("query_id", "category", lookups.trace_category(F.when(size == 0, "given"), routes, F.col("category")).alias("traced"))


@query("SELECT lang AS query_id, doc_id AS rank, md5(substring(text, 1, 500)) AS content, CAST(CASE WHEN doc_id % 3 = 0 AND n_chars % 100 > 0 THEN (n_chars % 100) / 100.0 WHEN n_chars % 50 > 0 THEN (n_chars % 50) / 1000.0 ELSE (n_chars % 10) / 10.0 END AS DOUBLE) AS score FROM documents")
def trace_items(spark, sf_dir):
    i, n = F.col("doc_id"), F.col("n_chars")
    rows = _docs(spark, sf_dir).select(F.col("lang").alias("query_id"), i.alias("rank"), "text", F.when(i % 3 == 0, (n % 100) / 100.0).alias("rerank_score"), ((n % 50) / 1000.0).alias("recall_score"), ((n % 10) / 10.0).alias("score"))
    return lookups.trace_items(rows).withColumn("content", F.md5("content"))


LEVELS = "(1, 1, '栈', 1.0D, 'auto', false), (1, 2, '栈', 2.0D, 'manual', true), (1, 3, '队列', 1.6D, 'auto', true), (1, 4, '树', CAST(NULL AS DOUBLE), 'auto', false), (1, 5, '图', CAST(NULL AS DOUBLE), NULL, NULL), (1, 6, '', 1.0D, 'auto', true), (2, 1, '栈', 1.0D, 'auto', true)"


@example("SELECT * FROM (VALUES (1, '栈', '未知'), (1, '队列', '综合(1.6)'), (1, '树', '理解(1.3)'), (1, '图', '未知'), (2, '栈', '基础(1.0)')) t(query_id, point, note)")
def difficulty_notes(spark, sf_dir):
    evidence = inline(spark, LEVELS, "query_id, rank, point, difficulty, difficulty_source, named_level")
    return lookups.difficulty_notes(evidence, inline(spark, "('树', 1.3D)", "name, difficulty"), questions.difficulty_label)


NODES_SQL = "nodes AS (SELECT p_name AS name, min('f' || (p_partkey % 50) || '.md') AS source_file, min(p_brand) AS category FROM part GROUP BY p_name), lost AS (SELECT * FROM nodes WHERE source_file NOT IN (SELECT 'f' || (s_suppkey % 40) || '.md' FROM supplier))"


def _nodes(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    nodes = p.groupBy(F.col("p_name").alias("name")).agg(F.min(F.concat(F.lit("f"), F.col("p_partkey") % 50, F.lit(".md"))).alias("source_file"), F.min("p_brand").alias("category"))
    chunks = table(spark, sf_dir, "supplier").select(F.concat(F.lit("f"), F.col("s_suppkey") % 40, F.lit(".md")).alias("source_file"))
    edges = p.select(F.col("p_name").alias("source"), F.lag("p_name").over(_by_type()).alias("target")).filter("target is not null")
    return nodes, edges, graph.indexed_files(chunks)


def _by_type():
    from pyspark.sql import Window

    return Window.partitionBy("p_type").orderBy("p_partkey")


@query(f"WITH {NODES_SQL} SELECT category, count(*) AS cleaned FROM lost GROUP BY category")
def kg_orphan_cleanup(spark, sf_dir):
    nodes, edges, indexed = _nodes(spark, sf_dir)
    return graph.drop_orphans(nodes, edges, indexed)[2]


@query(f"""
WITH {NODES_SQL}, e AS (SELECT p_name AS source, lag(p_name) OVER (PARTITION BY p_type ORDER BY p_partkey) AS target FROM part)
SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM e WHERE target IS NOT NULL) AS edges, (SELECT count(*) FROM lost) AS orphans, round((SELECT count(*) FROM lost) / greatest((SELECT count(*) FROM nodes), 1)::DOUBLE, 4) AS orphan_ratio
""")
def kg_health(spark, sf_dir):
    return graph.health(*_nodes(spark, sf_dir))


@query(f"""
WITH {NODES_SQL}, e AS (SELECT p_name AS source, lag(p_name) OVER (PARTITION BY p_type ORDER BY p_partkey) AS target FROM part), t(name) AS (VALUES ('new node'))
SELECT (SELECT count(*) FROM nodes) + 1 AS nodes, (SELECT count(*) FROM (SELECT DISTINCT source, target FROM e WHERE target IS NOT NULL)) + 1 AS edges
""")
def kg_edge_upsert(spark, sf_dir):
    nodes, edges, _ = _nodes(spark, sf_dir)
    edges = edges.withColumn("relation", F.lit("RELATED_TO"))
    new = nodes.agg(F.min("name").alias("source")).select("source", F.lit("new node").alias("target"), F.lit("RELATED_TO").alias("relation"))
    kept, both = graph.upsert_edges(nodes, edges, new)
    return kept.agg(F.count("*").alias("nodes")).crossJoin(both.agg(F.count("*").alias("edges")))


@query()
def kg_fulltext(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    nodes = p.groupBy(F.col("p_name").alias("name")).agg(F.min(F.concat_ws(" ", "p_brand", "p_type")).alias("description"))
    topics = p.select(F.substring_index("p_type", " ", -1).alias("topic")).distinct()
    return graph.full_text(topics, nodes)


@query(f"""
WITH RECURSIVE {EDGES_SQL}, t(query_id, pos, name) AS (VALUES (1, 1, 'p1'), (1, 2, 'p7'), (2, 1, 'p30')),
up AS (SELECT name AS start, e.source AS name, 1 AS hops FROM (SELECT DISTINCT name FROM t) s JOIN edges e ON e.target = s.name UNION SELECT u.start, e.source, u.hops + 1 FROM up u JOIN edges e ON e.target = u.name WHERE u.hops < 2),
down AS (SELECT name AS start, e.target AS name, 1 AS hops FROM (SELECT DISTINCT name FROM t) s JOIN edges e ON e.source = s.name UNION SELECT u.start, e.target, u.hops + 1 FROM down u JOIN edges e ON e.source = u.name WHERE u.hops < 2),
near AS (SELECT t.query_id, t.pos, t.name AS start, a.way, a.hops, a.name FROM t JOIN (SELECT start, name, 0 AS way, min(hops) AS hops FROM up GROUP BY ALL UNION ALL SELECT start, name, 1, min(hops) FROM down GROUP BY ALL) a ON a.start = t.name),
n AS (SELECT query_id, name, min((pos, way, hops, name)) AS p FROM (SELECT query_id, pos, -1 AS way, 0 AS hops, name FROM t UNION ALL SELECT query_id, pos, way, hops, name FROM near) GROUP BY ALL),
nr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY p) AS rank FROM n),
e AS (SELECT query_id, CASE way WHEN 0 THEN name ELSE start END AS source, CASE way WHEN 0 THEN start ELSE name END AS target, min((pos, way, hops, name)) AS p FROM near GROUP BY ALL),
er AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY p) AS rank FROM e),
na AS (SELECT query_id, string_agg(name, ',' ORDER BY rank) AS nodes FROM nr WHERE rank <= 24 GROUP BY 1), ea AS (SELECT query_id, string_agg(source || ' -> ' || target, ',' ORDER BY rank) AS edges FROM er WHERE rank <= 32 GROUP BY 1)
SELECT query_id, nodes, edges, (CASE query_id WHEN 1 THEN 0.81 ELSE 0.73 END)::DOUBLE AS confidence FROM na JOIN ea USING (query_id)
""")
def kg_evidence(spark, sf_dir):
    found = graph.evidence(_edges(spark, sf_dir), inline(spark, "(1, 1, 'p1'), (1, 2, 'p7'), (2, 1, 'p30')", "query_id, pos, name"))
    return found.select("query_id", F.array_join("nodes", ",").alias("nodes"), F.array_join("edges", ",").alias("edges"), "confidence")


@query()
def kg_evidence_terms(spark, sf_dir):
    topics = inline(spark, "(1, 1, 'p1'), (1, 2, 'p7'), (2, 1, 'p30')", "query_id, pos, name")
    return graph.evidence_terms(graph.evidence(_edges(spark, sf_dir), topics)).select("query_id", F.array_join("terms", ",").alias("terms"))


@query("SELECT doc_id, regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '\\s+', ' ', 'g') AS text FROM documents")
def normalized_queries(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.normalize_query(F.col("text")).alias("text"))


@query("""
WITH w AS (SELECT doc_id, list_filter(list_transform(string_split(text, ' '), lambda x: trim(x)), lambda x: x <> '')[1:40] AS w FROM documents)
SELECT doc_id, array_to_string(list_filter(w, lambda x, i: list_position(list_transform(w, lambda y: lower(y)), lower(x)) = i), ' ') AS words FROM w
""")
def distinct_words(spark, sf_dir):
    words = F.slice(F.filter(F.transform(F.split("text", " "), lambda x: F.trim(x)), lambda x: x != ""), 1, 40)
    return _docs(spark, sf_dir).select("doc_id", F.array_join(T.ordered_distinct(words), " ").alias("words"))


@query("SELECT doc_id, CASE WHEN k <= 100 THEN text ELSE substring(text, 1, CAST(floor(length(text) * 100 / greatest(k, 1)::DOUBLE) AS BIGINT)) || chr(10) || '[...truncated]' END AS text FROM (SELECT doc_id, text, CAST(floor(length(text) * 0.25) AS BIGINT) AS k FROM documents)")
def texts_in_budget(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.truncate_to_tokens(F.col("text"), F.lit(100)).alias("text"))


@query("SELECT 'm' || conv_id AS thread_id, min(conv_id) AS conv_id FROM conversations WHERE conv_id % 2 = 0 GROUP BY ALL")
def new_threads(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    named = c.select(F.concat(F.lit("m"), "conv_id").alias("thread_id"), "conv_id")
    return dialog.ensure(named.filter("conv_id % 2 = 1"), named)


def _flags():
    kinds = ("code", "exercise", "answer", "structured", "concept", "comparison", "learning_path")
    i = F.col("item_id")
    return {k: i % (n + 3) == 0 for n, k in enumerate(kinds)} | {"short": F.length("text") < 40, "long": F.length("text") > 80}


@query("""
WITH f AS (SELECT item_id, length(text) AS n, item_id % 3 = 0 AS code, item_id % 4 = 0 AS exercise, item_id % 5 = 0 AS answer, item_id % 6 = 0 AS structured, item_id % 7 = 0 AS concept, item_id % 8 = 0 AS comparison, item_id % 9 = 0 AS path FROM benchmark)
SELECT item_id, NOT (code OR exercise OR answer OR structured OR concept OR comparison OR path) AND NOT n < 40 AS needs_model, NOT n < 40 AND (comparison OR n > 80 OR n > 30) AS decompose, NOT (item_id % 3 = 1) AND item_id % 4 < 2 AS hyde, code OR item_id % 2 = 0 AS code FROM f
""")
def routing_flags(spark, sf_dir):
    f, i = _flags(), F.col("item_id")
    merged = lookups.merged_flags(f, {"code": F.when(i % 2 == 0, True), "short": F.lit(True)})
    return table(spark, sf_dir, "benchmark").select("item_id", routing.needs_model(f).alias("needs_model"), routing.should_decompose(F.col("text"), f).alias("decompose"), routing.needs_hyde(i % 4, i % 3 == 1).alias("hyde"), merged["code"].alias("code"))


@query("SELECT doc_id, CASE WHEN n_chars % 100 >= 80 THEN 'grading_excellent' WHEN n_chars % 100 >= 60 THEN 'grading_pass' ELSE 'grading_fail' END AS event_type, CASE WHEN d <= 1.1 THEN '基础' WHEN d <= 1.4 THEN '理解' WHEN d <= 1.7 THEN '综合' ELSE '高级' END AS label FROM (SELECT *, 1.0::DOUBLE + (n_chars % 12) / 10.0 AS d FROM documents)")
def graded_documents(spark, sf_dir):
    n = F.col("n_chars")
    return _docs(spark, sf_dir).select("doc_id", questions.grading_type(n % 100).alias("event_type"), questions.difficulty_label(1.0 + (n % 12) / 10.0).alias("label"))


@query(_expanded(f"""
WITH RECURSIVE {STATES_SQL}, r AS (SELECT user_id, kp, score, row_number() OVER (PARTITION BY user_id ORDER BY score, kp) AS rank FROM es WHERE score < 0.3)
SELECT user_id, string_agg('point ' || kp, '、' ORDER BY rank) AS topics, CASE WHEN avg(score) < 0.3 THEN '基础' WHEN avg(score) < 0.5 THEN '理解' ELSE '综合' END AS band FROM r WHERE rank <= 3 GROUP BY user_id
"""))
def practice_plans(spark, sf_dir):
    weak = _effective(spark, sf_dir).filter("effective_score < 0.3").select("user_id", "kp", F.concat(F.lit("point "), "kp").alias("name"), "effective_score")
    return questions.practice_plan(weak)


@query("""
WITH v AS (SELECT source, list_sort(list(n_chars)) AS v, count(*) AS n FROM documents GROUP BY source)
SELECT source, v[CAST(round_even((n - 1) * 0.5, 0) AS BIGINT) + 1] AS p50, v[CAST(round_even((n - 1) * 0.95, 0) AS BIGINT) + 1] AS p95 FROM v
""")
def length_percentiles(spark, sf_dir):
    return evaluate.nearest_percentiles(_docs(spark, sf_dir), "source", "n_chars", {"p50": 0.5, "p95": 0.95})


@query("SELECT doc_id, rating, substring(text, 1, 500) AS query, substring(text, 1, 2000) AS answer_preview FROM (SELECT *, doc_id % 3 - 1 AS rating FROM documents) WHERE rating <> 0")
def feedback_lines(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", (F.col("doc_id") % 3 - 1).alias("rating"), F.col("text").alias("query"), F.col("text").alias("answer_preview"))
    return evaluate.log_feedback(rows)


@query("""SELECT '{"ts":' || doc_id || ',"event":"ingest","stage":"chunk","status":"' || CASE WHEN doc_id % 2 = 0 THEN 'ok' ELSE 'error' END || '","duration_ms":' || n_chars || ',"tags":{"lang":"' || lang || '"},"values":{"n":' || n_chars % 10 || '}}' AS value FROM documents""")
def metric_lines(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return evaluate.metric_lines(d.select(F.col("doc_id").alias("ts"), F.lit("ingest").alias("event"), F.lit("chunk").alias("stage"), F.when(F.col("doc_id") % 2 == 0, "ok").otherwise("error").alias("status"), F.col("n_chars").alias("duration_ms"), F.create_map(F.lit("lang"), "lang").alias("tags"), F.create_map(F.lit("n"), F.col("n_chars") % 10).alias("values")))


@query("SELECT user_id, kp, event_type, outcome FROM (SELECT user_id, kp, CASE WHEN c = 'high' THEN 'qa_high_confidence' ELSE 'qa_low_confidence' END AS event_type, CAST(CASE WHEN c = 'high' THEN 1.0 ELSE 0.3 END AS DOUBLE) AS outcome FROM (SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS kp, CASE event_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'low' END AS c FROM events))")
def answered_events(spark, sf_dir):
    kind, outcome = learning.qa_event(F.when(F.col("event_id") % 3 == 0, "high").when(F.col("event_id") % 3 == 1, "low"))
    return _events(spark, sf_dir).select("user_id", "kp", kind.alias("event_type"), outcome.alias("outcome"))


@query(_expanded(f"WITH RECURSIVE {STATES_SQL} SELECT user_id, kp, row_number() OVER (PARTITION BY user_id ORDER BY last_at DESC, kp) AS place FROM es WHERE last_at >= TIMESTAMP '2024-01-20'"))
def latest_states(spark, sf_dir):
    return learning.latest_states(_effective(spark, sf_dir), F.lit("2024-01-20").cast("timestamp")).select("user_id", "kp", "place")


@query("""
WITH n AS (SELECT 'r' || r_regionkey AS id, 0 AS level FROM region UNION ALL SELECT 'n' || n_nationkey, 1 FROM nation UNION ALL SELECT 'c' || c_custkey, 2 FROM customer),
e AS (SELECT 'r' || n_regionkey AS source, 'n' || n_nationkey AS target FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer)
SELECT source, target FROM e WHERE source IN (SELECT id FROM n WHERE level < 2) AND target IN (SELECT id FROM n WHERE level < 2)
""")
def visible_edges(spark, sf_dir):
    r, n, c = (table(spark, sf_dir, x) for x in ("region", "nation", "customer"))
    name = lambda p, k: F.concat(F.lit(p), k)
    nodes = r.select(name("r", "r_regionkey").alias("id"), F.lit(0).alias("level")).union(n.select(name("n", "n_nationkey"), F.lit(1))).union(c.select(name("c", "c_custkey"), F.lit(2)))
    edges = n.select(name("r", "n_regionkey").alias("source"), name("n", "n_nationkey").alias("target")).union(c.select(name("n", "c_nationkey"), name("c", "c_custkey"))).withColumn("relation", F.lit("has"))
    return learning.visible_levels(nodes, edges)[1].select("source", "target")


@query("SELECT vec_id AS key, vec_id * 7 % 3600 AS stored_at FROM embeddings WHERE 3600 - vec_id * 7 % 3600 <= 1800")
def live_cache_entries(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), (F.col("vec_id") * 7 % 3600).alias("stored_at"))
    return retrieval.cache_compact(rows, F.lit(3600))


@query("SELECT item_id, substring(sha256(concat_ws('|', lower(trim(text)), 'c' || (item_id % 4), 'f')), 1, 24) AS key FROM benchmark")
def cache_keys(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", retrieval.cache_key(F.col("text"), F.concat(F.lit("c"), F.col("item_id") % 4), F.lit("f")).alias("key"))


ANSWERS = "(1, '根据教材第3章，栈是后进先出。来源：ds.md', 'knowledge_agent', 'low', array('栈 是 后进先出')), (2, '结论如下。', 'knowledge_agent', 'medium', array('结论')), (3, '答案 Source 2: os.md。来源文件：os.md', 'path_agent', 'high', cast(array() as array<string>))"


@example("""
SELECT * FROM (VALUES (1, '教材第3章', 'ds.md', E'根据教材第3章，栈是后进先出。来源：ds.md\\n⚠️ 此回答可能包含未经验证的内容，请谨慎参考。', '根据教材第3章，栈是后进先出。来源：ds.md', true),
 (2, '', '', E'结论如下。\\n📌 以上回答未检索到充分依据，部分内容为模型推断，仅供参考。', E'结论如下。\\n\\n来源：a.md、b.md', false), (3, '', 'os.md', '答案 Source 2: os.md。来源文件：os.md', '答案 Source 2: os.md。来源文件：os.md', false)) t(id, doubtful, sources, noted, with_sources, fast)
""")
def answer_notes(spark, sf_dir):
    rows = spark.sql(f"SELECT * FROM (VALUES {ANSWERS}) t(id, answer, agent, level, outputs)")
    a, given = F.col("answer"), F.when(F.col("id") == 2, F.array(F.lit("a.md"), F.lit("b.md"))).otherwise(F.array().cast("array<string>"))
    return rows.select(
        "id", F.array_join(govern.unverified_citations(a, F.col("outputs")), ",").alias("doubtful"), F.array_join(govern.sources_of(a), ",").alias("sources"), govern.disclaimer(a, F.col("agent"), F.col("level")).alias("noted"),
        govern.append_sources(a, given).alias("with_sources"), govern.fast_stream(F.when(F.col("id") == 1, "knowledge_agent").otherwise("path_agent"), F.lit(True), [F.lit(False)], F.lit("L1")).alias("fast"),
    )


@query("SELECT doc_id, source, lang AS collection, n_chars AS length FROM documents")
def migrated_columns(spark, sf_dir):
    """Older column names, list columns and hidden ones on the way into a flat store."""
    old = _docs(spark, sf_dir).select("doc_id", F.col("source").alias("file"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("collection"), F.col("lang").alias("category"), F.col("n_chars").alias("length"), F.array("lang").alias("tags"), F.lit(1).alias("_hidden"))
    return files.scalar_columns(files.migrate(old, {"file": "source", "category": "collection"})).select("doc_id", "source", "collection", "length")
