"""Queries of the composed retrieval, repair of text, and what follows from mastery."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import learning, repair, retrieval, search
from .registry import example, inline, query, table
from .routing_queries import _questions


def _corpus(spark, sf_dir):
    """All documents as chunks: section = source, places in the section, embedding by id; null without a vector."""
    from .search_queries import _chunks

    v = table(spark, sf_dir, "embeddings")
    c = _chunks(spark, sf_dir).withColumnRenamed("doc_id", "chunk_id").withColumn("content_type", F.when(F.col("chunk_id") % 4 == 0, "section").otherwise("text"))
    return c.join(v.select(F.col("vec_id").alias("chunk_id"), "embedding"), "chunk_id", "left")


def _batch(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), search.query_terms(F.col("text")).alias("terms"))
    return b.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding"), "query_id", "left")


@query()
def retrieve_documents(spark, sf_dir):
    return retrieval.retrieve(_batch(spark, sf_dir), _corpus(spark, sf_dir), retrieval.Options(threshold=0.03))


@query()
def retrieve_composed(spark, sf_dir):
    """Routes, weights and depth by the kind of each benchmark question."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    questions = b.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding"), "query_id", "left")
    return retrieval.retrieve_composed(questions, _corpus(spark, sf_dir), retrieval.Options(threshold=0.03))


@query()
def retrieve_expanded(spark, sf_dir):
    chunks = _corpus(spark, sf_dir)
    found = retrieval.retrieve(_batch(spark, sf_dir), chunks, retrieval.Options(threshold=0.03))
    return retrieval.expand(found, chunks)


@query()
def retrieve_with_retry(spark, sf_dir):
    return retrieval.retrieve_with_retry(_batch(spark, sf_dir), _corpus(spark, sf_dir), retrieval.Options(threshold=0.06))


@query()
def retrieval_metrics(spark, sf_dir):
    """What each stage and route of a retrieval lets through, observed in the one run."""
    return retrieval.traced(_batch(spark, sf_dir), _corpus(spark, sf_dir))[1]


@query()
def retrieval_trace(spark, sf_dir):
    return retrieval.trace(_batch(spark, sf_dir), _corpus(spark, sf_dir))


@query()
def evidence_context(spark, sf_dir):
    from .search_queries import _evidence

    rows = _evidence(spark, sf_dir).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("evidence_id"), "text"), "evidence_id")
    return retrieval.evidence(rows).select("query_id", "used", "n", F.length("context").alias("n_chars"))


@example("""
SELECT * FROM (VALUES (1, 'concept_meta,comparison_meta,structured_meta,merged_qa_meta'), (2, 'concept_meta,formula_meta,table_meta'), (3, 'code_meta,structured_meta,section_meta,formula_meta,table_meta'), (4, 'section_meta'), (5, 'exercise_meta,merged_qa_meta'), (6, 'answer_meta,merged_qa_meta'), (7, 'section_meta'), (8, 'concept_meta,comparison_meta,merged_qa_meta')) t(id, routes)
""")
def metadata_routes(spark, sf_dir):
    rows, f = _questions(spark)
    f = dict(f) | {"short": F.lit(False)}
    listed = retrieval.metadata_routes(f, F.col("text"), F.col("text"))
    return rows.select("id", F.array_join(F.transform(listed, lambda r: r["route"]), ",").alias("routes"))


@example("SELECT * FROM (VALUES (1, 0, '栈', 1.0::DOUBLE), (1, 1, '表', 0.5::DOUBLE), (1, 2, '无', 0.5::DOUBLE)) t(query_id, pos, term, specificity)")
def term_specificity(spark, sf_dir):
    words = inline(spark, "('ds', '栈'), ('ds', '链表'), ('os', '页表')", "collection, word")
    return retrieval.specificity(inline(spark, "(1, 0, '栈'), (1, 1, '表'), (1, 2, '无')", "query_id, pos, term"), words)


@example("SELECT * FROM (VALUES (1, '栈是什么'), (2, '图 学习路线 重点章节'), (3, '链表'), (4, '死锁'), (5, '任意')) t(id, query)")
def agent_queries(spark, sf_dir):
    rows = inline(spark, "(1, 'grading_agent', '题目：栈是什么 学生答案：后进先出'), (2, 'path_agent', '图应该怎么学'), (3, 'question_agent', '出一道关于链表的选择题'), (4, 'question_agent', '给我出死锁选择题'), (5, 'knowledge_agent', '任意')", "id, agent, text")
    return rows.select("id", retrieval.agent_query(F.col("text"), F.col("agent")).alias("query"))


@example("SELECT * FROM (VALUES (1, '进程|线程'), (2, '死锁|什么是死锁')) t(id, topics)")
def topic_candidates(spark, sf_dir):
    rows = spark.sql("SELECT * FROM VALUES (1, '进程和线程的区别', cast(array() as array<string>)), (2, '什么是死锁', array('死锁')) AS t(id, text, terms)")
    found = retrieval.topic_candidates(F.col("text"), F.col("terms"))
    return rows.select("id", F.array_join(F.filter(found, lambda x: ~F.contains(x, F.lit("和"))), "|").alias("topics"))


@example("SELECT * FROM (VALUES (1, 'a,b'), (2, 'a,b,c'), (3, '')) t(id, points)")
def knowledge_points(spark, sf_dir):
    rows = spark.createDataFrame([(1, '["a", "b", ""]'), (2, "a, b，c"), (3, " ")], "id int, value string")
    return rows.select("id", F.array_join(retrieval.knowledge_points(F.col("value")), ",").alias("points"))


@query("WITH d AS (SELECT doc_id, lang, n_chars FROM documents), k AS (SELECT lang AS key, max_by(doc_id, n_chars * 100000 + doc_id) AS id, max(n_chars * 100000 + doc_id) AS stored_at FROM d GROUP BY lang) SELECT key, id, stored_at FROM k ORDER BY stored_at DESC LIMIT 3")
def cache_store(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("key"), F.col("doc_id").alias("id"), (F.col("n_chars") * 100000 + F.col("doc_id")).alias("stored_at"))
    return retrieval.cache_store(d.filter("id % 2 = 0"), d.filter("id % 2 = 1"), 3)


@example("SELECT * FROM (VALUES (1, 'a sentence goes on. Next line'), (2, E'这是一个例子。\\n# 标题'), (3, 'hyphenated word'), (4, E'alpha one\\nalpha one two\\nalpha two\\n\\nzeta nine\\nzeta nine ten\\nzeta ten')) t(id, text)")
def pdf_repair(spark, sf_dir):
    rows = spark.createDataFrame([(1, "a sentence\ngoes on. Next\nline"), (2, "这是一\n个例子。\n# 标题"), (3, "hyphen-\nated\nword")], "id int, text string")
    columns = spark.createDataFrame([(4, "alpha one\nzeta nine\nalpha one two\nzeta nine ten\nalpha two\nzeta ten")], "id int, text string")
    split = F.pandas_udf(lambda s: s.map(repair.split_columns), "string")
    return rows.select("id", repair.repair_layout(F.col("text")).alias("text")).unionByName(columns.select("id", split("text").alias("text")))


@query()
def semantic_segments(spark, sf_dir):
    return repair.segments(table(spark, sf_dir, "documents"))


SYNONYMS = {"BST": "二叉搜索树", "BST树": "二叉搜索树", "二叉排序树": "二叉搜索树", "OS": "操作系统", "哈希表": "散列表"}


@example("SELECT * FROM (VALUES (1, '二叉搜索树和散列表', 2, 'BST树和哈希表 二叉搜索树 二叉排序树 散列表'), (2, 'POSIX 操作系统', 1, 'POSIX OS 操作系统'), (3, 'none', 0, 'none')) t(id, normal, n, expanded)")
def synonyms(spark, sf_dir):
    rows = inline(spark, "(1, 'BST树和哈希表'), (2, 'POSIX OS'), (3, 'none')", "id, text")
    normal, n = repair.normalize_synonyms(F.col("text"), SYNONYMS, word_boundary=False)
    bounded, m = repair.normalize_synonyms(F.col("text"), SYNONYMS, word_boundary=True)
    ascii_only = F.col("text").contains("POSIX")
    return rows.select("id", F.when(ascii_only, bounded).otherwise(normal).alias("normal"), F.when(ascii_only, m).otherwise(n).alias("n"), repair.expand_query(F.col("text"), SYNONYMS).alias("expanded"))


WEAK = "(1, 'c', 0.1D, 1), (1, 'x', 0.25D, 2), (2, 'b', 0.2D, 1)"
EDGES = "('a', 'b'), ('b', 'c'), ('z', 'c')"


@example("SELECT * FROM (VALUES (1, 'c', 0.1::DOUBLE, 'b,z,a', '10%: prerequisites first'), (1, 'x', 0.25::DOUBLE, '', '25%: review'), (2, 'b', 0.2::DOUBLE, 'a', '20%: prerequisites first')) t(user_id, name, effective_score, prerequisites, reason)")
def recommendations(spark, sf_dir):
    return learning.recommendations(inline(spark, WEAK, "user_id, name, effective_score, rank"), inline(spark, EDGES, "source, target"))


@example("SELECT * FROM (VALUES (1, 'c', 0, 'b', 0.7::DOUBLE), (1, 'c', 1, 'c', 0.1::DOUBLE), (1, 'x', 0, 'x', 0.25::DOUBLE), (2, 'b', 0, 'a', NULL), (2, 'b', 1, 'b', 0.2::DOUBLE)) t(user_id, target, pos, name, score)")
def learning_path(spark, sf_dir):
    return learning.learning_paths(inline(spark, WEAK, "user_id, name, effective_score, rank"), inline(spark, EDGES, "source, target"), inline(spark, "(1, 'b', 0.7D)", "user_id, name, score"))


@example("SELECT * FROM (VALUES (1, E'c 10%; x 25%\\nlate; early'), (2, 'b 20%'), (3, 'only')) t(user_id, context)")
def session_context(spark, sf_dir):
    talks = inline(spark, "(1, 'early', 1), (1, 'late', 2), (1, '', 3), (3, 'only', 1)", "user_id, summary, updated_at")
    return learning.session_context(inline(spark, WEAK, "user_id, name, effective_score, rank"), talks)


@example("SELECT * FROM (VALUES (1, '7'), (2, '2'), (3, '1,2')) t(doc_id, kp_ids)")
def points_of_docs(spark, sf_dir):
    docs = inline(spark, "(1, '[7]', 'a', ''), (2, null, 'b', '[a]'), (3, '', 'zz', '[a > b]'), (4, null, 'none', '')", "doc_id, kp_json, name, heading")
    found = learning.points_of_docs(docs, inline(spark, "(1, 'a'), (2, 'b')", "kp_id, name"))
    return found.select("doc_id", F.array_join("kp_ids", ",").alias("kp_ids"))


@example("SELECT * FROM (VALUES (1, 1), (2, 2), (3, 1), (4, NULL)) t(id, kp_id)")
def resolve_point(spark, sf_dir):
    rows = inline(spark, "(1, 'a', 'b', 'b', 'x'), (2, 'zz', 'b', 'a', 'x'), (3, 'zz', 'zz', 'zz', 'x'), (4, 'zz', 'zz', 'zz', 'none')", "id, name, tail, topic, collection")
    return learning.resolve_point(rows, inline(spark, "(1, 'a', 'x'), (2, 'b', 'x')", "kp_id, name, category"))


@example("SELECT * FROM (VALUES (1, 'c1', 'search', 'q', 'found'), (1, 'c2', 'kg', 'p', NULL)) t(message_id, call_id, tool, input, output)")
def tool_steps(spark, sf_dir):
    rows = spark.createDataFrame([(1, "assistant", None, None, [("c1", "search", "q"), ("c2", "kg", "p")]), (2, "tool", "c1", "found", None)], "id int, role string, call_id string, text string, calls array<struct<call_id: string, tool: string, input: string>>")
    return learning.tool_steps(rows)


@example("SELECT * FROM (VALUES (1, true, false, 'source: good'), (2, false, true, ''), (3, false, true, '')) t(run_id, sufficient, all_empty, snippets)")
def retrieval_guard(spark, sf_dir):
    rows = inline(spark, "(1, 1, 'no result'), (1, 2, 'source: good'), (2, 1, 'no result'), (3, 1, ' ')", "run_id, seq, output")
    return learning.guard(rows, "no result", "source")


@example("SELECT * FROM (VALUES (1, E'aa key\\n\\ncc key\\n\\n[...部分检索结果已按相关性筛选截断]'), (2, 'short')) t(id, text)")
def context_truncate(spark, sf_dir):
    rows = spark.createDataFrame([(1, "aa key\n\n" + "b" * 40 + " key key\n\ncc key\n\ndd", ["key"]), (2, "short", ["x"])], "id int, text string, terms array<string>")
    return rows.select("id", learning.truncate_context(F.col("text"), F.col("terms"), 30).alias("text"))


@example("SELECT * FROM (VALUES ('链表', '链表'), ('BST', 'bst tree')) t(label, name)")
def focus_node(spark, sf_dir):
    return learning.focus_node(inline(spark, "('链表'), ('双链表'), ('bst tree')", "name"), inline(spark, "('链表'), ('BST'), ('none')", "label"))


@example("SELECT * FROM (VALUES (1, 1, 's', 'step'), (2, 1, 'f', 'src'), (3, 1, 'answer', 'text')) t(id, pos, title, snippet)")
def evidence_items(spark, sf_dir):
    steps = inline(spark, "(1, 1, 's', 'step')", "id, pos, title, text")
    sources = inline(spark, "(1, 1, 'f', 'src'), (2, 1, 'f', 'src')", "id, pos, source, text")
    return learning.evidence_items(steps, sources, inline(spark, "(1, 'text'), (2, 'text'), (3, 'text')", "id, text"))


@example("SELECT * FROM (VALUES (1, E'[来源: a]\\nx\\n\\n[来源: unknown]\\ny')) t(query_id, text)")
def formatted_docs(spark, sf_dir):
    return retrieval.format_docs(inline(spark, "(1, 1, 'a', 'x'), (1, 2, null, 'y'), (1, 6, 'b', 'z')", "query_id, rank, source, text"))


@example("SELECT * FROM (VALUES (1, 'txt_' || left(sha256('c1'), 16), 0.5::DOUBLE), (2, 'txt_' || left(sha256('f:body'), 16), 0.2::DOUBLE), (3, 'txt_' || left(sha256('unknown:body'), 16), 0.0::DOUBLE)) t(id, evidence_id, score)")
def text_evidence(spark, sf_dir):
    rows = inline(spark, "(1, 'c1', 'f', 'body', 0.5D, 0.1D), (2, '', 'f', 'body', 0D, 0.2D), (3, null, null, 'body', 0D, null)", "id, chunk_id, source, text, rerank_score, recall_score")
    return retrieval.text_evidence(rows).select("id", "evidence_id", "score")
