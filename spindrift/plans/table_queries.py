"""Queries of small rules over rows that are made of whole given tables; their examples over literal rows are tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import corpus, dialog, evaluate, govern, graph, learning, questions, retrieval, routing, salvage, tracing
from .graph_queries import EDGES_SQL, _edges
from .registry import query, table


@query("""
WITH c AS (SELECT user_id, count(*) FILTER (WHERE value >= 100) AS p, count(*) FILTER (WHERE value < 100) AS m FROM events GROUP BY user_id), t AS (SELECT user_id, p / CAST(p + m AS DOUBLE) AS s, p + m AS n FROM c WHERE p + m > 0)
SELECT user_id, round(greatest(0.0, least(1.0, (s + 3.8416 / (2.0 * n) - 1.96 * sqrt((s * (1 - s) + 3.8416 / (4.0 * n)) / n)) / (1 + 3.8416 / n))), 6) AS bound FROM t
""")
def wilson_bound(spark, sf_dir):
    """How sure each user's share of high values is."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("value") >= 100).alias("p"), F.count_if(F.col("value") < 100).alias("m"))
    return e.filter("p + m > 0").select("user_id", F.round(tracing.wilson(F.col("p"), F.col("m")), 6).alias("bound"))


@query("""
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || ' 到 ' || strftime(o_orderdate, '%Y-%m') || '底 ' || lpad(CAST(o_orderkey % 12 + 1 AS VARCHAR), 2, '0') || ':' || lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0') AS text FROM orders
""")
def date_normalize(spark, sf_dir):
    """The dates of all orders as Chinese text, and back."""
    d, k = F.col("o_orderdate"), F.col("o_orderkey")
    text = F.concat(F.year(d), F.lit("年"), F.month(d), F.lit("月"), F.dayofmonth(d), F.lit("日 到 "), F.year(d), F.lit("年"), F.month(d), F.lit("月底 "), k % 12 + 1, F.lit("点"), k % 60, F.lit("分"))
    return table(spark, sf_dir, "orders").select("o_orderkey", corpus.normalize_times(corpus.normalize_dates(text)).alias("text"))


@query("""
WITH t AS (SELECT doc_id, coalesce(text, '') || repeat('数据', CAST(doc_id % 200 AS INTEGER)) AS text FROM documents), c AS (SELECT doc_id, length(text) AS n, len(regexp_extract_all(text, '[一-鿿㐀-䶿]')) AS z, len(regexp_extract_all(text, '[a-zA-Z]')) AS l FROM t)
SELECT doc_id, CASE WHEN n >= 50 AND z + l > 0 THEN round(2.0 * least(z, l) / CAST(z + l AS DOUBLE), 3) ELSE 0.0 END AS degree FROM c
""")
def language_mix(spark, sf_dir):
    """All documents with a tail of another script, which grows with the id."""
    text = F.concat(F.coalesce("text", F.lit("")), F.expr("repeat('数据', cast(doc_id % 200 as int))"))
    return table(spark, sf_dir, "documents").select("doc_id", corpus.language_mix(text).alias("degree"))


@query("""
SELECT doc_id, CAST(ceil(length(text) / 200.0) AS BIGINT) AS n, md5(array_to_string(list_transform(range(0, CAST(ceil(length(text) / 200.0) AS BIGINT)), lambda i: substring(text, i * 200 + 1, 200)), '|')) AS digest FROM documents WHERE text IS NOT NULL
""")
def fixed_chunks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", govern.fixed_chunks(F.col("text"), 200).alias("c"))
    return docs.select("doc_id", F.size("c").cast("long").alias("n"), F.md5(F.array_join("c", "|")).alias("digest"))


TREE_SQL = """m AS (SELECT DISTINCT conv_id * 100000 + turn AS id, conv_id AS conversation_id, CASE WHEN turn > 0 THEN conv_id * 100000 + (turn - 1) // 2 END AS parent_id FROM conversations)"""


def _tree(spark, sf_dir):
    """All conversations with their turns as a binary tree."""
    c = table(spark, sf_dir, "conversations")
    parent = F.when(F.col("turn") > 0, F.col("conv_id") * 100000 + F.expr("(turn - 1) div 2"))
    return c.select((F.col("conv_id") * 100000 + F.col("turn")).alias("id"), F.col("conv_id").alias("conversation_id"), parent.alias("parent_id")).distinct()


@query(f"""
WITH {TREE_SQL}, k AS (SELECT parent_id, count(*) AS children FROM m WHERE parent_id IS NOT NULL GROUP BY parent_id)
SELECT m.id, row_number() OVER (PARTITION BY conversation_id, m.parent_id ORDER BY m.id) - 1 AS siblings_order, coalesce(children, 0) AS children FROM m LEFT JOIN k ON k.parent_id = m.id
""")
def sibling_order(spark, sf_dir):
    return dialog.child_counts(dialog.sibling_order(_tree(spark, sf_dir))).select("id", "siblings_order", "children")


@query("WITH c AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) SELECT user_id, n, n >= 16 AND n % 16 = 0 AS due FROM c")
def summary_trigger(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n")).select("user_id", "n", dialog.summary_due(F.col("n")).alias("due"))


@query("""
WITH s AS (SELECT user_id AS question_id, event_id, value < 100 AS wrong, lag(value < 100) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events WHERE value IS NOT NULL)
SELECT question_id, count(*) FILTER (WHERE before AND NOT wrong) AS redo_count, arg_max(wrong, event_id) AS is_wrong FROM s GROUP BY question_id
""")
def redo_count(spark, sf_dir):
    """Each user's events as grades of one question."""
    e = table(spark, sf_dir, "events").filter("value is not null")
    return questions.redo_counts(e.select(F.col("user_id").alias("question_id"), F.col("event_id").alias("at"), (F.col("value") < 100).alias("is_wrong")))


@query("""
WITH r AS (SELECT user_id, event_id, CASE WHEN event_id % 3 > 0 THEN event_id % 10 / 10.0 END AS q, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE value < 100)
SELECT user_id, event_id AS id FROM r WHERE n <= 20 AND (q IS NULL OR q >= 0.5)
""")
def wrong_questions(spark, sf_dir):
    """Each user's twenty latest low events, but for poor ones."""
    i = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(i.alias("id"), "user_id", F.col("ts").alias("created_at"), (F.col("value") < 100).alias("is_wrong"), F.when(i % 3 > 0, i % 10 / 10.0).alias("quality_score"))
    return questions.wrong_questions(rows, 20).select("user_id", "id")


@query("""
SELECT 'n' || (user_id % 1000) AS name, arg_max(event_type, event_id) AS category, arg_max(props, event_id) AS description, 'f' || (arg_max(user_id, event_id) % 7) AS source_file, max(event_id) AS seq FROM events GROUP BY 1
""")
def kg_upsert(spark, sf_dir):
    """All events as writes of nodes; each node is as its last write left it."""
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("n"), F.col("user_id") % 1000).alias("name"), F.col("event_type").alias("category"), F.col("props").alias("description"), F.concat(F.lit("f"), F.col("user_id") % 7).alias("source_file"), F.col("event_id").alias("seq"))
    return graph.upsert_nodes(e.filter("seq % 2 = 0"), e.filter("seq % 2 = 1"))


def _parts(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("name"), "p_partkey")


@query(f"WITH {EDGES_SQL} SELECT source, target FROM edges WHERE CAST(source[2:] AS BIGINT) NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 3 = 0) AND CAST(target[2:] AS BIGINT) NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 3 = 0)")
def kg_delete(spark, sf_dir):
    """The edges that are left when every third part goes."""
    return graph.delete(_parts(spark, sf_dir), _edges(spark, sf_dir), F.col("p_partkey") % 3 == 0)[1].select("source", "target")


@query(f"WITH {EDGES_SQL}, n AS (SELECT 'p' || p_partkey AS name FROM part WHERE p_partkey % 2 = 0) SELECT source, target FROM edges WHERE source IN (SELECT name FROM n) AND target IN (SELECT name FROM n)")
def kg_import(spark, sf_dir):
    """The edges between even parts."""
    return graph.import_source(_parts(spark, sf_dir).filter("p_partkey % 2 = 0"), _edges(spark, sf_dir)).select("source", "target")


_AGENT_CASE = " ".join(f"WHEN regexp_matches(t, '{words}') THEN '{name}'" for name, words in routing.AGENTS)
_ASKED = ["出题", "批改", "学习计划", "什么是", "路径", "复习", "help"]
_ASKED_SQL = "CASE turn % 7 " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(_ASKED)) + " END"


@query(f"WITH q AS (SELECT conv_id, turn, lower({_ASKED_SQL} || ' ' || coalesce(text, '')) AS t FROM conversations) SELECT conv_id, turn, CASE {_AGENT_CASE} END AS agent FROM q")
def agent_route(spark, sf_dir):
    """All turns of all conversations, each with a request in front."""
    ask = F.element_at(F.array(*map(F.lit, _ASKED)), (F.col("turn") % 7 + 1).cast("int"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", routing.agent(F.concat(ask, F.lit(" "), F.coalesce("text", F.lit("")))).alias("agent"))


@query("SELECT event_id, CASE WHEN event_id % 3 < 2 THEN props END AS json FROM events")
def loose_json(spark, sf_dir):
    """The properties of all events, in fences, within text, or broken."""
    i = F.col("event_id") % 3
    text = F.when(i == 0, F.concat(F.lit("answer:\n```json\n"), "props", F.lit("\n``` end"))).when(i == 1, F.concat(F.lit("see "), "props", F.lit(" done"))).otherwise(F.concat(F.lit("cut "), F.expr("substring(props, 1, length(props) - 1)")))
    return table(spark, sf_dir, "events").select("event_id", questions.loose_json(text).alias("json"))


@query("SELECT event_id, event_type || ',' || user_id AS points FROM events")
def knowledge_points(spark, sf_dir):
    """Points of all events as a JSON list or with commas of two kinds."""
    i, user = F.col("event_id") % 3, F.col("user_id").cast("string")
    value = F.when(i == 0, F.to_json(F.array("event_type", user, F.lit("")))).when(i == 1, F.concat("event_type", F.lit(", "), user)).otherwise(F.concat("event_type", F.lit("，"), user))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(retrieval.knowledge_points(value), ",").alias("points"))


@query("SELECT doc_id, 'q' || coalesce(lang, 'xx') || ' done' AS text FROM documents")
def repeats_collapsed(spark, sf_dir):
    """A word for each document, from four to seven times in a row."""
    text = F.concat(F.expr("repeat(concat('q', coalesce(lang, 'xx')), cast(doc_id % 4 + 4 as int))"), F.lit(" done"))
    return table(spark, sf_dir, "documents").select("doc_id", corpus.collapse_repeats(text).alias("text"))


PAYLOAD_SQL = """e AS (SELECT event_id, event_id // 20 AS part, '{"name":"e' || event_id || '","description":"' || event_type || ' \\"q\\" ]}"}' AS item FROM events),
c AS (SELECT part, event_id, item, sum(length(item) + 1) OVER (PARTITION BY part ORDER BY event_id) + 9 AS ends, sum(length(item) + 1) OVER (PARTITION BY part) + 9 AS whole FROM e)"""


@query(f"""
WITH {PAYLOAD_SQL}, k AS (SELECT part, event_id, ends, whole, CASE WHEN part % 12 = 11 THEN whole + 2 ELSE (whole + 2) * (part % 12) // 12 END AS cut FROM c)
SELECT part, count(*) FILTER (WHERE ends <= cut) AS n, md5(coalesce(string_agg(CASE WHEN ends <= cut THEN 'e' || event_id END, ',' ORDER BY event_id), '')) AS names FROM k GROUP BY part
""")
def salvaged_payloads(spark, sf_dir):
    """All events as nodes of payloads of twenty, each cut off somewhere; the nodes that are whole come back."""
    e = table(spark, sf_dir, "events")
    item = F.concat(F.lit('{"name":"e'), "event_id", F.lit('","description":"'), "event_type", F.lit(' \\"q\\" ]}"}'))
    rows = e.groupBy(F.expr("event_id div 20").alias("part")).agg(F.array_sort(F.collect_list(F.struct("event_id", item.alias("item")))).alias("l"))
    text = F.concat(F.lit('{"nodes":['), F.array_join(F.transform("l", lambda x: x["item"]), ","), F.lit("]}"))
    rows = rows.select("part", text.alias("t")).withColumn("cut", F.when(F.col("part") % 12 == 11, F.length("t")).otherwise(F.floor(F.length("t") * (F.col("part") % 12) / 12)).cast("int"))
    found = graph.coerce_payload(salvage.complete(F.expr("substring(t, 1, cut)")))[0]
    names = F.transform(F.coalesce(found, F.expr("array()")), lambda x: x["name"])
    return rows.select("part", F.size(names).cast("long").alias("n"), F.md5(F.array_join(names, ",")).alias("names"))


@query("""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, CASE WHEN doc_id % 3 = 0 THEN 'given ' || doc_id ELSE NULL END AS given,
  CASE doc_id % 4 WHEN 0 THEN coalesce(lang, 'xx') || ' zqxj' WHEN 1 THEN 'zqxj qjxz' WHEN 2 THEN '12.3' ELSE coalesce(regexp_extract(text, '[a-z]{4,}'), '') || ' zqxj' END AS candidate FROM documents),
r AS (SELECT *, given IS NULL AND row_number() OVER (PARTITION BY given IS NULL ORDER BY doc_id) <= 50 AS allowed FROM d),
g AS (SELECT *, list_filter(regexp_extract_all(lower(candidate), '[a-z0-9_]+'), lambda w: w <> '') AS words, substring(trim(regexp_extract(text, '(?m)^\\s*(\\S.*)$', 1)), 1, 40) AS line FROM r),
m AS (SELECT *, CASE WHEN given IS NOT NULL THEN 'given' WHEN NOT allowed THEN 'degraded' WHEN candidate <> '12.3' AND 2 * len(list_filter(words, lambda w: contains(lower(text), w))) >= len(words) THEN 'checked' ELSE 'rejected' END AS method FROM g)
SELECT doc_id, method, CASE method WHEN 'given' THEN given WHEN 'checked' THEN trim(candidate) WHEN 'degraded' THEN '[推测]' || trim(candidate) ELSE CASE WHEN line = '' THEN '[未命名文档]' ELSE '[推测]' || line END END AS heading FROM m
""")
def grounded_headings(spark, sf_dir):
    """Candidates for the headings of all documents, checked for the first fifty that need it."""
    i = F.col("doc_id")
    word = F.regexp_extract(F.coalesce("text", F.lit("")), "[a-z]{4,}", 0)
    candidate = F.when(i % 4 == 0, F.concat(F.coalesce("lang", F.lit("xx")), F.lit(" zqxj"))).when(i % 4 == 1, "zqxj qjxz").when(i % 4 == 2, "12.3").otherwise(F.concat(word, F.lit(" zqxj")))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.when(i % 3 == 0, F.concat(F.lit("given "), i)).alias("given"), candidate.alias("candidate"))
    return salvage.headings(docs, 50)


@query("""
SELECT count(*) AS total, count(*) FILTER (WHERE turn % 3 = 0) AS triggered, round(avg(CASE WHEN turn % 3 = 0 THEN 1.0 ELSE 0.0 END), 4) AS rate, round(coalesce(avg(CASE WHEN turn % 3 = 0 THEN conv_id % 4 END), 0.0), 4) AS avg_parts FROM conversations
""")
def decompose_rates(spark, sf_dir):
    """Every third turn of all conversations as a question that was taken apart."""
    rows = table(spark, sf_dir, "conversations").select((F.col("turn") % 3 == 0).alias("triggered"), (F.col("conv_id") % 4).alias("parts"))
    return evaluate.decompose_stats(rows)


@query("""
SELECT user_id, event_id % 9 AS kp, event_id AS seq, round(value / 707.0, 3) AS mastery, round(value / 911.0, 3) AS confidence, round(value / 1013.0, 3) AS effective_score, round(-value / 1103.0, 3) AS delta, event_type,
  CASE event_type WHEN 'click' THEN 'Clicked' WHEN 'purchase' THEN 'Bought' ELSE event_type END AS event_label FROM events
""")
def history_rows(spark, sf_dir):
    """All events as rows of a history for display."""
    v = F.col("value")
    rows = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 9).alias("kp"), F.col("event_id").alias("seq"), (v / 707.0).alias("mastery"), (v / 911.0).alias("confidence"), (v / 1013.0).alias("effective_score"), (-v / 1103.0).alias("delta"), "event_type")
    return learning.history_points(rows, {"click": "Clicked", "purchase": "Bought"})
