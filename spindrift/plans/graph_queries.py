"""Queries of the knowledge graph; edges are neighbouring parts of an order."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from ..operators import graph
from .registry import example, inline, query, table

EDGES_SQL = "edges AS (SELECT DISTINCT 'p' || a AS source, 'p' || b AS target FROM (SELECT l_partkey AS a, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS b FROM lineitem) WHERE a IS NOT NULL AND b IS NOT NULL)"


def _edges(spark, sf_dir):
    """Edges of every order between the real part keys."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    l = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), F.lead("l_partkey").over(w).alias("b")).filter("a is not null and b is not null")
    return l.select(F.concat(F.lit("p"), "a").alias("source"), F.concat(F.lit("p"), "b").alias("target")).distinct()


def _starts(spark):
    return inline(spark, "('p1'), ('p7'), ('p30')", "start")


def _reach_sql(depth: int, source: str, target: str) -> str:
    return f"""r AS (SELECT s AS start, e.{target} AS name, 1 AS hops FROM (SELECT unnest(['p1', 'p7', 'p30']) AS s) JOIN edges e ON e.{source} = s
  UNION SELECT r.start, e.{target}, r.hops + 1 FROM r JOIN edges e ON e.{source} = r.name WHERE r.hops < {depth})"""


@query(f"WITH RECURSIVE {EDGES_SQL}, {_reach_sql(2, 'source', 'target')} SELECT start, name, min(hops) AS hops FROM r GROUP BY ALL")
def kg_successors(spark, sf_dir):
    return graph.neighbours(_edges(spark, sf_dir), _starts(spark), 2)


@query(f"WITH RECURSIVE {EDGES_SQL}, {_reach_sql(3, 'target', 'source')} SELECT start, name, min(hops) AS hops FROM r GROUP BY ALL")
def kg_prerequisites(spark, sf_dir):
    return graph.neighbours(_edges(spark, sf_dir), _starts(spark), 3, reverse=True)


@query(f"""
WITH RECURSIVE {EDGES_SQL}, p AS (
  SELECT t AS target, e.source AS head, [e.source, t] AS path, [e.source || '>' || t] AS used, 1 AS length FROM (SELECT unnest(['p1', 'p7', 'p30']) AS t) JOIN edges e ON e.target = t
  UNION ALL SELECT p.target, e.source, [e.source] || p.path, p.used || [e.source || '>' || e.target], p.length + 1 FROM p JOIN edges e ON e.target = p.head WHERE p.length < 3 AND NOT list_contains(p.used, e.source || '>' || e.target)
), k AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY length, array_to_string(path, chr(1))) AS rank FROM p)
SELECT target, array_to_string(path, ' ') AS path, length, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 3
""")
def kg_paths(spark, sf_dir):
    found = graph.paths(_edges(spark, sf_dir), _starts(spark).withColumnRenamed("start", "target"), 3)
    return found.select("target", F.array_join("path", " ").alias("path"), "length", "rank")


@query(f"""
WITH RECURSIVE {EDGES_SQL}, down AS (SELECT s AS start, e.target AS name, 1 AS hops FROM (SELECT unnest(['p1', 'p7', 'p30']) AS s) JOIN edges e ON e.source = s UNION SELECT d.start, e.target, d.hops + 1 FROM down d JOIN edges e ON e.source = d.name WHERE d.hops < 2),
up AS (SELECT s AS start, e.source AS name, 1 AS hops FROM (SELECT unnest(['p1', 'p7', 'p30']) AS s) JOIN edges e ON e.target = s UNION SELECT d.start, e.source, d.hops + 1 FROM up d JOIN edges e ON e.target = d.name WHERE d.hops < 2),
n AS (SELECT start, name FROM down UNION SELECT start, name FROM up), k AS (SELECT start, name, row_number() OVER (PARTITION BY start ORDER BY name) AS rank FROM n WHERE start <> name)
SELECT start, name, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 30
""")
def kg_subgraph_nodes(spark, sf_dir):
    return graph.subgraph(_edges(spark, sf_dir), _starts(spark))[0]


@query(f"""
WITH RECURSIVE {EDGES_SQL}, both_ways AS (SELECT source, target FROM edges UNION SELECT target, source FROM edges),
r AS (SELECT s AS start, s AS name, 0 AS hops FROM (SELECT unnest(['p1', 'p7', 'p30']) AS s) UNION SELECT r.start, e.target, r.hops + 1 FROM r JOIN both_ways e ON e.source = r.name WHERE r.hops < 1),
n AS (SELECT DISTINCT start, name FROM r), k AS (SELECT a.start, e.source, e.target, row_number() OVER (PARTITION BY a.start ORDER BY e.source, e.target) AS rank FROM edges e JOIN n a ON a.name = e.source JOIN n b ON b.name = e.target AND a.start = b.start)
SELECT start, source, target, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 40
""")
def kg_subgraph_edges(spark, sf_dir):
    return graph.subgraph(_edges(spark, sf_dir), _starts(spark), depth=1)[1]


@example("SELECT * FROM (VALUES ('死锁', '死锁', 0, 1.0::DOUBLE), ('BST', '二叉搜索树', 1, 0.9::DOUBLE), ('链表', '双链表', 2, 0.666667::DOUBLE), ('链表', '循环链表', 2, 0.5::DOUBLE)) t(topic, name, tier, score)")
def kg_resolve(spark, sf_dir):
    nodes = inline(spark, "('死锁'), ('死锁预防'), ('二叉搜索树'), ('双链表'), ('循环链表'), ('一种特别长的链表结构名称')", "name")
    topics = inline(spark, "('死锁'), ('BST'), ('链表'), ('无')", "topic")
    synonyms = inline(spark, "('BST', '二叉搜索树'), ('BST', '平衡树')", "topic, synonym")
    return graph.resolve(topics, nodes, synonyms).select("topic", "name", "tier", F.round("score", 6).alias("score"))


@query("""
WITH pts AS (SELECT c_name AS name, r_name AS subject, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
ch AS (SELECT r_name AS subject, digit AS word, 'ch' || digit AS chapter, CAST(digit AS INTEGER) AS priority FROM region, (SELECT unnest(['1', '2', '3']) AS digit)),
f AS (SELECT p.name, p.subject, min_by(ch.chapter, ch.priority) AS chapter FROM pts p JOIN ch ON p.subject = ch.subject AND contains(p.name, ch.word) GROUP BY ALL)
SELECT p.subject, coalesce(f.chapter, '其他') AS chapter, count(*) AS points FROM pts p LEFT JOIN f ON p.name = f.name AND p.subject = f.subject GROUP BY ALL
""")
def kg_rollup(spark, sf_dir):
    return _rollup(spark, sf_dir)[0]


def _rollup(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    points = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("c_name").alias("name"), F.col("r_name").alias("subject"))
    words = inline(spark, "('1', 'ch1', 1), ('2', 'ch2', 2), ('3', 'ch3', 3)", "word, chapter, priority")
    chapters = t("region").select(F.col("r_name").alias("subject")).crossJoin(F.broadcast(words))
    edges = points.select(F.col("name").alias("source")).withColumn("target", F.concat(F.expr("left(source, length(source) - 1)"), F.lit("1")))
    return graph.rollup(points, chapters, edges)


@query("""
WITH pts AS (SELECT c_name AS name, r_name AS subject FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
ch AS (SELECT r_name AS subject, digit AS word, 'ch' || digit AS chapter, CAST(digit AS INTEGER) AS priority FROM region, (SELECT unnest(['1', '2', '3']) AS digit)),
f AS (SELECT p.name, p.subject, min_by(ch.chapter, ch.priority) AS chapter FROM pts p JOIN ch ON p.subject = ch.subject AND contains(p.name, ch.word) GROUP BY ALL),
e AS (SELECT p.name, p.subject, p.subject || '/' || coalesce(f.chapter, '其他') AS c FROM pts p LEFT JOIN f ON p.name = f.name AND p.subject = f.subject)
SELECT least(x.c, y.c) AS a, greatest(x.c, y.c) AS b, count(*) AS links, bool_or(x.subject <> y.subject) AS cross_subject FROM e x JOIN e y ON y.name = left(x.name, length(x.name) - 1) || '1' WHERE x.c <> y.c GROUP BY ALL
""")
def kg_rollup_links(spark, sf_dir):
    return _rollup(spark, sf_dir)[1]


def _nodes(spark):
    return inline(spark, "('a', 'x', 'f1', 1), ('b', 'x', 'f2', 2), ('c', 'y', 'gone', 3), ('a', 'y', 'f2', 4)", "name, category, source_file, seq")


@example("SELECT * FROM (VALUES ('a', 'y', 'f2', 4), ('b', 'x', 'f2', 2), ('c', 'y', 'gone', 3)) t(name, category, source_file, seq)")
def kg_upsert(spark, sf_dir):
    rows = _nodes(spark)
    return graph.upsert_nodes(rows.filter("seq < 3"), rows.filter("seq >= 3"))


@example("SELECT 3::BIGINT AS nodes, 2::BIGINT AS edges, 1::BIGINT AS orphans, 0.3333::DOUBLE AS orphan_ratio")
def kg_orphans(spark, sf_dir):
    nodes = graph.upsert_nodes(_nodes(spark).limit(0), _nodes(spark))
    return graph.health(nodes, inline(spark, "('a', 'b'), ('b', 'c')", "source, target"), inline(spark, "('f1'), ('f2')", "source_file"))


@example("SELECT * FROM (VALUES ('a', 'b'), ('c', 'd')) t(source, target) WHERE source <> 'a'")
def kg_delete(spark, sf_dir):
    nodes, edges = graph.delete(inline(spark, "('a', 'f1'), ('b', 'f2'), ('c', 'f2'), ('d', 'f2')", "name, source_file"), inline(spark, "('a', 'b'), ('c', 'd')", "source, target"), F.col("source_file") == "f1")
    return edges.select("source", "target")


@example("SELECT * FROM (VALUES ('a', 'b')) t(source, target)")
def kg_import(spark, sf_dir):
    return graph.import_source(inline(spark, "('a'), ('b')", "name"), inline(spark, "('a', 'b'), ('a', 'z')", "source, target")).select("source", "target")


@example("SELECT * FROM (VALUES (1, 'a,b', 'a>b:RELATED_TO,b>a:PREREQUISITE_OF')) t(id, nodes, edges)")
def kg_payload(spark, sf_dir):
    rows = spark.createDataFrame([(1, '{"nodes": [{"name": "a"}, {"title": "b"}, {"x": 1}], "edges": [{"from": "a", "to": "b", "type": "other"}, {"source": "b", "target": "a", "relation": "prerequisite_of"}]}')], "id int, payload string")
    nodes, edges = graph.coerce_payload(F.col("payload"))
    text = F.transform(edges, lambda e: F.concat(e["source"], F.lit(">"), e["target"], F.lit(":"), e["relation"]))
    return rows.select("id", F.array_join(F.transform(nodes, lambda n: n["name"]), ",").alias("nodes"), F.array_join(text, ",").alias("edges"))
