"""Knowledge graph: node resolution, n-hop neighbours, paths, subgraphs, rollups, upserts, orphans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .search import top_k


def char_jaccard(a: Column, b: Column) -> Column:
    x, y = (F.array_distinct(F.filter(F.split(c, ""), lambda s: s != "")) for c in (a, b))
    union = F.size(F.array_union(x, y))
    return F.when(union > 0, F.size(F.array_intersect(x, y)) / union).otherwise(0.0)


def resolve(topics: DataFrame, nodes: DataFrame, synonyms: DataFrame, least: float = 0.4) -> DataFrame:
    """Nodes of each topic in the first tier that has any: topic, name, tier, score.

    Tier 0 is the exact name (1.0), tier 1 the name of a synonym (0.9), tier 2
    names that hold the topic (two CJK or three Latin characters and more)
    with a character Jaccard of ``least``, the five best. Topics and names
    meet at a topic's first two characters.
    """
    exact = topics.join(nodes.select(F.col("name").alias("topic")), "topic", "left_semi").select("topic", F.col("topic").alias("name"), F.lit(0).alias("tier"), F.lit(1.0).alias("score"))
    by_synonym = topics.join(synonyms, "topic").join(nodes.select("name"), F.col("synonym") == F.col("name")).select("topic", "name", F.lit(1).alias("tier"), F.lit(0.9).alias("score"))
    long = (F.regexp_count("topic", F.lit("[\\u4e00-\\u9fff]")) >= 2) | (F.regexp_count("topic", F.lit("[A-Za-z]")) >= 3)
    held = holding(nodes.select("name").distinct(), "name", topics.filter(long).distinct(), "topic").select("name", "topic")
    partly = held.withColumn("score", char_jaccard(F.col("topic"), F.col("name"))).filter(F.col("score") >= least)
    partly = top_k(partly, ["topic"], [F.desc("score"), F.asc("name")], 5).select("topic", "name", F.lit(2).alias("tier"), "score")
    every = exact.unionByName(by_synonym.distinct()).unionByName(partly)
    return every.withColumn("_t", F.min("tier").over(Window.partitionBy("topic"))).filter("tier = _t").drop("_t")


def holding(wholes: DataFrame, whole: str, parts: DataFrame, part: str) -> DataFrame:
    """Pairs of rows in which the text ``whole`` holds the text ``part``; they meet at the first two characters of the part."""
    keys = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length(whole)), lambda i: F.array(F.substring(F.col(whole), i, F.lit(1)), F.substring(F.col(whole), i, F.lit(2))))))
    spread = wholes.filter(F.length(whole) > 0).select("*", F.explode(keys).alias("_k"))
    asked = parts.filter(F.length(part) > 0).withColumn("_k", F.substring(part, 1, 2))
    return spread.join(asked, "_k").filter(F.contains(F.col(whole), F.col(part))).drop("_k")


def neighbours(edges: DataFrame, starts: DataFrame, depth: int, reverse: bool = False) -> DataFrame:
    """Nodes within ``depth`` steps of each start: start, name, hops (the fewest). Rounds of joins; a node is expanded once."""
    source, target = ("target", "source") if reverse else ("source", "target")
    step = edges.select(F.col(source).alias("at"), F.col(target).alias("to")).distinct()
    seen = step.limit(0).select(F.lit("").alias("start"), F.col("at").alias("name"), F.lit(0).alias("hops"))
    front = starts.select("start", F.col("start").alias("name"))
    for hop in range(1, depth + 1):
        reached = front.join(step, F.col("name") == F.col("at")).select("start", F.col("to").alias("name")).distinct()
        front = reached.join(seen, ["start", "name"], "left_anti")
        seen = seen.unionByName(front.withColumn("hops", F.lit(hop)))
    return seen


def paths(edges: DataFrame, targets: DataFrame, depth: int = 5, most: int = 3) -> DataFrame:
    """Shortest paths that end at each target, up to ``most``: target, path, length, rank. An edge is used once in a path, a node may recur.

    A target that has ``most`` paths gets no longer ones, so fewer than
    ``most`` paths of a target are ever extended.
    """
    step = edges.select("source", "target").distinct()
    front = targets.select("target", F.col("target").alias("at"), F.array("target").alias("path"), F.array().cast("array<string>").alias("used"), F.lit(0).cast("long").alias("found"))
    out = None
    for n in range(1, depth + 1):
        front = front.filter(F.col("found") < most)
        key = F.concat_ws("\u0001", F.col("e.source"), F.col("e.target"))
        front = front.alias("f").join(step.alias("e"), F.col("f.at") == F.col("e.target")).filter(~F.array_contains("f.used", key))
        front = front.select("f.target", F.col("e.source").alias("at"), F.concat(F.array("e.source"), "f.path").alias("path"), F.array_append("f.used", key).alias("used"), "f.found")
        front = front.withColumn("found", F.col("found") + F.count("*").over(Window.partitionBy("target")))
        one = front.select("target", "path", F.lit(n).alias("length"))
        out = one if out is None else out.unionByName(one)
    ranked = out.withColumn("_p", F.array_join("path", "\u0001"))
    return top_k(ranked, ["target"], [F.asc("length"), F.asc("_p")], most).select("target", "path", "length", "rank")


def subgraph(edges: DataFrame, starts: DataFrame, depth: int = 2, most_nodes: int = 30, most_edges: int = 40) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) around each start: nodes up and down within ``depth`` without the start, edges with both ends within ``depth`` either way."""
    near = neighbours(edges, starts, depth).unionByName(neighbours(edges, starts, depth, reverse=True)).select("start", "name").distinct().filter("start <> name")
    nodes = top_k(near, ["start"], [F.asc("name")], most_nodes)
    both = edges.select("source", "target").union(edges.select("target", "source"))
    reach = neighbours(both, starts, depth).select("start", "name").union(starts.select("start", F.col("start").alias("name"))).distinct()
    inner = edges.select("source", "target").distinct().join(reach.select("start", F.col("name").alias("source")), "source").join(reach.select("start", F.col("name").alias("target")), ["start", "target"])
    return nodes.select("start", "name", "rank"), top_k(inner, ["start"], [F.asc("source"), F.asc("target")], most_edges).select("start", "source", "target", "rank")


def rollup(points: DataFrame, chapters: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chapter sizes and links between chapters.

    ``points`` (name, subject) belong to the chapter of their subject whose
    word they hold and that comes first in ``chapters`` (subject, chapter,
    word, priority), else to ``其他``. Links (``edges``: source, target)
    between chapters are counted once for each unordered pair.
    """
    held = points.join(chapters, "subject").filter(F.contains("name", F.col("word")))
    first = held.groupBy("name", "subject").agg(F.min_by("chapter", "priority").alias("chapter"))
    placed = points.join(first, ["name", "subject"], "left").withColumn("chapter", F.coalesce("chapter", F.lit("其他")))
    sizes = placed.groupBy("subject", "chapter").agg(F.count("*").alias("points"))
    ends = placed.select("name", F.concat_ws("/", "subject", "chapter").alias("c"), "subject")
    links = edges.join(ends.withColumnsRenamed({"name": "source", "c": "a", "subject": "sa"}), "source").join(ends.withColumnsRenamed({"name": "target", "c": "b", "subject": "sb"}), "target").filter("a <> b")
    pair = links.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count("*").alias("links"), F.bool_or(F.col("sa") != F.col("sb")).alias("cross_subject"))
    return sizes, pair


def upsert_nodes(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Nodes by name (name, category, description, source_file, seq); the last write wins."""
    both = existing.unionByName(new)
    cols = [c for c in existing.columns if c != "name"]
    return both.groupBy("name").agg(F.max_by(F.struct(*cols), "seq").alias("v")).select("name", "v.*")


def upsert_edges(nodes: DataFrame, edges: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) with ``new`` edges (source, target, relation); missing ends are created."""
    ends = new.select(F.col("source").alias("name")).union(new.select("target")).distinct()
    created = ends.join(nodes.select("name"), "name", "left_anti")
    for c in nodes.columns:
        if c != "name":
            created = created.withColumn(c, F.lit(None).cast(nodes.schema[c].dataType))
    return nodes.unionByName(created), edges.unionByName(new).dropDuplicates(["source", "target", "relation"])


def import_source(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges of which both ends exist."""
    have = nodes.select("name")
    return edges.join(have.withColumnRenamed("name", "source"), "source", "left_semi").join(have.withColumnRenamed("name", "target"), "target", "left_semi")


def delete(nodes: DataFrame, edges: DataFrame, gone: Column) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) without the nodes that ``gone`` marks and all edges at them."""
    out = nodes.filter(F.coalesce(gone, F.lit(False))).select("name")
    left = edges.join(out.withColumnRenamed("name", "source"), "source", "left_anti").join(out.withColumnRenamed("name", "target"), "target", "left_anti")
    return nodes.filter(~F.coalesce(gone, F.lit(False))), left


def orphans(nodes: DataFrame, indexed: DataFrame) -> DataFrame:
    """Nodes whose source file isn't among the indexed files (source_file)."""
    return nodes.filter("source_file is not null and source_file <> ''").join(indexed.select("source_file").distinct(), "source_file", "left_anti")


def health(nodes: DataFrame, edges: DataFrame, indexed: DataFrame) -> DataFrame:
    """One row: nodes, edges, orphans, orphan_ratio (4 digits)."""
    lost = orphans(nodes, indexed).agg(F.count("*").alias("orphans"))
    out = nodes.agg(F.count("*").alias("nodes")).crossJoin(edges.agg(F.count("*").alias("edges"))).crossJoin(lost)
    return out.withColumn("orphan_ratio", F.round(F.col("orphans") / F.greatest("nodes", F.lit(1)), 4))


def indexed_files(chunks: DataFrame) -> DataFrame:
    """source_file of every collection's chunks, once each."""
    return chunks.filter("coalesce(source_file, '') <> ''").select("source_file").distinct()


def drop_orphans(nodes: DataFrame, edges: DataFrame, indexed: DataFrame, category: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, report) without orphans, of one category if it is given; the report counts them by category."""
    lost = orphans(nodes, indexed)
    lost = lost.filter(F.col("category") == category) if category else lost
    marked = nodes.join(lost.select("name", F.lit(True).alias("_gone")), "name", "left")
    kept, left = delete(marked, edges, F.col("_gone"))
    return kept.drop("_gone"), left, lost.groupBy(F.coalesce("category", F.lit("unknown")).alias("category")).agg(F.count("*").alias("cleaned"))


def full_text(topics: DataFrame, nodes: DataFrame, least: float = 0.3, most: int = 3) -> DataFrame:
    """Nodes whose name or description shares terms with a topic: topic, name, score, rank, by BM25 relative to the best, at least ``least``."""
    from .search import bm25, query_terms

    docs = nodes.select(F.col("name").alias("doc_id"), F.concat_ws(" ", "name", "description").alias("text"))
    found = bm25(docs, topics.select(F.col("topic").alias("query_id"), query_terms(F.col("topic")).alias("terms")), most)
    return found.filter(F.col("score") >= least).select(F.col("query_id").alias("topic"), F.col("doc_id").alias("name"), "score", "rank")


def evidence(edges: DataFrame, topics: DataFrame, depth: int = 2, most_nodes: int = 24, most_edges: int = 32, most_paths: int = 6) -> DataFrame:
    """Graph evidence of each query: query_id, nodes, edges, paths, confidence.

    ``topics`` (query_id, pos, name) are the resolved nodes of a query, in
    order. Around them stand prerequisites and next topics within ``depth``,
    an edge for each, and the paths that end there. Lists are cut in the order
    of topic, distance and name.
    """
    starts = topics.select(F.col("name").alias("start")).distinct()
    around = neighbours(edges, starts, depth, reverse=True).withColumn("way", F.lit(0)).unionByName(neighbours(edges, starts, depth).withColumn("way", F.lit(1)))
    near = topics.withColumnRenamed("name", "start").join(around, "start")
    place = F.struct("pos", "way", "hops", "name")
    own = topics.select("query_id", F.struct("pos", F.lit(-1).alias("way"), F.lit(0).alias("hops"), "name").alias("p"))
    ordered = own.unionByName(near.select("query_id", place.alias("p"))).groupBy("query_id", F.col("p.name").alias("name")).agg(F.min("p").alias("p"))
    nodes = top_k(ordered, ["query_id"], [F.asc("p")], most_nodes).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"]).alias("nodes"))
    back = F.col("way") == 0
    links = near.select("query_id", place.alias("p"), F.when(back, F.col("name")).otherwise(F.col("start")).alias("source"), F.when(back, F.col("start")).otherwise(F.col("name")).alias("target"))
    links = links.groupBy("query_id", "source", "target").agg(F.min("p").alias("p"))
    link_lists = top_k(links, ["query_id"], [F.asc("p")], most_edges).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.concat_ws(" -> ", "source", "target").alias("e")))), lambda x: x["e"]).alias("edges"))
    walks = paths(edges, starts.withColumnRenamed("start", "target"), depth).select("target", F.array_join("path", " -> ").alias("w"), F.col("rank").alias("r"))
    walks = topics.withColumnRenamed("name", "target").join(walks, "target")
    walk_lists = top_k(walks, ["query_id"], [F.asc("pos"), F.asc("r")], most_paths).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "w"))), lambda x: x["w"]).alias("paths"))
    base = topics.groupBy("query_id").agg(F.round(F.least(F.lit(0.95), 0.65 + 0.08 * F.countDistinct("name")), 6).alias("confidence"))
    none = F.array().cast("array<string>")
    out = base.join(nodes, "query_id", "left").join(link_lists, "query_id", "left").join(walk_lists, "query_id", "left")
    return out.select("query_id", "nodes", F.coalesce("edges", none).alias("edges"), F.coalesce("paths", none).alias("paths"), "confidence")


def evidence_terms(found: DataFrame) -> DataFrame:
    """query_id, terms: the names in nodes, edges and paths of graph evidence, sorted."""
    parts = F.concat("nodes", F.flatten(F.transform(F.concat("edges", "paths"), lambda x: F.split(x, " -> "))))
    return found.select("query_id", F.array_sort(F.array_distinct(F.filter(F.transform(parts, F.trim), lambda x: x != ""))).alias("terms"))


def coerce_payload(payload: Column) -> tuple[Column, Column]:
    """(nodes, edges) arrays of a loosely shaped JSON payload; unknown relations become RELATED_TO."""
    schema = "struct<nodes: array<struct<name: string, title: string, id: string, category: string, description: string>>, edges: array<struct<source: string, `from`: string, target: string, `to`: string, relation: string, `type`: string>>>"
    p = F.from_json(payload, schema)
    nodes = F.filter(F.transform(p["nodes"], lambda n: F.struct(F.coalesce(n["name"], n["title"], n["id"]).alias("name"), n["category"].alias("category"))), lambda n: F.coalesce(n["name"], F.lit("")) != "")
    kind = lambda e: F.upper(F.coalesce(e["relation"], e["type"], F.lit("")))
    edges = F.transform(p["edges"], lambda e: F.struct(F.coalesce(e["source"], e["from"]).alias("source"), F.coalesce(e["target"], e["to"]).alias("target"), F.when(kind(e).isin("PREREQUISITE_OF", "RELATED_TO"), kind(e)).otherwise("RELATED_TO").alias("relation")))
    return F.array_distinct(nodes), F.array_distinct(F.filter(edges, lambda e: e["source"].isNotNull() & e["target"].isNotNull()))


def context(neighbour_rows: DataFrame) -> DataFrame:
    """Text of each start's neighbours (start, name, hops, direction) in order of distance and name."""
    parts = neighbour_rows.groupBy("start", "direction").agg(F.array_sort(F.collect_list(F.struct("hops", "name"))).alias("n"))
    line = F.concat_ws(": ", "direction", F.array_join(F.transform("n", lambda x: x["name"]), " -> "))
    return parts.groupBy("start").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("text"))
