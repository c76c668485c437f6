"""What follows from mastery: recommendations, learning paths, session context, and the points that answers touch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graph
from .graph import holding
from .search import top_k


def recommendations(weak: DataFrame, edges: DataFrame, limit: int = 5, most: int = 3) -> DataFrame:
    """Each user's weak points (user_id, name, effective_score, rank) with up to ``most`` prerequisites within two steps."""
    first = weak.filter(F.col("rank") <= limit)
    before = graph.neighbours(edges, first.select(F.col("name").alias("start")).distinct(), 2, reverse=True)
    listed = top_k(before, ["start"], [F.asc("hops"), F.asc("name")], most).groupBy("start").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"]), ",").alias("prerequisites"))
    out = first.join(listed, first["name"] == listed["start"], "left").drop("start").withColumn("prerequisites", F.coalesce("prerequisites", F.lit("")))
    share = F.concat(F.round(F.col("effective_score") * 100).cast("int").cast("string"), F.lit("%"))
    reason = F.when(F.col("prerequisites") != "", "prerequisites first").otherwise("review")
    return out.select("user_id", "name", "effective_score", "prerequisites", F.concat_ws(": ", share, reason).alias("reason"))


def learning_paths(weak: DataFrame, edges: DataFrame, scores: DataFrame, depth: int = 4) -> DataFrame:
    """The shortest path to each user's weak point with the user's score on every step: user_id, target, pos, name, score."""
    targets = weak.select(F.col("name").alias("target")).distinct()
    path = graph.paths(edges, targets, depth, 1).select("target", F.posexplode("path").alias("pos", "step"))
    rows = weak.select("user_id", F.col("name").alias("target"), F.col("effective_score").alias("own")).join(path, "target", "left")
    rows = rows.select("user_id", "target", "own", F.coalesce("pos", F.lit(0)).alias("pos"), F.coalesce("step", "target").alias("name"))
    known = rows.join(scores.select("user_id", "name", "score"), ["user_id", "name"], "left")
    return known.select("user_id", "target", "pos", "name", F.when(F.col("name") == F.col("target"), F.col("own")).otherwise(F.col("score")).alias("score"))


def session_context(weak: DataFrame, conversations: DataFrame, most_weak: int = 5, most_sessions: int = 3) -> DataFrame:
    """Text of each user's weakest points and latest conversation summaries: user_id, context."""
    points = weak.filter(F.col("rank") <= most_weak).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.concat("name", F.lit(" "), F.round(F.col("effective_score") * 100).cast("int").cast("string"), F.lit("%")).alias("t")))).alias("p"))
    latest = top_k(conversations.filter("summary <> ''"), ["user_id"], [F.desc("updated_at")], most_sessions).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("summary").alias("t")))).alias("s"))
    both = points.join(latest, "user_id", "full_outer")
    text = lambda c: F.array_join(F.transform(c, lambda x: x["t"]), "; ")
    return both.select("user_id", F.concat_ws("\n", text("p"), text("s")).alias("context"))


def points_of_docs(docs: DataFrame, registry: DataFrame) -> DataFrame:
    """Knowledge points that documents touch: doc_id, kp_ids (sorted).

    ``docs`` (doc_id, kp_json, name, heading): listed ids count first; without
    them a registry point of the same name; without that, points whose name
    stands in the heading.
    """
    listed = docs.select("doc_id", F.explode(F.from_json("kp_json", "array<long>")).alias("kp_id")).distinct()
    rest = docs.join(listed.select("doc_id").distinct(), "doc_id", "left_anti")
    named = rest.join(registry.select("kp_id", "name"), "name").select("doc_id", "kp_id")
    last = rest.join(named.select("doc_id").distinct(), "doc_id", "left_anti")
    parts = last.select("doc_id", F.explode(F.transform(F.split(F.regexp_replace("heading", "^\\[|\\]$", ""), ">"), lambda x: F.trim(x))).alias("name"))
    held = parts.join(registry.select("kp_id", "name"), "name").select("doc_id", "kp_id")
    every = listed.unionByName(named).unionByName(held).distinct()
    return every.groupBy("doc_id").agg(F.array_sort(F.collect_set("kp_id")).alias("kp_ids"))


def resolve_point(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """id, kp_id by evidence name, else heading tail, else topic, else the first point of the collection."""
    first = lambda key: registry.groupBy(key).agg(F.min("kp_id").alias("kp"))
    by_name = first("name")
    out = rows
    tries = []
    for i, column in enumerate(("name", "tail", "topic")):
        out = out.join(by_name.select(F.col("name").alias(column), F.col("kp").alias(f"_{i}")), column, "left")
        tries.append(F.col(f"_{i}"))
    out = out.join(first("category").select(F.col("category").alias("collection"), F.col("kp").alias("_c")), "collection", "left")
    return out.select("id", F.coalesce(*tries, F.col("_c")).alias("kp_id"))


def qa_event(confidence: Column) -> tuple[Column, Column]:
    """(event type, outcome) of an answered question by the confidence of its answer."""
    high = F.coalesce(confidence == "high", F.lit(False))
    return F.when(high, "qa_high_confidence").otherwise("qa_low_confidence"), F.when(high, 1.0).otherwise(0.3)


def tool_steps(messages: DataFrame) -> DataFrame:
    """Tool calls joined to their results by call id: message_id, call_id, tool, input, output (null if none came back)."""
    calls = messages.filter("role = 'assistant'").select(F.col("id").alias("message_id"), F.explode("calls").alias("c")).select("message_id", "c.call_id", "c.tool", "c.input")
    results = messages.filter("role = 'tool'").select("call_id", F.col("text").alias("output"))
    return calls.join(results, "call_id", "left").select("message_id", "call_id", "tool", "input", "output")


def guard(outputs: DataFrame, no_result: str, signals: str, most: int = 3) -> DataFrame:
    """Whether tool outputs hold evidence: run_id, sufficient, all_empty, snippets (the first that show a signal, cut)."""
    live = outputs.filter("trim(output) <> ''").withColumn("_none", F.col("output").rlike(no_result))
    base = outputs.groupBy("run_id").agg(F.count("*").alias("outputs"))
    stats = live.groupBy("run_id").agg(F.bool_and("_none").alias("all_empty"), F.bool_or(~F.col("_none")).alias("any"))
    shown = top_k(live.filter(~F.col("_none") & F.col("output").rlike(signals)), ["run_id"], [F.asc("seq")], most)
    texts = shown.groupBy("run_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.substring("output", 1, 200).alias("t")))), lambda x: x["t"]), "|").alias("snippets"))
    out = base.join(stats, "run_id", "left").join(texts, "run_id", "left")
    return out.select("run_id", F.coalesce("any", F.lit(False)).alias("sufficient"), F.coalesce("all_empty", F.lit(True)).alias("all_empty"), F.coalesce("snippets", F.lit("")).alias("snippets"))


def truncate_context(context: Column, terms: Column, budget: int = 3000) -> Column:
    """Parts of a context that fit a budget, most query terms first, in their own order.

    A part that doesn't fit is passed over and a smaller one may follow; parts
    without a term are left out once any was taken.
    """
    parts = F.filter(F.transform(F.split(context, "\\n\\n"), lambda x: F.trim(x)), lambda x: x != "")
    hits = lambda p: F.size(F.filter(terms, lambda t: F.contains(F.lower(p), F.lower(t))))
    order = F.array_sort(F.transform(parts, lambda p, i: F.struct(F.when(F.size(terms) > 0, -hits(p)).otherwise(F.lit(-1)).alias("h"), i.alias("i"), p.alias("p"))))
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<struct<i: int, p: string>>").alias("kept"))

    def take(s, x):
        size = F.length(x["p"]) + 2
        skip = ((x["h"] == 0) & (s["used"] > 0)) | (s["used"] + size > budget)
        return F.when(skip, s).otherwise(F.struct((s["used"] + size).alias("used"), F.array_append(s["kept"], F.struct(x["i"].cast("int").alias("i"), x["p"].alias("p"))).alias("kept")))

    kept = F.aggregate(order, start, take)["kept"]
    text = F.array_join(F.transform(F.array_sort(kept), lambda x: x["p"]), "\n\n")
    text = F.when(F.size(kept) == 0, F.substring(F.get(parts, F.lit(0)), 1, budget)).otherwise(text)
    return F.when(F.length(context) <= budget, context).otherwise(F.concat(text, F.lit("\n\n[...部分检索结果已按相关性筛选截断]")))


def focus_node(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """The node that each label means: equal, or one name holds the other, ignoring case and blanks; the shortest difference, then the name."""
    plain = lambda c: F.regexp_replace(F.lower(c), "\\s+", "")
    n, l = nodes.select("name", plain(F.col("name")).alias("_n")).distinct(), labels.select("label", plain(F.col("label")).alias("_l")).distinct()
    near = holding(n, "_n", l, "_l").select("name", "label").union(holding(l, "_l", n, "_n").select("name", "label")).distinct()
    return top_k(near.withColumn("gap", F.abs(F.length("name") - F.length("label"))), ["label"], [F.asc("gap"), F.asc("name")], 1).select("label", "name")


def visible_levels(nodes: DataFrame, edges: DataFrame, most: int = 2) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the first levels of a hierarchy; edges with both ends in sight, once each."""
    kept = nodes.filter(F.col("level") < most)
    have = kept.select("id")
    inner = edges.join(have.withColumnRenamed("id", "source"), "source", "left_semi").join(have.withColumnRenamed("id", "target"), "target", "left_semi")
    return kept, inner.dropDuplicates(["source", "target", "relation"])


def evidence_items(steps: DataFrame, sources: DataFrame, answers: DataFrame, most: int = 3) -> DataFrame:
    """Items for an answer: its first steps, else its first sources, else the answer: id, pos, title, snippet."""
    a = steps.filter(F.col("pos") <= most).select("id", "pos", "title", F.substring("text", 1, 96).alias("snippet"))
    b = sources.filter(F.col("pos") <= most).join(a.select("id").distinct(), "id", "left_anti").select("id", "pos", F.col("source").alias("title"), F.substring("text", 1, 88).alias("snippet"))
    both = a.unionByName(b)
    c = answers.join(both.select("id").distinct(), "id", "left_anti").select("id", F.lit(1).alias("pos"), F.lit("answer").alias("title"), F.substring("text", 1, 96).alias("snippet"))
    return both.unionByName(c)


def history_points(rows: DataFrame, labels: dict[str, str]) -> DataFrame:
    """History rows rounded for display, with the label of their event type."""
    table = F.create_map(*(F.lit(x) for pair in labels.items() for x in pair))
    r = lambda c: F.round(c, 3).alias(c)
    return rows.select("user_id", "kp", "seq", r("mastery"), r("confidence"), r("effective_score"), r("delta"), "event_type", F.coalesce(F.element_at(table, F.col("event_type")), F.col("event_type")).alias("event_label"))


def latest_states(states: DataFrame, since: Column) -> DataFrame:
    """States with an interaction at or after a moment, newest first in each user."""
    w = Window.partitionBy("user_id").orderBy(F.desc("last_interaction_at"), F.asc("kp"))
    return states.filter(F.col("last_interaction_at") >= since).withColumn("place", F.row_number().over(w).cast("long"))
