"""Evaluation, feedback and telemetry aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .search import top_k


def score_aggregate(scores: DataFrame, group: list[str], value: str) -> DataFrame:
    """Mean, population deviation, extremes, linear p50 and p90 (4 digits), and counts of valid and missing scores of each group."""
    v = F.when(~F.isnan(value), F.col(value))
    return scores.groupBy(*group).agg(
        F.round(F.avg(v), 4).alias("mean"), F.round(F.stddev_pop(v), 4).alias("std"), F.round(F.min(v), 4).alias("min"), F.round(F.max(v), 4).alias("max"),
        F.round(F.percentile(v, 0.5), 4).alias("p50"), F.round(F.percentile(v, 0.9), 4).alias("p90"), F.count("*").alias("n"), F.count(v).alias("valid_n"), F.count_if(F.isnan(value)).alias("nan_count"),
    )


def stage_timing(timings: DataFrame, stages: list[str], total: str = "total_ms") -> DataFrame:
    """avg, p50 and p95 (elements at n // 2 and int(0.95 n) in order) of each stage, and its share of the total's mean."""
    rows = timings.select(F.explode(F.create_map(*(x for s in stages for x in (F.lit(s), F.col(s).cast("double"))))).alias("stage", "ms")).filter("ms is not null")
    w = Window.partitionBy("stage").orderBy("ms")
    ranked = rows.withColumn("i", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(Window.partitionBy("stage")))
    at = lambda i: F.max(F.when(F.col("i") == i, F.col("ms")))
    out = ranked.groupBy("stage").agg(F.round(F.avg("ms"), 2).alias("avg_ms"), F.round(at(F.floor(F.col("n") / 2)), 2).alias("p50_ms"), F.round(at(F.least(F.col("n") - 1, F.floor(F.col("n") * 0.95))), 2).alias("p95_ms"))
    whole = out.filter(F.col("stage") == total).select(F.col("avg_ms").alias("_t"))
    share = F.when(F.col("stage") != total, F.round(F.col("avg_ms") / F.when(F.col("_t") > 0, F.col("_t")).otherwise(1) * 100, 1))
    return out.crossJoin(F.broadcast(whole)).select("stage", "avg_ms", "p50_ms", "p95_ms", share.alias("pct"))


def nearest_percentile(values: Column, ratio: float) -> Column:
    """Element at round((n - 1) * ratio), half to even, of the sorted values."""
    return F.get(F.array_sort(values), F.bround((F.size(values) - 1) * ratio).cast("int"))


def nearest_percentiles(rows: DataFrame, group: str, value: str, ratios: dict[str, float]) -> DataFrame:
    """``nearest_percentile`` of each group for whole tables: ``group`` and a column for each of ``ratios``.

    Equal values are counted before the shuffle, so a window holds the
    different values of a group, not its rows. Nulls are left out.
    """
    counted = rows.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(group)
    placed = counted.withColumn("_to", F.sum("_c").over(w.orderBy(value))).withColumn("_n", F.sum("_c").over(w))
    at = lambda r: F.bround((F.col("_n") - 1) * r).cast("long")
    return placed.groupBy(group).agg(*(F.min(F.when(F.col("_to") > at(r), F.col(value))).alias(name) for name, r in ratios.items()))


def route_ablation(parts: DataFrame) -> DataFrame:
    """What each query loses without a route: route, mean_delta (6 digits), queries, n_distinct.

    ``parts`` (query_id, route, key, part) are the terms of fused scores;
    leaving a route out subtracts its own terms.
    """
    whole = parts.groupBy("query_id").agg(F.sum("part").alias("whole"))
    own = parts.groupBy("query_id", "route").agg(F.sum("part").alias("own"))
    every = whole.crossJoin(F.broadcast(parts.select("route").distinct()))  # few routes
    delta = F.round(F.coalesce("own", F.lit(0.0)) * -1, 6)
    rows = every.join(own, ["query_id", "route"], "left").withColumn("delta", delta)
    return rows.groupBy("route").agg(F.round(F.avg("delta"), 6).alias("mean_delta"), F.count("*").alias("queries"), F.count_distinct("delta").alias("n_distinct"))


def feedback_stats(feedback: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """One row over the last days: total, positive, negative, positive_ratio (3 digits), avg_confidence (4)."""
    recent = feedback.filter(F.col("timestamp") >= as_of - F.make_dt_interval(F.lit(days)))
    out = recent.agg(F.count("*").alias("total"), F.count_if(F.col("rating") > 0).alias("positive"), F.count_if(F.col("rating") < 0).alias("negative"), F.round(F.coalesce(F.avg("confidence"), F.lit(0.0)), 4).alias("avg_confidence"))
    return out.withColumn("positive_ratio", F.round(F.col("positive") / F.greatest("total", F.lit(1)), 3))


def bad_case_clusters(feedback: DataFrame, top: int = 10) -> DataFrame:
    """Negative feedback by agent, depth and whether there was evidence: pattern, count, samples (3 shortest ids), most first."""
    bad = feedback.filter("rating < 0")
    pattern = F.concat_ws("|", F.coalesce("agent_name", F.lit("unknown")), F.coalesce("retrieval_depth", F.lit("unknown")), F.when(F.col("evidence_count") > 0, "has_ev").otherwise("no_ev"))
    marked = bad.withColumn("pattern", pattern)
    counts = marked.groupBy("pattern").agg(F.count("*").alias("count"))
    first = top_k(marked, ["pattern"], [F.asc("id")], 3).groupBy("pattern").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("samples"))
    return counts.join(first, "pattern").orderBy(F.desc("count"), "pattern").limit(top)


def log_feedback(rows: DataFrame) -> DataFrame:
    """Feedback lines worth keeping: no rating 0, query and answer cut."""
    return rows.filter("rating <> 0").withColumns({"query": F.substring("query", 1, 500), "answer_preview": F.substring("answer_preview", 1, 2000)})


def governance_stats(rows: DataFrame) -> DataFrame:
    """Per confidence: answers, passed and sourced shares (4 digits), and the most frequent flag. ``rows``: confidence, passed, has_source, flags."""
    base = rows.groupBy("confidence").agg(F.count("*").alias("answers"), F.round(F.avg(F.col("passed").cast("double")), 4).alias("pass_rate"), F.round(F.avg(F.col("has_source").cast("double")), 4).alias("source_rate"))
    flags = rows.select("confidence", F.explode("flags").alias("flag")).groupBy("confidence", "flag").count()
    first = top_k(flags, ["confidence"], [F.desc("count"), F.asc("flag")], 1).select("confidence", F.col("flag").alias("top_flag"))
    return base.join(first, "confidence", "left")


def contexts(rows: DataFrame, k: int, budget: int) -> DataFrame:
    """Contexts of each query: equal texts once, by tier and score, ``k`` at most, and as many tokens as fit (the last one cut if over 100 remain)."""
    best = Window.partitionBy("query_id", "text").orderBy("tier", F.desc("score"), "id")
    once = rows.withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n")
    ranked = top_k(once, ["query_id"], [F.asc("tier"), F.desc("score"), F.asc("id")], k)
    from .fusion import token_budget

    return token_budget(ranked, budget, 100)


def route_summary(rows: DataFrame) -> DataFrame:
    """Hits and routes of each route and of each collection: kind, name, calls, hits."""
    sets = rows.groupingSets([["route"], ["collection"]], "route", "collection").agg(F.count("*").alias("calls"), F.sum("hits").alias("hits"), F.grouping("route").alias("g"))
    return sets.select(F.when(F.col("g") == 0, "route").otherwise("collection").alias("kind"), F.coalesce("route", "collection").alias("name"), "calls", "hits")


def stage_deltas(stages: DataFrame) -> DataFrame:
    """Change of the count from each pipeline stage to the next: query_id, stage, n, delta."""
    w = Window.partitionBy("query_id").orderBy("stage")
    return stages.withColumn("delta", F.col("n") - F.lag("n").over(w))


def score_stats(rows: DataFrame) -> DataFrame:
    """top, avg, min and max score (6 digits) and count of each query and stage."""
    r = lambda c: F.round(c, 6)
    return rows.groupBy("query_id", "stage").agg(F.count("*").alias("n"), r(F.max("score")).alias("max"), r(F.avg("score")).alias("avg"), r(F.min("score")).alias("min"))


def metric_lines(rows: DataFrame) -> DataFrame:
    """Metric records (ts, event, stage, status, duration_ms, tags, values) as JSON lines."""
    return rows.select(F.to_json(F.struct("ts", "event", "stage", "status", "duration_ms", "tags", "values")).alias("value"))


def decompose_stats(rows: DataFrame) -> DataFrame:
    """One row: queries, triggered, rate (4 digits), mean number of parts of the triggered."""
    return rows.agg(F.count("*").alias("total"), F.count_if("triggered").alias("triggered"), F.round(F.avg(F.col("triggered").cast("double")), 4).alias("rate"), F.round(F.coalesce(F.avg(F.when(F.col("triggered"), F.col("parts"))), F.lit(0.0)), 4).alias("avg_parts"))
