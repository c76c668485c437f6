"""Merging ranked lists and expanding hits: reciprocal-rank fusion, section limits, sentence windows, evidence fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import estimate_tokens

# Weights of routes by query flag; flags are tried in this order, then "default".
FLAGS = ("code", "exercise", "answer", "concept", "comparison", "structured")
ROUTE_WEIGHTS = [
    ("semantic", "concept", 2.0), ("semantic", "comparison", 2.0), ("semantic", "default", 1.5),
    ("keyword_bm25", "code", 2.0), ("keyword_bm25", "exercise", 1.5), ("keyword_bm25", "answer", 1.5), ("keyword_bm25", "default", 1.0),
    ("focus", "default", 1.5), ("expanded", "concept", 0.8), ("expanded", "default", 0.6),
    ("code_meta", "code", 2.5), ("exercise_meta", "exercise", 2.5), ("answer_meta", "answer", 2.5),
    ("concept_meta", "concept", 1.5), ("concept_meta", "comparison", 1.5), ("comparison_meta", "comparison", 2.0),
    ("structured_meta", "structured", 2.0), ("section_meta", "default", 1.2),
    ("formula_meta", "concept", 1.8), ("formula_meta", "structured", 1.8), ("table_meta", "concept", 1.5), ("table_meta", "structured", 1.5),
    ("merged_qa_meta", "exercise", 2.0), ("merged_qa_meta", "answer", 2.0), ("merged_qa_meta", "comparison", 1.5),
]
ROUTES = tuple(dict.fromkeys(r for r, _, _ in ROUTE_WEIGHTS))


def route_weight(route: Column, flags: dict[str, Column] | None = None) -> Column:
    """Weight of a route (a prefix up to the last colon is dropped) for the first flag that has one, else its default, else 1."""
    name = F.trim(F.regexp_extract(route, "([^:]*)$", 1))
    by_key = {(r, f): w for r, f, w in ROUTE_WEIGHTS}
    default = F.lit(1.0)
    for r in ROUTES:
        if (r, "default") in by_key:
            default = F.when(name == r, by_key[r, "default"]).otherwise(default)
    out = default
    for flag in reversed(FLAGS):
        if flags and flag in flags:
            for r in ROUTES:
                if (r, flag) in by_key:
                    out = F.when(flags[flag] & (name == r), by_key[r, flag]).otherwise(out)
    return out


def rrf_k(routes: Column) -> Column:
    """The smoothing constant for a number of routes: 10 * sqrt(n), from 10 to 60."""
    return F.greatest(F.lit(10), F.least(F.lit(60), F.floor(20 * F.sqrt(routes) / 2))).cast("long")


def rrf(results: DataFrame) -> DataFrame:
    """Weighted reciprocal-rank fusion of ``results`` (query_id, route, rank, key, weight): query_id, key, score, routes, n_routes, rank."""
    n = F.size(F.collect_set("route").over(Window.partitionBy("query_id")))
    part = F.col("weight") / (F.col("_k") + F.col("rank"))
    merged = results.withColumn("_k", rrf_k(n)).groupBy("query_id", "key").agg(
        F.round(F.sum(part), 6).alias("score"), F.array_join(F.array_sort(F.collect_set("route")), ", ").alias("routes"), F.count_distinct("route").alias("n_routes")
    )
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("key"))
    return merged.withColumn("rank", F.row_number().over(w).cast("long"))


def weighted_rrf(results: DataFrame) -> DataFrame:
    """Fusion over an original query and its parts: ``results`` (query_id, label, rank, key, route_weight).

    The original counts 1.5, its parts 1.0. The smoothing constant follows the
    average number of hits of a label, rounded down.
    """
    w = Window.partitionBy("query_id")
    labels = F.size(F.collect_set("label").over(w))
    each = F.greatest(F.lit(1), F.floor(F.count("*").over(w) / labels))
    source = F.when(F.col("label") == "original", 1.5).otherwise(1.0)
    part = source * F.col("route_weight") / (F.col("_k") + F.col("rank"))
    merged = results.withColumn("_k", rrf_k(each)).groupBy("query_id", "key").agg(F.round(F.sum(part), 6).alias("score"), F.array_join(F.array_sort(F.collect_set("label")), ", ").alias("labels"))
    return merged


def section_top_n(ranked: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows of each query's section by score; rows without a section all stay."""
    w = Window.partitionBy("query_id", "section").orderBy(F.desc("score"), F.asc("key"))
    kept = (F.coalesce("section", F.lit("")) == "") | (F.col("_n") <= most)
    return ranked.withColumn("_n", F.row_number().over(w)).filter(kept).drop("_n")


def window_expand(hits: DataFrame, chunks: DataFrame, width: int, budget: int = 6000) -> DataFrame:
    """Neighbours within ``width`` of each query's first hit in a section: query_id, section, chunk_index, anchor, tokens, distance.

    ``hits`` (query_id, section, chunk_index, rank), ``chunks`` (section,
    chunk_index, tokens). Only the best hit of a section is expanded. Beyond
    the token budget the furthest rows go, on the left before the right; the
    anchor always stays.
    """
    w = Window.partitionBy("query_id", "section").orderBy("rank")
    first = hits.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("query_id", "section", F.col("chunk_index").alias("anchor"))
    near = first.join(chunks, "section").filter(F.col("chunk_index").between(F.col("anchor") - width, F.col("anchor") + width))
    near = near.withColumn("distance", F.col("chunk_index") - F.col("anchor"))
    # rows go in the order -width, -width + 1, ..., -1, width, width - 1, ..., 1: a row stays if all that outlive it fit
    keep = Window.partitionBy("query_id", "section").orderBy(F.when(F.col("distance") == 0, 0).when(F.col("distance") > 0, 1).otherwise(2), F.abs("distance"))
    total = F.sum("tokens").over(keep.rowsBetween(Window.unboundedPreceding, 0))
    return near.withColumn("_t", total).filter((F.col("_t") <= budget) | (F.col("distance") == 0)).select("query_id", "section", "chunk_index", "anchor", "tokens", "distance")


def parent_window(hits: DataFrame, parents: DataFrame, budget: int = 12000) -> DataFrame:
    """Parent texts of hits, once each, if over 40 characters longer than the hit and within the query's token budget.

    ``hits`` (query_id, rank, parent_id, n_chars), ``parents`` (parent_id, text).
    The first parent that doesn't fit ends the list.
    """
    w = Window.partitionBy("query_id", "parent_id").orderBy("rank")
    first = hits.filter("parent_id is not null").withColumn("_n", F.row_number().over(w)).filter("_n = 1")
    longer = first.join(parents, "parent_id").filter(F.length("text") > F.col("n_chars") + 40).withColumn("tokens", estimate_tokens(F.col("text")))
    total = F.sum("tokens").over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return longer.withColumn("used", total).filter(F.col("used") <= budget).select("query_id", "parent_id", "rank", "tokens", "used")


def noise_coverage(terms: Column, text: Column) -> Column:
    """Share of a query's terms (two characters or more) in a text; null if it has none."""
    long = F.array_distinct(F.transform(F.filter(terms, lambda t: F.length(t) >= 2), F.lower))
    return F.size(F.filter(long, lambda t: F.contains(F.lower(text), t))) / F.when(F.size(long) > 0, F.size(long))


def noise_downgrade(rows: DataFrame, least: float = 0.15, factor: float = 0.5) -> DataFrame:
    """Mark expanded rows with too few query terms: adds coverage, downgraded, factor.

    ``rows`` (terms, text, expanded, is_comparison): only expanded rows of
    queries that don't compare things are judged.
    """
    cover = F.when(F.col("expanded") & ~F.col("is_comparison"), F.round(noise_coverage(F.col("terms"), F.col("text")), 3))
    raw = F.when(F.col("expanded") & ~F.col("is_comparison"), noise_coverage(F.col("terms"), F.col("text")))
    low = F.coalesce(raw < least, F.lit(False))
    return rows.withColumns({"coverage": cover, "downgraded": low, "factor": F.when(low, factor).otherwise(1.0)})


def evidence_score(rows: DataFrame) -> Column:
    """Score of a text evidence: rerank, else recall, else plain score; 0 counts as 0.01; then the factors of its marks."""
    base = F.coalesce("rerank_score", "recall_score", "score", F.lit(0.0))
    out = F.when(base == 0, 0.01).otherwise(base)
    out = out * F.when(F.col("parent_window"), 1.08).otherwise(1.0)
    out = out * F.when(F.col("hyde"), 0.95).otherwise(1.0)
    out = out * F.when(F.col("downgraded"), 0.5).otherwise(1.0)
    return out * F.when(F.col("kg_match"), 1.2).otherwise(1.0)


def fusion_rank(evidence: DataFrame, per_source: int = 3) -> DataFrame:
    """Ranked evidence of each query: best of equal keys, by score, at most ``per_source`` of a source before the rest.

    ``evidence`` (query_id, key, source, and the columns of ``evidence_score``); adds final_score and rank.
    """
    scored = evidence.withColumn("final_score", F.round(evidence_score(evidence), 6))
    best = Window.partitionBy("query_id", "key").orderBy(F.desc("final_score"), F.asc("evidence_id"))
    scored = scored.withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n")
    of_source = Window.partitionBy("query_id", "source").orderBy(F.desc("final_score"), F.asc("key"))
    over = F.row_number().over(of_source) > per_source
    order = Window.partitionBy("query_id").orderBy("_over", F.desc("final_score"), "key")
    return scored.withColumn("_over", over).withColumn("rank", F.row_number().over(order).cast("long")).drop("_over")


def token_budget(ranked: DataFrame, budget: int, least_rest: int = 200) -> DataFrame:
    """The prefix of each query's rows that fits ``budget`` tokens; the first that doesn't is cut if over ``least_rest`` remain.

    ``ranked`` (query_id, rank, tokens); adds used (tokens taken from the row) and truncated.
    """
    before = F.coalesce(F.sum("tokens").over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = ranked.withColumn("_b", before)
    fits = F.col("_b") + F.col("tokens") <= budget
    first_over = (~fits) & (F.col("_b") <= budget) & (budget - F.col("_b") > least_rest)
    rows = rows.filter(fits | first_over).withColumn("truncated", ~fits)
    return rows.withColumn("used", F.when(F.col("truncated"), budget - F.col("_b")).otherwise(F.col("tokens")).cast("long")).drop("_b")


def interleave(rank: Column, n: Column) -> Column:
    """Place from 1 of a rank when odd ranks come first in order and even ones follow backwards; below four rows the order stays."""
    odd = (rank + 1) / 2
    even = F.ceil(n / 2) + (F.floor(n / 2) - rank / 2) + 1
    return F.when(n < 4, rank).when(rank % 2 == 1, odd).otherwise(even).cast("long")
