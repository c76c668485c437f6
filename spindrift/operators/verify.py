"""Checks of fused evidence, their weighted score, verdict and retry hints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weights of the checks; without a model's check its share goes to the others in proportion.
WEIGHTS = {"evidence_count": 0.20, "score_quality": 0.20, "source_diversity": 0.10, "content_sufficiency": 0.15, "duplication": 0.05, "kg_support": 0.05, "final_context": 0.15}
MODEL = 0.10
CRITICAL = ("evidence_count", "final_context", "score_quality")


def summarize(evidence: DataFrame) -> DataFrame:
    """Aggregates of each query's text evidence (query_id, source, content, rerank_score, recall_score, score) that the checks need."""
    primary = F.when(F.col("rerank_score") > 0, F.col("rerank_score")).when(F.col("recall_score") > 0, F.col("recall_score")).otherwise(F.coalesce("score", F.lit(0.0)))
    rows = evidence.withColumn("_p", primary)
    return rows.groupBy("query_id").agg(
        F.count("*").alias("n"), F.avg("_p").alias("avg_score"), F.count_if(F.col("rerank_score") > 0).alias("n_rerank"), F.count_distinct("source").alias("n_sources"),
        F.count_if(F.length(F.trim("content")) < 50).alias("n_thin"), F.sum(F.length("content")).alias("total_length"), F.count_distinct(F.trim(F.substring("content", 1, 120))).alias("n_heads"),
        F.count_if(F.col("_p") < 0.1).alias("n_low_rerank"), F.count_if(F.col("_p") < F.lit(0.03)).alias("n_low_recall"),
    )


def checks(threshold: float = 0.06) -> dict[str, tuple[Column, Column]]:
    """(score, passed) of each check over a summary with n_kg, kg_confidence and context_length; missing counts are 0."""
    c = lambda name: F.coalesce(F.col(name), F.lit(0))
    n, kg, conf, ctx = c("n"), c("n_kg"), F.coalesce("kg_confidence", F.lit(0.0)), c("context_length")
    none, kg_only = n == 0, (n == 0) & (kg > 0)
    zero, no, yes = F.lit(0.0), F.lit(False), F.lit(True)

    count = F.when(kg_only & (ctx > 0), 0.45).when(none, zero).otherwise(F.least(F.lit(1.0), 0.3 + 0.15 * n))
    count_ok = F.when(none, kg_only & (ctx > 0)).otherwise(yes)

    rerank = c("n_rerank") > 0
    least = F.when(rerank, 0.3).otherwise(max(0.01, threshold * 0.8))
    share = F.when(rerank, c("avg_score")).otherwise(F.least(F.lit(1.0), c("avg_score") / max(threshold * 2, 0.01)))
    low = F.when(rerank, c("n_low_rerank")).otherwise(c("n_low_recall")) / F.when(n > 0, n)
    below = c("avg_score") < least
    quality = F.when(kg_only, conf).when(none, zero).when(below, share).otherwise(F.least(F.lit(1.0), share * (1 - 0.3 * low)))
    quality_ok = F.when(kg_only, conf >= 0.3).when(none, no).otherwise(~below & (low < 0.8))

    div = c("n_sources") / F.when(n > 0, n)
    single = (c("n_sources") == 1) & (n > 2)
    diversity = F.when(kg_only, 0.5).when(none, zero).when(single, div * 0.5).otherwise(div)
    diversity_ok = F.when(kg_only, yes).when(none | single, no).otherwise(div >= 0.2)

    thin, length = c("n_thin") / F.when(n > 0, n), c("total_length")
    content = F.when(kg_only & (ctx > 0), F.least(F.lit(1.0), ctx / 50)).when(none, zero).when(thin > 0.5, 0.2).when(length < 200, length / 200).otherwise(F.least(F.lit(1.0), 0.5 + length / 3000))
    content_ok = F.when(none, kg_only & (ctx >= 50)).otherwise((thin <= 0.5) & (length >= 200))

    double = F.when(n > 1, 1 - c("n_heads") / n).otherwise(zero)
    support = F.when(kg > 0, F.least(F.lit(1.0), 0.5 + conf * 0.5)).otherwise(0.5)
    wanted = F.when(kg_only, 50).otherwise(200)
    final = F.when(ctx < wanted, ctx / wanted).otherwise(1.0)
    return {
        "evidence_count": (count, count_ok), "score_quality": (quality, quality_ok), "source_diversity": (diversity, diversity_ok), "content_sufficiency": (content, content_ok),
        "duplication": (1 - double, double <= 0.7), "kg_support": (support, yes), "final_context": (final, ctx >= wanted),
    }


def verify(summary: DataFrame, threshold: float = 0.06, model_score: Column | None = None) -> DataFrame:
    """query_id, overall, verdict (pass, soft_fail, hard_fail), failed checks and retry hints (k, score_threshold, use_rerank, max_tokens)."""
    found = checks(threshold)
    rest = sum(WEIGHTS.values())
    share = {k: w if model_score is not None else w + MODEL * w / rest for k, w in WEIGHTS.items()}
    total = sum((found[k][0] * w for k, w in share.items()), (model_score * MODEL if model_score is not None else F.lit(0.0)))
    overall = total / (sum(share.values()) + (MODEL if model_score is not None else 0))
    critical = found[CRITICAL[0]][1]
    for name in CRITICAL[1:]:
        critical = critical & found[name][1]
    rows = summary.withColumn("overall", overall).withColumn("_critical", critical)
    rows = rows.withColumn("verdict", F.when(~F.col("_critical"), "hard_fail").when(F.col("overall") >= 0.6, "pass").when(F.col("overall") >= 0.35, "soft_fail").otherwise("hard_fail"))
    failed = F.array_compact(F.array(*(F.when(~ok, F.lit(k)) for k, (_, ok) in found.items())))
    rows = rows.withColumn("failed", failed)
    has = lambda name: F.array_contains("failed", name) & (F.col("verdict") != "pass")
    k = F.coalesce(F.col("k"), F.lit(5)) if "k" in summary.columns else F.lit(5)
    tokens = F.coalesce(F.col("max_tokens"), F.lit(4000)) if "max_tokens" in summary.columns else F.lit(4000)
    more = F.greatest(F.when(has("evidence_count") | has("final_context"), F.least(F.lit(10), k + 3)), F.when(has("source_diversity"), F.least(F.lit(10), k + 2)))
    fewer = F.when(has("duplication"), F.greatest(F.lit(3), k - 1))
    hints = {
        "hint_k": F.when(more > k, more).when(fewer < k, fewer),
        "hint_threshold": F.when(has("score_quality"), max(0.01, threshold * 0.5)),
        "hint_rerank": F.when(has("score_quality"), True),
        "hint_tokens": F.when(has("content_sufficiency") | has("final_context"), F.least(F.lit(8000), tokens + 2000)),
    }
    return rows.withColumns(hints).select("query_id", F.round("overall", 6).alias("overall"), "verdict", F.array_join("failed", ",").alias("failed"), *hints)


def sufficient(verdict: Column, least: str = "soft_fail") -> Column:
    order = {"hard_fail": 0, "soft_fail": 1, "pass": 2}
    value = F.when(verdict == "pass", 2).when(verdict == "soft_fail", 1).otherwise(0)
    return value >= order[least]
