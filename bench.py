"""Time the headline queries: one JSON line with seconds for each.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the
cores. Every query is written to a no-op sink, so whole results are computed.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])

HEADLINE = (
    "bm25_topk", "vector_topk", "rrf_fusion", "section_topn", "window_expand", "fusion_rank", "evidence_verdict",
    "tracking_deltas", "mastery_fold", "mastery_history", "student_profile", "weak_points", "mastery_trend_daily",
    "clean_basic", "length_outliers", "exact_dedup", "keywords_freq", "chunk_greedy", "near_dup_jaccard",
    "kg_successors", "kg_paths", "kg_rollup", "turn_pairs", "score_aggregate", "bad_case_clusters",
)


def main() -> None:
    from pyspark.sql import SparkSession

    from spindrift.plans import catalogue

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    found = catalogue.queries()
    found["exact_dedup"](spark, sf).count()  # starts the engine
    seconds = {}
    for name in HEADLINE:
        began = time.perf_counter()
        found[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf.rstrip("/").rpartition("sf")[2]}))
    spark.stop()


if __name__ == "__main__":
    main()
