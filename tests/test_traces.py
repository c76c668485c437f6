"""Observed metrics of a retrieval against those of separate runs, in one execution."""

from pyspark.sql import functions as F

from spindrift.operators import retrieval
from spindrift.plans import retrieval_queries as plans

SF = "/root/testdata/sf0.001"


def test_observed_counts_equal_separate_runs(spark):
    queries, chunks = plans._batch(spark, SF), plans._corpus(spark, SF)
    for options in (retrieval.Options(threshold=0.02, routes=("semantic", "keyword_bm25")), retrieval.Options(threshold=9.0)):
        found, metrics = retrieval.traced(queries, chunks, options)
        got = {(r["stage"], r["route"]): r for r in metrics.collect()}
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, retrieval.retrieve(queries, chunks, options).collect()))
        hits = retrieval.route_hits(queries, chunks, options)
        separate = {("1-routes", r["route"]): r for r in hits.groupBy("route").agg(F.count("*").alias("n"), F.round(F.max("score"), 6).alias("top"), F.round(F.avg("score"), 6).alias("avg"), F.round(F.min("score"), 6).alias("low")).collect()}
        for key, r in separate.items():
            assert (got[key]["n"], got[key]["top"], got[key]["low"]) == (r["n"], r["top"], r["low"]) and abs(got[key]["avg"] - r["avg"]) < 2e-6
        assert got["1-routes", None]["n"] == hits.count() == sum(got["1-routes", route]["n"] for route in options.routes)
        assert got["5-found", None]["n"] == found.count()
        counts = [got[stage, None]["n"] for stage in ("1-routes", "2-fused", "3-sections", "4-threshold", "5-found")]
        assert counts == sorted(counts, reverse=True)
        assert options.threshold < 9 or (counts[-1], got["5-found", None]["top"]) == (0, None)
        by_query = {(r["query_id"], r["stage"]): r["n"] for r in retrieval.trace(queries, chunks, options).collect()}
        for stage, name in (("1-routes", "1-routes"), ("2-fused", "2-fused"), ("5-found", "3-found")):
            assert got[stage, None]["n"] == sum(n for (_, s), n in by_query.items() if s == name)
