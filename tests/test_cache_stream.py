"""The streamed cache against a cache that is asked in order: hits, expiry, eviction, odd vectors, files in any order."""

import random

import pytest

from spindrift.plans import catalogue
from spindrift.streaming import cache

SF = "/root/testdata/sf0.001"


def simulated(probes, threshold, ttl, capacity):
    """(collection, probe, entry, similarity, hit) in plain Python; probes are (collection, probe, seconds, vector)."""
    held, out = {}, []
    for group, probe, at, vector in sorted(probes, key=lambda p: (p[2], p[1])):
        entries = held.setdefault(group, {})
        for i in [i for i, e in entries.items() if at - e["stored"] > ttl]:
            del entries[i]
        size = sum(x * x for x in vector) ** 0.5 if vector and None not in vector else 0
        if not size:
            out.append((group, probe, None, None, False))
            continue
        v = [x / size for x in vector]
        best = min(((-round(sum(a * b for a, b in zip(v, e["v"])), 6), i) for i, e in entries.items()), default=None)
        if best and -best[0] >= threshold:
            entries[best[1]]["used"] = at
            out.append((group, probe, best[1], -best[0], True))
            continue
        out.append((group, probe, best and best[1], best and -best[0] + 0.0, False))
        entries[probe] = {"stored": at, "used": at, "v": v}
        if len(entries) > capacity:
            del entries[min(entries, key=lambda i: (entries[i]["used"], i))]
    return sorted(out)


def test_equals_a_cache_that_is_asked_in_order(spark, tmp_path):
    rng = random.Random(1)
    base = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(25)]
    probes = []
    for i in range(400):
        vector = [x + rng.gauss(0, 0.15) for x in rng.choice(base)]
        probes.append((rng.randint(0, 2), i, rng.randint(0, 4000), rng.choice([vector] * 20 + [None, [], [0.0] * 4, [1.0, None, 1.0, 1.0]])))
    rng.shuffle(probes)
    table = spark.createDataFrame(probes, "collection long, probe_id long, at long, embedding array<double>").selectExpr("collection", "probe_id", "timestamp_seconds(1700000000 + at) AS ts", "embedding").repartition(5)
    got = cache.answered(spark, f"file://{tmp_path}", table, threshold=0.95, ttl=600, capacity=6, delay="2 hours").collect()
    assert sorted((r["collection"], r["probe_id"], r["entry_id"], r["similarity"], r["hit"]) for r in got) == simulated(probes, 0.95, 600, 6)
    assert 30 < sum(r["hit"] for r in got) < 370


def test_least_recently_used_goes_and_time_ends_entries():
    e = cache.Entries([], 0.9, 10, 2)
    second = 1_000_000
    assert e.ask(1, 0, [1, 0, 0]) == (None, None, False)
    assert e.ask(2, second, [0, 1, 0])[2] is False
    assert e.ask(3, 2 * second, [1, 0, 0]) == (1, 1.0, True)  # 2 is now the least recently used
    e.ask(4, 3 * second, [0, 0, 1])
    assert sorted(e.ids) == [1, 4]
    assert e.ask(5, 10 * second, [1, 0, 0])[2] and not e.ask(6, 11 * second, [1, 0, 0])[2]  # a hit doesn't prolong an entry


@pytest.mark.parametrize("name", ["semantic_cache_stream"])
def test_query_equals_the_simulation(spark, name):
    rows = catalogue.queries()[name](spark, SF).collect()
    v = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    probes = [(r["label"], r["vec_id"], r["vec_id"] % 3600, r["embedding"]) for r in v if r["label"] is not None]
    expected = simulated(probes, cache.THRESHOLD, cache.TTL, cache.CAPACITY)
    assert sorted((r["collection"], r["probe_id"], r["entry_id"], r["hit"]) for r in rows) == [(a, b, c, e) for a, b, c, _, e in expected]
