"""Exact sums against Python integers, whitening against fractions, odd vectors, any partitioning."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.llm import whitening as wh

FIELDS = "vec_id long, embedding array<float>, label int, n long, component string"


def table(spark, vectors, parts=3):
    rows = [(i, v, None, 5, "x") for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, FIELDS).repartition(parts) if rows else spark.createDataFrame([], FIELDS)


def some(seed=1, n=200, d=6):
    rng = np.random.default_rng(seed)
    mixing = rng.normal(size=(d, d))
    return np.float32(rng.normal(size=(n, d)) @ mixing + 3 * rng.normal(size=d)).tolist()


def brute(vectors):
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    v = [[sum(Fraction(n * r[i] - s[i]) * (n * r[j] - s[j]) for r in x) / n**3 for j in range(d)] for i in range(d)]
    return x, n, s, v


@pytest.mark.parametrize("bits", [1, 19, 20, 21, 39, 41, 58, 61])
def test_sums_are_exact_at_any_size(bits):
    rng = random.Random(bits)
    x = np.array([[rng.randint(-(2**bits), 2**bits) for _ in range(4)] for _ in range(300)] + [[2**bits] * 4, [-(2**bits)] * 4])
    got = wh.Sums.of(x)
    rows = x.tolist()
    assert got.s.tolist() == [sum(r[j] for r in rows) for j in range(4)]
    assert got.xx.tolist() == [[sum(r[i] * r[j] for r in rows) for j in range(4)] for i in range(4)]
    again = wh.Sums.read(got.row())
    assert (again.n, again.s.tolist(), again.xx.tolist()) == (got.n, got.s.tolist(), got.xx.tolist())


def test_full_blocks_are_exact():
    x = np.full((wh.ROWS, 3), (1 << 21) - 1)
    x[::2] = 1 - (1 << 21)
    assert wh.Sums.of(x).xx[0, 1] == wh.ROWS * ((1 << 21) - 1) ** 2


@pytest.mark.parametrize("n", [3, 10**6, 10**10, 10**17])
def test_deviations_are_exact_for_any_number_of_rows(n):
    rng = np.random.default_rng(2)
    rows = rng.normal(size=(50, 5)) * 40
    x = [[math.floor(64 * c) + 1_000_000 for c in r] for r in rows.tolist()]
    s = np.array([1_000_000 * n + n // 3 + j for j in range(5)], object)
    model = wh.Whitener(n, s, np.eye(5), np.ones(5), np.ones(5))
    centred, squares = model.distances(rows)
    assert squares.tolist() == [sum((n * a - b) ** 2 for a, b in zip(r, s.tolist())) for r in x]
    assert np.allclose(centred, [[float(Fraction(n * a - b, n)) for a, b in zip(r, s.tolist())] for r in x], rtol=1e-15, atol=0)


def test_whitening_matches_fractions(spark):
    vectors = some()
    odd = [None, [], [1.0, None, 1.0, 1.0, 1.0, 1.0], [math.nan] * 6, [math.inf] + [1.0] * 5, [1.0, 2.0], vectors[0]]
    x, n, s, v = brute([*vectors, vectors[0]])
    rows = wh.whiten(table(spark, [*vectors, *odd]), components=4).collect()
    assert {r["vec_id"] for r in rows} == {*range(200), 206} and len(rows) == 201
    values, axes = np.linalg.eigh(np.array([[float(c) for c in row] for row in v]))
    values, axes = values[::-1], axes[:, ::-1]
    x = {**dict(enumerate(x[:200])), 206: x[200]}
    for r in rows:
        z = [n * a - b for a, b in zip(x[r["vec_id"]], s)]
        assert r["n"] == n and int(r["deviation"]) == sum(c * c for c in z)
        expected = (np.array([float(Fraction(c, n)) for c in z]) @ axes / np.sqrt(values))[:4]
        assert np.allclose(np.abs(r["whitened"]), np.abs(expected), rtol=1e-8, atol=1e-10)
        assert np.allclose(r["explained"], (values / values.sum())[:4], rtol=1e-10)
        assert r["identity_error"] < 1e-9
    w = np.array([r["whitened"] for r in rows])
    assert np.allclose(np.cov(w.T, bias=True), np.eye(4), atol=1e-9)


def test_partitioning_does_not_change_a_bit(spark):
    vectors = some(3, 500)
    models = [wh.scatter(table(spark, vectors, parts)) for parts in (1, 7, 40)]
    assert all(m.s.tolist() == models[0].s.tolist() and m.xx.tolist() == models[0].xx.tolist() and m.n == 500 for m in models)


def test_vectors_without_variance(spark):
    same = wh.whiten(table(spark, [[1.0, 2.0]] * 3)).collect()
    assert len(same) == 3 and all(r["whitened"] == [None, None] and r["explained"] == [0, 0] and r["deviation"] == 0 and r["identity_error"] == 0 for r in same)
    line = wh.whiten(table(spark, [[float(i), 5.0, 2.0 * i] for i in range(10)])).collect()
    assert all(r["whitened"][0] is not None and r["whitened"][1:] == [None, None] and r["identity_error"] < 1e-9 for r in line)
    one = wh.whiten(table(spark, [[1.0, 2.0]])).collect()
    assert one[0]["deviation"] == 0 and one[0]["whitened"] == [None, None]


def test_nothing_to_fit_and_large_entries(spark):
    assert wh.whiten(table(spark, [])).collect() == []
    assert wh.whiten(table(spark, [None, [], [math.nan]])).collect() == []
    rows = wh.whiten(table(spark, [[1e30, 1.0], [-1e30, 2.0], [1e12, 3.0]])).collect()
    assert len(rows) == 3 and all(r["identity_error"] < 1e-6 for r in rows)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    vectors = [r["embedding"] for r in spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()]
    good = [v for v in vectors if v and all(c is not None and math.isfinite(c) for c in v)]
    out = wh.op12_exact_whitening(spark, sf)
    assert out.count() == 32 * len(good)
    assert out.select("component").distinct().count() == 32
    w = np.array([[r["whitened"] for r in out.filter(F.col("component") == k).orderBy("vec_id").collect()] for k in (1, 2, 32)])
    assert np.allclose(w @ w.T / w.shape[1], np.eye(3), atol=1e-8)
