import random
import tracemalloc
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from spindrift.llm import cap_filters, jaccard_join, shingles
from spindrift.llm.common import Scratch

from ..oracle import by_spark, by_sql
from .fixtures import documents, empty, texts, words


def brute_sets(found):
    out = []
    for t in found:
        w = (t or "").encode().lower().split()
        out.append(set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    return out


def brute_groups(ids, found):
    sets = brute_sets(found)
    root = list(range(len(ids)))
    find = lambda x: x if root[x] == x else find(root[x])
    for i in range(len(ids)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if (sets[i] and sets[j] and ids[i] is not None and ids[j] is not None and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both)) or (ids[i] is not None and ids[i] == ids[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i in range(len(ids)):
        if ids[i] is not None:
            least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return sorted(((-1 if ids[i] is None else ids[i]), len(sets[i]), -1 if ids[i] is None else least[find(i)]) for i in range(len(ids)))


def grouped(docs, spark):
    rows = jaccard_join.near_duplicates(docs, Scratch(spark, "t")).collect()
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_shingles"], -1 if r["component_id"] is None else r["component_id"]) for r in rows)


def test_shingles_are_the_words_of_bytes():
    found = texts()
    for got, expected in zip(shingles.shingle_sets(found), brute_sets(found)):
        assert len(got) == len(expected)


def test_blocks_give_the_same_hashes(monkeypatch):
    text = ("  " + words(random.Random(1), 3000) + "\t" + "y" * 300 + " end ") * 2
    whole = next(shingles.shingle_sets([text]))
    monkeypatch.setattr(shingles, "BLOCK", 1000)
    monkeypatch.setattr(shingles, "LONG_WORD", 100)
    assert (next(shingles.shingle_sets([text])) == whole).all()


def test_counting_holds_neither_whole_sets_nor_all_texts():
    """A task counts the fronts of 4 million shingles within 32 MB; it held some 90 MB when it kept views of whole sets."""
    batch = pa.record_batch([[" ".join(f"{i // 2}.{j}" for j in range(2000)) for i in range(2000)]], ["text"])
    tracemalloc.start()
    rows = sum(found.num_rows for found in jaccard_join._fronts([batch], 80))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows > 500_000 and peak < 32 << 20


def test_counts_of_blocks_add_up(monkeypatch):
    monkeypatch.setattr(jaccard_join, "FLUSH", 300)
    found = texts()
    expected = Counter(h for one in shingles.shingle_sets(found) for h in one[: len(one) - -(-80 * len(one) // 100) + len(one) // 10 + 4].tolist())
    blocks = list(jaccard_join._fronts([pa.record_batch([found], ["text"])], 80))
    got = Counter()
    for block in blocks:
        got.update(dict(zip(np.asarray(block.column("h")).view(np.uint64).tolist(), block.column("n").to_pylist())))
    assert len(blocks) > 1 and got == expected


def test_groups_against_brute_force(spark):
    docs = documents(spark)
    rows = docs.collect()
    assert grouped(docs, spark) == brute_groups([r["doc_id"] for r in rows], [r["text"] for r in rows])


def variants(n, length=60, edits=6, seed=7):
    """A text and copies of it with a growing number of changed words, in mixed order."""
    rng = random.Random(seed)
    base = words(rng, length).split()
    out = []
    for i in range(n):
        copy = list(base)
        for k in rng.sample(range(length), min(length, rng.randint(0, edits))):
            copy[k] = f"new{rng.randint(0, 10**9)}"
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize(("n", "edits"), [(150, 2), (150, 8)])
def test_crowds_against_brute_force(spark, monkeypatch, n, edits):
    monkeypatch.setattr(jaccard_join, "BLOCK", 32)
    found = variants(n, edits=edits) + variants(20, length=200, edits=30, seed=9) + [words(random.Random(i), 50) for i in range(30)]
    passage = words(random.Random(99), 40)
    found += [passage + " " + words(random.Random(1000 + i), 60) for i in range(100)]
    docs = documents(spark, list(enumerate(found))).repartition(5)
    assert grouped(docs, spark) == brute_groups(list(range(len(found))), found)


def test_sql_agrees(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(texts()) if i != len(texts()) - 6]
    documents(spark, rows).write.parquet(str(tmp_path / "sf" / "documents.parquet"))
    got = by_spark(jaccard_join.op9_jaccard_groups(spark, str(tmp_path / "sf")))
    assert got == by_sql(jaccard_join.ORACLE, {"documents": pd.DataFrame(rows, columns=["doc_id", "text"])})


def test_empty_documents(spark):
    assert grouped(empty(spark), spark) == []


VECTORS = "vec_id long, embedding array<float>, label int, n string, cid string"


def vectors(n, dim=32, seed=1, near=0.1):
    rng = np.random.default_rng(seed)
    centers = rng.standard_normal((max(1, n // 12), dim))
    return (centers[rng.integers(0, len(centers), n)] + near * rng.standard_normal((n, dim)) * rng.random((n, 1)) * 3).astype(np.float32)


def brute_links(rows, threshold=0.93):
    unit = []
    for _, v, label, *_ in rows:
        ok = v is not None and label is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)
        x = np.array(v, np.float64) if ok else None
        unit.append(None if x is None else x / np.linalg.norm(x))
    n = len(rows)
    links, root = [0] * n, list(range(n))
    find = lambda x: x if root[x] == x else find(root[x])
    for i in range(n):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and float(unit[i] @ unit[j]) >= threshold:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i in range(n):
        if rows[i][0] is not None:
            least[find(i)] = min(least.get(find(i), rows[i][0]), rows[i][0])
    return sorted((rows[i][0] if rows[i][0] is not None else -1, links[i], least.get(find(i), -1)) for i in range(n))


def linked(spark, rows, **options):
    df = spark.createDataFrame(rows, VECTORS)
    return sorted((r["vec_id"] if r["vec_id"] is not None else -1, r["n_links"], r["component_id"] if r["component_id"] is not None else -1) for r in cap_filters.near_duplicates(df, Scratch(spark, "t"), **options).collect())


@pytest.mark.parametrize(("crowd", "block"), [(200, 512), (3, 8)])
def test_links_against_brute_force(spark, monkeypatch, crowd, block):
    monkeypatch.setattr(cap_filters, "CROWD", crowd)
    monkeypatch.setattr(cap_filters, "BLOCK", block)
    rows = [(i, v.tolist(), i % 3, "x", "y") for i, v in enumerate(vectors(400))]
    rows += [(1000 + i, rows[0][1], 0, "x", "y") for i in range(50)]
    assert linked(spark, rows) == brute_links(rows)


def test_odd_vectors(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 0), (2, [2.0, 4.0, 6.0], 0), (3, v, None), (4, None, 0), (5, [], 0), (6, [0.0, 0.0, 0.0], 0), (7, [1.0, None, 3.0], 0), (8, [1.0, float("nan"), 3.0], 0), (9, [float("inf"), 1.0, 1.0], 0), (10, v, 1), (11, v + [0.0], 0), (12, v, 0), (12, v, 0), (None, v, 0), (13, [-0.0, 1.0, 0.0], 2), (14, [0.0, 1.0, 0.0], 2), (15, [1e-30, 2e-30, 3e-30], 0)]
    rows = [(*r, "x", "y") for r in rows]
    assert linked(spark, rows) == brute_links(rows)
    assert linked(spark, []) == []


def test_threshold_is_in_double_precision(spark):
    a = np.zeros(8, np.float32)
    a[0] = 1
    rows = []
    for i, cos in enumerate((0.9299999, 0.93, 0.9300001)):
        b = a.copy()
        b[0], b[1] = cos, (1 - cos**2) ** 0.5
        rows += [(2 * i, a.tolist(), i, "x", "y"), (2 * i + 1, b.tolist(), i, "x", "y")]
    assert linked(spark, rows) == brute_links(rows)


def test_every_vector_is_listed():
    unit = vectors(500)
    unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
    listed = cap_filters.directions(9, 0.93)
    rows, filters = cap_filters.decode(unit.astype(float), 9, listed)
    assert np.bincount(rows, minlength=500).min() >= listed
    rotation, parts, slices = cap_filters.code(32, 9)
    turned = unit @ rotation
    scores = sum((turned[:, s] @ w.T)[:, np.arange(729) // 9**k % 9] for k, (s, w) in enumerate(zip(slices[::-1], parts[::-1])))
    for r in range(0, 500, 50):
        mine = filters[rows == r]
        assert scores[r][mine].min() >= np.delete(scores[r], mine).max() - 1e-9


@pytest.mark.parametrize("n", [8, 10, 11, 12])
def test_words_that_a_polynomial_confuses_do_not_link(n):
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    one, other = shingles.shingle_sets([f"{a} one two three four", f"{b} one two three four"])
    assert len(one) == len(other) == 1 and one[0] != other[0]
