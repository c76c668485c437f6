"""Queries that cover whole tables, against brute force."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from spindrift.operators import corpus, drivers
from spindrift.plans import catalogue

SF = "/root/testdata/sf0.001"


def rows_of(name):
    return pd.read_parquet(f"{SF}/{name}.parquet").to_dict("records")


def grams(text):
    import re

    t = re.sub(r"[ \t\n\x0b\f\r]+", " ", text.strip(" "))
    return {t[i : i + 3] for i in range(len(t) - 2)} or ({t} if t else set())


def jaccard_pairs(docs, threshold):
    sets = [(i, grams(t)) for i, t in docs if t is not None]
    sets = [(i, g) for i, g in sets if g]
    pairs = ((min(i, j), max(i, j), len(x & y) / len(x | y)) for k, (i, x) in enumerate(sets) for j, y in sets[k + 1 :])
    return {(i, j): round(s, 6) for i, j, s in pairs if s >= threshold}


@pytest.mark.parametrize("threshold", [0.9, 0.7])
def test_near_pairs_match_brute_force(spark, threshold):
    base = "the quick brown fox jumps over the lazy dog while it rains "
    texts = [base, base + "x", base[:-4], base * 2, base, " ", "", "ab", "ab ", "abc", "a", None, *(base[: 12 + i] for i in range(0, 44, 2)), "é" * 9, "日本語の文章です", "日本語の文章です。"]
    docs = list(enumerate(texts))
    got = corpus.near_pairs(spark.createDataFrame(docs, "doc_id long, text string"), threshold).collect()
    assert len(got) == len({(r["a"], r["b"]) for r in got})
    assert {(r["a"], r["b"]): r["similarity"] for r in got} == jaccard_pairs(docs, threshold)


def prose(n, seed, copies=0.3):
    """Texts of one small vocabulary, which share many grams by chance; some are near copies of others."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(150)]
    out = []
    for _ in range(n):
        t = rng.choice(out).split(" ") if out and rng.random() < copies else [rng.choice(vocabulary) for _ in range(rng.randint(60, 90))]
        t[rng.randrange(len(t))] = rng.choice(vocabulary)
        out.append(" ".join(t))
    return out


def test_near_pairs_meet_across_blocks_and_few_others_are_verified(spark, monkeypatch):
    monkeypatch.setattr(corpus, "BLOCK", 64)
    monkeypatch.setattr(corpus, "TOGETHER", 50)
    docs = list(enumerate(prose(400, 5)))
    expected = jaccard_pairs(docs, 0.9)
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    seen = []
    verified = corpus.pair_similarity
    monkeypatch.setattr(corpus, "pair_similarity", lambda pairs, *rest: seen.append(pairs.count()) or verified(pairs, *rest))
    got = {(r["a"], r["b"]): r["similarity"] for r in corpus.near_pairs(rows, 0.9).collect()}
    assert len(expected) > 100 and got == expected
    # of 79,800 pairs; those that share a part of their sets by chance were thousands
    assert seen[0] <= 1.5 * len(expected)


def test_dedup_verifies_few_pairs(spark, monkeypatch):
    docs = list(enumerate(prose(200, 9)))
    pairs, seen = sorted(jaccard_pairs(docs, 0.9)), []
    verified = corpus.pair_similarity
    monkeypatch.setattr(corpus, "pair_similarity", lambda pairs, *rest: seen.append(pairs.count()) or verified(pairs, *rest))
    gone = set()
    for a, b in pairs:
        if a not in gone:
            gone.add(b)
    got = drivers.dedup(spark.createDataFrame(docs, "doc_id long, text string")).filter("not kept").collect()
    assert gone and {r["doc_id"] for r in got} == gone
    assert seen[0] <= 1.5 * len(pairs)


def test_rows_without_an_id_have_no_near_pairs(spark):
    text = "one text that a row without an id repeats, more or less"
    docs = spark.createDataFrame([(1, text), (None, text), (None, text + "!"), (2, text + "?")], "doc_id long, text string")
    assert [(r["a"], r["b"]) for r in corpus.near_pairs(docs, 0.9).collect()] == [(1, 2)]


def test_near_copies_of_documents_are_found(spark):
    docs = [(r["doc_id"], r["text"]) for r in rows_of("documents")]
    expected = jaccard_pairs(docs, 0.9)
    got = {(r["a"], r["b"]): r["similarity"] for r in catalogue.queries()["near_dup_jaccard"](spark, SF).collect()}
    assert expected and got == expected
    found = [(r["a"], r["b"]) for r in catalogue.queries()["minhash_candidates"](spark, SF).collect()]
    assert len(found) == len(set(found)) and {p for p, s in expected.items() if s == 1} <= set(found)
    counts = {r["doc_id"]: r["n"] for r in catalogue.queries()["shingle_counts"](spark, SF).collect()}
    assert counts == {i: len(grams(t)) for i, t in docs}


def test_searches_grow_with_the_table(spark, tmp_path):
    found = catalogue.queries()
    v = spark.read.parquet(f"{SF}/embeddings.parquet")
    ids = [r[0] for r in v.filter("vec_id % 100 = 0").select("vec_id").collect()]
    assert len(ids) == 5
    for name in ("vector_topk", "vector_topk_filtered", "semantic_cache_lookup"):
        assert {r["query_id"] for r in found[name](spark, SF).collect()} == set(ids)
    # a late copy of query 0 is found by all three; the cache needs a time at which it is live
    late = 360_007
    v.unionByName(v.filter("vec_id = 0").withColumn("vec_id", F.lit(late).cast("long"))).filter(f"vec_id in (0, 1, 2, {late})").write.parquet(str(tmp_path / "embeddings.parquet"))
    for name in ("vector_topk", "vector_topk_filtered"):
        assert (late, 1.0) in {(r["vec_id"], r["similarity"]) for r in found[name](spark, str(tmp_path)).collect()}
    entries = spark.read.parquet(str(tmp_path / "embeddings.parquet")).filter("vec_id > 0").unionByName(v.filter("vec_id = 0").withColumn("label", F.lit(-1)))
    entries = entries.unionByName(v.filter("vec_id = 0").withColumn("vec_id", F.lit(100).cast("long")))
    entries.write.parquet(str(tmp_path / "cache" / "embeddings.parquet"))
    hits = {r["query_id"]: (r["vec_id"], r["hit"]) for r in found["semantic_cache_lookup"](spark, str(tmp_path / "cache")).collect()}
    assert hits[100] in {(100, True), (late, True)}


def test_graph_holds_every_order(spark):
    from itertools import groupby

    edges = set()
    rows = sorted((r["l_orderkey"], r["l_linenumber"], r["l_partkey"]) for r in rows_of("lineitem"))
    for _, order in groupby(rows, lambda r: r[0]):
        keys = [f"p{r[2]}" for r in order]
        edges |= set(zip(keys, keys[1:]))
    down, up = {}, {}
    for s, t in edges:
        down.setdefault(s, set()).add(t)
        up.setdefault(t, set()).add(s)

    def reach(start, step, depth):
        hops, front = {}, {start}
        for n in range(1, depth + 1):
            front = {t for s in front for t in step.get(s, ())} - set(hops)
            hops |= dict.fromkeys(front, n)
        return hops

    starts, found = ["p1", "p7", "p30"], catalogue.queries()
    collect = lambda name, *c: sorted(tuple(r[x] for x in c) for r in found[name](spark, SF).collect())
    both = {x: down.get(x, set()) | up.get(x, set()) for x in {*down, *up}}
    assert collect("kg_successors", "start", "name", "hops") == sorted((s, t, n) for s in starts for t, n in reach(s, down, 2).items())
    assert collect("kg_prerequisites", "start", "name", "hops") == sorted((s, t, n) for s in starts for t, n in reach(s, up, 3).items())
    nodes, inner, paths = [], [], []
    for s in starts:
        near = sorted(({*reach(s, down, 2), *reach(s, up, 2)}) - {s})[:30]
        nodes += [(s, x, i) for i, x in enumerate(near, 1)]
        around = {s, *reach(s, both, 1)}
        inner += [(s, *e, i) for i, e in enumerate(sorted(e for e in edges if around >= set(e))[:40], 1)]
        every, front = [], [((s,), frozenset())]
        for n in range(1, 4):
            front = [((x, *p), u | {(x, p[0])}) for p, u in front for x in up.get(p[0], ()) if (x, p[0]) not in u]
            every += [(n, "\u0001".join(p)) for p, _ in front]
        paths += [(s, p.replace("\u0001", " "), n, i) for i, (n, p) in enumerate(sorted(every)[:3], 1)]
    assert collect("kg_subgraph_nodes", "start", "name", "rank") == sorted(nodes)
    assert collect("kg_subgraph_edges", "start", "source", "target", "rank") == sorted(inner)
    assert collect("kg_paths", "target", "path", "length", "rank") == sorted(paths)


def test_documents_without_vector_are_retrieved(spark, tmp_path):
    from spindrift.operators import search
    from spindrift.plans import retrieval_queries as r

    word = "Zyxwvutsrq"
    d = spark.read.parquet(f"{SF}/documents.parquet")
    lone = 900_000
    extra = d.filter("doc_id = 0").withColumns({"doc_id": F.lit(lone + 4).cast("long"), "text": F.lit(f"{word} {word}"), "source": F.lit("lone")})
    before = extra.withColumns({"doc_id": F.lit(lone).cast("long"), "text": F.lit("A neighbour.")})
    d.unionByName(extra).unionByName(before).write.parquet(str(tmp_path / "documents.parquet"))
    b = spark.read.parquet(f"{SF}/benchmark.parquet")
    b.filter("item_id <> 1").unionByName(b.filter("item_id = 1").withColumn("text", F.lit(word))).write.parquet(str(tmp_path / "benchmark.parquet"))
    v = spark.read.parquet(f"{SF}/embeddings.parquet").filter("vec_id < 100")
    v.write.parquet(str(tmp_path / "embeddings.parquet"))
    sf, found = str(tmp_path), catalogue.queries()
    rows = found["retrieve_documents"](spark, sf).collect()
    assert lone + 4 in {x["chunk_id"] for x in rows if x["query_id"] == 1}
    near = {x["chunk_id"]: x["expanded"] for x in found["retrieve_expanded"](spark, sf).collect() if x["query_id"] == 1}
    assert near[lone + 4] is False and near[lone] is True
    assert r._corpus(spark, sf).count() == d.count() + 2
    hits = r.retrieval.route_hits(r._batch(spark, sf), r._corpus(spark, sf), r.retrieval.Options())
    got = {(x["query_id"], x["key"], x["rank"]) for x in hits.filter("route = 'keyword_bm25'").collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    whole = search.bm25(docs, r._batch(spark, sf), r.retrieval.Options().coarse_k)
    assert got == {(x["query_id"], x["doc_id"], x["rank"]) for x in whole.collect()}
    assert hits.filter("route = 'semantic' and key >= 100").isEmpty()


def test_no_row_subset_is_left(spark):
    found = catalogue.queries()
    sources = {r["source"] for r in rows_of("documents")}
    assert {r["query_id"] for r in found["evidence_verdict"](spark, SF).collect()} == sources
    from spindrift.plans import routing_queries, tracing_queries

    assert routing_queries._summary(spark, SF).agg(F.sum("n")).first()[0] == len(rows_of("documents"))
    users = {r["user_id"] for r in tracing_queries._effective(spark, SF).select("user_id").distinct().collect()}
    assert {r["user_id"] for r in found["category_detail"](spark, SF).collect()} == users
    own = {}
    for r in rows_of("documents"):
        key = f"r{r['doc_id'] % 5}", r["source"]
        own[key] = own.get(key, 0) + 1 / (20 + r["n_chars"] % 30)
    got = {r["route"]: r["mean_delta"] for r in found["route_ablation"](spark, SF).collect()}
    assert got == {f"r{k}": pytest.approx(-sum(own.get((f"r{k}", s), 0) for s in sources) / len(sources), abs=2e-6) for k in range(5)}


def test_parents_hold_their_hits(spark):
    from spindrift.plans import search_queries as s

    chunks = sorted((((x["section"], x["chunk_index"]), x.asDict()) for x in s._chunks(spark, SF).collect()), key=lambda c: c[0])
    parents, texts = {}, {}
    for (section, i), r in chunks:
        parents.setdefault(f"{section}:{i // 3}", []).append(r["text"])
        texts[section, i] = r["text"]
    expected = set()
    by_query = {}
    for h in s._hits(s._chunks(spark, SF)).collect():
        by_query.setdefault(h["query_id"], []).append((h["rank"], h["section"], h["chunk_index"]))
    assert any(i >= 3 for hits in by_query.values() for _, _, i in hits)
    for query, hits in by_query.items():
        seen, used = set(), 0
        for rank, section, i in sorted(hits):
            parent = f"{section}:{i // 3}"
            text = "".join(parents[parent])
            assert texts[section, i] in text
            if parent not in seen and len(text) > len(texts[section, i]) + 40:
                used += len(text) // 4
                if used <= 12000:
                    expected.add((query, parent, rank, len(text) // 4, used))
            seen.add(parent)
    got = {(r["query_id"], r["parent_id"], r["rank"], r["tokens"], r["used"]) for r in catalogue.queries()["parent_window"](spark, SF).collect()}
    assert expected and got == expected
