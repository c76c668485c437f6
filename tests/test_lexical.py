"""The stored lexical index against the search by scan: odd texts, long terms, appended segments, skipped blocks."""

import random

import pytest

from spindrift.operators import lexical, search

from .oracle import by_spark


def corpus(spark, seed=1, n=300):
    rng = random.Random(seed)
    parts = ["the", "quick", "brown", "aa", "aaaa", "abab", "node.js", "x_1", "进程死锁", "操作系统", "哈哈哈", "é", "interoperability", "operating", "operate", "-", "。", "\n"]
    rows = [(i, rng.choice(["", " "]).join(rng.choice(parts) for _ in range(rng.randint(0, 60)))) for i in range(n)]
    return spark.createDataFrame([*rows, (n, None), (n + 1, ""), (n + 2, "aaaaa" * 700 + " 哈" * 30), (n + 3, rows[5][1])], "doc_id long, text string").repartition(3)


QUERIES = [(1, ["aa", "aaa"]), (2, ["opera", "operating"]), (3, ["进程", "死锁", "哈哈"]), (4, ["node.js", "x_1", "quick"]), (5, ["nothing", "here"]), (6, []), (7, None), (8, ["abab", "bab"]), (9, ["interoperability"]), (10, ["The", "the"]), (11, ["操作系统", "ro", "aa", "aa", ""])]


def asked(spark, queries=QUERIES):
    return spark.createDataFrame(queries, "query_id int, terms array<string>")


@pytest.mark.parametrize("segment", [2000, 1 << 21])
@pytest.mark.parametrize("k,cap", [(1, None), (10, None), (1000, 20)])
def test_scores_equal_the_scan(spark, tmp_path, segment, k, cap):
    docs = corpus(spark)
    index = lexical.build(docs, str(tmp_path / "i"), segment)
    assert by_spark(lexical.bm25(index, asked(spark), k, cap)) == by_spark(search.bm25(docs, asked(spark), k, cap))


def test_documents_can_be_appended(spark, tmp_path):
    docs = corpus(spark)
    for part in range(3):
        lexical.build(docs.filter(f"doc_id % 3 = {part}"), str(tmp_path / "i"), 2000)
    index = lexical.read(spark, str(tmp_path / "i"))
    assert by_spark(lexical.bm25(index, asked(spark), 5)) == by_spark(search.bm25(docs, asked(spark), 5))


def test_blocks_and_segments_are_skipped(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(20))) for i in range(4000)]
    rows[1234] = (1234, "rareword alpha " * 8)
    rows[1300] = (1300, "rareword alpha")
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    index = lexical.build(docs, str(tmp_path / "i"), 100_000)
    queries = asked(spark, [(1, ["rareword", "alpha"])])
    found, named = lexical.scores(index, queries, 1)
    read = found.filter("raw is null").agg({"blocks": "sum", "unpacked": "sum"}).first()
    segments = index.filter("kind = 'lengths'").count()
    scored = found.filter("raw is null").count()
    every = lexical._united(lexical._parts(index.filter("kind = 'run'"), ["alpha", "rareword"], True), index.filter("kind = 'lengths'"))
    blocks = sum(len(lexical.Lists(r.asDict() | {"terms": "t"}).last) for r in every.collect())
    assert segments >= 4 and scored == 1
    assert read["sum(unpacked)"] <= 6 < read["sum(blocks)"] < blocks
    assert by_spark(lexical.ranked(found, named, 1)) == by_spark(search.bm25(docs, queries, 1))


def test_a_search_does_not_read_texts_or_other_buckets(spark, tmp_path):
    index = lexical.build(corpus(spark), str(tmp_path / "i"), 3000)
    assert "text" not in index.columns
    plan = lexical._gram_heads(index, ["aa"])._jdf.queryExecution().executedPlan().toString()
    assert "docs" not in plan.split("ReadSchema")[1] and "In(bucket" in plan.replace("EqualTo(bucket", "In(bucket")


def test_odd_input(spark, tmp_path):
    with pytest.raises(ValueError):
        lexical.bm25(lexical.build(corpus(spark, n=6), str(tmp_path / "i")), asked(spark, [(1, ["a b"])]), 3)
    empty = lexical.build(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "e"))
    assert lexical.bm25(empty, asked(spark), 3).collect() == []
    assert lexical.bm25(lexical.build(corpus(spark, n=6), str(tmp_path / "f")), asked(spark, []), 3).collect() == []


def test_counts_of_terms_are_those_of_a_search_in_each_text(spark, monkeypatch):
    monkeypatch.setattr(search, "CHARACTERS", 500)
    docs = corpus(spark, 3, 60)
    terms = ["aa", "aaa", "abab", "ab", "ba", "the", "he", "oper", "opera", "进程", "死锁", "哈哈", "进程死锁", "1", "x_1", "node.js", "é", "k。", "-", "q", "程死", "none"]
    got = {(r["doc_id"], r["term"]): (r["dl"], r["tf"]) for r in search.term_counts(docs, spark.createDataFrame([(t,) for t in terms], "term string")).collect()}
    expected = {(r["doc_id"], t): (len(r["text"]), r["text"].count(t)) for r in docs.collect() for t in terms if r["text"] and t in r["text"]}
    assert got == expected
