"""Golden values, properties and edge cases of the operators."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spindrift.functions import text as T
from spindrift.operators import chunking, corpus, dialog, fusion, govern, graph, questions, search, tracing
from spindrift.sources import files


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("v")).first()["v"]


def test_rrf_constant(spark):
    got = spark.createDataFrame([(1,), (4,), (36,), (100,)], "n long").select(fusion.rrf_k(F.col("n"))).collect()
    assert [r[0] for r in got] == [10, 20, 60, 60]


def test_interleave(spark):
    got = spark.range(1, 6).select("id", fusion.interleave(F.col("id"), F.lit(5)).alias("p")).collect()
    assert [r["id"] for r in sorted(got, key=lambda r: r["p"])] == [1, 3, 5, 4, 2]


def test_deltas(spark):
    expected = {"qa_high_confidence": (0.06, 0.12), "quiz_correct": (0.1, 0.2), "quiz_partial": (0.015, 0.03), "quiz_wrong": (-0.06, -0.03), "grading_fail": (-0.08, -0.04), "unknown": (0.0, 0.0)}
    for kind, values in expected.items():
        for difficulty, value in zip((1.0, 2.0), values):
            assert one(spark, tracing.event_delta(F.lit(kind), F.lit(difficulty), F.lit(1.0))) == pytest.approx(value)


def test_retention_starts_at_a_day(spark):
    assert one(spark, tracing.retained(F.lit(0.8), F.lit(0.5), F.lit(23.9))) == 0.8
    assert one(spark, tracing.retained(F.lit(0.8), F.lit(0.5), F.lit(24.0))) == pytest.approx(0.8 * math.exp(-24 / 216))


def test_wilson_grows(spark):
    got = [one(spark, tracing.wilson(F.lit(n), F.lit(0))) for n in (0, 1, 5, 50)]
    assert got == sorted(got) and got[0] == 0


def test_time_ago(spark):
    got = [one(spark, tracing.time_ago(F.lit(h))) for h in (0.001, 0.5, 5.0, 50.0)]
    assert got == ["刚刚", "30分钟前", "5小时前", "2天前"]


def test_daily_trend_golden(spark):
    rows = spark.sql("SELECT * FROM VALUES (1, timestamp'2024-01-01 01:00', 0.2D, 0.1D, 'b'), (1, timestamp'2024-01-01 23:00', 0.4D, 0.3D, 'a') AS t(user_id, created_at, mastery, effective_score, event_type)")
    row = tracing.daily_trend(rows).first()
    assert (row["avg_mastery"], row["avg_effective_score"], row["event_count"], row["event_types"]) == (0.3, 0.2, 2, "a,b")


def test_stream_equals_batch(spark):
    from spindrift.plans.chunk_queries import stream_mastery
    from spindrift.plans.tracing_queries import mastery_history

    sf = "/root/testdata/sf0.001"
    streamed = {r["event_id"]: r["mastery"] for r in stream_mastery(spark, sf).filter("not late").collect()}
    batch = {r["event_id"]: r["mastery"] for r in mastery_history(spark, sf).collect()}
    assert len(streamed) > 0.9 * len(batch)
    assert all(batch[k] == pytest.approx(v, abs=1e-8) for k, v in streamed.items())


def test_exact_dedup_is_idempotent(spark):
    docs = spark.createDataFrame([(1, "a "), (2, "a"), (3, None), (4, ""), (5, "b")], "doc_id long, text string")
    kept = corpus.exact_dedup(docs).filter("kept").select("doc_id")
    again = corpus.exact_dedup(docs.join(kept, "doc_id")).filter("kept").select("doc_id")
    assert sorted(r[0] for r in kept.collect()) == sorted(r[0] for r in again.collect()) == [1, 5]


def test_greedy_keep_follows_order(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "a long, b long")
    assert {r["removed"]: r["kept"] for r in corpus.greedy_keep(pairs).collect()} == {2: 1, 4: 3}


def test_ngram_pairs_match_brute_force(spark):
    texts = ["abcdefgh", "abcdefgx", "zzzzzzzz", "abcdefgh", "", "ab", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    grams = [None if not t else ({t[i : i + 3] for i in range(len(t) - 2)} or {t}) for t in texts]
    expected = {(i, j) for i in range(7) for j in range(i + 1, 7) if grams[i] and grams[j] and len(grams[i] & grams[j]) / len(grams[i] | grams[j]) >= 0.5}
    assert {(r["a"], r["b"]) for r in corpus.ngram_pairs(docs, 0.5).collect()} == expected


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["Word one. ", "Second sentence! ", "\n\n", "# Head\n", "```\ncode. x\n```\n", "|a|b|\n", "tail"]), max_size=30))
def test_chunks_lose_no_words(parts):
    text = "".join(parts)
    rows = chunking.chunk_one(1, "s", text, 60, 0)
    got = " ".join(r[13] for r in rows) + " " + " ".join(r[7] for r in rows)
    for word in {"one", "Second", "code", "tail"}:
        if word in text and len(text) > 200:
            assert word in got
    assert all(r[13].strip() for r in rows)


def test_chunk_ids_and_sections():
    rows = chunking.chunk_one(7, "f.md", "intro text.\n# A\nalpha text.\n## B\nbeta text.", 400, 100)
    assert [(r[1], r[8]) for r in rows] == [("chk::f.md::0::0", ""), ("chk::f.md::1::0", "[A]"), ("chk::f.md::2::0", "[A > B]")]


def test_parent_window_keeps_anchor():
    assert chunking.parent_window(["a" * 10, "b" * 10, "c" * 10], 1, 24) == "a" * 10 + "\n\n" + "b" * 10


def test_paths_use_an_edge_once(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "source string, target string")
    got = graph.paths(edges, spark.createDataFrame([("a",)], "target string"), 5).collect()
    assert [r["path"] for r in sorted(got, key=lambda r: r["rank"])] == [["c", "a"], ["b", "c", "a"], ["a", "b", "c", "a"]]


def test_safe_filename(spark):
    names = ["../../etc/passwd", "a b.md", "", "..", "目录/笔记.md"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(files.safe_filename(F.col("n"))).collect()
    assert [r[0] for r in got] == ["passwd", "a_b.md", "upload", "upload", "笔记.md"]


def test_load_decodes_and_isolates_errors(spark, tmp_path):
    (tmp_path / "os").mkdir()
    (tmp_path / "os" / "a.md").write_bytes("进程".encode("gb18030"))
    (tmp_path / "b.txt").write_bytes("plain".encode())
    (tmp_path / "c.bin").write_bytes(b"\x00\x01")
    rows = {r["source"]: r for r in files.load(spark, str(tmp_path)).collect()}
    assert rows["os/a.md"]["text"] == "进程" and rows["os/a.md"]["category"] == "os"
    assert rows["b.txt"]["text"] == "plain" and rows["c.bin"]["error"]


def test_eval_samples(spark, tmp_path):
    (tmp_path / "set.jsonl").write_text('# note\n\n{"query": "q", "metadata": {"category": "os"}}\nbroken\n{"reference": "none"}\n')
    rows = files.eval_samples(spark, str(tmp_path)).collect()
    assert [(r["set"], r["query"], r["metadata"]["category"]) for r in rows] == [("set", "q", "os")]


def test_append_chunks_skips_known(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = spark.createDataFrame([("x", "a"), ("x", "a"), ("y", "a")], "collection string, text string")
    assert files.append_chunks(rows, path) == 2
    assert files.append_chunks(rows, path) == 0
    files.drop_collection(spark, path, "x")
    assert [r["collection"] for r in files.collection_info(spark.read.parquet(path)).collect()] == ["y"]


def test_token_budget_prefix(spark):
    rows = spark.createDataFrame([("q", 1, 300), ("q", 2, 900), ("q", 3, 10)], "query_id string, rank int, tokens long")
    got = fusion.token_budget(rows, 1000).collect()
    assert [(r["rank"], r["used"], r["truncated"]) for r in got] == [(1, 300, False), (2, 700, True)]


def test_bm25_of_empty_inputs(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    queries = spark.createDataFrame([(1, ["a", ""])], "query_id long, terms array<string>")
    assert search.bm25(docs, queries, 5).collect() == []


def test_forged_sources_are_checked(spark):
    df = spark.createDataFrame([("根据教材第 3 章，如此", ["根据教材 3 的内容"]), ("根据教材第 9 章，如此", ["x"])], "a string, o array<string>")
    got = df.select(F.size(govern.forged(F.col("a"), F.col("o")))).collect()
    assert got[1][0] == 1


def test_question_quality_golden(spark):
    rows = spark.createDataFrame([("b", "x", f"s{i}", "") for i in range(5)], "batch_id string, question_type string, stem string, explanation string")
    assert {r["quality_score"] for r in questions.quality(rows).collect()} == {0.5}


def test_nfkc(spark):
    assert one(spark, T.nfkc(F.lit("ＡＢ①"))) == "AB1"


def test_summary_due(spark):
    got = spark.createDataFrame([(15,), (16,), (32,)], "n long").select(dialog.summary_due(F.col("n"))).collect()
    assert [r[0] for r in got] == [False, True, True]


def test_term_counts_match_str_count(spark):
    texts = ["aaa aa b", "", None, "ab abab", "été été"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    terms = ["a", "aa", "ab", "é", "zz"]
    got = {(r["doc_id"], r["term"]): r["tf"] for r in search.term_counts(docs, spark.createDataFrame([(t,) for t in terms], "term string")).collect()}
    assert got == {(i, t): x.count(t) for i, x in enumerate(texts) if x for t in terms if t in x}


def test_segments_cover_the_text():
    from spindrift.operators.repair import segment_one

    text = " ".join(["alpha beta gamma"] * 120) + " " + " ".join(["one two three"] * 120)
    found = segment_one(text, 50, 25, 0.55, 500, 700)
    assert len(found) > 2 and found[0][0] == 0
    assert all(p + n == q for (p, n), (q, _) in zip(found, found[1:])) and sum(n for _, n in found) == len(text)
    assert segment_one("short", 50, 25, 0.55, 500, 2000) == []


def test_truncated_context_keeps_order(spark):
    from spindrift.operators import learning

    text = "first key\n\n" + "x" * 50 + "\n\nsecond key key\n\nthird"
    df = spark.createDataFrame([(text, ["key"])], "c string, t array<string>")
    got = df.select(learning.truncate_context(F.col("c"), F.col("t"), 40)).first()[0]
    assert got.startswith("first key\n\nsecond key key") and "x" not in got.split("[")[0]


def test_synonyms_replace_longest_first(spark):
    from spindrift.operators import repair

    text, n = repair.normalize_synonyms(F.lit("BST树 BST"), {"BST": "tree", "BST树": "TREE"})
    assert spark.range(1).select(text, n).first()[:] == ("TREE tree", 2)


def test_retry_takes_only_failed_queries(spark):
    from spindrift.plans.retrieval_queries import retrieve_with_retry

    rows = retrieve_with_retry(spark, "/root/testdata/sf0.001").collect()
    attempts = {}
    for r in rows:
        attempts.setdefault(r["query_id"], set()).add(r["attempt"])
    assert all(len(a) == 1 for a in attempts.values())
