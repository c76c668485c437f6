"""Corpus drivers, chunks, streams and graph evidence against brute force."""

import re

import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spindrift.operators import chunking, corpus, drivers, graph, lookups, retrieval
from spindrift.plans import catalogue
from spindrift.streaming import tracking

from .test_whole_tables import jaccard_pairs

SF = "/root/testdata/sf0.001"
PART = st.sampled_from(["# Head\n", "## Sub\n", "A whole sentence. ", "short tail without an end", "\n\n", "\n", "题目1：问题？\n", "答案：A\n", "```\ncode {}\n```\n", "| a | b |\n|---|---|\n| 1 | 2 |\n", "- item\n", "$$x$$\n", "没有句号的一段", "长" * 90, "word " * 60])


def words(text):
    return sorted(re.findall(r"\w+", text))


@settings(max_examples=150, deadline=None)
@given(st.lists(PART, max_size=14).map("".join), st.sampled_from([120, 400, None]))
def test_chunks_hold_every_word(text, size):
    """Without overlap the words of all chunks and headings are those of the text."""
    rows = chunking.chunk_one(1, "s", text, size, 0)
    whole = " ".join(r[13] for r in rows) + " " + " ".join(title for level, title, _, _ in chunking.sections(text) if level)
    missing = [w for w in set(words(text)) if words(whole).count(w) < words(text).count(w)]
    assert not missing, missing


def test_a_short_tail_stays():
    rows = chunking.chunk_one(1, "s", "This is a complete sentence.\n\nshort tail without an end", 400, 100)
    assert [r[13] for r in rows] == ["This is a complete sentence.\n\nshort tail without an end"]


def test_sections_are_cut_by_their_type():
    exam = "## 真题\n" + "".join(f"### 第{i}题（x）\n{'题干' * 300}\n正确答案：A\n" for i in range(1, 6))
    rows = chunking.chunk_one(1, "s", exam, None, None)
    assert chunking.split_questions("".join(f"##### {i}\n{'x' * 900}\n" for i in range(5)), 2000) == [f"##### {i}\n{'x' * 900}" + (f"\n\n##### {i + 1}\n{'x' * 900}" if i < 4 else "") for i in (0, 2, 4)]
    assert all(r[12] == "A" for r in rows if r[11]) and any(r[11] for r in rows)
    prose = "A sentence of words that goes on. " * 60
    sizes = {k: max(len(r[13]) for r in chunking.chunk_one(1, "s", head + prose, None, None)) for k, head in {"text": "# Notes\n\n", "code": "# Notes\n\n```\ncode\n```\n\n"}.items()}
    assert sizes["code"] <= 1200 and sizes["text"] <= 1200
    assert [chunking.section_kind(*x) for x in (("答案：A", "练习"), ("| a |\n|---|\n", ""), ("$$x$$", ""), ("- a\n", ""), ("plain", "习题"), ("plain", "解析"), ("plain", ""))] == ["merged_qa", "table", "formula", "list", "exercise", "answer", "text"]


def test_dedup_against_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in pd.read_parquet(f"{SF}/documents.parquet").to_dict("records")]
    first, expected = {}, {}
    for i, t in sorted(docs):
        if t.strip(" "):
            j = first.setdefault(t.strip(" "), i)
            expected[i] = (i == j, j, None if i == j else "exact")
    left = [(i, t) for i, t in sorted(docs) if i in expected and expected[i][0]]
    gone = {}
    for a, b in sorted(jaccard_pairs(left, 0.9)):
        if a not in gone:
            gone.setdefault(b, a)
    expected |= {b: (False, min(a for a, x in jaccard_pairs(left, 0.9) if x == b and a not in gone), "fuzzy") for b in gone}
    got = {r["doc_id"]: (r["kept"], r["duplicate_of"], r["kind"]) for r in catalogue.queries()["dedup_documents"](spark, SF).collect()}
    assert got == expected and {k for _, _, k in got.values()} == {None, "exact", "fuzzy"}


def test_anomalies_of_both_phases(spark):
    texts = [f"normal text that says something ordinary {'w' * i}" for i in range(8)] + ["░▒▓" * 20, " ".join(f"w{i}" for i in range(2000)), "".join(f"数据{chr(97 + i)}{chr(98 + i)} {chr(0x4e00 + i)}" for i in range(20)), None, "aaaaaaaaaaaaaaaaaaaaaaaa"]
    rows = {r["doc_id"]: r for r in drivers.anomalies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert 8 not in rows and len(rows) == len(texts) - 1
    assert "language_mixed" in rows[10]["actions"] and rows[9]["outlier"] == "too_long" and "length:too_long" in rows[9]["actions"]
    assert any(a.startswith("collapsed") for a in rows[12]["actions"]) and rows[0]["actions"] == [] and rows[11]["text"] == ""
    assert drivers.anomalies(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_characters_are_counted_in_time_linear_in_a_text(spark):
    import time
    from collections import Counter

    texts = ["aa b，b. c\t", "😀😀é 😀 x", "", " ., ", None, "мир é 中文 word " * 3, "".join(chr(0x4E00 + i % 3000) for i in range(40_000)) + "中" * 3000, "Ab9" * 100_000]
    left_out = set("，。！？：；、“”‘’（）【】《》…—·.,;:!?()[]{}/'\" \t\n\x0b\f\r")
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    rows.select(corpus.frequent_chars(F.col("text"))).limit(1).collect()
    began = time.time()
    got = {r["id"]: r for r in rows.select("id", corpus.frequent_chars(F.col("text")).alias("chars"), corpus.language_mix(F.col("text")).alias("mix"), corpus.garbage_ratio(F.col("text")).alias("garbage")).collect()}
    assert time.time() - began < 30
    for i, t in enumerate(texts):
        if t is None:
            assert got[i]["chars"] is None and got[i]["garbage"] is None
            continue
        counts = Counter(c for c in t if c not in left_out)
        top = sorted((-n, c) for c, n in counts.items())[:5]
        assert [(r["char"], r["n"]) for r in got[i]["chars"]] == [(c, -n) for n, c in top if -n * 100 > sum(counts.values()) * 5]
        normal = sum(bool(re.match(r"[\u4e00-\u9fff\u3400-\u4dbf\u3000-\u303f\uff00-\uffef \t\n\x0b\f\r\x20-\x7e]", c)) for c in t)
        assert got[i]["garbage"] == (len(t) - normal) / max(len(t.strip(" ")), 1)
        z, a = len(re.findall("[\u4e00-\u9fff\u3400-\u4dbf]", t)), len(re.findall("[a-zA-Z]", t))
        assert got[i]["mix"] == (round(2 * min(z, a) / (z + a), 3) if len(t) >= 50 and z + a else 0)


def test_graph_evidence_and_terms(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "c"), ("a", "b")], "source string, target string")
    topics = spark.createDataFrame([(1, 1, "c"), (1, 2, "b"), (2, 1, "none")], "query_id long, pos int, name string")
    got = {r["query_id"]: r for r in graph.evidence(edges, topics).collect()}
    assert got[1]["nodes"] == ["c", "b", "x", "a", "d"] and got[1]["confidence"] == 0.81
    assert got[1]["edges"] == ["b -> c", "x -> c", "a -> c", "c -> d", "a -> b", "b -> c", "b -> d"] or set(got[1]["edges"]) == {"b -> c", "x -> c", "a -> c", "c -> d", "a -> b", "b -> d"}
    assert got[1]["paths"][:2] == ["b -> c", "x -> c"] and len(got[1]["paths"]) <= 6
    assert got[2]["nodes"] == ["none"] and got[2]["edges"] == [] and got[2]["paths"] == []
    terms = {r["query_id"]: r["terms"] for r in graph.evidence_terms(graph.evidence(edges, topics)).collect()}
    assert terms == {1: ["a", "b", "c", "d", "x"], 2: ["none"]}


def test_full_text_finds_descriptions(spark):
    nodes = spark.createDataFrame([("stack", "last in first out"), ("queue", "first in first out"), ("tree", None)], "name string, description string")
    topics = spark.createDataFrame([("last",), ("first out",), ("absent",)], "topic string")
    got = {(r["topic"], r["name"]) for r in graph.full_text(topics, nodes).collect()}
    assert got == {("last", "stack"), ("first out", "queue"), ("first out", "stack")}


def test_paths_of_a_dense_graph_stay_few(spark):
    n = 40
    edges = spark.createDataFrame([(f"n{i}", f"n{j}") for i in range(n) for j in range(n) if i != j], "source string, target string")
    rows = graph.paths(edges, spark.createDataFrame([("n0",)], "target string"), depth=5).collect()
    assert [(r["length"], r["path"]) for r in sorted(rows, key=lambda r: r["rank"])] == [(1, ["n1", "n0"]), (1, ["n10", "n0"]), (1, ["n11", "n0"])]


def test_lookups_take_the_first_of_a_key(spark):
    rows = spark.createDataFrame([(i % 3, i, f"v{i}") for i in range(30)] + [(None, 99, "null")], "k int, id int, v string")
    wanted = spark.createDataFrame([(1,), (2,), (7,), (1,)], "k int")
    assert {(r["k"], r["id"]) for r in lookups.by_keys(rows, wanted, ["k"], ["id"]).collect()} == {(1, 1), (2, 2)}
    assert lookups.by_keys(rows, wanted, ["k"]).count() == 20


def test_streams_close(spark):
    rows = spark.createDataFrame([(1, 2, "2024-01-01 10:00:00", 5, 0.1)], "user_id long, kp long, ts string, event_id long, delta double").withColumn("ts", F.col("ts").cast("timestamp"))
    last = tracking.closing_row(rows).collect()
    assert len(last) == 1 and last[0]["user_id"] == -1 and last[0]["ts"].year > 2032
    assert tracking.closing_row(rows.limit(0)).collect() == []


def test_a_user_has_one_state_with_all_points(spark, tmp_path):
    from spindrift.operators.tracing import step

    schema = "user_id long, kp long, ts timestamp, event_id long, delta double"
    rows = spark.sql("SELECT id % 3 AS user_id, if(id % 7 = 6, null, id % 7) AS kp, timestamp_micros(1700000000000000 + (id * 37 % 200) * 1000000) AS ts, id AS event_id, (id % 5 - 2) / 10D AS delta FROM range(200)")
    rows.unionByName(tracking.closing_row(rows)).write.parquet(f"{tmp_path}/in")
    out = tracking.mastery_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "1 minute")
    q = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    assert max(s["numRowsTotal"] for p in q.recentProgress for s in p["stateOperators"]) == 4
    expected, last = {}, {}
    for i in sorted(range(200), key=lambda i: (i * 37 % 200, i)):
        key = i % 3, None if i % 7 == 6 else i % 7
        last[key], change = step(last.get(key), 1700000000000000 + (i * 37 % 200) * 1000000, (i % 5 - 2) / 10)
        expected[i] = (*key, last[key][1], last[key][2], change, False)
    got = {r["event_id"]: (r["user_id"], r["kp"], r["mastery"], r["confidence"], r["delta"], r["late"]) for r in spark.read.schema(out.schema).parquet(f"{tmp_path}/out").filter("user_id >= 0").collect()}
    assert got == expected


def test_keywords_count_in_the_row(spark):
    docs = spark.createDataFrame([(1, "the cat The 数据结构与算法 ab"), (2, None), (3, "")], "doc_id long, text string")
    got = [(r["doc_id"], r["word"], r["n"], r["rank"]) for r in corpus.keywords(docs, 3).collect()]
    assert got == [(1, "the", 2, 1), (1, "cat", 1, 2), (1, "与算法", 1, 3)]


def test_composed_retrieval_follows_the_question(spark):
    texts = [("进程调度决定哪个进程先运行", "text"), ("线程调度决定哪个线程先运行", "text"), ("进程调度和线程调度的区别", "table"), ("进程是资源分配的单位", "text"), ("习题：栈的应用", "exercise"), ("stack overflow in recursion", "code_mixed")]
    chunks = spark.createDataFrame([(i, t, [1.0, float(i)], f"s{i}", k) for i, (t, k) in enumerate(texts)], "chunk_id long, text string, embedding array<double>, section string, content_type string")
    questions = spark.createDataFrame([(1, "请比较进程调度和线程调度的区别", None), (2, "进程是什么", [1.0, 3.0]), (3, "stack_overflow recursion 代码示例", None), (4, "", None), (5, None, None)], "query_id long, text string, embedding array<double>")
    routes = {(r["query_id"], r["label"], r["route"], r["only"]) for r in retrieval.composed_routes(questions).collect()}
    assert {(1, "part1", "keyword_bm25", None), (1, "part2", "keyword_bm25", None), (1, "original", "comparison_meta", "table")} <= routes
    assert any(q == 3 and r == "code_meta" and only == "code_mixed" for q, _, r, only in routes) and not any(q in (4, 5) for q, *_ in routes)
    rows = retrieval.retrieve_composed(questions, chunks, retrieval.Options(threshold=0.0)).collect()
    got = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append(r["chunk_id"])
    assert got[1][0] == 2 and set(got[1]) >= {0, 1} and got[2][0] == 3 and got[3][0] == 5 and set(got) == {1, 2, 3}
    assert {r["query_id"]: r["depth"] for r in rows}[1] in ("standard", "shallow") and all(len(v) <= 8 for v in got.values())
