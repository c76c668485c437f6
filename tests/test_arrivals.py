"""Arrivals against a stored corpus: parts give what one run gives, repeats add nothing, the store isn't shuffled."""

import random

from spindrift.operators import arrivals, corpus, drivers
from spindrift.plans import catalogue

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted((r["doc_id"], r["kept"], r["duplicate_of"], r["kind"]) for r in df.collect())


def texts(seed=1, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    out = []
    for i in range(n):
        if out and rng.random() < 0.6:
            t = rng.choice(out).split(" ")
            if rng.random() < 0.7:
                t[rng.randrange(len(t))] = word()
            out.append(" ".join(t))
        else:
            out.append(" ".join(word() for _ in range(rng.randint(1, 60))))
    return [*out, "", "   ", None, "ab", "ab ", "ba"]


def test_parts_give_what_one_run_gives_and_repeats_add_nothing(spark, tmp_path):
    docs = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    store = arrivals.Store(spark, f"file://{tmp_path}/s", buckets=4)
    early, late = docs.filter("doc_id < 40"), docs.filter("doc_id >= 40")
    first, second = rows(arrivals.add(store, early)), rows(arrivals.add(store, late))
    assert first + second == rows(drivers.dedup(docs))
    assert {"exact", "fuzzy", None} == {r[3] for r in first + second}
    sizes = {t: store.table(t).count() for t in ("digests", "grams")}
    assert rows(arrivals.add(store, early)) == first
    assert {t: store.table(t).count() for t in ("digests", "grams")} == sizes
    assert sizes["grams"] == sum(r[1] for r in first + second)


def test_few_documents_of_the_store_are_candidates(spark, tmp_path, monkeypatch):
    from .test_whole_tables import jaccard_pairs, prose

    monkeypatch.setattr(arrivals, "BLOCK", 16)
    docs = list(enumerate(prose(200, 7)))
    rows_of = spark.createDataFrame(docs, "doc_id long, text string")
    store = arrivals.Store(spark, f"file://{tmp_path}/s", buckets=4)
    standing = {r["doc_id"] for r in arrivals.add(store, rows_of.filter("doc_id < 100")).collect() if r["kept"]}
    near = {(a, b) for a, b in jaccard_pairs(docs, 0.9) if a in standing and b >= 100}
    got = {(r["a"], r["b"]) for r in arrivals.candidates(store, corpus.gram_signatures(rows_of.filter("doc_id >= 100"), 0.9)).collect()}
    assert near and near <= got and len(got) <= 1.5 * len(near) + 5


def test_a_failure_between_tables_is_mended_by_the_next_run(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(texts(3, 30))), "doc_id long, text string")
    expected = rows(drivers.dedup(docs))
    for at in ("grams", "digests"):
        store = arrivals.Store(spark, f"file://{tmp_path}/{at}", buckets=4)
        append = arrivals.Store.append

        def failing(self, rows, table, at=at, append=append):
            if table == at:
                raise OSError("disk")
            append(self, rows, table)

        monkeypatch.setattr(arrivals.Store, "append", failing)
        try:
            arrivals.add(store, docs)
        except OSError:
            pass
        monkeypatch.setattr(arrivals.Store, "append", append)
        assert rows(arrivals.add(store, docs)) == expected
        assert store.table("digests").count() == store.table("digests").distinct().count()
        assert store.table("grams").count() == sum(r[1] for r in expected)


def test_the_store_is_read_without_an_exchange(spark, tmp_path):
    docs = spark.createDataFrame(list(enumerate(texts(4, 20))), "doc_id long, text string")
    store = arrivals.Store(spark, f"file://{tmp_path}/s", buckets=8)
    arrivals.add(store, docs)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        signed = corpus.gram_signatures(docs, 0.9)
        joins = [arrivals.candidates(store, signed).select("a", "b"), docs.withColumnRenamed("doc_id", "a").join(store.table("grams").withColumnRenamed("doc_id", "a"), "a")]
        for df in joins:
            df.collect()
            plan = df._jdf.queryExecution().executedPlan().toString().split("== Final Plan ==")[-1].split("== Initial Plan ==")[0].split("\n")
            scans = [i for i, line in enumerate(plan) if "FileScan parquet" in line and "Bucketed: true" in line]
            assert scans
            for i in scans:
                depth = len(plan[i]) - len(plan[i].lstrip(" :+-*"))
                above = []
                for line in reversed(plan[:i]):
                    d = len(line) - len(line.lstrip(" :+-*"))
                    if d < depth:
                        above.append(line)
                        depth = d
                upto = next(k for k, line in enumerate(above) if "Join" in line)
                assert not any("Exchange" in line for line in above[:upto]), plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_store_is_opened_again(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    docs = spark.createDataFrame([(1, "one two three four five six"), (2, "seven eight nine ten")], "doc_id long, text string")
    arrivals.add(arrivals.Store(spark, path, buckets=4), docs)
    for t in arrivals.TABLES:  # as a new session, which knows no tables
        spark.sql(f"DROP TABLE {arrivals.Store(spark, path, buckets=4).name(t)}")
    again = spark.createDataFrame([(7, "one two three four five six"), (8, " seven  eight nine ten")], "doc_id long, text string")
    assert rows(arrivals.add(arrivals.Store(spark, path, buckets=4), again)) == [(7, False, 1, "exact"), (8, False, 2, "fuzzy")]


def test_query_equals_one_run(spark):
    q = catalogue.queries()
    assert rows(q["arrivals_dedup"](spark, SF)) == rows(q["dedup_documents"](spark, SF))
