import random

from pyspark.sql import functions as F

from spindrift.llm import common


def brute_components(pairs):
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


def test_components_match_union_find(spark):
    rng = random.Random(3)
    pairs = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1040)] + [(5000, i) for i in range(5001, 5100)] + [(9, 9)]
    got = common.components(spark.createDataFrame(pairs, "a long, b long"), common.Scratch(spark, "t")).collect()
    expected = brute_components([p for p in pairs if p[0] != p[1]])
    assert {r["node"]: r["component"] for r in got} == expected and len(got) == len(expected)


def test_components_of_nothing(spark):
    assert common.components(spark.createDataFrame([], "a long, b long"), common.Scratch(spark, "t")).collect() == []


def test_running_total(spark):
    rows = spark.range(0, 1000, 1, 7).select((F.col("id") * 37 % 1000).alias("k"), (F.col("id") % 5).alias("v"))
    got = {r["k"]: r["t"] for r in common.running_total(rows, ["k"], "v", "t", common.Scratch(spark, "t")).collect()}
    values, total = {r["k"]: r["v"] for r in rows.collect()}, 0
    for k in sorted(values):
        assert got[k] == total
        total += values[k]


def test_settings_are_put_back(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    with common.settings(spark, {key: "5"}):
        assert spark.conf.get(key) == "5"
    assert spark.conf.get(key) == before


def test_clean_removes_scratch(spark):
    scratch = common.Scratch(spark, "t")
    scratch.table(spark.range(3), "x")
    common.clean(spark)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(scratch.path)
    assert not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def test_a_local_session_without_the_setting_keeps_one_folder():
    from types import SimpleNamespace

    import pytest

    def session(master):
        context = SimpleNamespace(applicationId=f"none-{master}", master=master, getConf=lambda: {})
        return SimpleNamespace(conf={}, sparkContext=context)

    root = common.shared_root(session("local[2]"))
    assert root == common.shared_root(session("local[2]")) and root.startswith("file:///")
    with pytest.raises(ValueError):
        common.shared_root(session("local-cluster[2,1,1024]"))
