"""Cut payloads at every place, odd payloads, and budgets at any partitioning."""

import json
import random

import pytest
from pyspark.sql import functions as F

from spindrift.operators import salvage

PAYLOAD = {"nodes": [{"name": 'a "q" \\ ]}', "tags": ["x", ["y", {"z": 1}]]}, {"name": "é\n", "n": -1.5e3, "ok": True, "no": None}, {}, []], "more": {"k": [1, 22, "3"], "s": "t"}, "edges": [{"source": "a", "target": "b"}]}


def before(cut, text):
    """Where the brackets that are elements of outermost arrays close before the cut."""
    out, stack, quoted, escaped = [], [], False, False
    for i, c in enumerate(text[:cut]):
        if quoted:
            escaped, quoted = (c == "\\" and not escaped), not (c == '"' and not escaped)
            continue
        if c == '"':
            quoted = True
        elif c in "{[":
            stack.append(c)
        elif c in "}]":
            stack.pop()
            if "[" in stack and stack.index("[") == len(stack) - 1:
                out.append(i + 1)
    return out


@pytest.mark.parametrize("indent", [None, 2])
def test_every_cut_keeps_what_is_whole(indent):
    text = json.dumps(PAYLOAD, indent=indent)
    for cut in range(len(text) + 1):
        got = salvage.closed("Here: " + text[:cut])
        if cut == 0:
            assert got is None
            continue
        value = json.loads(got)
        ends = before(cut, text)
        containers = sum(isinstance(x, (dict, list)) for v in (value.get("nodes", []), value.get("edges", []), value.get("more", {}).get("k", [])) for x in v)
        assert containers == len(ends)
        assert value.get("nodes", []) == PAYLOAD["nodes"][: len(value.get("nodes", []))]
        assert value.get("edges", []) == PAYLOAD["edges"][: len(value.get("edges", []))]
        assert value.get("more", {}).get("k", []) == PAYLOAD["more"]["k"][: len(value.get("more", {}).get("k", []))]
    assert json.loads(salvage.closed(text)) == PAYLOAD


def test_odd_payloads(spark):
    cases = {None: None, "": None, "no json": None, "[": "[]", '{"a"': "{}", '{"a": 12': "{}", "[1, 2": "[1]", "[1, 2,": "[1, 2]", '["x", "y': '["x"]', "[1]]": "[1]", "[1 2]": "[1]", '{"a": [1, }': '{"a": [1]}', '[{"a": 1}, {"b"': '[{"a": 1}]', "[tr": "[]", "[true, fal": "[true]"}
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "id int, t string")
    got = {r["id"]: r["c"] for r in rows.select("id", salvage.complete(F.col("t")).alias("c")).collect()}
    for i, expected in enumerate(cases.values()):
        assert (got[i] is None) == (expected is None) and (expected is None or json.loads(got[i]) == json.loads(expected)), i


@pytest.mark.parametrize("budget", [0, 1, 17, 500])
def test_the_first_calls_are_spent_at_any_partitioning(spark, budget):
    rng = random.Random(1)
    ids = rng.sample(range(1000), 200)
    rows = [(i, i % 3 > 0) for i in ids] + [(None, True)]
    expected = sorted(i for i in ids if i % 3)[:budget]
    for parts in (1, 3, 11):
        table = spark.createDataFrame(rows, "id long, w boolean").repartition(parts)
        got = salvage.within_budget(table, F.col("w"), "id", budget).collect()
        assert sorted(r["id"] for r in got if r["allowed"]) == expected and len(got) == len(rows)


def test_headings(spark):
    rows = [(1, "Dead locks of processes", None, "Deadlock locks"), (2, "死锁的条件", "", "死锁"), (3, "text", None, "的了"), (4, "text\nmore", None, "12-3"), (5, "", None, "x"), (6, None, None, None), (7, "t", "Own", "zz"), (8, "anything", None, "unseen words"), (9, "q", None, salvage.UNNAMED)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, given string, candidate string")
    got = {r["doc_id"]: (r["heading"], r["method"]) for r in salvage.headings(docs, 6).collect()}
    assert got == {1: ("Deadlock locks", "checked"), 2: ("死锁", "checked"), 3: ("[推测]text", "rejected"), 4: ("[推测]text", "rejected"), 5: ("[未命名文档]", "rejected"), 6: ("[未命名文档]", "rejected"), 7: ("Own", "given"), 8: ("[推测]unseen words", "degraded"), 9: ("[推测][未命名文档]", "degraded")}
