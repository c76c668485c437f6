"""Fill-in-the-middle against plain Python on odd texts, with every kind of unit and chunks of any size."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.llm import fill_middle

from .fixtures import documents, empty


def split(text, unit):
    if unit == "word":
        return [x for x in re.split(r"(?<=[\x20\x09-\x0d])(?=[^\x20\x09-\x0d])", text) if x]
    if unit == "line":
        return [x for x in re.split(r"(?<=\n)", text) if x]
    return list(text)


def brute(doc_id, text, unit="code_point"):
    text = text or ""
    d = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = split(text, unit)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in fill_middle.MARKS) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


MORE = ["<", "<P", "a<P><S", "<S<", "><P", "x<M>y", "́e", "é" * 5000, "😀\n\nb\n", "<" * 50 + "S>", "M>" * 7 + "<"]


@pytest.mark.parametrize("unit", sorted(fill_middle.UNITS))
def test_transform_matches_plain_python(spark, unit):
    from .fixtures import texts

    rows = [(i, t) for i, t in enumerate(texts() + MORE * 12)] + [(None, "null id"), (3, "again"), (3, "again")]
    docs = documents(spark, rows)
    out = fill_middle.transform(docs, unit).withColumn("restored", fill_middle.restore(F.col("output"), F.col("form")))
    got = sorted((repr(r["doc_id"]), r["n"], r["form"], r["prefix_units"], r["middle_units"], r["output"], r["restored"]) for r in out.collect())
    assert got == sorted((repr(i), *brute(i, t, unit), t or "") for i, t in rows)
    assert {"plain", "psm", "spm"} == {r[2] for r in got}


@pytest.mark.parametrize("unit", sorted(fill_middle.UNITS))
def test_chunks_of_any_size_give_the_same_places(unit):
    rng = random.Random(5)
    some = ["".join(rng.choice("a b\né😀 \n") for _ in range(rng.randint(0, 60))) for _ in range(40)]
    data = np.frombuffer("".join(some).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t.encode()) for t in some)])
    for chunk in (1, 2, 3, 7, 64, 4096):
        chunks = fill_middle.Chunks(data, offsets, unit, chunk)
        assert chunks.units.tolist() == [len(split(t, unit)) for t in some]
        for i, t in enumerate(some):
            units = split(t, unit)
            for r in range(len(units) + 1):
                assert chunks.places(np.array([i]), np.array([r]))[0] == offsets[i] + len("".join(units[:r]).encode())


def test_only_owning_chunks_are_scanned_again():
    text = "ab\n" * 50_000
    chunks = fill_middle.Chunks(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]), "line")
    seen = []
    flags = chunks._flags
    chunks._flags = lambda a, b: seen.append((a, b)) or flags(a, b)
    assert chunks.places(np.array([0, 0]), np.array([20_000, 40_000])).tolist() == [60_000, 120_000]
    assert seen == [(60_000 // fill_middle.CHUNK, 60_000 // fill_middle.CHUNK + 1), (120_000 // fill_middle.CHUNK, 120_000 // fill_middle.CHUNK + 1)]


def test_empty_table_and_marks_that_overlap(spark):
    assert fill_middle.transform(empty(spark)).collect() == []
    for marks in (("<P>", "<P>", "<M>"), ("aa", "b", "c"), ("ab", "bc", "d"), ("", "b", "c")):
        with pytest.raises(ValueError):
            fill_middle.transform(empty(spark), marks=marks)


def test_own_marks_and_rates(spark):
    docs = documents(spark, [(i, "one two three") for i in range(200)])
    rows = fill_middle.transform(docs, "word", rate=100, spm=0, marks=("[P]", "[S]", "[M]")).collect()
    assert {r["form"] for r in rows} == {"psm"} and all(r["output"].startswith("[P]") for r in rows)
