"""The positional index against plain Python: phrases, proximity, segments, blocks of test texts, odd texts."""

import random
import re

import numpy as np
import pytest

from spindrift.llm import positional_index as px
from spindrift.llm import words
from spindrift.llm.common import Scratch

from .fixtures import documents, empty, texts

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return WORD.findall((text or "").translate(LOWER))


def windows(text, width):
    w = split(text)
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute(docs, items, width):
    owners = {}
    for i, t in items:
        for p in windows(t, width):
            owners.setdefault(p, set()).add(i)
    out = []
    for i, t in docs:
        w = split(t)
        hit, held = set(), set()
        for n in {len(p) for p in owners}:
            for a in range(len(w) - n + 1):
                if (p := tuple(w[a : a + n])) in owners:
                    hit |= set(range(a, a + n))
                    held |= owners[p]
        out.append((repr(i), len(w), len(hit), sorted(str(x) for x in held if x is not None)))
    return sorted(out)


def result(df):
    rows = df.collect()
    for r in rows:
        at = -1
        for s in r["spans"]:
            assert s["start"] > at and s["length"] > 0
            at = s["start"] + s["length"] - 1
        assert at < r["n_words"]
    return sorted((repr(r["doc_id"]), r["n_words"], sum(s["length"] for s in r["spans"]), list(r["items"])) for r in rows)


def corpus(seed, n, letters="abcde"):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(letters) for _ in range(rng.randint(0, 80)))) for i in range(n)]


@pytest.mark.parametrize("width,segment,block", [(1, 1, 1), (3, 64, 64), (4, 4096, 1 << 20), (10, 1 << 22, 1 << 22)])
def test_phrases_match_plain_python(spark, tmp_path, width, segment, block):
    docs = corpus(1, 60) + [(None, "a b c d e a b c"), (7, "again a b"), (7, "again a b")]
    items = [(100 + i, t) for i, (_, t) in enumerate(corpus(2, 25))] + [(1, docs[3][1]), (2, docs[3][1]), (None, docs[4][1]), (3, "e d"), (4, None), (5, " ,. "), (9, "b")]
    index = px.build(spark.createDataFrame(docs, "doc_id long, text string"), str(tmp_path / "i"), segment)
    got = px.search(index, spark.createDataFrame(items, "item_id long, text string"), Scratch(spark, "t"), width, block)
    assert result(got) == brute(docs, items, width)


def test_odd_texts_and_extra_columns(spark, tmp_path):
    some = list(enumerate(texts()))
    long = texts()[8]
    items = spark.createDataFrame([("x", long.upper(), 1), ("y", "été à la plage", 2), ("z", "日本語", 3)], "item_id string, text string, doc_id int")
    index = px.build(documents(spark, some), str(tmp_path / "i"))
    got = px.search(index, items, Scratch(spark, "t"), 10)
    assert result(got) == brute(some, [("x", long.upper()), ("y", "été à la plage"), ("z", "日本語")], 10)
    assert px.search(px.build(empty(spark), str(tmp_path / "e")), items, Scratch(spark, "t")).collect() == []
    none = px.search(index, items.filter("false"), Scratch(spark, "t")).collect()
    assert len(none) == len(some) and not any(r["spans"] or r["items"] for r in none)


def test_a_passage_does_not_run_over_two_documents(spark, tmp_path):
    docs = [(1, "x a b c"), (2, "d e f y"), (3, "a b c d"), (4, "a b c d")]
    index = px.build(spark.createDataFrame(docs, "doc_id long, text string"), str(tmp_path / "i"))
    got = px.search(index, spark.createDataFrame([(1, "a b c d e f"), (2, "c d a b")], "item_id long, text string"), Scratch(spark, "t"), 4)
    assert result(got) == brute(docs, [(1, "a b c d e f"), (2, "c d a b")], 4)


def test_occurrences_and_proximity(spark, tmp_path):
    docs = corpus(3, 30, "abcdefgh")
    items = [(i, t) for i, t in corpus(4, 6, "abcdefgh") if t]
    index = px.build(spark.createDataFrame(docs, "doc_id long, text string"), str(tmp_path / "i"), 500)
    table = spark.createDataFrame(items, "item_id long, text string")
    exact, near = set(), set()
    for d, t in docs:
        w = split(t)
        for i, x in items:
            for p in windows(x, 3):
                exact |= {(d, str(i), a, len(p)) for a in range(len(w)) if tuple(w[a : a + len(p)]) == p}
                ends = {}
                for a in range(len(w)):
                    for b in range(a, min(a + 5, len(w))):
                        if set(p) <= set(w[a : b + 1]):
                            ends[b] = a
                            break
                near |= {(d, str(i), a, b - a + 1) for b, a in ends.items()}
    scratch = Scratch(spark, "t")
    assert {tuple(r) for r in px.occurrences(index, table, scratch, 3).collect()} == exact
    assert {tuple(r) for r in px.occurrences(index, table, scratch, 3, span=5).collect()} == near


def test_long_windows_lists_are_cut_into_steps(monkeypatch):
    monkeypatch.setattr(px, "PLACES", 5)
    docs = [t.encode() for _, t in corpus(5, 20, "ab")]
    ids, sizes, terms, counts, postings = px._segment(list(range(20)), docs)
    segment = px.Segment({"ids": ids, "words": sizes, "terms": terms, "counts": counts, "postings": postings})
    found = px.Windows(["q"], [docs[0]], 3)
    got = sum(len(start) for _, _, start in segment.phrases(found))
    wanted = windows(docs[0].decode(), 3)
    assert got == sum(tuple(split(d.decode())[a : a + 3]) in wanted for d in docs for a in range(len(split(d.decode())) - 2))


def test_postings_come_back():
    rng = np.random.default_rng(1)
    lists = [np.sort(rng.choice(1 << 25, n, replace=False)) for n in (1, 5, 1000, 3)]
    counts = np.array([len(x) for x in lists])
    firsts = np.cumsum(counts) - counts
    planes = np.frombuffer(px.packed(np.concatenate(lists).astype(np.int64), firsts), np.uint8).reshape(4, -1)
    for some in ([0, 1, 2, 3], [2], [3, 0], []):
        some = np.array(some, np.int64)
        assert px.unpacked(planes, firsts[some], counts[some]).tolist() == [x for k in some for x in lists[k].tolist()]


def thue_morse(n, a=b"a", b=b"b"):
    while n:
        a, b, n = a + b, b + a, n - 1
    return a, b


@pytest.mark.parametrize("n", [3, 4, 6, 10, 12])
def test_words_that_a_polynomial_confuses_are_told_apart(n):
    data = b" ".join(thue_morse(n))
    starts, ends = words.spans(data, px.WORD_BYTES)
    assert len(set(words.folded(data, starts, ends).tolist())) == len(set(words.terms(data, starts, ends, 0x30).tolist())) == 2


def test_words_of_any_length_have_their_own_numbers():
    rng = random.Random(7)
    some = sorted({"".join(rng.choice("abzé0") for _ in range(rng.randint(1, 90))) for _ in range(5000)})
    data = " ".join(some).encode()
    starts, ends = words.spans(data, px.WORD_BYTES)
    for number in (words.folded, lambda *x: words.terms(*x, 0x30)):
        found = number(data, starts, ends)
        assert len(set(found.tolist())) == len(some)
        for i in (5, 100, 4000):
            assert number(some[i].encode(), np.array([0]), ends[[i]] - starts[[i]])[0] == found[i]
