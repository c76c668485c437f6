"""Titles and sections: features, offsets, the best of all cuts, covers of odd texts."""

import itertools
import random

import numpy as np
import pytest

from spindrift.operators import layout

BODY = "This sentence is long enough to be a part of the body of a text, and it ends with a mark.\n"


def test_titles_by_their_features():
    text = "Intro words of a title\n\n" + BODY + "第一章 绪论\n" + BODY + "SECOND PART\n" + BODY + "12\n\n- item\n\nShort line with mark.\n\n2.1 Numbered heading\n" + BODY + "page 3\n" + "alone\n" + BODY
    found = layout.titles(text)
    assert [t for _, t in found] == ["Intro words of a title", "第一章 绪论", "SECOND PART", "2.1 Numbered heading"]
    assert all(text[a:].startswith(t) for a, t in found)


@pytest.mark.parametrize("seed", range(4))
def test_the_cut_is_the_best_of_all(seed):
    rng = np.random.default_rng(seed)
    rows = rng.normal(size=(9, 4)) * (rng.random((9, 1)) > 0.1)
    rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)
    value = lambda cut: sum((rows[a:b].sum(axis=0) ** 2).sum() / (b - a) - 0.35 for a, b in zip(cut, [*cut[1:], 9]))
    every = [(0, *some) for n in range(9) for some in itertools.combinations(range(1, 9), n)]
    every = [c for c in every if max(b - a for a, b in zip(c, [*c[1:], 9])) <= 5]
    assert abs(value(layout.best_cut(rows, 0.35, 5)) - max(map(value, every))) < 1e-8


def test_a_change_of_subject_is_found():
    rng = random.Random(1)
    one, two = ["bank lock thread process wait".split(), "tree node leaf root branch".split()]
    text = "".join(" ".join(rng.choice(words) for _ in range(12)) + ". " for words in (one, two) for _ in range(30))
    found = layout.sections(text)
    change = text.index(text.split(". ")[30])
    assert any(abs(a - change) <= layout.UNIT + 100 for a, *_ in found[1:]) and {m for *_, m in found} == {"topic"}


def test_sections_cover_any_text():
    rng = random.Random(2)
    some = ["", "x", "\n\n\n", "a" * 5000, "\n" * 3000, BODY * 50, "标题\n\n" + "内容很多。" * 600 + "\n\n二、方法\n" + "步骤。" * 500, "".join(rng.choice(["a b. ", "\n", "。", "TITLE LINE\n", "é😀 "]) for _ in range(2500))]
    for text in some:
        found = layout.sections(text)
        assert "".join(text[a:b] for a, b, *_ in found) == text
        assert all(a < b for a, b, *_ in found) and [a for a, *_ in found][1:] == [b for _, b, *_ in found][:-1]
    assert [m for *_, m in layout.sections(some[6])] == ["title"] * 2 and layout.sections(some[6])[1][2] == "二、方法"


def test_rows_of_a_table(spark):
    docs = spark.createDataFrame([(1, BODY * 40, "x"), (2, None, "x"), (3, "", "x"), (4, "short", "x")], "doc_id long, text string, title string")
    rows = layout.layout_sections(docs).collect()
    assert {r["doc_id"] for r in rows} == {1, 4}
    assert [(r["section"], r["start"], r["end"], r["method"]) for r in rows if r["doc_id"] == 4] == [(0, 0, 5, "whole")]
