"""Titles by layout, and sections of texts without headings.

A line is scored by its features: a chapter mark or number in front, capitals
only, few characters, no mark at its end, blank lines around it. Lines of
TITLE points and more are titles, with their offsets. A long text with two
titles or more is cut at them. Others are cut where their subject changes: a
text's paragraphs (long ones by sentences) are units with hashed word counts,
and dynamic programming finds the cut that makes the sum of the sections'
cohesion, less PENALTY for each, the largest of all cuts into sections of at
most UNITS units. Sections cover a text without gap or overlap.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..sources.files import spread

#: Points that make a title, and the longest one in characters.
TITLE, LONGEST = 3, 40
#: Shorter texts are one section. Units hold this many characters at least, sections this many units at most.
LONG, UNIT, UNITS = 2000, 200, 40
DIM, PENALTY = 64, 0.35
# Marks of chapters, page numbers, lines of capitals, marks that end a sentence, and marks of lists, quotes, fences and headings.
CHAPTER = re.compile(r"(?:第[一二三四五六七八九十百千零\d]+[章节篇部]|\d+(?:\.\d+)*[.、]?\s|[一二三四五六七八九十]+、|[（(][一二三四五六七八九十\d]+[)）])\s*\S")
PAGE = re.compile(r"(?:第\s*\d+\s*页|page\s*\d+|-?\s*\d+\s*-?)$", re.IGNORECASE)
CAPITALS = re.compile(r"[A-Z][A-Z\s\d\-:]{2,}$")
ENDS, MARKS = "。！？；.!?;,，、：:", ("-", "*", "+", ">", "```", "~~~", "#", "|")

_LINE = re.compile(r"[^\n]*\n?")
_SENTENCE = re.compile(r"[^\n。！？.!?]*[\n。！？.!?]*")
_WORD = re.compile(r"[a-zA-Z]{3,}|[一-鿿]")


def points(line: str, before: bool, after: bool) -> int:
    """How much a stripped line looks like a title; ``before`` and ``after`` tell whether the lines around it are blank."""
    if not line or PAGE.match(line) or line.startswith(MARKS):
        return 0
    if CHAPTER.match(line) and len(line) <= 2 * LONGEST and line[-1] not in ENDS:
        return TITLE
    if CAPITALS.match(line):
        return TITLE
    return (2 <= len(line) <= LONGEST and line[-1] not in ENDS) * (1 + before + after)


def titles(text: str) -> list[tuple[int, str]]:
    """(offset of its line, title) of each title of a text."""
    lines, at = [], 0
    for m in _LINE.finditer(text):
        if m[0]:
            lines.append((at, m[0].strip()))
            at += len(m[0])
    out = []
    for i, (start, line) in enumerate(lines):
        before = i == 0 or not lines[i - 1][1]
        after = i + 1 < len(lines) and not lines[i + 1][1]
        if points(line, before, after) >= TITLE:
            out.append((start, line))
    return out


def units(text: str) -> list[int]:
    """Where units of a text begin: paragraphs and sentences, put together up to UNIT characters."""
    out, size = [0], 0
    at = 0
    for m in _SENTENCE.finditer(text):
        if not m[0]:
            continue
        if size >= UNIT:
            out.append(at)
            size = 0
        at += len(m[0])
        size += len(m[0])
    return out


def vectors(parts: list[str]) -> np.ndarray:
    """Hashed word counts of each part, of length one; zeros for a part without words."""
    rows = np.zeros((len(parts), DIM))
    for i, part in enumerate(parts):
        for w in _WORD.findall(part.lower()):
            rows[i, zlib.crc32(w.encode()) % DIM] += 1
    rows -= rows.mean(axis=0)  # words that all parts share tell nothing
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def cohesion(sums: np.ndarray, i: np.ndarray | int, j: int) -> np.ndarray:
    """Cohesion of the units from ``i`` to before ``j`` by prefix sums: the squared length of their sum, for each unit."""
    d = sums[j] - sums[i]
    return (d * d).sum(axis=-1) / (j - np.asarray(i))


def best_cut(rows: np.ndarray, penalty: float = PENALTY, most: int = UNITS) -> list[int]:
    """Where the sections of the best cut begin, in units; of equal ones that with the longest last sections."""
    n = len(rows)
    sums = np.concatenate((np.zeros((1, rows.shape[1])), np.cumsum(rows, axis=0)))
    value, back = np.zeros(n + 1), np.zeros(n + 1, np.int64)
    for j in range(1, n + 1):
        i = np.arange(max(0, j - most), j)
        total = np.round(value[i] + cohesion(sums, i, j) - penalty, 9)
        k = int(total.argmax())
        value[j], back[j] = total[k], i[k]
    out = []
    while n:
        n = int(back[n])
        out.append(n)
    return out[::-1]


def sections(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, title, method) of the sections of a text: method is whole, title or topic."""
    if not text:
        return []
    if len(text) <= LONG:
        return [(0, len(text), "", "whole")]
    found = titles(text)
    if len(found) >= 2:
        starts, names, method = [a for a, _ in found], [t for _, t in found], "title"
        if starts[0] > 0:
            starts, names = [0, *starts], ["", *names]
    else:
        at = units(text)
        cut = best_cut(vectors([text[a:b] for a, b in zip(at, [*at[1:], len(text)])]))
        starts, method = [at[i] for i in cut], "topic"
        names = [text[a : a + 200].strip().split("\n")[0][:LONGEST] for a in starts]
    return [(a, b, t, method) for a, b, t in zip(starts, [*starts[1:], len(text)], names)]


def layout_sections(docs: DataFrame) -> DataFrame:
    """doc_id, section, start, end, title, method of ``docs`` (doc_id, text); offsets are in characters. Null and empty texts give no row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ("section", "start", "end", "title", "method")

    def run(batches):
        for batch in batches:
            at, out = [], []
            for row, text in enumerate(batch.column(1)):
                found = sections(text.as_py() or "")
                at += [row] * len(found)
                out += [(i, *s) for i, s in enumerate(found)]
            columns = list(zip(*out)) or [[]] * 5
            types = (pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, types))], names=["doc_id", *names])

    return spread(docs.select("doc_id", "text")).mapInArrow(run, f"doc_id {kind}, section int, start long, end long, title string, method string")
