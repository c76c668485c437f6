"""Fill-in-the-middle: texts cut at two ranks of their units and put together around marks.

Units are what an adjacent-character predicate separates: it looks at two
neighbouring bytes of UTF-8 and says whether a unit begins at the second one
(code points, words with the blanks behind them, lines). Texts are taken as
chunks of a fixed number of bytes, each of which also sees the byte before it,
so a predicate holds or fails for a place in whichever chunk it lies:

1. the boundaries of all chunks of a batch of texts are counted, in parallel,
   and only the counts are kept;
2. prefix sums of the counts give the rank at which each chunk begins, and the
   number of units of each text;
3. the ranks of both cuts are routed to the chunks that own them, and only
   those are scanned again for the places.

A text arrives whole in one task and leaves it whole, so chunks are blocks of
that task's arrays and nothing is shuffled; beside a batch a task holds one
number for each chunk, never one for each unit.

Defined results: null texts count as empty; they and texts that hold a mark
are plain. Rows that repeat are each cut, alike for equal ids; a null id is
hashed as an empty one. Other columns are not looked at. An empty table gives
no rows.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches

MARKS = ("<P>", "<S>", "<M>")
#: Bytes of a chunk, and about how many are looked at in one step.
CHUNK, STEP = 1 << 12, 1 << 20

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
#: Whether a unit begins at the second of two neighbouring bytes.
UNITS = {
    "code_point": lambda before, at: (at & 0xC0) != 0x80,
    "word": lambda before, at: _BLANK[before] & ~_BLANK[at],
    "line": lambda before, at: before == 10,
}


class Chunks:
    """The texts of a batch, back to back in ``data`` and bounded by ``offsets``, as chunks with their counts of units."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, unit: str, chunk: int = CHUNK):
        self.data, self.offsets, self._begins = data, offsets, UNITS[unit]
        per = -(-np.diff(offsets) // chunk)
        self.first = np.concatenate(([0], np.cumsum(per)))  # of each text
        inside = np.arange(self.first[-1]) - np.repeat(self.first[:-1], per)
        self.start = np.repeat(offsets[:-1], per) + inside * chunk
        self.end = np.minimum(self.start + chunk, np.repeat(offsets[1:], per))
        self._head = inside == 0
        counts = np.zeros(len(self.start), np.int64)
        step = max(1, STEP // chunk)
        for a in range(0, len(counts), step):
            b = min(a + step, len(counts))
            counts[a:b] = np.add.reduceat(self._flags(a, b), self.start[a:b] - self.start[a], dtype=np.int64)
        #: Units that begin in earlier chunks of the batch.
        self.before = np.concatenate(([0], np.cumsum(counts)))
        self.units = self.before[self.first[1:]] - self.before[self.first[:-1]]

    def _flags(self, a: int, b: int) -> np.ndarray:
        """Where units begin in the chunks from ``a`` to before ``b``; a text's first byte begins one."""
        lo, hi = self.start[a], self.end[b - 1]
        seen = self.data[max(lo - 1, 0) : hi]  # with the byte before
        flags = np.ones(hi - lo, bool)
        flags[len(flags) - len(seen) + 1 :] = self._begins(seen[:-1], seen[1:])
        flags[self.start[a:b][self._head[a:b]] - lo] = True
        return flags

    def places(self, text: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Where in ``data`` the unit of each rank begins in each text; a text's end for the rank after its last."""
        out = self.offsets[1:][text].copy()
        inner = np.flatnonzero(rank < self.units[text])
        wanted = self.before[self.first[text[inner]]] + rank[inner]
        owner = np.searchsorted(self.before, wanted, "right") - 1
        for i, k, r in zip(inner.tolist(), owner.tolist(), (wanted - self.before[owner]).tolist()):
            out[i] = self.start[k] + np.flatnonzero(self._flags(k, k + 1))[r]
        return out


def _parts(id: Column) -> list[Column]:
    """The first four numbers of 32 bits in the SHA-256 of ``1:`` and the id."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def _clear(marks: tuple[str, str, str]) -> None:
    """Marks must be found again in an output: none may overlap another, or itself."""
    for a in marks:
        for b in marks:
            if not a or (a != b and a in b) or any(a[k:] == b[: len(a) - k] for k in range(1, len(a))) or len(set(marks)) < 3:
                raise ValueError(f"marks {marks} overlap")


def transform(docs: DataFrame, unit: str = "code_point", rate: int = 90, spm: int = 20, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """doc_id, n, form, prefix_units, middle_units, prefix_chars, middle_chars, output of each of ``docs`` (doc_id, text).

    ``rate`` per cent of the texts are cut, ``spm`` per cent of these with the
    suffix first (form spm), others with the prefix first (psm); the form of
    the rest is plain, and their output the text. ``marks`` stand before
    prefix, suffix and middle. ``n`` counts units of the kind ``unit``.
    """
    small_batches(docs.sparkSession)
    _clear(marks)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    h = _parts(F.col("doc_id"))
    plain = (text == "") | (h[2] % 100 >= rate)
    for m in marks:
        plain = plain | F.contains(text, F.lit(m))
    form = F.when(plain, "plain").when(h[3] % 100 < spm, "spm").otherwise("psm")
    rows = docs.select("doc_id", text.alias("text"), h[0].alias("a"), h[1].alias("b"), form.alias("form"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    P, S, M = (m.encode() for m in marks)

    def run(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
            raw = texts.buffers()[2]
            data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
            chunks = Chunks(data, offsets, unit)
            forms = batch.column("form").to_pylist()
            at = np.flatnonzero([f != "plain" for f in forms])
            n = chunks.units[at]
            ranks = [np.asarray(batch.column(c))[at] % (n + 1) for c in "ab"]
            low, high = np.minimum(*ranks), np.maximum(*ranks)
            x, y = chunks.places(at, low), chunks.places(at, high)
            output = [None] * len(forms)
            chars = np.zeros((2, len(at)), np.int64)
            for k, (i, p, q) in enumerate(zip(at.tolist(), x.tolist(), y.tolist())):
                a, b = int(offsets[i]), int(offsets[i + 1])
                before, middle, after = data[a:p].tobytes(), data[p:q].tobytes(), data[q:b].tobytes()
                output[i] = b"".join((S, after, P, before, M, middle) if forms[i] == "spm" else (P, before, S, after, M, middle))
                if unit != "code_point":
                    chars[:, k] = [np.count_nonzero((data[u:v] & 0xC0) != 0x80) for u, v in ((a, p), (p, q))]
            for i in np.flatnonzero([o is None for o in output]).tolist():
                output[i] = data[offsets[i] : offsets[i + 1]].tobytes()
            if unit == "code_point":
                chars[:] = low, high - low
            cut = [np.full(len(forms), 0, np.int64) for _ in range(4)]
            for column, values in zip(cut, (low, high - low, *chars)):
                column[at] = values
            none = np.ones(len(forms), bool)
            none[at] = False
            columns = [batch.column("doc_id"), pa.array(chunks.units), batch.column("form"), *(pa.array(c, mask=none) for c in cut)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(output, pa.binary()).view(pa.string())], names=["doc_id", "n", "form", "prefix_units", "middle_units", "prefix_chars", "middle_chars", "output"])

    return rows.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_units long, middle_units long, prefix_chars long, middle_chars long, output string")


def restore(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output of this form was made of."""
    P, S, M = marks
    between = lambda a, b: F.substring_index(F.substring_index(output, a, -1), b, 1)
    middle = F.substring_index(output, M, -1)
    psm = F.concat(between(P, S), middle, between(S, M))
    spm = F.concat(between(P, M), middle, between(S, P))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests of the outputs and of the restored texts of all ``documents``, cut by code points."""
    out = transform(spark.read.parquet(os.path.join(sf_dir, "documents.parquet")))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    restored = restore(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored).alias("restored_sha256"))


ORACLE = """
WITH h AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents
), k AS (
  SELECT doc_id, t, n, CAST('0x' || substring(d, 1, 8) AS BIGINT) AS h1, CAST('0x' || substring(d, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substring(d, 17, 8) AS BIGINT) AS h3, CAST('0x' || substring(d, 25, 8) AS BIGINT) AS h4 FROM h
), f AS (
  SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || left(t, a) || '<S>' || substring(t, b + 1) || '<M>' || substring(t, a + 1, b - a)
    WHEN 'spm' THEN '<S>' || substring(t, b + 1) || '<P>' || left(t, a) || '<M>' || substring(t, a + 1, b - a) ELSE t END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM f
"""
