"""A distributed positional inverted index, and phrase and proximity search of test texts in it.

Words are runs of bytes outside 00-2F, 3A-60 and 7B-7F in UTF-8, A to Z
lower-cased. The index is partitioned by documents: a task packs its texts
into segments of about SEGMENT bytes and writes one row for each, with the
segment's dictionary (every term, sorted, and its count) and the postings of
all terms (the places of their words in the segment, ascending, as differences
in planes of bytes, which compress well). So building shuffles nothing, no
term is gathered in one place however frequent it is, and a lost executor
costs a few segments.

A search brings the test texts to the segments. Texts are written in blocks of
about BLOCK bytes, which a task reads one at a time, so neither side has to
fit anywhere. In a segment all windows go together:

1. windows with a term that the dictionary lacks are out;
2. the list of each window's rarest term, less the term's offset, gives the
   places where the window may begin;
3. these are intersected with the lists of the other terms, the rarest first,
   each less its offset.

Terms of up to eight bytes are exact, longer ones are told apart by 61 bits.

Defined results: null texts and texts without words have no words and no hits;
null or blank test texts have no windows. Rows that repeat are searched each.
Test texts without an id give hits but are not listed. An empty table gives no
rows; no test texts give no hits. Other columns are not looked at.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHILE_WRITING, Scratch, settings, small_batches
from .files import open_fs
from .words import byte_set, spans, terms

#: Bytes of text of a segment (one document at least) and of a block of test texts.
SEGMENT, BLOCK = 4 << 20, 4 << 20
#: Places that are intersected at a time.
PLACES = 1 << 21

_U = np.uint64
WORD_BYTES = byte_set((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
#: No word has a byte below this one.
LEAST_BYTE = 0x30


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(terms of all words of the texts, in order; the number of words before each text and at the end)."""
    data = b"\n".join(texts).lower()
    starts, ends = spans(data, WORD_BYTES)
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return terms(data, starts, ends, LEAST_BYTE), np.searchsorted(starts, offsets)


def packed(places: np.ndarray, firsts: np.ndarray) -> bytes:
    """Ascending places of each term as differences, all lowest bytes first; ``firsts`` is where the terms begin."""
    gaps = np.diff(places, prepend=0)
    gaps[firsts] = places[firsts]
    return gaps.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unpacked(planes: np.ndarray, firsts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places of the terms whose postings begin at ``firsts``, one list after the other."""
    ends = np.cumsum(counts)
    at = np.repeat(firsts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)
    gaps = np.zeros(len(at), np.int64)
    for k in range(4):
        gaps |= planes[k, at].astype(np.int64) << (8 * k)
    sums = np.concatenate(([0], np.cumsum(gaps)))
    return sums[1:] - np.repeat(sums[ends - counts], counts)


def _segment(ids: list, texts: list[bytes]) -> tuple:
    """The row of a segment."""
    found, bounds = words_of(texts)
    order = np.argsort(found)
    ranked = found[order]
    begins = np.concatenate(([True], ranked[1:] != ranked[:-1])) if len(ranked) else np.zeros(0, bool)
    # places ascend within a term: the sort above needn't be stable
    both = np.sort((np.cumsum(begins, dtype=_U) << _U(32)) | order.astype(_U))
    firsts = np.flatnonzero(begins)
    counts = np.diff(firsts, append=len(ranked))
    return ids, np.diff(bounds).astype("<u4").tobytes(), ranked[firsts].astype("<u8").tobytes(), counts.astype("<u4").tobytes(), packed((both & _U(0xFFFFFFFF)).astype(np.int64), firsts)


def build(docs: DataFrame, path: str, segment: int = SEGMENT) -> DataFrame:
    """Write the index of ``docs`` (doc_id, text) to ``path`` and return it: ids, words, terms, counts, postings of each segment."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    id_type = docs.sparkSession.createDataFrame([], f"x {kind}").toArrow().schema.field("x").type

    def run(batches):
        ids, texts, size = [], [], 0

        def row():
            columns = [pa.array([x], t) for x, t in zip(_segment(ids, texts), (pa.list_(id_type), *[pa.binary()] * 4))]
            return pa.RecordBatch.from_arrays(columns, names=["ids", "words", "terms", "counts", "postings"])

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                text = text.as_py() or b""
                if ids and size + len(text) > segment:
                    yield row()
                    ids, texts, size = [], [], 0
                ids.append(i)
                texts.append(text)
                size += len(text) + 1
        if ids:
            yield row()

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"ids array<{kind}>, words binary, terms binary, counts binary, postings binary")
    with settings(docs.sparkSession, WHILE_WRITING):
        # a row is megabytes: the writer looks at its size after each one
        sizes = {"parquet.block.size": 16 << 20, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1, "parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 1}
        rows.write.options(**sizes).option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path)


class Windows:
    """The distinct windows of a block of test texts, by their length, with the texts that hold them."""

    def __init__(self, ids: list[str | None], texts: list[bytes], width: int):
        found, bounds = words_of(texts)
        self.ids = ids
        self.terms, word = np.unique(found, return_inverse=True)
        pieces: dict[int, list] = {}
        for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
            size = min(width, b - a)
            if size:
                pieces.setdefault(size, []).append((i, np.lib.stride_tricks.sliding_window_view(word[a:b], size)))
        #: length: (words of each distinct window; where its texts begin in the third; the texts)
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size, some in pieces.items():
            owner = np.repeat([i for i, _ in some], [len(w) for _, w in some])
            rows, which = np.unique(np.concatenate([w for _, w in some]), axis=0, return_inverse=True)
            pairs = np.unique(np.stack([which.ravel(), owner]), axis=1)
            self.by_length[size] = rows, np.searchsorted(pairs[0], np.arange(len(rows) + 1)), pairs[1]


@lru_cache(maxsize=2)
def _block(folder: str, name: str, width: int) -> Windows:
    system, path = open_fs(folder)
    table = ds.dataset(f"{path}/{name}", filesystem=system, format="parquet").to_table(["id", "text"])
    return Windows(table.column("id").to_pylist(), [t or b"" for t in table.column("text").cast(pa.binary()).to_pylist()], width)


class Segment:
    """A row of the index, open for search."""

    def __init__(self, row: dict):
        self.ids = row["ids"]
        self.words = np.frombuffer(row["words"], "<u4").astype(np.int64)
        self.bounds = np.concatenate(([0], np.cumsum(self.words)))
        self._terms = np.frombuffer(row["terms"], "<u8")
        self._counts = np.frombuffer(row["counts"], "<u4").astype(np.int64)
        self._firsts = np.cumsum(self._counts) - self._counts
        self._planes = np.frombuffer(row["postings"], np.uint8).reshape(4, -1)

    def known(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the dictionary, words) of the terms; no words if the segment hasn't the term."""
        if not len(self._terms):
            return np.zeros(len(some), np.int64), np.zeros(len(some), np.int64)
        at = np.minimum(np.searchsorted(self._terms, some), len(self._terms) - 1)
        return at, np.where(self._terms[at] == some, self._counts[at], 0)

    def lists(self, at: np.ndarray) -> np.ndarray:
        """The postings of the terms at these places of the dictionary, one list after the other."""
        return unpacked(self._planes, self._firsts[at], self._counts[at])

    def document(self, places: np.ndarray) -> np.ndarray:
        """The number in the segment of the document that each place lies in."""
        return np.searchsorted(self.bounds, places, "right") - 1

    def phrases(self, windows: Windows):
        """(length, windows, places) of exact occurrences: a window begins at each of the places."""
        at, counts = self.known(windows.terms)
        for size, (rows, _, _) in windows.by_length.items():
            alive = np.flatnonzero((counts[rows] > 0).all(axis=1))
            if not len(alive):
                continue
            rarest = np.argsort(counts[rows[alive]], axis=1, kind="stable")
            used, word = np.unique(rows[alive], return_inverse=True)
            word = word.reshape(len(alive), size)
            n = counts[used]
            places = self.lists(at[used])
            first = np.cumsum(n) - n
            keys = (np.repeat(np.arange(len(used)), n) << 32) | places  # ascending
            lead = np.take_along_axis(word, rarest[:, :1], 1)[:, 0]
            cuts = np.searchsorted(np.cumsum(n[lead]), np.arange(PLACES, n[lead].sum() + PLACES, PLACES), "left") + 1
            for a, b in zip([0, *cuts.tolist()], cuts.tolist()):
                if a >= len(alive):
                    break
                some = np.arange(a, min(b, len(alive)))
                m = n[lead[some]]
                window = np.repeat(some, m)
                inside = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                start = places[first[lead[window]] + inside] - rarest[window, 0]
                for k in range(1, size):
                    offset = rarest[window, k]
                    want = (word[window, offset] << 32) | np.maximum(start + offset, 0)
                    hit = (start >= 0) & (keys[np.minimum(np.searchsorted(keys, want), len(keys) - 1)] == want)
                    window, start = window[hit], start[hit]
                hit = (start >= 0) & (self.document(start) == self.document(start + size - 1))
                if hit.any():
                    yield size, alive[window[hit]], start[hit]

    def near(self, windows: Windows, span: int):
        """(length, windows, first places, last places) where all distinct words of a window stand in at most ``span`` words.

        For each word of a window, from where all of them follow soonest; of
        stretches that end alike only the shortest is kept.
        """
        at, counts = self.known(windows.terms)
        for size, (rows, _, _) in windows.by_length.items():
            for w in np.flatnonzero((counts[rows] > 0).all(axis=1)).tolist():
                words = np.unique(rows[w])
                some = [self.lists(at[[x]]) for x in words[np.argsort(counts[words], kind="stable")]]
                # a stretch holds the rarest word: only places about one of these can begin it
                begin = [some[0]]
                for places in some[1:]:
                    after = np.minimum(np.searchsorted(some[0], places), len(some[0]) - 1)
                    begin.append(places[(some[0][after] >= places) & (some[0][after] - places < span)])
                begin = np.unique(np.concatenate(begin))
                last = begin.copy()
                for places in some:
                    after = np.searchsorted(places, begin)
                    ok = after < len(places)
                    begin, last = begin[ok], np.maximum(last[ok], places[after[ok]])
                ok = (last - begin < span) & (self.document(begin) == self.document(last))
                begin, last = begin[ok], last[ok]
                if len(begin):
                    shortest = np.concatenate((last[1:] != last[:-1], [True]))
                    yield size, np.full(int(shortest.sum()), w), begin[shortest], last[shortest]


def _blocks(items: DataFrame, scratch: Scratch, block: int) -> tuple[str, list[str]]:
    """Write the test texts (item_id, text) in files of about ``block`` bytes; (folder, names)."""
    rows = items.select(F.col("item_id").cast("string").alias("id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    folder = scratch.folder("items")
    rows.repartition(int(total // block) + 1, F.xxhash64("id", "text")).write.parquet(folder)
    return folder, sorted(f.rpartition("/")[2] for f in scratch.spark.read.schema(rows.schema).parquet(folder).inputFiles())


def search(index: DataFrame, items: DataFrame, scratch: Scratch, width: int = 10, block: int = BLOCK) -> DataFrame:
    """doc_id, n_words, spans, items of each document of ``index``: where windows of ``items`` (item_id, text) occur, and whose.

    A window is ``width`` consecutive words of a text, or all of them if there
    are fewer. ``spans`` are the stretches (start, length) of words in any
    occurrence, apart from each other; ``items`` the ids, as strings in order.
    """
    folder, names = _blocks(items, scratch, block)
    kind = index.schema["ids"].dataType.elementType.simpleString()

    def rows_of(segment: Segment, id_type: pa.DataType) -> pa.RecordBatch:
        n = len(segment.ids)
        edges = np.zeros(segment.bounds[-1] + 1, np.int32)
        owners = set()
        for name in names:
            windows = _block(folder, name, width)
            for size, which, start in segment.phrases(windows):
                np.add.at(edges, start, 1)
                np.add.at(edges, start + size, -1)
                _, first, texts = windows.by_length[size]
                pairs = np.unique(np.stack([segment.document(start), which]), axis=1)
                m = first[pairs[1] + 1] - first[pairs[1]]
                flat = np.repeat(first[pairs[1]] - (np.cumsum(m) - m), m) + np.arange(m.sum())
                held = np.unique(np.stack([np.repeat(pairs[0], m), texts[flat]]), axis=1)
                owners.update((d, windows.ids[i]) for d, i in held.T.tolist() if windows.ids[i] is not None)
        hit = np.diff((np.cumsum(edges[:-1]) > 0).astype(np.int8), prepend=0, append=0)
        begin, end = np.flatnonzero(hit > 0), np.flatnonzero(hit < 0)
        # a stretch may run over the end of a document into the next one
        inner = segment.bounds[1:-1]
        cut = np.unique(inner[(np.searchsorted(begin, inner, "left") - np.searchsorted(end, inner, "right")) > 0])
        begin, end = np.sort(np.concatenate((begin, cut))), np.sort(np.concatenate((end, cut)))
        doc = segment.document(begin)
        each = np.searchsorted(doc, np.arange(n + 1))
        stretch = pa.StructArray.from_arrays([pa.array(begin - segment.bounds[doc]), pa.array(end - begin)], names=["start", "length"])
        named: dict[int, list[str]] = {}
        for d, i in sorted(owners):
            named.setdefault(d, []).append(i)
        columns = [pa.array(segment.ids, id_type), pa.array(segment.words), pa.ListArray.from_arrays(pa.array(each, pa.int32()), stretch), pa.array([named.get(d, []) for d in range(n)], pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "spans", "items"])

    def run(batches):
        for batch in batches:
            id_type = batch.schema.field("ids").type.value_type
            for k in range(batch.num_rows):
                yield rows_of(Segment({c: batch.column(c)[k].as_py() for c in batch.schema.names}), id_type)

    return index.mapInArrow(run, f"doc_id {kind}, n_words long, spans array<struct<start:long,length:long>>, items array<string>")


def occurrences(index: DataFrame, items: DataFrame, scratch: Scratch, width: int = 10, span: int | None = None, block: int = BLOCK) -> DataFrame:
    """doc_id, item_id, start, length of each occurrence of a window of ``items`` in the documents of ``index``, once for each text that has it.

    With ``span`` the words of a window may stand in any order and apart, all
    of them within that many words of a document: each shortest such stretch.
    """
    folder, names = _blocks(items, scratch, block)
    kind = index.schema["ids"].dataType.elementType.simpleString()

    def found(segment: Segment, windows: Windows):
        if span is None:
            yield from ((size, which, start, start + size - 1) for size, which, start in segment.phrases(windows))
        else:
            yield from segment.near(windows, span)

    def run(batches):
        for batch in batches:
            id_type = batch.schema.field("ids").type.value_type
            for k in range(batch.num_rows):
                segment = Segment({c: batch.column(c)[k].as_py() for c in batch.schema.names})
                for name in names:
                    windows = _block(folder, name, width)
                    for size, which, start, last in found(segment, windows):
                        _, first, texts = windows.by_length[size]
                        m = first[which + 1] - first[which]
                        item = texts[np.repeat(first[which] - (np.cumsum(m) - m), m) + np.arange(m.sum())]
                        start, last = np.repeat(start, m), np.repeat(last, m)
                        doc = segment.document(start)
                        columns = [pa.array([segment.ids[d] for d in doc.tolist()], id_type), pa.array([windows.ids[i] for i in item.tolist()], pa.string()), pa.array(start - segment.bounds[doc]), pa.array(last - start + 1)]
                        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "start", "length"])

    return index.mapInArrow(run, f"doc_id {kind}, item_id string, start long, length long").distinct()


def op11_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all ``documents`` that lie in a window of ten words of a ``benchmark`` text, and the texts."""
    scratch = Scratch(spark, "positions")
    index = build(spark.read.parquet(os.path.join(sf_dir, "documents.parquet")), scratch.folder("index"))
    found = search(index, spark.read.parquet(os.path.join(sf_dir, "benchmark.parquet")), scratch, 10)
    hits = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["length"])
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    rows = found.select("doc_id", "n_words", hits.alias("n_hit"), F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"))
    return rows.withColumn("contaminated", F.col("n_hit") > 0)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: array_to_string(w[i:i + 9], ' '))) AS phrase FROM b WHERE len(w) > 0
), sizes AS (SELECT DISTINCT n FROM windows), places AS (
  SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n
), hits AS (
  SELECT r, i, p.n, item_id FROM (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM places) p JOIN windows USING (n, phrase)
), marked AS (
  SELECT r, count(DISTINCT i + k) AS n_hit FROM (SELECT DISTINCT r, i, n FROM hits) h, (SELECT unnest(range(0, 10)) AS k) WHERE k < n GROUP BY r
), named AS (
  SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM hits GROUP BY r
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN marked USING (r) LEFT JOIN named USING (r)
"""
