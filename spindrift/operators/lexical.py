"""Lexical search in a stored index: packed posting lists with block maxima, and top-k that skips blocks and segments.

Scores are those of ``search.bm25``: terms match as substrings, lengths are in
characters. A term consists of word characters (Latin letters, digits, ``_``
and ``.``) or of Chinese characters, so it occurs within runs of these. The
index has a list for each gram of two to four characters of a run, and one for
each run of five and more word characters. A term of up to four characters has
its own list; a longer one has the lists of the runs that contain it.

The index is a Parquet table partitioned by documents: tasks gather texts into
segments of about SEGMENT characters. A row holds the lists of one segment in
one of BUCKETS buckets of terms, so a search reads the buckets of its terms.
Rows are clustered by bucket in the files. Lists are cut into blocks of BLOCK
postings, each with its last document, its largest term frequency and its
shortest text, which bound its scores whatever the corpus statistics become.
More documents are appended as further segments.

A search takes four steps:

1. heads (terms, counts, block maxima) of the buckets in question give document
   frequencies and a bound for each query in each segment;
2. each query is scored in the segment of its highest bound, and its k-th best
   score there is the first threshold;
3. the other segments whose bound reaches the threshold are scored;
4. the best of all segments are ranked.

Within a segment a document's bound is the sum of the maxima of the blocks
that it lies in; blocks with no document that can reach the threshold are not
unpacked. A skipped document or segment can't be among the best k.
"""

from __future__ import annotations

import math
import re
import uuid
import zlib
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.files import spread, stored
from .search import K1, B, top_k

#: Characters of a segment (one text at least), its texts at most, buckets of terms, postings of a block.
SEGMENT, DOCUMENTS, BUCKETS, BLOCK = 2 << 20, 1 << 16, 32, 64
#: Lengths of grams; longer runs of word characters have lists of their own.
GRAMS = (2, 3, 4)

LONG_RUNS = re.compile("[A-Za-z0-9_.]{5,}")
_TERM = re.compile("[A-Za-z0-9_.]{2,}|[一-鿿]{2,4}")
#: Scores are rounded to nine digits; a bound may fall short of them by less than this.
SLACK = 1e-8

_LATIN = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_."
#: 1 to 64 for the word characters, 0 for others; and the range of the Chinese ones.
_CODES = np.zeros(128, np.int64)
_CODES[[ord(c) for c in _LATIN]] = np.arange(1, 65)
_FIRST, _LAST = 0x4E00, 0x9FFF


def bucket(term: str) -> int:
    return zlib.crc32(term.encode()) % BUCKETS


def _apart(places: np.ndarray, linked: np.ndarray, size: int) -> np.ndarray:
    """Which occurrences count without overlap, from the left; ``linked`` ones overlap the one before."""
    keep = np.ones(len(places), bool)
    edges = np.diff(np.concatenate((linked, [False])).astype(np.int8), prepend=0)
    for a, b in zip((np.flatnonzero(edges > 0) - 1).tolist(), np.flatnonzero(edges < 0).tolist()):
        after = -1
        for i, p in enumerate(places[a:b].tolist(), a):
            if p < after:
                keep[i] = False
            else:
                after = p + size
    return keep


def gram_lists(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(grams; number of texts with each; these texts, gram by gram; occurrences in each without overlap)."""
    chars = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
    latin = np.where(chars < 128, _CODES[np.minimum(chars, 127)], 0)
    chinese = np.where((chars >= _FIRST) & (chars <= _LAST), chars - _FIRST + 1, 0)
    terms, sizes, docs, times = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for codes, bits, letter in ((latin, 7, lambda c: _LATIN[c - 1]), (chinese, 15, lambda c: chr(c + _FIRST - 1))):
        if not codes.any():
            continue
        for n in GRAMS:
            m = len(codes) - n + 1
            if m <= 0:
                continue
            key, whole = np.zeros(m, np.int64), np.ones(m, bool)
            for i in range(n):
                part = codes[i : i + m]
                key = key << bits | part
                whole &= part > 0
            at = np.flatnonzero(whole)
            if not len(at):
                continue
            key = key[at]
            if bits * n > 31:  # else key and place share a number
                distinct, key = np.unique(key, return_inverse=True)
            both = np.sort(key << 32 | at)
            key, at = both >> 32, both & 0xFFFFFFFF
            doc = np.searchsorted(bounds, at, "right") - 1
            begins = np.concatenate(([True], key[1:] != key[:-1]))
            new = begins | np.concatenate(([True], doc[1:] != doc[:-1]))
            linked = ~new & (np.diff(at, prepend=-n) < n)
            keep = _apart(at, linked, n) if linked.any() else np.ones(len(at), bool)
            firsts = np.flatnonzero(new)
            heads = np.flatnonzero(begins[firsts])
            docs.append(doc[firsts])
            times.append(np.add.reduceat(keep.astype(np.int64), firsts))
            sizes.append(np.diff(heads, append=len(firsts)))
            found = key[firsts[heads]]
            found = distinct[found] if bits * n > 31 else found
            mask = (1 << bits) - 1
            terms += ["".join(letter(k >> bits * i & mask) for i in range(n - 1, -1, -1)) for k in found.tolist()]
    return terms, np.concatenate(sizes), np.concatenate(docs), np.concatenate(times)


def bordered(term: str) -> bool:
    """Whether occurrences of a term can overlap."""
    return any(term[k:] == term[: len(term) - k] for k in range(1, len(term)))


def countable(term: str) -> bool:
    """Whether ``count_grams`` can count a term: a gram of one kind of characters that can't overlap itself."""
    return len(term) in GRAMS and _TERM.fullmatch(term) is not None and not bordered(term)


def count_grams(texts: list[str], terms: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of a text, number of a term, occurrences) for each of ``terms``, which are countable, and each text that holds it."""
    chars = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
    out = [np.zeros((3, 0), np.int64)]
    for latin in (True, False):
        bits = 7 if latin else 15
        code = (lambda c: _LATIN.index(c) + 1) if latin else (lambda c: ord(c) - _FIRST + 1)
        by_size: dict[int, list[tuple[int, int]]] = {}
        for i, t in enumerate(terms):
            if t[0].isascii() == latin:
                by_size.setdefault(len(t), []).append((sum(code(c) << bits * (len(t) - 1 - k) for k, c in enumerate(t)), i))
        if not by_size:
            continue
        codes = np.where(chars < 128, _CODES[np.minimum(chars, 127)], 0) if latin else np.where((chars >= _FIRST) & (chars <= _LAST), chars - _FIRST + 1, 0)
        for n, some in by_size.items():
            m = len(codes) - n + 1
            if m <= 0:
                continue
            keys, which = np.array(sorted(some)).T
            key = codes[:m].copy()
            for k in range(1, n):
                key <<= bits
                key |= codes[k : k + m]
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            place = np.flatnonzero(keys[at] == key)
            doc = np.searchsorted(bounds, place, "right") - 1
            times = np.bincount(at[place] * len(texts) + doc, minlength=len(keys) * len(texts))
            held = np.flatnonzero(times)
            out.append(np.stack([held % len(texts), which[held // len(texts)], times[held]]))
    return tuple(np.concatenate(out, axis=1))


def run_lists(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """The same for runs of word characters that are longer than a gram."""
    number: dict[str, int] = {}
    which, docs, times = array("q"), array("q"), array("q")
    for d, text in enumerate(texts):
        for run, n in Counter(LONG_RUNS.findall(text)).items():
            which.append(number.setdefault(run, len(number)))
            docs.append(d)
            times.append(n)
    order = np.argsort(np.array(which), kind="stable")
    return list(number), np.bincount(np.array(which, np.int64), minlength=len(number)), np.array(docs)[order], np.array(times)[order]


def planes(values) -> bytes:
    """Numbers as all lowest bytes, then all second ones, and so on, which compresses well."""
    return np.asarray(values, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def numbers(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


FIELDS = "kind string, bucket int, segment string, ids array<{}>, terms string, counts binary, last binary, most binary, least binary, docs binary, times binary"
NAMES = [f.split()[0] for f in FIELDS.split(", ")]


def _lists(kind: str, segment: str, terms: list[str], sizes: np.ndarray, docs: np.ndarray, times: np.ndarray, lengths: np.ndarray) -> list[tuple]:
    """Rows of one segment from lists that follow one another; ``lengths`` are those of its texts."""
    of = np.array([bucket(t) for t in terms], np.int64)
    firsts = np.cumsum(sizes) - sizes
    out = []
    for b in np.unique(of).tolist():
        some = np.flatnonzero(of == b)
        n = sizes[some]
        at = np.repeat(firsts[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        d, t, cuts = docs[at], times[at], _cuts(n)
        gaps = np.diff(d, prepend=0)
        gaps[cuts] = d[cuts]  # each block is unpacked by itself
        last = np.append(d[cuts[1:] - 1], d[-1])
        out.append((kind, b, segment, None, "\n".join([terms[i] for i in some.tolist()]), planes(n), planes(last), planes(np.maximum.reduceat(t, cuts)), planes(np.minimum.reduceat(lengths[d], cuts)), planes(gaps), planes(t)))
    return out


def _cuts(sizes: np.ndarray) -> np.ndarray:
    """Where blocks begin in lists of these sizes, one after the other."""
    per = -(-sizes // BLOCK)
    inside = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    return np.repeat(np.cumsum(sizes) - sizes, per) + inside * BLOCK


def build(docs: DataFrame, path: str, segment: int = SEGMENT) -> DataFrame:
    """Append the index of ``docs`` (doc_id, text) to ``path`` and return the whole index.

    Null texts count as documents but hold nothing and don't enter the mean
    length. A document that is given twice is found twice.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    id_type = docs.sparkSession.createDataFrame([], f"x {kind}").toArrow().schema.field("x").type

    def rows(ids, texts):
        name = uuid.uuid4().hex
        sizes = np.array([len(t or "") for t in texts], np.int64)
        found = [("lengths", 0, name, ids, "", planes([t is not None for t in texts]), b"", b"", b"", planes(sizes), b"")]
        whole = [t or "" for t in texts]
        for label, lists in (("gram", gram_lists(whole)), ("run", run_lists(whole))):
            found += _lists(label, name, *lists, sizes)
        columns = [pa.array(c, id_t) for c, id_t in zip(zip(*found), (pa.string(), pa.int32(), pa.string(), pa.list_(id_type), pa.string(), *[pa.binary()] * 6))]
        return pa.RecordBatch.from_arrays(columns, names=NAMES)

    def run(batches):
        ids, texts, size = [], [], 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if ids and (size + len(text or "") > segment or len(ids) >= DOCUMENTS):
                    yield rows(ids, texts)
                    ids, texts, size = [], [], 0
                ids.append(i)
                texts.append(text)
                size += len(text or "")
        if ids:
            yield rows(ids, texts)

    spark = docs.sparkSession
    found = spread(docs.select("doc_id", F.col("text").cast("string").alias("text"))).mapInArrow(run, FIELDS.format(kind))
    part = F.pmod(F.xxhash64("segment"), F.lit(int(spark.conf.get("spark.sql.shuffle.partitions"))))
    # a bucket's rows lie together in a file, so its groups of rows are left out by their statistics
    found.repartition("kind", "bucket", part).sortWithinPartitions("kind", "bucket", "segment").write.mode("append").option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(path)
    return spark.read.schema(found.schema).parquet(path)


class Lists:
    """The posting lists of a row, or of a part of one, open for search."""

    def __init__(self, row: dict):
        self.terms = row["terms"].split("\n") if row["terms"] else []
        self.sizes = numbers(row["counts"])
        self.cuts = _cuts(self.sizes)
        self.last, self.most, self.least = (numbers(row[c]) for c in ("last", "most", "least"))
        self._docs, self._times = (np.frombuffer(row[c], np.uint8).reshape(4, -1) if row.get(c) is not None else None for c in ("docs", "times"))
        per = -(-self.sizes // BLOCK)
        self.blocks = np.concatenate(([0], np.cumsum(per)))
        self.ends = np.append(self.cuts[1:], self.sizes.sum()).astype(np.int64)
        self._known = None

    def unpacked(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents, times) of the postings in these blocks, which are in order."""
        n = self.ends[blocks] - self.cuts[blocks]
        ends = np.cumsum(n)
        at = np.repeat(self.cuts[blocks] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
        gaps, times = (sum(p[k, at].astype(np.int64) << (8 * k) for k in range(4)) for p in (self._docs, self._times))
        sums = np.concatenate(([0], np.cumsum(gaps)))
        return sums[1:] - np.repeat(sums[ends - n], n), times

    def held(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``unpacked`` for a list of its own; a block that another query has unpacked is not unpacked again."""
        if self._known is None:
            n = int(self.sizes.sum())
            self._known = np.zeros(len(self.last), bool), np.zeros(n, np.int64), np.zeros(n, np.int64)
        known, docs, times = self._known
        if not len(blocks):
            return docs[:0], times[:0]
        new = blocks[~known[blocks]]
        if len(new) == len(known):
            docs[:], times[:] = self.unpacked(new)
        elif len(new):
            at = np.concatenate([np.arange(a, b) for a, b in zip(self.cuts[new].tolist(), self.ends[new].tolist())])
            docs[at], times[at] = self.unpacked(new)
        known[new] = True
        if len(blocks) == len(known):
            return docs, times
        at = np.concatenate([np.arange(a, b) for a, b in zip(self.cuts[blocks].tolist(), self.ends[blocks].tolist())])
        return docs[at], times[at]

    def part(self, k: int) -> tuple:
        """The list of term number ``k`` as bytes: counts, last, most, least, docs, times."""
        a, b = self.blocks[k], self.blocks[k + 1]
        x, y = self.cuts[a], self.ends[b - 1]
        return (planes([self.sizes[k]]), *(planes(v[a:b]) for v in (self.last, self.most, self.least)), *(np.ascontiguousarray(p[:, x:y]).tobytes() for p in (self._docs, self._times)))


def saturated(times, lengths, mean: float):
    """The share of a term's weight that a document of this length has for so many occurrences."""
    return times * (K1 + 1) / (times + K1 * (1 - B + B * lengths / mean))


_HEAD = ("kind", "bucket", "segment", "terms", "counts", "last", "most", "least")
_PART = "segment string, term string, counts binary, last binary, most binary, least binary, docs binary, times binary"


def _gram_heads(index: DataFrame, terms: list[str]) -> DataFrame:
    """segment, term, n, most, least of the terms that are grams, from the heads of their buckets."""
    wanted = frozenset(terms)

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                lists = Lists(row)
                for k, term in enumerate(lists.terms):
                    if term in wanted:
                        a, b = lists.blocks[k], lists.blocks[k + 1]
                        out.append((row["segment"], term, int(lists.sizes[k]), int(lists.most[a:b].max()), int(lists.least[a:b].min())))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["segment", "term", "n", "most", "least"])

    rows = index.filter(F.col("kind") == "gram").filter(F.col("bucket").isin(sorted({bucket(t) for t in terms}))).select(*_HEAD)
    return rows.mapInArrow(run, "segment string, term string, n long, most long, least long")


def _parts(rows: DataFrame, terms: list[str], within: bool) -> DataFrame:
    """The lists of ``terms`` in these rows of the index; with ``within`` of all runs that contain one, with its times multiplied."""

    def run(batches):
        import ahocorasick

        machine = ahocorasick.Automaton()
        for t in terms:
            machine.add_word(t, t)
        machine.make_automaton()
        wanted, number = frozenset(terms), {t: i for i, t in enumerate(terms)}
        for batch in batches:
            for row in batch.to_pylist():
                lists, out = Lists(row), []
                if not within:
                    out = [(row["segment"], term, *lists.part(k)) for k, term in enumerate(lists.terms) if term in wanted]
                else:
                    line = np.cumsum([0, *(len(t) + 1 for t in lists.terms)])
                    hits = [(end, number[term]) for end, term in machine.iter(row["terms"])] if terms else []
                    if hits:
                        ends, which = np.array(hits).T
                        which, k = np.unique(np.stack([which, np.searchsorted(line, ends, "right") - 1]), axis=1)
                        per = lists.blocks[k + 1] - lists.blocks[k]
                        docs, times = lists.unpacked(np.repeat(lists.blocks[k] - (np.cumsum(per) - per), per) + np.arange(per.sum()))
                        n = lists.sizes[k]
                        times = times * np.repeat([lists.terms[j].count(terms[i]) for i, j in zip(which.tolist(), k.tolist())], n)
                        edges = np.append(0, np.cumsum(n))
                        firsts = np.flatnonzero(np.diff(which, prepend=-1))
                        for x, y in zip(firsts.tolist(), [*firsts[1:].tolist(), len(which)]):
                            a, b = edges[x], edges[y]
                            out.append((row["segment"], terms[which[x]], planes([b - a]), b"", b"", b"", planes(docs[a:b]), planes(times[a:b])))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.string(), *[pa.binary()] * 6))], names=[f.split()[0] for f in _PART.split(", ")])

    return rows.mapInArrow(run, _PART)


def _united(parts: DataFrame, lengths: DataFrame) -> DataFrame:
    """One list with blocks for each segment and term from the lists of its runs, which lie in several buckets."""
    kind = parts.select("segment", "term", "docs", "times", F.lit(None).cast("binary").alias("sizes"))
    both = kind.unionByName(lengths.select("segment", F.lit(None).cast("string").alias("term"), F.lit(None).cast("binary").alias("docs"), F.lit(None).cast("binary").alias("times"), F.col("docs").alias("sizes")))

    def run(table):
        rows = table.to_pylist()
        sizes = next(numbers(r["sizes"]) for r in rows if r["sizes"] is not None)
        lists: dict[str, list] = {}
        for r in rows:
            if r["term"] is not None:
                lists.setdefault(r["term"], []).append(r)
        out = []
        for term, some in sorted(lists.items()):
            docs = np.concatenate([numbers(r["docs"]) for r in some])
            times = np.concatenate([numbers(r["times"]) for r in some])
            docs, which = np.unique(docs, return_inverse=True)
            total = np.bincount(which, times).astype(np.int64)
            row = _lists("run", rows[0]["segment"], [term], np.array([len(docs)]), docs, total, sizes)[0]
            out.append((row[2], term, *row[5:]))
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.string(), *[pa.binary()] * 6))], names=[f.split()[0] for f in _PART.split(", ")])

    return both.groupBy("segment").applyInArrow(run, _PART)


class _Search:
    """One query in one segment: a bound for each document, and its score once all its blocks are unpacked."""

    def __init__(self, lists: list[tuple[float, Lists]], lengths: np.ndarray, mean: float):
        self.lengths, self.mean = lengths, mean
        self.bound, self.raw = np.zeros(len(lengths)), np.zeros(len(lengths))
        self.lists = []
        for weight, x in lists:
            # the bound of the block that each document up to the last one lies in
            each = np.maximum(weight * saturated(x.most, x.least, mean), 0)
            block = np.repeat(np.arange(len(x.last)), np.diff(x.last, prepend=-1))
            self.bound[: len(block)] += each[block]
            self.lists.append((weight, x, each, block, np.zeros(len(x.last), bool)))
        self.lists.sort(key=lambda t: -t[2].max())

    def unpack(self, k: int, docs: np.ndarray) -> None:
        """Make the share of list ``k`` exact for all documents in the blocks of ``docs``."""
        weight, x, each, block, done = self.lists[k]
        blocks = np.unique(block[docs[docs < len(block)]])
        blocks = blocks[~done[blocks]]
        if not len(blocks):
            return
        done[blocks] = True
        new = np.zeros(len(done), bool)
        new[blocks] = True
        self.bound[: len(block)] -= (each * new)[block]
        found, times = x.held(blocks)
        share = weight * saturated(times, self.lengths[found], self.mean)
        self.bound[found] += share
        self.raw[found] += share

    def best(self, k: int, threshold: float) -> tuple[np.ndarray, int, int]:
        """(the documents of the ``k`` best scores, with ties, that reach ``threshold``; blocks; blocks unpacked)."""
        met = np.zeros(len(self.lengths), bool)
        near = np.flatnonzero(self.bound > 0)
        for j in range(len(self.lists)):
            near = near[self.bound[near] >= threshold - SLACK]
            self.unpack(j, near)
            if j == 0 and len(near) > k:
                # the most promising documents raise the threshold
                some = near[np.argpartition(-self.bound[near], k - 1)[:k]]
                for i in range(1, len(self.lists)):
                    self.unpack(i, some)
                threshold = max(threshold, float(self.bound[some].min()))
        for _, x, _, _, done in self.lists:
            met[x.held(np.flatnonzero(done))[0]] = True
        near = near[met[near] & (self.bound[near] >= threshold - SLACK)]
        score = np.round(self.raw[near], 9)
        if len(near) > k:
            near = near[score >= np.partition(score, len(near) - k)[len(near) - k]]
        return near, sum(len(t[1].last) for t in self.lists), sum(int(t[4].sum()) for t in self.lists)


def _scored(wanted: DataFrame, parts: DataFrame, lengths: DataFrame, queries: dict, weights: dict[str, float], mean: float, k: int, kind: str) -> DataFrame:
    """query, doc_id, raw and blocks, unpacked of the pairs in ``wanted`` (segment, query, threshold): the best ``k`` of each segment, and in a row without a document what was read."""
    left = lengths.select("segment", "ids", F.col("docs").alias("sizes"))
    asked = wanted.groupBy("segment").agg(F.collect_list(F.struct("query", "threshold")).alias("asked"))  # at most the batch of queries
    left = left.join(asked, "segment")
    right = parts.join(wanted.select("segment").distinct(), "segment", "left_semi")

    def run(key, one, lists):
        row, held = one.to_pylist(), {}
        out = []
        if row:
            ids, sizes = row[0]["ids"], numbers(row[0]["sizes"])
            for r in lists.to_pylist():
                held[r["term"]] = Lists(r | {"terms": r["term"]})
            for q in row[0]["asked"]:
                search = _Search([(weights[t], held[t]) for t in queries[q["query"]] if t in held], sizes, mean)
                near, total, unpacked = search.best(k, q["threshold"])
                out += [(q["query"], ids[d], float(np.round(search.raw[d], 9)), None, None) for d in near.tolist()]
                out.append((q["query"], None, None, total, unpacked))
        columns = list(zip(*out)) or [[]] * 5
        id_type = one.schema.field("ids").type.value_type
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), id_type, pa.float64(), pa.int64(), pa.int64()))], names=["query", "doc_id", "raw", "blocks", "unpacked"])

    return left.groupBy("segment").cogroup(right.groupBy("segment")).applyInArrow(run, f"query int, doc_id {kind}, raw double, blocks long, unpacked long")


def bm25(index: DataFrame, queries: DataFrame, k: int, df_cap: int | None = None) -> DataFrame:
    """The result of ``search.bm25`` from an index: query_id, doc_id, score, rank of the top ``k`` for each of ``queries`` (query_id, terms)."""
    return ranked(*scores(index, queries, k, df_cap), k)


def scores(index: DataFrame, queries: DataFrame, k: int, df_cap: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(scored rows, queries by number) of a search, with the counts of blocks that there were and that were unpacked.

    Terms are bounded by the batch of queries, and so are the weights that the
    driver works out. Terms with other characters raise an error.
    """
    spark = index.sparkSession
    kind = index.schema["ids"].dataType.elementType.simpleString()
    batch = [(r["query_id"], list(dict.fromkeys(t for t in r["terms"] or () if t))) for r in queries.select("query_id", "terms").collect()]
    terms = sorted({t for _, some in batch for t in some})
    if odd := [t for t in terms if not _TERM.fullmatch(t)]:
        raise ValueError(f"the index has no lists for {odd[:3]}")
    by_number = {i: some for i, (_, some) in enumerate(batch)}
    short, long = [t for t in terms if len(t) <= GRAMS[-1]], [t for t in terms if len(t) > GRAMS[-1]]
    named = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(batch)], f"query int, query_id {queries.schema['query_id'].dataType.simpleString()}")
    lengths = index.filter("kind = 'lengths'").select("segment", "ids", "counts", "docs")

    @F.udf("struct<n:long,texts:long,chars:long>")
    def sizes(flags, chars):
        return len(flags) // 4, int(numbers(flags).sum()), int(numbers(chars).sum())

    stats = lengths.select(sizes("counts", "docs").alias("s")).agg(F.sum("s.n").alias("n"), F.sum("s.texts").alias("texts"), F.sum("s.chars").alias("chars")).first()
    total, mean = stats["n"] or 0, (stats["chars"] or 0) / (stats["texts"] or 1) or 1.0
    runs = stored(_united(_parts(index.filter("kind = 'run'"), long, True), lengths)) if long else spark.createDataFrame([], _PART)

    def head(batches):
        for batch in batches:
            rows = batch.to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("segment"), batch.column("term"), pa.array([int(numbers(r["counts"])[0]) for r in rows], pa.int64()), pa.array([int(numbers(r["most"]).max()) for r in rows], pa.int64()), pa.array([int(numbers(r["least"]).min()) for r in rows], pa.int64())], names=["segment", "term", "n", "most", "least"])

    heads = stored(_gram_heads(index, short).unionByName(runs.mapInArrow(head, "segment string, term string, n long, most long, least long")))
    weights = {}
    for r in heads.groupBy("term").agg(F.sum("n").alias("n")).collect():  # one for each term of the batch
        df = min(r["n"], df_cap or r["n"])
        weights[r["term"]] = math.log((total - df + 0.5) / (df + 0.5) + 1)
    weight = spark.createDataFrame(list(weights.items()) or [], "term string, w double")
    used = spark.createDataFrame([(i, t) for i, some in by_number.items() for t in some], "query int, term string")
    share = F.col("w") * F.col("most") * (K1 + 1) / (F.col("most") + K1 * (1 - B + B * F.col("least") / F.lit(mean)))
    bounds = stored(heads.join(F.broadcast(weight), "term").join(F.broadcast(used), "term").groupBy("segment", "query").agg(F.sum(F.greatest(share, F.lit(0.0))).alias("bound")))
    first = Window.partitionBy("query").orderBy(F.desc("bound"), "segment")
    top = bounds.withColumn("place", F.row_number().over(first)).filter("place = 1").select("segment", "query", F.lit(0.0).alias("threshold"))
    grams_of = index.filter(F.col("kind") == "gram").filter(F.col("bucket").isin(sorted({bucket(t) for t in short}))).select(*_HEAD, "docs", "times")

    def scored(wanted):
        parts = _parts(grams_of.join(wanted.select("segment").distinct(), "segment", "left_semi"), short, False).unionByName(runs)
        return stored(_scored(wanted, parts, lengths, by_number, weights, mean, k, kind))

    begun = scored(top)
    kth = top_k(begun.filter("doc_id is not null or raw is not null"), ["query"], [F.desc("raw")], k).filter(F.col("rank") == k).select("query", F.col("raw").alias("threshold"))
    rest = bounds.join(top.select("segment", "query"), ["segment", "query"], "left_anti").join(kth, "query", "left")
    rest = stored(rest.select("segment", "query", "bound", F.coalesce("threshold", F.lit(0.0)).alias("threshold")).filter(F.col("bound") >= F.col("threshold") - SLACK).drop("bound"))
    return begun.unionByName(scored(rest)), named


def ranked(found: DataFrame, named: DataFrame, k: int) -> DataFrame:
    total = found.filter("raw is not null").join(F.broadcast(named), "query")
    rows = top_k(total, ["query_id"], [F.desc("raw"), F.asc("doc_id")], k)
    best = F.max("raw").over(Window.partitionBy("query_id"))
    return rows.select("query_id", "doc_id", F.round(F.when(best > 0, F.col("raw") / best).otherwise(F.col("raw")), 6).alias("score"), "rank")


def read(spark: SparkSession, path: str) -> DataFrame:
    """A stored index."""
    return spark.read.parquet(path)
