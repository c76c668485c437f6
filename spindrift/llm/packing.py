"""Packing of tokenized documents into as few sequences as possible.

Only lengths matter to the packing, and there are at most ``capacity``
different ones, so the driver solves a histogram whose size doesn't grow with
the corpus. A filling of a sequence (a pattern) is chosen once and applied as
often as the counts allow. Documents then find their place on the executors:
the n-th piece of a length goes to the n-th slot of that length.

The solver is bin completion: around the largest remaining piece it
enumerates the fillings of a sequence, of any number of pieces, least waste
first, and passes over dominated ones (a filling in which one piece left out
fits as well, or could stand for some that are in). It backs out of a
branch once its waste exceeds what a better packing may waste. Best-fit
decreasing gives the first incumbent, and a packing that meets the bound of
total length / capacity ends the search. ``NODES`` bounds the fillings that
are looked at, not the documents: every piece is placed in any case, and the
best packing so far is the result when the search ends there.

Defined results: a null text is empty and holds the end id alone; equal rows
are separate documents; rows with a null doc_id are packed too; extra columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, bisect_right
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, running_total
from .tokens import encoder

NODES = 50_000
#: So many open branches keep their enumeration; earlier ones start it again when the search comes back to them.
OPEN = 64
#: Words that a worker keeps the ids of; other stages share its memory.
CACHE_WORDS = 250_000
PIECE = "doc_id long, name binary, piece int, start long, length int, ids_crc32 long"

#: A pattern: how often it is used, and its (size, copies), largest first.
Pattern = tuple[int, list[tuple[int, int]]]


def best_fit(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Best-fit decreasing over a histogram; like sequences are handled together."""
    rooms: dict[int, list[list]] = {}
    for size in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[size])
        for room in sorted(r for r in rooms if r >= size):
            while left and rooms.get(room):
                group = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room]
                each = min(room // size, left)
                used = min(group[0], left // each)
                left -= used * each
                if group[0] > used:
                    rooms.setdefault(room, []).append([group[0] - used, group[1]])
                rooms.setdefault(room - each * size, []).append([used, [*group[1], (size, each)]])
        each = capacity // size
        if left >= each:
            rooms.setdefault(capacity - each * size, []).append([left // each, [(size, each)]])
        if left % each:
            rooms.setdefault(capacity - left % each * size, []).append([1, [(size, left % each)]])
    return [(n, items) for groups in rooms.values() for n, items in groups]


def smeared(bits: int, width: int) -> int:
    """``bits`` and all places up to ``width`` above them."""
    step = 1
    while width > 0:
        step = min(step, width)
        bits |= bits << step
        width, step = width - step, 2 * step
    return bits


class Fillings:
    """The fillings of a sequence around its largest piece, least waste first: (waste, {size: copies}).

    ``left`` are the pieces that remain, by size. Sums that the smaller sizes
    reach are the bits of integers, so the enumeration never enters a branch
    that doesn't end in a filling. A dominated filling comes as (waste, None).
    """

    def __init__(self, left: np.ndarray, capacity: int):
        self.sizes = np.flatnonzero(left).tolist()
        self.counts = left[self.sizes].tolist()
        self.largest = self.sizes[-1]
        self.counts[-1] -= 1
        self.room = capacity - self.largest
        self.present = sum(1 << s for s, n in zip(self.sizes, self.counts) if n)
        self.reach = self._reach()

    def _reach(self) -> list[int]:
        """For each i, the sums up to ``room`` of the i smallest sizes; the list ends early once all sums are reached."""
        mask, reach = (2 << self.room) - 1, [1]
        for size, n in zip(self.sizes, self.counts):
            if size > self.room or reach[-1] == mask:
                break
            sums, n, step = reach[-1], min(n, self.room // size), 1
            while n:
                step = min(step, n)
                sums |= sums << size * step & mask
                n, step = n - step, 2 * step
            reach.append(sums)
        return reach

    def __iter__(self):
        for waste in range(self.room + 1):
            if self.reach[-1] >> self.room - waste & 1:
                for chosen in self._sums(len(self.sizes), self.room - waste):
                    need = dict(chosen)
                    need[self.largest] = need.get(self.largest, 0) + 1
                    yield waste, None if self.dominated(chosen, waste) else need

    def _sums(self, below: int, total: int):
        """All choices of the ``below`` smallest sizes with this sum, larger pieces first: [(size, copies)]."""
        if not total:
            yield []
            return
        at, last = min(below, bisect_right(self.sizes, total)), len(self.reach) - 1
        while at and self.reach[min(at, last)] >> total & 1:  # else smaller sizes alone don't reach the sum
            at -= 1
            size = self.sizes[at]
            for n in range(min(self.counts[at], total // size), 0, -1):
                if self.reach[min(at, last)] >> total - n * size & 1:
                    for rest in self._sums(at, total - n * size):
                        yield [(size, n), *rest]

    def dominated(self, chosen: list[tuple[int, int]], waste: int) -> bool:
        """Whether a piece that is left out fits as well, or may stand for one smaller piece, or for several."""
        mask = (2 << self.room) - 1
        out, single = self.present, 0
        one = several = 0  # sums of at least one piece, and of at least two
        for size, n in chosen:
            if self.counts[bisect_left(self.sizes, size)] == n:
                out &= ~(1 << size)
            single |= 1 << size
            for _ in range(n):
                several = (several | (several | one) << size) & mask
                one = (one | one << size | 1 << size) & mask
        larger = smeared((single | 1) << 1, waste - 1) if waste else 0
        return bool((smeared(several, waste) | larger) & out)


def solve(counts: np.ndarray, capacity: int, nodes: int = NODES) -> list[Pattern]:
    """Patterns that use up ``counts`` (by size, up to ``capacity``).

    A filling is first applied as often as the counts allow, then once.
    """
    left = counts.astype(np.int64)
    total = int((np.arange(len(left)) * left).sum())
    bound = -(-total // capacity)
    incumbent = best_fit(left, capacity)
    fewest = sum(n for n, _ in incumbent)

    def apply(taken: tuple[int, dict[int, int]], sign: int) -> None:
        for size, n in taken[1].items():
            left[size] += sign * taken[0] * n

    # a frame: its fillings, how many of them came, the waste before it, a filling to try once more, and what it has taken
    frames: list[list] = []

    def enter(waste: int) -> None:
        frames.append([iter(Fillings(left, capacity)), 0, waste, None, None])
        if len(frames) > OPEN:
            frames[-OPEN - 1][0] = None

    if fewest > bound:
        enter(0)
    while frames and nodes > 0 and fewest > bound:
        frame = frames[-1]
        if frame[4]:
            apply(frame[4], 1)
            frame[4] = None
        fillings, came, before, once, _ = frame
        slack = (fewest - 1) * capacity - total - before
        if not once:
            nodes -= 1
            if fillings is None:
                fillings = frame[0] = islice(iter(Fillings(left, capacity)), came, None)
            frame[1] += 1
        waste, need = once or next(fillings, (slack + 1, None))
        frame[3] = None
        if waste > slack:  # later fillings waste more
            frames.pop()
            continue
        if need is None:
            continue
        times = 1
        if not once:
            times = min(int(left[s]) // n for s, n in need.items())
            times = max(1, min(times, slack // waste)) if waste else times
            frame[3] = (waste, need) if times > 1 else None
        frame[4] = times, need
        apply(frame[4], -1)
        if left.any():
            enter(before + times * waste)
        else:
            incumbent = [(f[4][0], sorted(f[4][1].items(), reverse=True)) for f in frames]
            fewest = sum(n for n, _ in incumbent)
    return incumbent


def slots(patterns: list[Pattern]) -> dict[str, np.ndarray]:
    """Ranges of ranks for each size: sorted ``key`` (size and first rank), and base, copies and offset there."""
    rows, taken, base = [], {}, 0
    for times, items in patterns:
        at = 0
        for size, copies in items:
            rank = taken.get(size, 0)
            rows.append((size << 40 | rank, rank, base, copies, at))
            taken[size] = rank + times * copies
            at += size * copies
        base += times
    rows.sort()
    return dict(zip(("key", "rank", "base", "copies", "offset"), np.array(rows, np.int64).reshape(-1, 5).T.copy()))


def cut(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, keep_ids: bool = False) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text): at most ``capacity`` ids each; ``ids`` (32-bit) if asked for."""

    def run(batches):
        from pyspark import TaskContext

        enc, task, at = encoder(tokenizer, CACHE_WORDS), TaskContext.get().partitionId(), 0
        width = f"<u{enc.width}"
        tail = np.array([end_id], width).tobytes()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                wide = np.frombuffer(enc.encode(text.as_py()) + tail, width).astype("<u4").tobytes()
                name = task.to_bytes(4, "big") + at.to_bytes(8, "big")
                at += 1
                for i, start in enumerate(range(0, len(wide) // 4, capacity)):
                    part = wide[start * 4 : (start + capacity) * 4]
                    rows.append((doc_id, name, i, start, len(part) // 4, zlib.crc32(part), part if keep_ids else None))
            columns = list(zip(*rows)) if rows else [[] for _ in range(7)]
            types = [pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            names = [f.split()[0] for f in PIECE.split(", ")] + ["ids"]
            n = 7 if keep_ids else 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns[:n], types)], names=names[:n])

    wanted = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return wanted.mapInArrow(run, PIECE + (", ids binary" if keep_ids else ""))


def place(pieces: DataFrame, capacity: int, scratch: Scratch) -> DataFrame:
    """Add sequence_id and offset to ``pieces`` (PIECE, more columns may follow)."""
    pieces = scratch.table(pieces, "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[row["length"]] = row["count"]
    table = slots(solve(counts, capacity))
    first = np.cumsum(counts) - counts
    ranked = running_total(pieces.withColumn("_one", F.lit(1)), ["length", "doc_id", "name", "piece"], "_one", "_rank", scratch)
    shared = pieces.sparkSession.sparkContext.broadcast((table, first))  # at most a few ranges for each length

    def run(batches):
        table, first = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            length = np.asarray(batch.column("length")).astype(np.int64)
            rank = np.asarray(batch.column("_rank")) - first[length]
            i = np.searchsorted(table["key"], length << 40 | rank, "right") - 1
            step = rank - table["rank"][i]
            seq = table["base"][i] + step // table["copies"][i]
            offset = table["offset"][i] + step % table["copies"][i] * length
            kept = [c for c in batch.schema.names if not c.startswith("_")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(seq), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(run, schema + ", sequence_id long, offset long")


def sequences(placed: DataFrame) -> DataFrame:
    """The packed id sequences (32-bit little-endian) of pieces that carry ``ids``; a sequence is at most one capacity long."""
    parts = placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.expr("aggregate(parts, X'', (a, p) -> concat(a, p.ids))").alias("ids"))


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, scratch: Scratch) -> DataFrame:
    return place(cut(docs, tokenizer, end_id, capacity), capacity, scratch).drop("name")


def op4_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all ``documents`` into sequences of at most 4096 tokens."""
    from .tokens import default_path

    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    return pack(docs, default_path("word_bpe_49k.json"), 1, 4096, Scratch(spark, "packing"))
