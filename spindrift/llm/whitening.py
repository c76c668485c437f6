"""Whitening of embeddings by the exact integer scatter of their scaled entries.

Each entry c becomes the integer floor(scale * c) + offset. Tasks sum what is
left of these after a shift of their own, and the cross-products, without any
rounding: entries are cut into limbs of 20 bits, whose products over up to
8,192 rows add up below 2**53, so matrix products of doubles are exact, and
the limbs' sums are put together as Python integers. Shifts are taken back in
integers too. Partial sums meet in tasks, FAN at a time, and a few reach the
driver, where n X'X - S S' is formed exactly; only then it becomes doubles (each
entry rounded once) and is decomposed by ``eigh``. How far rows are summed
together doesn't change a single bit.

Defined results: rows whose vector is null or empty or holds null or
non-finite entries are left out, and so are those of another length than most
(the longer of equally frequent ones). Repeated rows count each and are each
returned. Scaled entries beyond 2**61 count as 2**61. A component without
variance has whitened null, explained 0 (as all have if nothing varies), and
doesn't enter the identity error. An empty table gives no rows. Other columns
are not looked at.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
#: Bits of a limb and rows of a product: 2**(2 * BITS) * ROWS is at most 2**53.
BITS, ROWS = 20, 1 << 13
#: Partial sums that one task puts together.
FAN = 32


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, rows) of the usable vectors of a list column, by length."""
    sizes = np.asarray(pc.fill_null(column.value_lengths(), 0)).astype(np.int64)
    flat = np.asarray(column.flatten().cast(pa.float64()).fill_null(np.nan))
    ends = np.cumsum(sizes)
    for size in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == size)
        rows = flat[(ends[at] - size)[:, None] + np.arange(size)]
        good = np.isfinite(rows).all(axis=1)
        if good.any():
            yield at[good], rows[good]


def integers(rows: np.ndarray, scale: int, offset: int) -> np.ndarray:
    return np.clip(np.floor(scale * rows), -(2.0**61), 2.0**61).astype(np.int64) + offset


def products(y: np.ndarray) -> np.ndarray:
    """Y'Y of at most ROWS rows of integers, as Python integers."""
    limbs, rest = [], y
    while True:
        low = rest & ((1 << BITS) - 1)
        high = rest >> BITS
        if ((high == 0) | (high == -1)).all() and (np.abs(rest) < 1 << BITS).all():
            limbs.append(rest.astype(np.float64))
            break
        limbs.append(low.astype(np.float64))
        rest = high
    out = np.zeros((y.shape[1],) * 2, object)
    for i, a in enumerate(limbs):
        for j, b in enumerate(limbs):
            out += (a.T @ b).astype(np.int64).astype(object) << BITS * (i + j)
    return out


@dataclass
class Sums:
    """Number, sums and cross-products of rows of integers, without rounding."""

    n: int
    s: np.ndarray
    xx: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> Sums:
        """The sums of at most ROWS rows, by way of their differences from the middle of each column."""
        shift = (x.min(axis=0) >> 1) + (x.max(axis=0) >> 1)
        y = x - shift
        shift = shift.astype(object)
        # limbs of the sums, too, so that they can't overflow
        low, high = y & ((1 << 32) - 1), y >> 32
        sy = low.sum(axis=0).astype(object) + (high.sum(axis=0).astype(object) << 32)
        cross = np.outer(shift, sy)
        return cls(len(x), sy + len(x) * shift, products(y) + cross + cross.T + len(x) * np.outer(shift, shift))

    def __add__(self, other: Sums) -> Sums:
        return Sums(self.n + other.n, self.s + other.s, self.xx + other.xx)

    def row(self) -> dict:
        upper = self.xx[np.triu_indices(len(self.s))]
        return {"dim": len(self.s), "n": self.n, "sums": ",".join(map(str, [*self.s, *upper]))}

    @classmethod
    def read(cls, row: dict) -> Sums:
        d = row["dim"]
        numbers = np.array([int(x) for x in row["sums"].split(",")], object)
        xx = np.zeros((d, d), object)
        xx[np.triu_indices(d)] = numbers[d:]
        xx.T[np.triu_indices(d)] = numbers[d:]
        return cls(row["n"], numbers[:d], xx)


def _rows(found: list[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    if found:
        yield pa.RecordBatch.from_pylist(found, schema=schema)


def _met(parts: DataFrame, merge) -> DataFrame:
    """A row for each task put together until FAN tasks or fewer are left."""
    n = parts.rdd.getNumPartitions()
    while n > FAN:
        n = -(-n // FAN)
        parts = parts.repartition(n).mapInArrow(merge, parts.schema)
    return parts


_SUMS = pa.schema([("dim", pa.int32()), ("n", pa.int64()), ("sums", pa.string())])


def _merged(batches) -> Iterator[pa.RecordBatch]:
    by_dim: dict[int, Sums] = {}
    for batch in batches:
        for row in batch.to_pylist():
            got = Sums.read(row)
            by_dim[row["dim"]] = by_dim[row["dim"]] + got if row["dim"] in by_dim else got
    yield from _rows([s.row() for s in by_dim.values()], _SUMS)


def scatter(vectors: DataFrame, scale: int = SCALE, offset: int = OFFSET) -> Sums | None:
    """The sums over the usable vectors (embedding) of the most frequent length; None if there are none."""

    def run(batches):
        held: dict[int, list] = {}
        total: dict[int, Sums] = {}

        def flush(size):
            got = Sums.of(np.concatenate(held.pop(size)))
            total[size] = total[size] + got if size in total else got

        for batch in batches:
            for _, rows in matrices(batch.column(0)):
                size = rows.shape[1]
                for a in range(0, len(rows), ROWS):
                    part = rows[a : a + ROWS]
                    if sum(map(len, held.get(size, []))) + len(part) > ROWS:
                        flush(size)
                    held.setdefault(size, []).append(integers(part, scale, offset))
        for size in list(held):
            flush(size)
        yield from _rows([s.row() for s in total.values()], _SUMS)

    parts = vectors.select("embedding").mapInArrow(run, "dim int, n long, sums string")
    by_dim: dict[int, Sums] = {}
    for row in _met(parts, _merged).collect():  # at most FAN rows of each length
        got = Sums.read(row.asDict())
        by_dim[row["dim"]] = by_dim[row["dim"]] + got if row["dim"] in by_dim else got
    return max(by_dim.values(), key=lambda s: (s.n, len(s.s)), default=None)


@dataclass
class Whitener:
    """Turns rows of integers into whitened components."""

    n: int
    s: np.ndarray  # Python integers
    axes: np.ndarray  # a column for each component, of unit length
    values: np.ndarray  # variance of each, falling
    explained: np.ndarray
    scale: int = SCALE
    offset: int = OFFSET

    @classmethod
    def fit(cls, sums: Sums, components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET) -> Whitener:
        exact = sums.n * sums.xx - np.outer(sums.s, sums.s)
        square = sums.n * sums.n
        v = np.array([[x / square for x in row] for row in exact])  # correctly rounded quotients of integers
        values, axes = np.linalg.eigh(v)
        values, axes = values[::-1][:components].copy(), axes[:, ::-1][:, :components]
        axes = axes * np.where(np.take_along_axis(axes, np.abs(axes).argmax(axis=0)[None], 0)[0] < 0, -1.0, 1.0)
        trace = sum(exact.diagonal().tolist()) / square
        values[values <= len(v) * np.finfo(float).eps * max(values.max(initial=0), 0)] = 0
        return cls(sums.n, sums.s, axes, values, values / trace if trace else values, scale, offset)

    def distances(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """n * x - S of each row, as doubles divided by n, and the exact sums of their squares."""
        base = np.array([int(x) // self.n for x in self.s], np.int64)
        y = integers(rows, self.scale, self.offset) - base
        rest = self.s - self.n * base.astype(object)  # from 0 to n - 1
        d = len(base)
        if int(np.abs(y).max(initial=0)) * self.n + self.n < 1 << 60:
            z = self.n * y - rest.astype(np.int64)
            half = 28
            if int(np.abs(z).max(initial=0)) < 1 << 2 * half and d <= 64:
                high, low = z >> half, z & ((1 << half) - 1)
                a, b, c = (high * high).sum(axis=1), (high * low).sum(axis=1), (low * low).sum(axis=1)
                squares = [(i << 2 * half) + (j << half + 1) + k for i, j, k in zip(a.tolist(), b.tolist(), c.tolist())]
                return z / self.n, np.array(squares, object)
            z = z.astype(object)
        else:
            z = self.n * y.astype(object) - rest
        return (z / self.n).astype(np.float64), (z * z).sum(axis=1)

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        """The components of centred rows; NaN for those without variance."""
        root = np.sqrt(np.where(self.values > 0, self.values, np.nan))
        return centred @ (self.axes / root)


_MOMENTS = pa.schema([("n", pa.int64()), ("s", pa.list_(pa.float64())), ("ww", pa.list_(pa.float64()))])


def _added(batches) -> Iterator[pa.RecordBatch]:
    rows = [r for batch in batches for r in batch.to_pylist()]
    if rows:
        total = {"n": sum(r["n"] for r in rows), "s": np.sum([r["s"] for r in rows], axis=0).tolist(), "ww": np.sum([r["ww"] for r in rows], axis=0).tolist()}
        yield from _rows([total], _MOMENTS)


def identity_error(vectors: DataFrame, model: Whitener) -> float:
    """The largest entry of the covariance of all whitened vectors less the identity, in a pass of its own."""
    shared = vectors.sparkSession.sparkContext.broadcast(model)  # components * dimensions numbers
    k = model.axes.shape[1]

    def run(batches):
        model = shared.value
        n, s, ww = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            for _, rows in matrices(batch.column(0)):
                if rows.shape[1] == len(model.s):
                    w = np.nan_to_num(model.whitened(model.distances(rows)[0]))
                    n, s, ww = n + len(w), s + w.sum(axis=0), ww + w.T @ w
        if n:
            yield from _rows([{"n": n, "s": s.tolist(), "ww": ww.ravel().tolist()}], _MOMENTS)

    parts = vectors.select("embedding").mapInArrow(run, "n long, s array<double>, ww array<double>")
    rows = _met(parts, _added).collect()
    n = sum(r["n"] for r in rows)
    mean = np.sum([r["s"] for r in rows], axis=0) / n
    covariance = np.sum([r["ww"] for r in rows], axis=0).reshape(k, k) / n - np.outer(mean, mean)
    varies = model.values > 0
    return float(np.abs(covariance - np.eye(k))[np.ix_(varies, varies)].max(initial=0.0))


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """vec_id, n, deviation, whitened, explained, identity_error of the usable ``vectors`` (vec_id, embedding).

    ``whitened`` and ``explained`` have an entry for each component, by falling
    variance. ``deviation`` is the exact sum over dimensions of (n x - S)**2, as
    decimal(38, 0); it is null where it needs more digits.
    """
    small_batches(vectors.sparkSession)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    fields = f"vec_id {kind}, n long, deviation string, whitened array<double>, explained array<double>, identity_error double"
    sums = scatter(vectors, scale, offset)
    if sums is None:
        return vectors.sparkSession.createDataFrame([], fields.replace("deviation string", "deviation decimal(38,0)"))
    model = Whitener.fit(sums, components, scale, offset)
    error = identity_error(vectors, model)
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        explained = pa.array([model.explained.tolist()], pa.list_(pa.float64()))
        for batch in batches:
            for at, rows in matrices(batch.column(1)):
                if rows.shape[1] != len(model.s):
                    continue
                centred, squares = model.distances(rows)
                w = model.whitened(centred)
                m, k = w.shape
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (m + 1) * k, k), pa.int32()), pa.array(w.ravel(), mask=np.isnan(w.ravel())))
                columns = [batch.column(0).take(pa.array(at)), pa.array(np.full(m, model.n)), pa.array([str(x) for x in squares.tolist()]), lists, pa.concat_arrays([explained] * m), pa.array(np.full(m, error))]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "n", "deviation", "whitened", "explained", "identity_error"])

    rows = vectors.select("vec_id", "embedding").mapInArrow(run, fields)
    return rows.withColumn("deviation", F.expr("try_cast(deviation as decimal(38,0))"))


def op12_exact_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each usable vector of ``embeddings`` and component; a deviation beyond a long is an error, never a wrong number."""
    rows = whiten(spark.read.parquet(os.path.join(sf_dir, "embeddings.parquet")))
    each = rows.select("vec_id", "n", F.col("deviation").cast("long").alias("deviation"), F.posexplode(F.arrays_zip("whitened", "explained")).alias("k", "c"), "identity_error")
    return each.select("vec_id", (F.col("k") + 1).alias("component"), "n", "deviation", "c.whitened", "c.explained", "identity_error")
