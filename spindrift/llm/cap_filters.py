"""Near-duplicate embeddings by spherical-cap filters.

Filter directions are the products of a random code: a vector is rotated and
split into three parts, each part has ``k`` random unit codewords, and the
``k**3`` combinations are the directions. List decoding finds all directions
whose inner product with a vector exceeds a height, without trying them all:
codewords are taken part by part, best first, and only while the best of the
parts still to come can reach the height. A vector that exceeds fewer than it
should gets its nearest directions instead. The number of directions grows
with the number of vectors, so that buckets keep their size, and the height is
such that a pair at the threshold shares ``SHARED`` directions on average.

Vectors meet in the buckets of their directions and are compared there in
double precision; a pair counts only in the first bucket that it shares, so a
row carries the directions before its bucket's. Buckets come in ``ROUNDS``
passes, which bounds the shuffle files that exist at one time. Equal vectors
of a label are one class and are compared once. A bucket of more than
``CROWD`` classes is dealt into blocks that meet two by two, so no task gets
an unbounded group. Tasks return counts and spanning forests, never pairs.
All classes of a bucket are compared, so vectors of one label that all lie in
a narrow cone share their buckets and cost the square of their number.

Defined results: vectors that are null, empty, zero or hold null or
non-finite components link with nothing, as do rows without a label and
vectors of different lengths; equal rows are vectors of their own; a null
vec_id counts as a link but never names a component; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import os
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import Scratch, components, forest, partitions

#: Directions that a pair at the threshold shares on average.
SHARED = 4.5
#: Vectors for each direction.
PER_FILTER = 100
CROWD = 512
BLOCK = 256
ROUNDS = 4
SEED = 20260102


@lru_cache(maxsize=8)
def code(dim: int, k: int) -> tuple[np.ndarray, list[np.ndarray], list[slice]]:
    """Rotation, codewords of each part, and the parts, for vectors of ``dim`` components."""
    rng = np.random.Generator(np.random.PCG64([SEED, dim, k]))
    rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    cuts = np.linspace(0, dim, 4).astype(int)
    parts = [slice(a, b) for a, b in zip(cuts[:-1], cuts[1:])]
    words = []
    for p in parts:
        c = rng.standard_normal((k, max(1, p.stop - p.start)))
        words.append((c / np.linalg.norm(c, axis=1, keepdims=True))[:, : p.stop - p.start])
    return rotation, words, parts


@lru_cache(maxsize=8)
def directions(k: int, threshold: float) -> int:
    """How many of the ``k**3`` directions a vector should exceed, so that a pair at the threshold shares SHARED of them."""
    normal, rest = NormalDist(), math.sqrt(1 - threshold**2)
    for listed in range(4, k**3):
        height = normal.inv_cdf(1 - listed / k**3)
        x = np.linspace(height, height + 6, 200)
        density = np.exp(-x * x / 2)
        both = np.array([1 - normal.cdf((height - threshold * y) / rest) for y in x])
        if listed * float((density * both).sum() / density.sum()) >= SHARED:
            return listed
    return k**3


def _ragged(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place within it) for ``counts`` entries of each row."""
    rows = np.repeat(np.arange(len(counts)), counts)
    return rows, np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)


def _exceeding(parts: list[np.ndarray], height: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, filter, product) of the directions above ``height``; ``parts`` has the products with each part's codewords."""
    k = parts[0].shape[1]
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for a in range(0, len(parts[0]), 256):
        some = [p[a : a + 256] for p in parts]
        order = [np.argsort(-p, axis=1, kind="stable") for p in some]
        best = [np.take_along_axis(p, o, axis=1) for p, o in zip(some, order)]
        row, place, product = np.arange(len(some[0])), np.zeros(len(some[0]), np.int64), np.zeros(len(some[0]))
        for at in range(3):
            later = sum((b[:, 0] for b in best[at + 1 :]), np.zeros(len(some[0])))
            counts = (best[at][row] + (product + later[row])[:, None] >= height).sum(axis=1)  # sorted, so these stand in front
            parent, i = _ragged(counts)
            row, place = row[parent], place[parent] * k + order[at][row[parent], i]
            product = product[parent] + best[at][row, i]
        found.append((row + a, place, product))
    return tuple(np.concatenate(c) for c in zip(*found))


def decode(unit: np.ndarray, k: int, listed: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) of every direction that a unit vector exceeds, sorted; the height gives ``listed`` on average.

    A vector far from all directions has its height lowered until it exceeds
    ``listed`` of them, so that its neighbours, which are as far, still meet it.
    """
    rotation, words, parts = code(unit.shape[1], k)
    listed = min(listed, k**3)
    spread = math.sqrt(3 / unit.shape[1])
    height = NormalDist().inv_cdf(1 - min(0.5, listed / k**3)) * spread
    turned = unit @ rotation
    products = [turned[:, p] @ w.T for p, w in zip(parts, words)]
    left, rows, filters = np.arange(len(unit)), [], []
    lowered = False
    while len(left):
        r, f, v = _exceeding([p[left] for p in products], height)
        counts = np.bincount(r, minlength=len(left))
        keep = counts[r] >= listed
        if lowered:  # of these only the best
            order = np.lexsort((f, -v, r))
            rank = np.arange(len(r)) - np.repeat(np.cumsum(counts) - counts, counts)
            r, f, keep = r[order], f[order], keep[order] & (rank < listed)
        rows.append(left[r[keep]])
        filters.append(f[keep])
        left, lowered = left[counts < listed], True
        height -= 0.25 * spread
    r, f = np.concatenate([np.zeros(0, np.int64), *rows]), np.concatenate([np.zeros(0, np.int64), *filters])
    order = np.lexsort((f, r))
    return r[order], f[order]


def _prepare(float_type: str, with_vectors: bool):
    """vec_id, label, name (digest of a usable vector with its label, else null), and the vector's bytes if asked for."""

    def run(batches):
        for batch in batches:
            labels = batch.column("label").to_pylist()
            lists = batch.column("embedding")
            flat = np.asarray(lists.flatten().cast(pa.float64()).fill_null(float("nan"))) + 0.0 if len(lists) else np.zeros(0)
            sizes = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(lists), 0)).astype(int)
            ends = np.cumsum(sizes)
            bad = np.cumsum(np.concatenate([[0], ~np.isfinite(flat)]))
            some = np.cumsum(np.concatenate([[0], flat != 0]))
            usable = (bad[ends] == bad[ends - sizes]) & (some[ends] > some[ends - sizes])
            data = flat.astype(float_type).tobytes()
            width = np.dtype(float_type).itemsize
            names, vectors = [], []
            for label, ok, a, b in zip(labels, usable.tolist(), (ends - sizes).tolist(), ends.tolist()):
                v = data[a * width : b * width] if ok and label is not None else None
                vectors.append(v)
                names.append(None if v is None else hashlib.blake2b(f"{label} {b - a} ".encode() + v, digest_size=16).digest())
            columns = [batch.column("vec_id"), batch.column("label"), pa.array(names, pa.binary())] + ([pa.array(vectors, pa.binary())] if with_vectors else [])
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "name", "vec"][: len(columns)])

    return run


def _units(vectors: list[bytes], float_type: str) -> np.ndarray:
    """Vectors of one length, scaled to length one."""
    v = np.frombuffer(b"".join(vectors), float_type).reshape(len(vectors), -1).astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _listed(k: int, listed: int, float_type: str):
    """The classes and ``own``, the directions that each exceeds."""

    def run(batches):
        for batch in batches:
            vectors = batch.column("vec").to_pylist()
            own: list = [None] * len(vectors)
            by_size: dict[int, list[int]] = {}
            for i, v in enumerate(vectors):
                by_size.setdefault(len(v), []).append(i)
            for at in by_size.values():
                for a in range(0, len(at), 1000):
                    some = at[a : a + 1000]
                    rows, filters = decode(_units([vectors[i] for i in some], float_type), k, listed)
                    ends = np.searchsorted(rows, np.arange(len(some) + 1))
                    for i, x, y in zip(some, ends[:-1], ends[1:]):
                        own[i] = filters[x:y]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.list_(pa.int64()))], names=[*batch.schema.names, "own"])

    return run


def _presence(lists: pa.ListArray) -> np.ndarray:
    """A row for each list and a column for each value that several lists hold."""
    values, column, count = np.unique(np.asarray(lists.flatten()), return_inverse=True, return_counts=True)
    column = np.where(count > 1, np.cumsum(count > 1) - 1, -1)[column]
    out = np.zeros((len(lists), int((count > 1).sum())), np.float32)
    rows, _ = _ragged(np.asarray(lists.value_lengths()))
    out[rows[column >= 0], column[column >= 0]] = 1
    return out


def _compare(threshold: float, float_type: str):
    """a, b, links of the classes of one bucket, or of two of its blocks: the number of vectors newly linked with ``a``, and the smallest class that it reaches."""

    def group(t):
        cid, n, block = (np.asarray(t.column(c).combine_chunks()) for c in ("cid", "n", "block"))
        unit = _units(t.column("vec").to_pylist(), float_type)
        before = None
        left, right = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
        one = t.column("bi")[0].as_py() == t.column("bj")[0].as_py()
        if not one and block.min() == block.max():
            return None
        links, ends = np.zeros(len(cid)), []
        for a in range(0, len(left), 512):
            some = left[a : a + 512]
            products = unit[some] @ unit[right].T
            i, j = np.nonzero(products >= threshold - 1e-9)
            close = np.abs(products[i, j] - threshold) < 1e-9
            i, j = some[i], right[j]
            keep = i < j if one else np.ones(len(i), bool)
            at = np.flatnonzero(close & keep)
            keep[at] = np.einsum("ij,ij->i", unit[i[at]], unit[j[at]]) >= threshold
            i, j = i[keep], j[keep]
            if len(i):  # pairs that meet in an earlier bucket count there
                before = _presence(t.column("before").combine_chunks()) if before is None else before
                keep = (before[some] @ before.T)[np.searchsorted(some, i), j] == 0
                i, j = i[keep], j[keep]
            links += np.bincount(i, n[j], len(cid)) + np.bincount(j, n[i], len(cid))
            root = forest(len(cid), i, j)
            hit = np.flatnonzero(root != np.arange(len(cid)))
            ends.append((hit, root[hit]))
        hit = links > 0
        root = forest(len(cid), *(np.concatenate(x) for x in zip(*ends)))
        return cid[hit], cid[root[hit]], links[hit].astype(np.int64)

    return _by_run(["label", "dim", "f", "bi", "bj"], group)


def _by_run(names: list[str], group):
    """Apply ``group`` to each run of rows that are equal in ``names``; rows arrive sorted by them."""

    def done(table, last):
        cols = [np.asarray(table.column(c).combine_chunks()) for c in names]
        change = np.zeros(max(0, table.num_rows - 1), bool)
        for c in cols:
            change |= c[1:] != c[:-1]
        edges = [0, *(np.flatnonzero(change) + 1).tolist(), table.num_rows]
        edges = edges if last else edges[:-1]
        found = [group(table.slice(a, b - a)) for a, b in zip(edges, edges[1:]) if b - a > 1]
        out = [np.concatenate(c) for c in zip(*[x for x in found if x is not None])] or [np.zeros(0, np.int64)] * 3
        return pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=["a", "b", "links"]), table.slice(edges[-1])

    def run(batches):
        carry = None
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                table = pa.Table.from_batches([batch.slice(a, 2000)])
                table = pa.concat_tables([carry, table]) if carry is not None else table
                out, carry = done(table, False)
                if out.num_rows:
                    yield out
        if carry is not None and carry.num_rows:
            yield done(carry, True)[0]

    return run


def near_duplicates(vectors: DataFrame, scratch: Scratch, threshold: float = 0.93, k: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors`` (vec_id, label, embedding)."""
    spark = vectors.sparkSession
    element = vectors.schema["embedding"].dataType.elementType.simpleString()
    float_type = "<f4" if element == "float" else "<f8"
    label = "long" if isinstance(vectors.schema["label"].dataType, IntegralType) else "string"
    wanted = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast(label).alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    named = wanted.mapInArrow(_prepare(float_type, True), f"vec_id long, label {label}, name binary, vec binary").filter("name is not null")
    classes = named.groupBy("name").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.any_value("label").alias("label"), F.any_value("vec").alias("vec"))
    # written before it is used, so that a class keeps its number
    classes = scratch.table(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    k = k or max(3, math.ceil((classes.count() / PER_FILTER) ** (1 / 3)))
    shape = f"label {label}, cid long, n long, vec binary"
    listed = classes.select("label", "cid", "n", "vec").mapInArrow(_listed(k, directions(k, threshold), float_type), shape + ", own array<long>")
    listed = scratch.table(listed.withColumn("dim", F.octet_length("vec")), "listed")

    key = ["label", "dim", "f"]
    sizes = listed.select("label", "dim", F.explode("own").alias("f")).groupBy(*key).agg(F.count("*").alias("size"))
    crowds = scratch.table(sizes.filter(F.col("size") > CROWD).withColumn("blocks", F.ceil(F.col("size") / BLOCK)), "crowds")
    crowded = not crowds.isEmpty()
    links = "a long, b long, links long"
    payload = ["cid", "n", "vec", "before"]

    def compared(rows: DataFrame) -> DataFrame:
        place = [*key, "bi", "bj"]
        return rows.repartition(partitions(spark), *place).sortWithinPartitions(*place).mapInArrow(_compare(threshold, float_type), links)

    found = None
    for r in range(ROUNDS):
        spread = listed.select("label", "dim", "cid", "n", "vec", "own", F.posexplode("own").alias("pos", "f")).filter(F.col("f") % ROUNDS == r)
        spread = spread.select(*key, "cid", "n", "vec", F.expr("slice(own, 1, pos)").alias("before"))
        none = F.lit(0).cast("long")
        small = spread.join(crowds, key, "left_anti") if crowded else spread
        part = compared(small.select(*key, none.alias("bi"), none.alias("bj"), none.alias("block"), *payload))
        if crowded:
            dealt = spread.join(crowds, key).withColumn("block", F.expr("pmod(xxhash64(cid), blocks)")).withColumn("o", F.explode(F.expr("sequence(0L, blocks - 1)")))
            part = part.unionByName(compared(dealt.select(*key, F.least("block", "o").alias("bi"), F.greatest("block", "o").alias("bj"), "block", *payload)))
        part = scratch.table(part, "links")
        found = part if found is None else found.unionByName(part)
    counts = found.groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("links"))
    parts = components(found.filter("a <> b").select("a", "b"), scratch)
    joined = classes.select("name", "cid", "rep", "n").join(counts, "cid", "left").join(parts.withColumnRenamed("node", "cid"), "cid", "left")
    joined = scratch.table(joined.withColumn("c", F.coalesce("component", "cid")).drop("component"), "joined")
    # a class without links is a component of its own and needs no lookup
    ids = joined.filter("links is not null").groupBy("c").agg(F.min("rep").alias("component_id"))
    of_class = joined.join(ids, "c", "left").select("name", F.coalesce("component_id", "rep").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    out = wanted.mapInArrow(_prepare(float_type, False), f"vec_id long, label {label}, name binary").select("vec_id", "name").join(of_class, "name", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op7_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all ``embeddings`` within their labels."""
    return near_duplicates(spark.read.parquet(os.path.join(sf_dir, "embeddings.parquet")), Scratch(spark, "caps"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), ok AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
  SELECT vec_id AS node, vec_id AS other FROM v
  UNION
  SELECT reach.node, pairs.b FROM reach JOIN pairs ON reach.other = pairs.a
), c AS (
  SELECT node, min(other) AS component_id FROM reach GROUP BY node
), n AS (
  SELECT a, count(*) AS n FROM pairs GROUP BY a
)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c ON v.vec_id = c.node LEFT JOIN n ON v.vec_id = n.a
"""
