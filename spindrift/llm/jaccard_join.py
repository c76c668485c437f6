"""Near-duplicate documents by a grouped prefix join on word shingles.

Two documents link when 100 * |A & B| >= percent * |A | B| over their sets of
distinct shingles. The join is exact up to collisions of shingle hashes (64 bits); sets and
prefixes are told apart by 128 bits:

1. Documents with equal sets are one class; only classes are joined.
2. Shingles are ordered by hash, but very common ones come last, so passages
   that many documents share rarely reach a prefix. Any fixed order finds all
   links; the list of common shingles only saves work, and its length is
   bounded by counts over all documents.
3. Two linked sets share a shingle among their first n - ceil(percent * n /
   100) + 1. Classes with the same prefix and size form one group; groups that
   share a prefix shingle are candidates if their sizes allow a link and the
   shingles they share in their prefixes leave room for the overlap.
4. Groups at a shingle that more than SMALL groups share aren't paired. Those
   whose sizes come close form a cluster. Its members meet block by block
   where their sizes allow a link; products of presence matrices compare two
   blocks, and only a spanning forest of their links leaves the task. This is
   quadratic in the members of a cluster that have about the same size, so the
   order of shingles has to keep clusters to near copies: it does as long as
   the list of common shingles holds all that more than SMALL texts share.
5. Members of other candidate groups are verified pair by pair, on whole sets.
6. Components of the verified links give each document its class id.

Defined results: null, empty and blank texts have no shingles and link with
nothing; equal rows are judged one by one and give equal rows; a null doc_id
gets a null component_id and links nothing; extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, components, forest, join_spread, partitions
from .shingles import shingle_sets, strings

#: The list of common shingles holds at most so many (8 bytes each).
COMMON_MOST = 1 << 21
#: Up to so many groups at a shingle are paired with each other at once.
SMALL = 48
#: Hashes or pairs that a task holds before it counts them and passes them on.
FLUSH = 1 << 18
#: Members of a cluster that a task compares with each other at once.
BLOCK = 256


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _fronts(batches, percent: int):
    """Batches (h, n): how many texts of a block have the shingle h near the front of the hash order; ``batches`` have the texts first."""
    held, size = [], 0

    def counted():
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([_signed(values), pa.array(counts.astype(np.int64))], names=["h", "n"])

    for batch in batches:
        for one in shingle_sets(strings(batch.column(0))):
            n = len(one)
            front = one[: n - _least_overlap(n, percent) + n // 10 + 4].copy()  # a view would keep the whole set
            held.append(front)
            size += len(front)
            if size > FLUSH:
                yield counted()
                held, size = [], 0
    if held:
        yield counted()


def _common(docs: DataFrame, percent: int, scratch: Scratch) -> np.ndarray:
    """Shingles that many documents have near the front of the hash order, sorted; counts cover all documents.

    Only that front can reach a prefix, so only it is counted: within blocks
    of texts first, then over all.
    """
    rows = docs.select(F.col("text").cast("string")).mapInArrow(lambda batches: _fronts(batches, percent), "h long, n long")
    sums = rows.groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") > SMALL)
    sums = scratch.table(sums, "common")
    total = sums.agg(F.sum("n")).first()[0] or 0
    least = -(-total // COMMON_MOST)
    found = sums.filter(F.col("n") >= least).select("h").toArrow().column(0)  # at most COMMON_MOST rows
    return np.sort(np.asarray(found.combine_chunks()).view(np.uint64)) if len(found) else np.zeros(0, np.uint64)


def _least_overlap(n: np.ndarray | int, percent: int):
    return -(-percent * n // 100)


def _ordered(values: np.ndarray, common: np.ndarray) -> np.ndarray:
    if not len(common) or not len(values):
        return values
    at = np.minimum(np.searchsorted(common, values), len(common) - 1)
    hit = common[at] == values
    return np.concatenate([values[~hit], values[hit]])


def _key(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


SETS = "doc_id long, key binary, n long, prefix binary, prefix_key binary"


def sets(docs: DataFrame, percent: int, common) -> DataFrame:
    """doc_id, class key and size of each document's set, and its prefix in the global order."""

    def run(batches):
        order = common.value
        for batch in batches:
            keys, sizes, prefixes, names = [], [], [], []
            for values in shingle_sets(strings(batch.column(1))):
                n = len(values)
                prefix = _ordered(values, order)[: n - _least_overlap(n, percent) + 1 if n else 0]
                keys.append(_key(values) if n else None)
                sizes.append(n)
                prefixes.append(prefix.tobytes() if n else None)
                names.append(_key(np.append(prefix, np.uint64(n))) if n else None)
            columns = [batch.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(prefixes, pa.binary()), pa.array(names, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "key", "n", "prefix", "prefix_key"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SETS)


def _tokens(groups: DataFrame) -> DataFrame:
    """One row for each prefix shingle of each group: token, g, n."""

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                part = batch.slice(a, 2000)
                prefixes = [np.frombuffer(p.as_py(), np.uint64) for p in part.column("prefix")]
                lengths = np.array([len(p) for p in prefixes], np.int64)
                tokens = np.concatenate(prefixes)
                g, n = (np.repeat(np.asarray(part.column(c)), lengths) for c in ("g", "n"))
                yield pa.RecordBatch.from_arrays([_signed(tokens), pa.array(g), pa.array(n)], names=["token", "g", "n"])

    return groups.select("g", "n", "prefix").mapInArrow(run, "token long, g long, n long")


def _candidates(tokens: DataFrame, percent: int) -> DataFrame:
    """Pairs of groups that share shingles with few groups, and links between groups that share one with many.

    Rows (a, b, na, nb, c): for c > 0 the groups share c such shingles, a < b;
    for c = 0, b is a group at a shingle with more than SMALL groups and a the
    first of those that lead to its size without a gap that no link can cross.
    Rows arrive sorted by token and size; a task holds runs of up to SMALL
    rows, and of a longer run only the first row and the last size.
    """

    def run(batches):
        pairs, links = [], []
        held = 0
        carry = first = None

        def flush():
            nonlocal pairs, links, held
            rows = np.concatenate(pairs) if pairs else np.zeros((0, 4), np.int64)
            rows, count = np.unique(rows, axis=0, return_counts=True) if len(rows) else (rows, np.zeros(0, np.int64))
            far = np.unique(np.concatenate(links), axis=0) if links else np.zeros((0, 2), np.int64)
            columns = [np.concatenate([rows[:, i], far[:, i]]) for i in (0, 1)]
            columns += [np.concatenate([rows[:, i], np.zeros(len(far), np.int64)]) for i in (2, 3)]
            columns.append(np.concatenate([count.astype(np.int64), np.zeros(len(far), np.int64)]))
            pairs, links, held = [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["a", "b", "na", "nb", "c"])

        def meet(g, n, i, j):
            nonlocal held
            fits = 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
            i, j = i[fits], j[fits]
            swap = g[i] > g[j]
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            pairs.append(np.stack([g[i], g[j], n[i], n[j]], axis=1))
            held += len(i)

        def chain(start, last, others, sizes):
            """Link a run's rows to the first of their sizes; returns the first of the last ones, and the last size."""
            nonlocal held
            before = np.concatenate([[last], sizes[:-1]])
            place = np.maximum.accumulate(np.where(100 * before < percent * sizes, np.arange(1, len(others) + 1), 0))
            begin = np.concatenate([[start], others])[place]
            links.append(np.stack([begin, others], axis=1)[begin != others])
            held += len(others)
            return (begin[-1], sizes[-1]) if len(others) else (start, last)

        def runs(token, g, n, last):
            """Handle all whole runs; returns where the last, unfinished run begins."""
            edges = np.concatenate([[0], np.flatnonzero(np.diff(token)) + 1, [len(token)]])
            sizes = np.diff(edges)
            end = len(sizes) if last else len(sizes) - 1
            for size in np.unique(sizes[:end]).tolist():
                at = edges[:-1][:end][sizes[:end] == size]
                if 1 < size <= SMALL:
                    i, j = np.triu_indices(size, 1)
                    step = max(1, FLUSH // len(i))
                    for k in range(0, len(at), step):
                        some = at[k : k + step, None]
                        meet(g, n, (some + i).ravel(), (some + j).ravel())
                elif size > SMALL:
                    for s in at.tolist():
                        chain(g[s], n[s], g[s + 1 : s + size], n[s + 1 : s + size])
            return edges[end]

        for batch in batches:
            part = [np.asarray(batch.column(c)) for c in ("token", "g", "n")]
            if carry is not None:
                part = [np.concatenate([x, y]) for x, y in zip(carry, part)]
                carry = None
            if first is not None and len(part[0]):  # more rows of a long run whose first row is known
                same = int((part[0] == first[0]).sum())  # tokens are sorted, so these stand in front
                first = (first[0], *chain(*first[1:], part[1][:same], part[2][:same]))
                part = [x[same:] for x in part]
                first = first if not len(part[0]) else None
            if len(part[0]):
                at = runs(*part, False)
                rest = [x[at:] for x in part]
                if len(rest[0]) > SMALL:
                    first = (rest[0][0], *chain(rest[1][0], rest[2][0], rest[1][1:], rest[2][1:]))
                else:
                    carry = rest
            if held > FLUSH:
                yield flush()
        if carry is not None and len(carry[0]):
            runs(*carry, True)
        yield flush()

    ordered = tokens.repartition(partitions(tokens.sparkSession), "token").sortWithinPartitions("token", "n")
    return ordered.mapInArrow(run, "a long, b long, na long, nb long, c long")


def _links(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the linked pairs of two lists of sets, by products of presence matrices over shared shingles."""
    every = left + right
    values = np.concatenate(every)
    owner = np.repeat(np.arange(len(every)), [len(x) for x in every])
    shingles, at, count = np.unique(values, return_inverse=True, return_counts=True)
    column = np.where(count > 1, np.cumsum(count > 1) - 1, -1)[at]
    keep = column >= 0
    owner, column = owner[keep], column[keep]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((len(left), len(right)))
    wide = int(column[-1]) + 1 if len(column) else 0
    for a in range(0, wide, 4096):
        lo, hi = np.searchsorted(column, [a, a + 4096])
        matrix = np.zeros((len(every), min(4096, wide - a)), np.float32)
        matrix[owner[lo:hi], column[lo:hi] - a] = 1
        both += matrix[: len(left)] @ matrix[len(left) :].T
    sizes = np.add.outer([len(x) for x in left], [len(x) for x in right])
    return np.nonzero(100 * both >= percent * (sizes - both))


def _compare_blocks(members: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """A spanning forest (a, b) of the links within each cluster; ``members``: cluster, key, n; ``texts``: cid, text.

    Sizes are dealt into levels, so that linked sets are of one level or of
    neighbouring ones. A level of a cluster is dealt into blocks of about
    BLOCK members; blocks of such levels meet two by two, so a task holds two
    blocks at a time, however large the cluster is.
    """
    level = F.floor(F.log("n") / float(np.log(100 / percent))).cast("long")
    members = members.withColumn("level", level)
    sizes = members.groupBy("cluster", "level").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / BLOCK))
    near = lambda step, name: sizes.select("cluster", (F.col("level") + step).alias("level"), F.col("blocks").alias(name))
    around = sizes.join(near(1, "below"), ["cluster", "level"], "left").join(near(-1, "above"), ["cluster", "level"], "left")
    number = lambda step, n: F.expr(f"if({n} is null, array(), transform(sequence(0L, {n} - 1), x -> struct(level + {step} as level, x as block)))")
    dealt = join_spread(members.drop("n"), around, ["cluster", "level"], members.count()).withColumn("own", F.struct("level", F.expr("pmod(xxhash64(key), blocks)").alias("block")))
    dealt = dealt.withColumn("o", F.explode(F.concat(number(-1, "below"), number(0, "blocks"), number(1, "above"))))
    place = lambda c: F.col(c)["level"] * (1 << 40) + F.col(c)["block"]
    dealt = dealt.select("cluster", F.least(place("own"), place("o")).alias("bi"), F.greatest(place("own"), place("o")).alias("bj"), place("own").alias("block"), "key")
    dealt = dealt.join(texts.withColumnRenamed("cid", "key"), "key")
    names = ["cluster", "bi", "bj"]

    def group(table):
        keys, block = (np.asarray(table.column(c).combine_chunks()) for c in ("key", "block"))
        sets = list(shingle_sets(strings(table.column("text"))))
        bi, bj = table.column("bi")[0].as_py(), table.column("bj")[0].as_py()
        left, right = np.flatnonzero(block == bi), np.flatnonzero(block == bj)
        i, j = _links([sets[x] for x in left], [sets[x] for x in right], percent)
        i, j = left[i], right[j]
        root = forest(len(keys), i, j)
        hit = root != np.arange(len(keys))
        return keys[hit], keys[root[hit]]

    def run(batches):
        carry = None

        def done(table, last):
            cols = [np.asarray(table.column(c).combine_chunks()) for c in names]
            change = np.zeros(max(0, table.num_rows - 1), bool)
            for c in cols:
                change |= c[1:] != c[:-1]
            edges = [0, *(np.flatnonzero(change) + 1).tolist(), table.num_rows]
            if not last:
                edges = edges[:-1]
            found = [group(table.slice(x, y - x)) for x, y in zip(edges, edges[1:]) if y - x > 1]
            out = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * 2
            return pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=["a", "b"]), table.slice(edges[-1])

        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                table = pa.Table.from_batches([batch.slice(a, 1000)])
                table = pa.concat_tables([carry, table]) if carry is not None else table
                out, carry = done(table, False)
                yield out
        if carry is not None and carry.num_rows:
            yield done(carry, True)[0]

    ordered = dealt.repartition(partitions(members.sparkSession), *names).sortWithinPartitions(*names)
    return ordered.mapInArrow(run, "a long, b long")


def _verify(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs of classes (a, b) that link; ``texts`` has cid and text of every class in them."""

    def run(batches):
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            known: dict = {}
            ok = []
            for i in range(0, len(a), 500):
                known = {}
                for side, column in (("a", a), ("b", b)):
                    texts = {}
                    for k, t in zip(column[i : i + 500], batch.column(f"text_{side}").slice(i, 500)):
                        if k not in known and k not in texts:
                            texts[k] = t.as_py()
                    known |= dict(zip(texts, shingle_sets(list(texts.values()))))
                for x, y in zip(a[i : i + 500], b[i : i + 500]):
                    u, v = known[x], known[y]
                    both = len(np.intersect1d(u, v, assume_unique=True))
                    ok.append(100 * both >= percent * (len(u) + len(v) - both))
            mask = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(mask)

    left = texts.select(F.col("cid").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("cid").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(run, "a long, b long")


def _texts(docs: DataFrame, wanted: DataFrame, scratch: Scratch) -> DataFrame:
    """cid, text of the classes in ``wanted`` (cid, key, rep: their smallest doc_id).

    A bit for each hash of a wanted id goes to the scan (2 MB at most), so
    only texts that may be needed are shuffled; keys are computed again, which
    settles ids that occur with several texts.
    """
    bits = 24
    words = wanted.select((F.xxhash64("rep").bitwiseAND(F.lit((1 << bits) - 1))).alias("h"))
    words = words.groupBy((F.col("h") / 32).cast("int").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(h % 32 as int)))").alias("v"))
    table = np.zeros(1 << (bits - 5), np.int64)
    for part in words.toArrow().to_batches():  # at most 2**19 rows
        table[np.asarray(part.column("w"))] = np.asarray(part.column("v"))
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def maybe(batches):
        table = shared.value
        for batch in batches:
            h = np.asarray(batch.column("h"))
            yield batch.filter(pa.array((table[h >> 5] >> (h & 31)) & 1 == 1)).select(["rep", "text"])

    def keyed(batches):
        for batch in batches:
            keys = [_key(v) if len(v) else None for v in shingle_sets(strings(batch.column("text")))]
            same = pa.array([k == w for k, w in zip(keys, batch.column("key").to_pylist())], pa.bool_())
            yield batch.select(["cid", "text"]).filter(same)

    hashed = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text")).filter("rep is not null")
    hashed = hashed.withColumn("h", F.xxhash64("rep").bitwiseAND(F.lit((1 << bits) - 1))).mapInArrow(maybe, "rep long, text string")
    found = wanted.join(hashed, "rep").select("cid", "key", "text").mapInArrow(keyed, "cid long, text string")
    return scratch.table(found.dropDuplicates(["cid"]), "texts")


def near_duplicates(docs: DataFrame, scratch: Scratch, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    common = spark.sparkContext.broadcast(_common(docs, percent, scratch))  # at most COMMON_MOST hashes
    every = scratch.table(sets(docs, percent, common), "sets")
    known = every.filter("n > 0 and doc_id is not null")
    # g is short for a group's prefix key: two groups of one g are both joined, which only adds pairs to verify
    g = F.xxhash64("prefix_key").alias("g")
    classes = known.select("doc_id", "key", "n", g).groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("g").alias("g"))
    # written before it is used, so that a class keeps its number
    classes = scratch.table(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    groups = known.groupBy("prefix_key").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix")).select(g, "n", "prefix")
    found = scratch.table(_candidates(_tokens(groups), percent), "candidates")

    # Clusters: classes of one group, and of groups that share a shingle with many others.
    members = classes.select("g", "cid", "n")
    first = members.groupBy("g").agg(F.min("cid").alias("first"), F.count("*").alias("size"))
    of = lambda g, k: first.select(F.col("g").alias(g), F.col("first").alias(k))
    chains = found.filter("c = 0").select(F.col("a").alias("ga"), F.col("b").alias("gb")).distinct()
    chains = chains.join(of("ga", "a"), "ga").join(of("gb", "b"), "gb").select("a", "b")
    within = members.join(first.filter("size > 1"), "g").filter("cid <> first").select(F.col("first").alias("a"), F.col("cid").alias("b"))
    clusters = components(chains.unionByName(within), scratch).select(F.col("node").alias("cid"), F.col("component").alias("cluster"))
    clusters = scratch.table(clusters, "clusters")

    # Other pairs: groups outside a common cluster share no shingle but the counted ones.
    pairs = found.filter("c > 0").groupBy("a", "b", "na", "nb").agg(F.sum("c").alias("c"))
    rest = f"floor(({percent} * greatest(na, nb) + 99) / 100) - 1"
    need = f"floor(({percent} * (na + nb) + {99 + percent}) / {100 + percent})"
    pairs = pairs.filter(f"c + {rest} >= {need}").select(F.col("a").alias("ga"), F.col("b").alias("gb")).distinct()
    side = lambda g, k, c: members.join(clusters, "cid", "left").select(F.col("g").alias(g), F.col("cid").alias(k), F.col("cluster").alias(c))
    pairs = pairs.join(side("ga", "a", "ca"), "ga").join(side("gb", "b", "cb"), "gb")
    pairs = scratch.table(pairs.filter("ca is null or cb is null or ca <> cb").select("a", "b"), "pairs")

    wanted = pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))).unionByName(clusters.select("cid")).distinct()
    texts = _texts(docs, classes.select("cid", "key", "rep").join(wanted, "cid"), scratch)
    placed = scratch.table(clusters.join(members.select("cid", "n"), "cid").withColumnRenamed("cid", "key"), "placed")
    links = _verify(pairs, texts, percent).unionByName(_compare_blocks(placed, texts, percent))
    parts = components(scratch.table(links, "links"), scratch)

    classes = classes.select("key", "cid", "rep").join(parts.withColumnRenamed("node", "cid"), "cid", "left").withColumn("c", F.coalesce("component", "cid"))
    ids = classes.groupBy("c").agg(F.min("rep").alias("component_id"))
    of_class = classes.join(ids, "c").select("key", "component_id")
    # equal ids with different texts are one document: their components are one
    result = every.select("doc_id", F.col("n").alias("n_shingles"), "key").join(of_class, "key", "left")
    return _one_id(result.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))), scratch)


def _one_id(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Merge the components of an id that stands in several; most tables have none."""
    rows = scratch.table(rows.select("doc_id", "n_shingles", "component_id"), "rows")
    torn = rows.groupBy("doc_id").agg(F.min("component_id").alias("a"), F.max("component_id").alias("b")).filter("a <> b").select("a", "b")
    if torn.isEmpty():
        return rows
    joined = components(rows.filter("component_id <> doc_id").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b")), scratch)
    return rows.join(joined.withColumnRenamed("node", "doc_id").withColumnRenamed("component", "_c"), "doc_id", "left").withColumn("component_id", F.coalesce("_c", "component_id")).drop("_c")


def op9_jaccard_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all ``documents``."""
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    return near_duplicates(docs, Scratch(spark, "jaccard"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN CAST([] AS VARCHAR[])
    WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i+4], ' '))) END AS shingles
  FROM w
), e AS (
  SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s
), pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM e x JOIN e y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id
    AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
), reach AS (
  SELECT doc_id AS node, doc_id AS other FROM s
  UNION
  SELECT reach.node, pairs.b FROM reach JOIN pairs ON reach.other = pairs.a
)
SELECT s.doc_id, CAST(len(s.shingles) AS BIGINT) AS n_shingles, c.component_id
FROM s JOIN (SELECT node, min(other) AS component_id FROM reach GROUP BY node) c ON s.doc_id = c.node
"""
