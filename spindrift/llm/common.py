"""What the training-data operators share: scratch tables, running totals, components.

Scratch data lives in the folder that the session names in
``spark.checkpoint.dir``, which every executor and the driver can reach. It
stays there because lazily read results depend on it; ``clean(spark)`` removes
what this session wrote.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

if TaskContext.get() is not None:  # in a Python worker: freed batches go back to the system at once, so an idle worker holds little
    pa.set_memory_pool(pa.system_memory_pool())

_ROOTS: dict[str, list[str]] = {}
#: The temporary folder of a local session that names none.
_OWN: dict[str, str] = {}
#: Rows of an Arrow batch while whole texts pass through Python.
BATCH_ROWS = "1000"
#: Once a scratch table is whole, the shuffle files behind it are of no use; small batches keep long texts in bounds.
WHILE_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Session settings for the time of a block; what they were before is put back."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def small_batches(spark: SparkSession) -> None:
    """Set the session to small Arrow batches, since a returned DataFrame runs later; a smaller setting of the caller stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > int(BATCH_ROWS):
        spark.conf.set(key, BATCH_ROWS)


def shared_root(spark: SparkSession) -> str:
    """The shared folder of this session; one of our own only if none is set and Spark runs in this process alone."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        # the setting can't be changed while a session runs: the folder is kept here
        root = _OWN.setdefault(spark.sparkContext.applicationId, "") or "file://" + tempfile.mkdtemp(prefix="spindrift-")
        _OWN[spark.sparkContext.applicationId] = root
    return root.rstrip("/") if "://" in root else "file://" + root.rstrip("/")


class Scratch:
    """Tables and files of one operator run, under the shared folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        small_batches(spark)
        self.path = f"{shared_root(spark)}/spindrift-{name}-{uuid.uuid4().hex[:12]}"
        _ROOTS.setdefault(spark.sparkContext.applicationId, []).append(self.path)
        self._n = 0

    def folder(self, name: str) -> str:
        self._n += 1
        return f"{self.path}/{self._n:02d}-{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back: the lineage ends here and survives lost executors."""
        path = self.folder(name)
        with settings(self.spark, WHILE_WRITING):
            df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> None:
    """Remove everything that operators of this session left in the shared folder."""
    for path in _ROOTS.pop(spark.sparkContext.applicationId, []):
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running_total(df: DataFrame, order: list[str], value: str, out: str, scratch: Scratch) -> DataFrame:
    """Add ``out``: the sum of ``value`` over all rows before this one in ``order``.

    A range shuffle keeps the order global; each range is summed on its own and
    only one number for each range reaches the driver, so no task sees all
    rows. ``order`` must tell rows apart (equal rows are interchangeable).
    """
    spark = df.sparkSession
    ranged = df.repartitionByRange(partitions(spark), *order).withColumn("_range", F.spark_partition_id())
    ranged = scratch.table(ranged, "ranges")
    sums = sorted(ranged.groupBy("_range").agg(F.sum(value).alias("s")).collect())
    before, total = [], 0
    for row in sums:
        before.append((row["_range"], total))
        total += row["s"] or 0
    bases = spark.createDataFrame(before, "_range int, _base long")
    window = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum(value).over(window), F.lit(0))
    # one row for each range, so the broadcast side is as small as the number of partitions
    return ranged.join(F.broadcast(bases), "_range").withColumn(out, (F.col("_base") + inside).cast("long")).drop("_range", "_base")


def marked(rows: DataFrame, values: DataFrame, column: str, bits: int = 24) -> DataFrame:
    """``rows`` with ``_maybe``: whether a bit says that ``column`` may be among those of ``values``; all that are pass, a few others too.

    There is a bit for the hash of each value: 2 MB with 24 bits, however many
    there are. They go to the tasks as one row with an array of words.
    """
    h = F.pmod(F.xxhash64(column), F.lit(1 << bits))
    words = values.select(h.alias("h")).withColumn("w", F.expr("cast(h div 64 as int)")).groupBy("w").agg(F.expr("bit_or(shiftleft(1L, cast(h % 64 as int)))").alias("v"))
    table = np.zeros(1 << max(0, bits - 6), np.int64)
    for part in words.toArrow().to_batches():  # at most 2**(bits - 6) rows
        table[np.asarray(part.column("w"))] = np.asarray(part.column("v"))
    one = rows.sparkSession.createDataFrame(pa.table({"_bits": pa.array([table], pa.list_(pa.int64()))}))
    bit = F.getbit(F.get("_bits", F.floor(h / 64).cast("int")), (h % 64).cast("int")) == 1
    return rows.crossJoin(F.broadcast(one)).withColumn("_maybe", F.coalesce(bit, F.lit(False))).drop("_bits")


def join_spread(left: DataFrame, right: DataFrame, keys: list[str], total: int) -> DataFrame:
    """``left`` joined with ``right``, which has one row for each key and ``n``, the number of rows of ``left`` (``total`` in all) with it.

    Keys of more rows than a partition's share are sent to all tasks (at most
    as many as there are partitions), so their rows are not gathered.
    """
    spark = left.sparkSession
    hot = right.filter(F.col("n") > max(100, total // partitions(spark))).collect()
    hot = F.broadcast(spark.createDataFrame(hot, right.schema))
    return left.join(hot, keys).unionByName(left.join(hot, keys, "left_anti").join(right, keys))


def components(edges: DataFrame, scratch: Scratch, limit: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a long, b long): rows (node, component).

    Each round is a large-star step and a small-star step, until the edges are
    stars around the smallest id of each component. A step finds the smallest
    neighbour of every node and moves the node's edges there. Nodes with more
    than their share of the edges (at most two a partition) are sent to all
    tasks, so the edges of a hub stay where they are and are never gathered.
    Nodes without an edge to another node don't appear.
    """

    def canonical(df: DataFrame) -> DataFrame:
        return df.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    def moved(df: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
        """The edges of ``df`` to a smaller v moved to the smallest neighbour m of u, and u, m of every u; ``n`` edges bound the hubs."""
        least = df.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        return join_spread(df, least, ["u"], n).drop("n"), least.drop("n")

    def state(df: DataFrame) -> tuple[int, bool]:
        """The number of edges, and whether they are stars around smaller ids."""
        ends = df.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(df.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        ends = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        row = ends.agg(F.sum("up").alias("n"), F.max(((F.col("up") > 1) | ((F.col("up") == 1) & (F.col("down") == 1))).cast("int")).alias("bad")).first()
        return row["n"] or 0, not row["bad"]

    e = scratch.table(canonical(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))), "edges")
    for _ in range(limit):
        n, settled = state(e)
        if settled:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large, _ = moved(both, 2 * n)
        large = scratch.table(canonical(large.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))), "large")
        small, least = moved(large, n)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.withColumnRenamed("m", "v"))
        e = scratch.table(canonical(small), "small")
    else:
        raise RuntimeError(f"components did not settle in {limit} rounds")
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index that each of ``n`` rows reaches over the links (i, j)."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if (root == before).all():
            return root
