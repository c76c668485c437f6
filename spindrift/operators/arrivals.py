"""Near-duplicate checks of arriving documents against a stored corpus, by a persisted signature index.

The store has three bucketed tables: ``digests`` (the MD5 of each text met, and
who had it first), ``signatures`` and ``grams`` of the documents that stand
(those that weren't found to be copies). Signatures are blocks of sketches: up
to about BLOCK documents of a size class and a slice, which is a hash of their
ids. A batch of arrivals is signed, and its rows alone are shuffled to the
buckets of the store; the store's side of each join is read where it lies,
without an exchange. Blocks of arrivals meet blocks of the store as
``corpus.near_pairs`` lets them meet, so only pairs whose sketches are near are
compared by their sets. Only arrivals that match no document of the store are
compared with each other.

Documents that don't stand have no signatures, so of any number of near copies
one is compared, and a corpus that is fed in parts makes far fewer pairs than
one run over all of it. Fed in the order of ids, parts give what
``drivers.dedup`` gives for the whole.

A batch that is given again, after a failure or by mistake, gives the same
result and adds no document twice: tables are written in an order (signatures,
grams, digests) in which what is missing is found by its id, and a document is
never compared with itself.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import settled, stored
from . import corpus

TABLES = {"digests": "digest", "signatures": "cell", "grams": "doc_id"}
#: Slices of a size class, and documents of a block.
SLICES, BLOCK = 8, 4096


@dataclass
class Store:
    """The tables under a folder; ``threshold`` and ``buckets`` must stay what they were when it was made."""

    spark: SparkSession
    path: str
    threshold: float = 0.9
    buckets: int = 64
    id_type: str = "bigint"

    def __post_init__(self):
        columns = {"digests": f"digest string, doc_id {self.id_type}", "signatures": f"cell bigint, docs array<struct<doc_id: {self.id_type}, n: int, sketch: binary>>", "grams": f"doc_id {self.id_type}, g binary"}
        for name, key in TABLES.items():
            # the catalogue of a session forgets external tables; their files keep their buckets
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name(name)} ({columns[name]}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{name}'")

    def name(self, table: str) -> str:
        return "arrivals_" + re.sub(r"\W", "_", f"{self.path}_{table}")

    def table(self, table: str) -> DataFrame:
        return self.spark.table(self.name(table))

    def append(self, rows: DataFrame, table: str) -> None:
        key = TABLES[table]
        rows = rows.select(*self.table(table).columns).repartition(self.buckets, key)
        rows.write.mode("append").format("parquet").bucketBy(self.buckets, key).sortBy(key).option("path", f"{self.path}/{table}").saveAsTable(self.name(table))


def _cell(level, slice):
    return level.cast("long") * SLICES + slice


def blocks(placed: DataFrame) -> DataFrame:
    """cell, docs: the documents of ``placed`` (cell, doc_id, n, sketch) in blocks of about BLOCK, dealt by a hash of their ids."""
    most = placed.groupBy("cell").count().agg(F.max("count")).first()[0] or 0
    chunk = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(-(-most // BLOCK) or 1))
    return placed.groupBy("cell", chunk.alias("chunk")).agg(F.collect_list(F.struct("doc_id", "n", "sketch")).alias("docs")).drop("chunk")


def candidates(store: Store, signed: DataFrame) -> DataFrame:
    """a, b: documents a of the store whose sets may be near that of a new document b."""
    import numpy as np
    import pyarrow as pa

    every = F.sequence(F.lit(0), F.lit(SLICES - 1))
    near = F.flatten(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda i: F.transform(every, lambda s: _cell(F.col("level") + i, s))))
    new = blocks(signed.select(F.explode(near).alias("cell"), "doc_id", "n", "sketch")).withColumnRenamed("docs", "new")
    threshold = store.threshold

    def meet(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                a, b = (batch.column(c)[row].values for c in (0, 1))
                for new, old in ((x, y) for x in _alike(b) for y in _alike(a)):
                    (n1, s1), (n2, s2) = ((np.asarray(x.field("n")).astype(np.int64), corpus.sketch_rows(x.field("sketch"))) for x in (new, old))
                    for i, j in corpus.close_sets(n1, s1, n2, s2, threshold):
                        yield pa.RecordBatch.from_arrays([old.field("doc_id").take(pa.array(j)), new.field("doc_id").take(pa.array(i))], names=["a", "b"])

    met = new.join(store.table("signatures"), "cell").select("docs", "new").mapInArrow(meet, f"a {store.id_type}, b {store.id_type}")
    return met.filter("a <> b").distinct()


def _alike(docs):
    """Documents of a block by the length of their sketches; those of a cell of arrivals come from up to three size classes."""
    import pyarrow as pa
    import pyarrow.compute as pc

    size = pc.binary_length(docs.field("sketch"))
    return [docs.filter(pc.equal(size, n)) for n in pa.array(size).unique()]


def add(store: Store, docs: DataFrame) -> DataFrame:
    """Check ``docs`` (doc_id, text) against the store and each other, and add what is new: doc_id, kept, duplicate_of, kind.

    Blank and null texts give no row and aren't stored. ``kind`` is 'exact',
    'fuzzy', or null for documents that stand. Rows that share an id are
    one document with the smallest of its texts.
    """
    docs = docs.groupBy("doc_id").agg(F.min("text").alias("text")).filter("doc_id is not null")
    rows = docs.withColumn("digest", F.md5(F.trim("text"))).filter(F.length(F.trim("text")) > 0)
    rows = settled(rows)
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first"))
    known = first.join(store.table("digests").withColumnRenamed("doc_id", "stored"), "digest", "left")
    known = known.groupBy("digest", "first").agg(F.min("stored").alias("stored"))
    known = settled(known.select("digest", F.coalesce("stored", "first").alias("duplicate_of")))
    exact = rows.select("doc_id", "digest").join(known, "digest")
    fresh = rows.join(known, (rows["digest"] == known["digest"]) & (rows["doc_id"] == known["duplicate_of"])).select("doc_id", "text")

    signed = stored(corpus.gram_signatures(fresh, store.threshold), "signed")
    sets = signed.select("doc_id", "g")
    pairs = settled(candidates(store, signed))
    of_new = pairs.join(sets.withColumnsRenamed({"doc_id": "b", "g": "gb"}), "b")
    both = of_new.join(store.table("grams").withColumnsRenamed({"doc_id": "a", "g": "ga"}), "a")
    met = corpus.set_similarity(both).filter(F.col("s") >= store.threshold)
    found = settled(met.groupBy(F.col("b").alias("doc_id")).agg(F.min("a").alias("near")))
    left = signed.join(found, "doc_id", "left_anti")
    within = corpus.greedy_keep(corpus.near_signed(left, store.threshold)).select(F.col("removed").alias("doc_id"), F.col("kept").alias("near"))
    near = settled(found.unionByName(within))

    standing = settled(sets.select("doc_id").join(near, "doc_id", "left_anti").join(store.table("grams").select("doc_id"), "doc_id", "left_anti"))
    result = exact.join(near, "doc_id", "left").select(
        "doc_id",
        ((F.col("doc_id") == F.col("duplicate_of")) & F.col("near").isNull()).alias("kept"),
        F.when(F.col("doc_id") == F.col("duplicate_of"), F.coalesce("near", "duplicate_of")).otherwise(F.col("duplicate_of")).alias("duplicate_of"),
        F.when(F.col("doc_id") != F.col("duplicate_of"), "exact").when(F.col("near").isNotNull(), "fuzzy").alias("kind"),
    )
    result = settled(result)
    # whoever has grams is complete: signatures go before them, and twice after a failure, which changes nothing
    slice = F.pmod(F.xxhash64("doc_id"), F.lit(SLICES))
    store.append(blocks(signed.join(standing, "doc_id").select(_cell(F.col("level"), slice).alias("cell"), "doc_id", "n", "sketch")), "signatures")
    store.append(sets.join(standing, "doc_id"), "grams")
    seen = known.select("digest", F.col("duplicate_of").alias("doc_id"))
    store.append(seen.join(store.table("digests").select("digest"), "digest", "left_anti"), "digests")
    return result
