"""Content-addressed store of token ids.

Whole texts become id streams. A rolling hash over the last ``WINDOW`` ids
cuts each stream where the hash meets a mask, so equal passages give equal
chunks wherever they stand. The store has three parts, all Parquet:

* ``stage/kind=chunk``: each distinct chunk once: ``key`` (16-byte BLAKE2b of
  its ids as little-endian unsigned 32-bit integers), ``n`` and ``body`` (ids
  as little-endian unsigned 16-bit integers, 32-bit for larger vocabularies);
* ``recipes``: in ascending doc_id order, each document's chunk keys and
  lengths, its number of ids and its Merkle root;
* the Merkle root of a document is a binary BLAKE2b tree over its chunk keys,
  so a reader that recomputes keys from bodies and roots from keys has
  verified the reconstruction.

Defined results: a null text is empty; an empty document holds the end id
alone; equal rows are kept as separate documents; rows with a null doc_id are
kept and come first; extra columns are ignored; an empty table gives an empty
store.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, running_total
from .tokens import encoder

WINDOW = 16
LEAST, MOST, MASK = 64, 1024, 0xFF
#: Odd multiplier of the polynomial rolling hash.
BASE = 0x9E3779B97F4A7C15
STAGE = "kind string, key binary, doc_id long, n long, body binary, sizes binary, root binary"


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64."""
    found = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        out = np.full(n, base, np.uint64)
        out[0] = 1
        with np.errstate(over="ignore"):
            found.append(np.multiply.accumulate(out))
    return found[0], found[1]


def rolling(ids: np.ndarray) -> np.ndarray:
    """Hash of the window that ends at each id; windows at the start are shorter."""
    n = len(ids)
    power, inverse = _powers(max(1 << 14, 1 << max(0, n - 1).bit_length()))
    with np.errstate(over="ignore"):
        mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        sums = np.cumsum(mixed * power[:n])
        sums[WINDOW:] -= sums[:-WINDOW].copy()
        out = sums * inverse[:n]
    return out ^ (out >> np.uint64(29))


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of a stream: where the hash meets the mask, within the size limits."""
    if len(ids) <= LEAST:
        return [len(ids)] if len(ids) else []
    marks = np.flatnonzero((rolling(ids) & np.uint64(MASK)) == 0) + 1
    ends, at = [], 0
    for m in marks.tolist():
        while m - at > MOST:
            at += MOST
            ends.append(at)
        if m - at >= LEAST:
            ends.append(m)
            at = m
    while len(ids) - at > MOST:
        at += MOST
        ends.append(at)
    if at < len(ids):
        ends.append(len(ids))
    return ends


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def merkle(keys: list[bytes]) -> bytes:
    """Root of the binary hash tree over ``keys``; an odd node moves up as it is."""
    level = [digest(b"\0" + k) for k in keys]
    while len(level) > 1:
        pairs = [digest(b"\1" + a + b) for a, b in zip(level[::2], level[1::2])]
        level = pairs + level[len(pairs) * 2 :]
    return level[0] if level else digest(b"")


def _staged(path: str, end_id: int):
    from pyspark import TaskContext

    def run(batches):
        enc, seen = encoder(path), set()
        width = f"<u{enc.width}"
        tail = np.array([end_id], width).tobytes()
        task, at = TaskContext.get().partitionId(), 0
        names = [f.split()[0] for f in STAGE.split(", ")]
        for batch in batches:
            rows, held = [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                packed = enc.encode(text.as_py()) + tail
                ids = np.frombuffer(packed, width)
                wide = ids.astype("<u4").tobytes()
                keys, sizes, start = [], [], 0
                for end in cuts(ids):
                    keys.append(digest(wide[start * 4 : end * 4]))
                    sizes.append(end - start)
                    if keys[-1] not in seen:
                        if len(seen) >= 500_000:
                            seen.clear()
                        seen.add(keys[-1])
                        body = packed[start * enc.width : end * enc.width]
                        held += len(body)
                        rows.append(("chunk", keys[-1], None, end - start, body, None, None))
                    start = end
                name = task.to_bytes(4, "big") + at.to_bytes(8, "big")
                at += 1
                rows.append(("recipe", name, doc_id, len(ids), b"".join(keys), np.array(sizes, "<u4").tobytes(), merkle(keys)))
                if held > 8 << 20:
                    yield _batch(names, rows)
                    rows, held = [], 0
            yield _batch(names, rows)

    return run


_TYPES = [pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]


def _batch(names, rows):
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], names=names)


def write(docs: DataFrame, tokenizer: str, end_id: int, scratch: Scratch) -> dict[str, str]:
    """Encode ``docs`` (doc_id, text) and write the store; returns its folders.

    One shuffle moves the ids: chunks that a task has seen before stay behind,
    and the rest meet by key, so a passage that a third of the documents hold
    arrives once from each task.
    """
    stage = scratch.folder("stage")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_staged(tokenizer, end_id), STAGE)
    rows.dropDuplicates(["kind", "key"]).write.partitionBy("kind").option("compression", "zstd").parquet(stage)
    spark = docs.sparkSession
    recipes = scratch.folder("recipes")
    found = spark.read.schema(STAGE).parquet(stage).filter("kind = 'recipe'")
    found = found.select("doc_id", F.col("key").alias("name"), "n", F.col("body").alias("keys"), "sizes", "root")
    found.repartitionByRange("doc_id", "name").sortWithinPartitions("doc_id", "name").write.option("compression", "zstd").parquet(recipes)
    return {"chunks": stage, "recipes": recipes}


RECIPE = "doc_id long, name binary, n long, keys binary, sizes binary, root binary"


def read_chunks(spark: SparkSession, store: dict[str, str]) -> DataFrame:
    return spark.read.schema(STAGE).parquet(store["chunks"]).filter("kind = 'chunk'").select("key", "n", "body")


def read_recipes(spark: SparkSession, store: dict[str, str]) -> DataFrame:
    return spark.read.schema(RECIPE).parquet(store["recipes"])


def steps(spark: SparkSession, store: dict[str, str]) -> DataFrame:
    """One row for each chunk of each document, after the root was verified: name, doc_id, pos, key, n, after (ids that follow)."""

    def run(batches):
        for batch in batches:
            out = {k: [] for k in ("name", "doc_id", "pos", "key", "n", "after")}
            for row in batch.to_pylist():
                keys = [row["keys"][i : i + 16] for i in range(0, len(row["keys"]), 16)]
                sizes = np.frombuffer(row["sizes"], "<u4").astype(np.int64)
                if merkle(keys) != row["root"] or int(sizes.sum()) != row["n"]:
                    raise ValueError(f"the manifest of document {row['doc_id']} doesn't match its root")
                out["name"] += [row["name"]] * len(keys)
                out["doc_id"] += [row["doc_id"]] * len(keys)
                out["pos"] += range(len(keys))
                out["key"] += keys
                out["n"] += sizes.tolist()
                out["after"] += (row["n"] - np.cumsum(sizes)).tolist()
            types = [pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types)], names=list(out))

    return read_recipes(spark, store).mapInArrow(run, "name binary, doc_id long, pos long, key binary, n long, after long")


def read_back(spark: SparkSession, store: dict[str, str]) -> DataFrame:
    """Every document's ids from the files: doc_id, name, ids (packed as stored). Each chunk is checked against its key."""
    bodies = read_chunks(spark, store).mapInArrow(_checked(True), "key binary, crc long, m long, body binary")
    joined = steps(spark, store).join(bodies, "key")
    parts = joined.groupBy("name", "doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "body"))).alias("parts"))
    return parts.select("doc_id", "name", F.expr("aggregate(parts, X'', (a, p) -> concat(a, p.body))").alias("ids"))


def _checked(with_body: bool):
    def run(batches):
        for batch in batches:
            keys, crcs, sizes, bodies = [], [], [], []
            for key, n, body in zip(*(c.to_pylist() for c in batch.columns)):
                wide = np.frombuffer(body, f"<u{len(body) // n}").astype("<u4").tobytes()
                if digest(wide) != key:
                    raise ValueError(f"a chunk doesn't match its key {key.hex()}")
                keys.append(key)
                crcs.append(zlib.crc32(wide))
                sizes.append(len(wide) // 4)
                bodies.append(body)
            out = [pa.array(keys, pa.binary()), pa.array(crcs, pa.int64()), pa.array(sizes, pa.int64())]
            names = ["key", "crc", "m"]
            if with_body:
                out, names = [*out, pa.array(bodies, pa.binary())], [*names, "body"]
            yield pa.RecordBatch.from_arrays(out, names=names)

    return run


#: The reflected CRC-32 polynomial.
POLY = 0xEDB88320


def _times(matrix: np.ndarray, vec: np.ndarray) -> np.ndarray:
    """GF(2) product of a 32-column matrix with each of ``vec``."""
    out = np.zeros(len(vec), np.uint32)
    for bit in range(32):
        out ^= np.where((vec >> np.uint32(bit)) & np.uint32(1), matrix[bit], np.uint32(0)).astype(np.uint32)
    return out


def _squares(count: int) -> list[np.ndarray]:
    """Matrices that append 1, 2, 4, ... zero ids of four bytes to a CRC."""
    m = np.array([POLY, *(1 << i for i in range(31))], np.uint32)  # appends one zero bit
    for _ in range(5):
        m = _times(m, m)
    found = [m]
    while len(found) < count:
        found.append(_times(found[-1], found[-1]))
    return found


def crc_after(crc: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The share of a part's CRC-32 in that of the whole, when ``ids`` 32-bit ids follow the part."""
    out, left = crc.astype(np.uint32), ids.astype(np.uint64)
    for k, m in enumerate(_squares(max(1, int(left.max()).bit_length())) if len(left) else []):
        hit = ((left >> np.uint64(k)) & np.uint64(1)).astype(bool)
        out[hit] = _times(m, out[hit])
    return out


def digests(spark: SparkSession, store: dict[str, str], scratch: Scratch) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, n_chunks, root of every document, from the store's files.

    Chunk bodies are read and verified once. CRC-32 is linear, so the CRC of a
    document is the exclusive or of its chunks' CRCs, each carried over the
    ids behind it; only those small rows are shuffled.
    """
    bodies = read_chunks(spark, store).mapInArrow(_checked(False), "key binary, crc long, m long")

    def carried(batches):
        for batch in batches:
            crc = crc_after(np.asarray(batch.column("crc")), np.asarray(batch.column("after")))
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(crc.astype(np.int64)), batch.column("m")], names=["name", "part", "m"])

    parts = steps(spark, store).join(bodies, "key").select("name", "crc", "after", "m").mapInArrow(carried, "name binary, part long, m long")
    sums = parts.groupBy("name").agg(F.expr("bit_xor(part)").alias("ids_crc32"), F.sum("m").alias("n_tokens"), F.count("*").alias("n_chunks"))
    docs = read_recipes(spark, store).select("doc_id", "name", "n", "root").join(sums, "name", "left")
    docs = docs.withColumn("n_tokens", F.expr("if(n_tokens = n, n, raise_error('ids are missing from the store'))"))
    total = running_total(docs, ["doc_id", "name"], "n_tokens", "start", scratch)
    return total.select("doc_id", "start", "n_tokens", "ids_crc32", "n_chunks", F.lower(F.hex("root")).alias("root"))


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all ``documents`` to a store and report each document from its files."""
    from .tokens import default_path

    scratch = Scratch(spark, "tokens")
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    store = write(docs, default_path("word_bpe_49k.json"), 2, scratch)
    return digests(spark, store, scratch)
