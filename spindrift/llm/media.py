"""Media columns: payloads as PNG members of archives, read by a Spark data source.

``write_archives`` stores each payload losslessly as an 8-bit RGB image of 64
pixels a row (192 bytes) and puts the images, uncompressed, into ZIP archives
of bounded size, one folder for a column. ``ArchiveSource`` is a Spark data
source over such a folder. The driver plans byte ranges from file sizes
alone; a task opens its archive, takes the members whose headers start in its
range, and streams them as Arrow batches of bounded bytes. Each member is read
on its own at its offset and tried again on its own; one that can't be read in
``tries`` attempts gives a row with ``error`` set and no data, or fails the
query with ``strict``. Only archives in the folder's manifest are read, so
those of lost task attempts don't count.

Defined results: a null text is an empty payload, which becomes 192 blanks;
equal texts give equal images; equal rows and null ids are kept as members of
their own; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
import struct
import zipfile
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import Scratch
from .files import MANIFEST, listing, new_file, open_fs, publish

ROW = 192
#: An archive is closed beyond this many bytes, so a lost task repeats little.
ARCHIVE_BYTES = 64 << 20
BATCH_BYTES = 8 << 20
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def pad(data: bytes) -> bytes:
    """``data`` with blanks up to a positive multiple of ROW."""
    return data.ljust(max(1, -(-len(data) // ROW)) * ROW, b" ")


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes, n_bytes: int) -> bytes:
    """The payload as pixels of an RGB image; the unpadded length goes into a text field."""
    rows = len(payload) // ROW
    pixels = np.zeros((rows, ROW + 1), np.uint8)  # each row starts with filter 0
    pixels[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, ROW)
    head = _chunk(b"IHDR", struct.pack(">IIBBBBB", ROW // 3, rows, 8, 2, 0, 0, 0))
    text = _chunk(b"tEXt", b"n_bytes\0" + str(n_bytes).encode())
    return SIGNATURE + head + text + _chunk(b"IDAT", zlib.compress(pixels.tobytes(), 3)) + _chunk(b"IEND", b"")


def from_png(data: bytes) -> tuple[bytes, int]:
    """(payload, unpadded length) of an image that ``to_png`` wrote; damage raises ValueError."""
    if data[:8] != SIGNATURE:
        raise ValueError("not an image")
    at, pixels, n_bytes, rows = 8, b"", -1, 0
    while at < len(data):
        (size,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + size]
        if struct.pack(">I", zlib.crc32(kind + body)) != data[at + 8 + size : at + 12 + size]:
            raise ValueError(f"damaged {kind!r} part")
        if kind == b"IHDR":
            rows = struct.unpack(">I", body[4:8])[0]
        elif kind == b"tEXt":
            n_bytes = int(body.partition(b"\0")[2])
        elif kind == b"IDAT":
            pixels += body
        at += 12 + size
    raw = np.frombuffer(zlib.decompress(pixels), np.uint8)
    return raw.reshape(rows, ROW + 1)[:, 1:].tobytes(), n_bytes


def features(payload: bytes) -> str:
    """Channel means and a 64-bit difference hash of 64 column means, in hex."""
    image = np.frombuffer(payload, np.uint8).reshape(-1, ROW // 3, 3)
    sums = image.sum(axis=0, dtype=np.int64)
    means = sums.sum(axis=0) // (image.shape[0] * image.shape[1])
    columns = sums.sum(axis=1)
    bits = np.packbits(columns >= np.roll(columns, 1)).tobytes().hex()
    return "-".join(map(str, means.tolist())) + ":" + bits


def write_archives(docs: DataFrame, folder: str) -> None:
    """Write every row of ``docs`` (doc_id, text) as a member of an archive in ``folder``."""

    def run(batches):
        from pyspark import TaskContext

        task, part = TaskContext.get().partitionId(), 0
        rows = ((d, t) for b in batches for d, t in zip(b.column(0).to_pylist(), b.column(1)))
        row = next(rows, None)
        while row:
            with new_file(folder, f"{task:06d}-{part:04d}", ".zip") as (out, published):
                with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as archive:
                    held = 0
                    while row and held < ARCHIVE_BYTES:
                        doc_id, data = row[0], (row[1].as_py() or "").encode("utf-8", "surrogatepass")
                        image = to_png(pad(data), len(data))
                        archive.writestr(zipfile.ZipInfo(f"{published['n']:09d}/{'' if doc_id is None else doc_id}.png"), image)
                        held += len(image)
                        published["n"] += 1
                        row = next(rows, None)
            part += 1
            yield pa.RecordBatch.from_pylist([published])

    wanted = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    publish(wanted.mapInArrow(run, MANIFEST), folder)


@dataclass
class ByteRange(InputPartition):
    path: str
    start: int
    end: int


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.range_bytes = int(options.get("rangeBytes", 4 << 20))
        self.most_ranges = int(options.get("mostRanges", 100_000))
        self.tries = int(options.get("tries", 3))
        self.strict = str(options.get("strict", "true")).lower() == "true"

    def partitions(self):
        files = listing(self.folder, ".zip")
        step = max(self.range_bytes, sum(size for _, size in files) // self.most_ranges)  # the plan stays small
        ranges = [ByteRange(p, a, min(a + step, size)) for p, size in files for a in range(0, size, step)]
        return ranges or [ByteRange("", 0, 0)]

    def read(self, partition):
        if not partition.path:
            return
        system, _ = open_fs(self.folder)
        with system.open_input_file(partition.path) as file:
            members = [m for m in zipfile.ZipFile(file).infolist() if partition.start <= m.header_offset < partition.end]
        rows, held = [], 0
        file = None
        for m in members:
            data, error = None, None
            for _ in range(self.tries):
                try:
                    file = file or zipfile.ZipFile(system.open_input_file(partition.path))
                    data, error = file.read(m), None
                    break
                except (OSError, zipfile.BadZipFile, zlib.error) as e:
                    error, file = f"{type(e).__name__}: {e}", None
            if error and self.strict:
                raise OSError(f"{partition.path} at {m.header_offset}: {error}")
            name = m.filename.rpartition("/")[2].removesuffix(".png")
            rows.append((int(name) if name else None, partition.path, m.header_offset, data, error))
            held += len(data or b"")
            if held >= BATCH_BYTES:
                yield self._batch(rows)
                rows, held = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows):
        types = [pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string()]
        names = ["doc_id", "archive", "offset", "media", "error"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


class ArchiveSource(DataSource):
    """``spark.read.format("spindrift_archive").load(folder)``: doc_id, archive, offset, media, error."""

    @classmethod
    def name(cls):
        return "spindrift_archive"

    def schema(self):
        return "doc_id long, archive string, offset long, media binary, error string"

    def reader(self, schema):
        return ArchiveReader(self.options)


def read_archives(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("spindrift_archive").options(**options).load(folder)


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def describe(media: DataFrame) -> DataFrame:
    """Digests and features of images (doc_id, media) as they were read back."""

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, image in zip(batch.column(0).to_pylist(), batch.column(1)):
                image = image.as_py()
                payload, n_bytes = from_png(image)
                rows.append((doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(image), hashlib.sha256(image).hexdigest(), features(payload)))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = list(zip(*rows)) if rows else [[] for _ in types]
            names = [f.split()[0] for f in FEATURES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return media.select("doc_id", "media").mapInArrow(run, FEATURES)


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store all ``documents`` as images in archives and describe them as read back."""
    folder = Scratch(spark, "media").folder("archives")
    write_archives(spark.read.parquet(os.path.join(sf_dir, "documents.parquet")), folder)
    return describe(read_archives(spark, folder))
