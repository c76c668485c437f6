"""WARC archives: written from pages, read back, assembled into captures.

``write`` stores each page as three records, each a gzip member of its own:
the response (or a revisit of an equal payload), and a request and a metadata
record that name it in WARC-Concurrent-To. ``read`` streams archives into one
row for each record; payload digests are computed from the bytes read.
``assemble`` joins the records of a transaction through their concurrent-to
identifiers, whichever side holds them, into one nested row for each capture.

Of the pages with equal payloads of at least ``LEAST`` bytes, the one with
the smallest page_id is the response and the others revisit it; null ids come
last, and among equal ids the first row read. Smaller payloads are responses.

Defined results: null html is an empty payload; a null url leaves the target
out; equal rows are captures of their own; a transaction without a request or
a metadata record has null there, and a request or metadata record whose
response is missing gives a capture with a null response; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, marked, partitions
from .files import MANIFEST, new_file, open_fs, publish, published

LEAST = 100
ARCHIVE_BYTES = 32 << 20
BATCH_BYTES = 8 << 20
SOFTWARE = "spindrift"
#: Repeated digests are marked by one of 2**BITS bits.
BITS = 24
#: Tasks that read archives; each takes its share of them.
READERS = 20_000


def record_id(row: int, kind: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.blake2b(f'{row} {kind}'.encode(), digest_size=16).digest())}>"


def record(headers: list[tuple[str, str | None]], body: bytes) -> bytes:
    """One WARC/1.1 record as a gzip member; fields without a value are left out, control characters are escaped."""
    lines = ["WARC/1.1"]
    for name, value in headers:
        if value is not None:
            lines.append(f"{name}: " + "".join(c if c >= " " else f"%{ord(c):02X}" for c in value))
    lines.append(f"Content-Length: {len(body)}")
    raw = "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def transaction(row: int, page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, date: str) -> list[bytes]:
    """The three records of a page; ``first`` is the row of the response that a revisit refers to."""
    own = record_id(row, "response")
    common = [("WARC-Date", date), ("WARC-Target-URI", url)]
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    payload_digest = ("WARC-Payload-Digest", f"sha256:{digest}")
    if first is None:
        kind, extra, body = "response", [payload_digest], head + payload
    else:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        kind, extra, body = "revisit", [payload_digest, ("WARC-Profile", profile), ("WARC-Refers-To", record_id(first, "response"))], head
    fields = f"page-id: {'' if page_id is None else page_id}\r\nsoftware: {SOFTWARE}\r\n".encode()
    path = "/" + (url or "").partition("://")[2].partition("/")[2]
    get = f"GET {''.join(c for c in path if c > ' ')} HTTP/1.1\r\n\r\n".encode()
    return [
        record([("WARC-Type", "request"), ("WARC-Record-ID", record_id(row, "request")), *common, ("WARC-Concurrent-To", own), ("Content-Type", "application/http; msgtype=request")], get),
        record([("WARC-Type", kind), ("WARC-Record-ID", own), *common, *extra, ("Content-Type", "application/http; msgtype=response")], body),
        record([("WARC-Type", "metadata"), ("WARC-Record-ID", record_id(row, "metadata")), *common, ("WARC-Concurrent-To", own), ("Content-Type", "application/warc-fields")], fields),
    ]


def decide(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``rows`` (row, page_id, url, payload, digest, large) and ``first``, the row that a revisit refers to.

    Digests are grouped without their payloads. A bit for each repeated digest
    goes to the scan, so payloads that occur once aren't shuffled, and the
    digests of very many rows (at most one for each partition) are sent to it
    whole, so a payload that a third of the rows share isn't shuffled either.
    """
    spark = rows.sparkSession
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row")
    groups = rows.filter("large").select("digest", order.alias("o")).groupBy("digest").agg(F.min("o")["row"].alias("first"), F.count("*").alias("n"))
    groups = scratch.table(groups.filter("n > 1"), "repeated")
    total = groups.agg(F.sum("n")).first()[0] or 0
    hot = groups.filter(F.col("n") > max(100, total // partitions(spark))).select("digest", F.col("first").alias("hot")).collect()  # at most as many as partitions
    hot = spark.createDataFrame([(r["digest"], r["hot"]) for r in hot], "digest string, hot long")
    seen = marked(rows, groups, "digest", BITS).join(F.broadcast(hot), "digest", "left").withColumn("maybe", F.col("large") & F.col("_maybe") & F.col("hot").isNull())
    columns = ["row", "page_id", "url", "payload", "digest"]
    # a small payload is a response even if a large one, or a hot one, has its digest
    known = seen.filter("not maybe").select(*columns, F.when(F.col("large"), F.expr("nullif(hot, row)")).alias("first"))
    met = seen.filter("maybe").select(*columns).join(groups.select("digest", "first"), "digest", "left")
    return known.unionByName(met.select(*columns, F.expr("nullif(first, row)").alias("first")))


def write(pages: DataFrame, folder: str, scratch: Scratch, date: str = "2000-01-01T00:00:00Z") -> None:
    """Write ``pages`` (page_id, url, html) as archives in ``folder``."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"),
        F.monotonically_increasing_id().alias("row"),
    ).withColumns({"digest": F.sha2("payload", 256), "large": F.octet_length("payload") >= LEAST})

    def run(batches):
        from pyspark import TaskContext

        task, part = TaskContext.get().partitionId(), 0
        rows = (r for b in batches for r in zip(*(b.column(i).to_pylist() if i != 3 else b.column(i) for i in range(6))))
        row = next(rows, None)
        while row:
            with new_file(folder, f"{task:06d}-{part:04d}", ".warc.gz") as (out, published):
                out.write(record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(-1 - part, f"info {task}")), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], f"software: {SOFTWARE}\r\n".encode()))
                held = 0
                while row and held < ARCHIVE_BYTES:
                    n, page_id, url, payload, digest, first = row
                    for data in transaction(n, page_id, url, payload.as_py(), digest, first, date):
                        out.write(data)
                        held += len(data)
                    published["n"] += 1
                    row = next(rows, None)
            part += 1
            yield pa.RecordBatch.from_pylist([published])

    decided = decide(rows, scratch).select("row", "page_id", "url", "payload", "digest", "first")
    publish(decided.mapInArrow(run, MANIFEST), folder)


def members(stream, block: int = 1 << 20):
    """The decompressed members of a gzip file, one at a time."""
    data, packer, out = b"", zlib.decompressobj(31), []
    while True:
        if not data:
            data = stream.read(block)
            if not data:
                break
        out.append(packer.decompress(data))
        data = b""
        if packer.eof:
            data = packer.unused_data
            yield b"".join(out)
            packer, out = zlib.decompressobj(31), []
    if b"".join(out):
        raise EOFError("the archive ends within a record")


RECORD = "archive string, record_type string, record_id string, concurrent_to string, refers_to string, target_uri string, date string, payload_bytes long, payload_digest string, fields map<string,string>"


def parse(raw: bytes, archive: str, with_payload: bool) -> tuple:
    """A row for a record: for HTTP messages the payload follows their head; revisits keep the digest they name."""
    head, _, body = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"{archive}: not a WARC record")
    h = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    body = body[: int(h["content-length"])]
    kind, payload, fields = h.get("warc-type"), b"", None
    if h.get("content-type", "").startswith("application/http"):
        payload = body.partition(b"\r\n\r\n")[2]
    elif h.get("content-type") == "application/warc-fields":
        fields = [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in body.decode("utf-8", "replace").split("\r\n")) if k]
    digest = hashlib.sha256(payload).hexdigest() if kind == "response" else h.get("warc-payload-digest", "").rpartition(":")[2] or None
    if kind == "response" and "warc-payload-digest" in h and h["warc-payload-digest"] != f"sha256:{digest}":
        raise ValueError(f"{archive}: the payload of {h.get('warc-record-id')} doesn't match its digest")
    row = (archive, kind, h.get("warc-record-id"), h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"), h.get("warc-date"), len(payload), digest, fields)
    return (*row, payload) if with_payload else row


def read(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """One row for each record of the archives in ``folder``; ``payload`` (binary) if asked for."""
    types = [pa.string()] * 7 + [pa.int64(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary()]
    names = [f.split()[0] for f in RECORD.split(", ")] + ["payload"]
    width = 11 if with_payload else 10

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names[:width])

    def run(batches):
        system, path = open_fs(folder)
        for names in batches:
            for name in names.column(0).to_pylist():
                rows, held = [], 0
                with system.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for raw in members(stream):
                        rows.append(parse(raw, name, with_payload))
                        held += 500 + (len(rows[-1][-1]) if with_payload else 0)
                        if held > BATCH_BYTES:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)

    files = published(spark, folder, ".warc.gz")
    files = files.repartition(min(max(1, files.count()), READERS))
    return files.mapInArrow(run, RECORD + (", payload binary" if with_payload else ""))


def assemble(records: DataFrame) -> DataFrame:
    """Captures: record_id, request, response, metadata (structs; null if missing), n_requests, n_metadata.

    Records meet at the id of their response. A response may name its request
    instead; that link is turned round first. Of several requests or metadata
    records of one response, the one with the smallest id is kept and all are
    counted, so no list grows with the data.
    """
    answers = F.col("record_type").isin("response", "revisit")
    wanted = records.filter(answers | F.col("record_type").isin("request", "metadata"))
    turned = wanted.filter(answers & F.col("concurrent_to").isNotNull()).groupBy(F.col("concurrent_to").alias("record_id")).agg(F.min("record_id").alias("_answer"))
    others = wanted.filter(~answers).join(turned, "record_id", "left").withColumn("_at", F.coalesce("_answer", "concurrent_to", "record_id")).drop("_answer")
    both = wanted.filter(answers).withColumn("_at", F.col("record_id")).unionByName(others)
    kept = [c for c in records.columns if c not in ("fields", "record_id")]
    whole = F.struct("record_id", *kept)
    of = lambda kind: F.min(F.when(F.col("record_type") == kind, whole))
    fields = F.min(F.when(F.col("record_type") == "metadata", F.struct("record_id", *kept, F.array_sort(F.map_entries("fields")).alias("fields"))))
    return both.groupBy(F.col("_at").alias("record_id")).agg(
        of("request").alias("request"),
        F.min(F.when(F.col("record_type").isin("response", "revisit"), whole)).alias("response"),
        fields.alias("metadata"),
        F.count_if(F.col("record_type") == "request").alias("n_requests"),
        F.count_if(F.col("record_type") == "metadata").alias("n_metadata"),
    )


def op10_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all ``pages`` as WARC archives, read them back, and report each capture."""
    scratch = Scratch(spark, "warc")
    folder = scratch.folder("archives")
    write(spark.read.parquet(os.path.join(sf_dir, "pages.parquet")), folder, scratch)
    records = scratch.table(read(spark, folder), "records")  # the archives are parsed once
    captures = assemble(records).withColumn("page_id", F.expr("cast(nullif(map_from_entries(metadata.fields)['page-id'], '') as long)"))
    flat = captures.select("page_id", "record_id", F.col("response.record_type").alias("record_type"), F.col("response.payload_bytes").alias("own"), F.col("response.payload_digest").alias("payload_digest"), F.col("response.refers_to").alias("to"))
    flat = scratch.table(flat, "captures")
    targets = flat.filter("record_type = 'response'").select(F.col("record_id").alias("to"), F.col("page_id").alias("refers_to"), F.col("own").alias("there"))
    joined = flat.join(targets, "to", "left")
    size = F.when(F.col("record_type") == "revisit", F.col("there")).otherwise(F.col("own"))
    return joined.select("page_id", size.alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
  SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM p
), f AS (
  SELECT payload_digest, min(page_id) AS first_id FROM d WHERE payload_bytes >= 100 GROUP BY 1
)
SELECT d.page_id, CAST(d.payload_bytes AS BIGINT) AS payload_bytes, d.payload_digest,
       CASE WHEN f.first_id IS NULL OR f.first_id = d.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN f.first_id <> d.page_id THEN f.first_id END AS refers_to
FROM d LEFT JOIN f ON d.payload_digest = f.payload_digest AND d.payload_bytes >= 100
"""
