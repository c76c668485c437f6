import hashlib
import zlib

import pandas as pd
import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from spindrift.llm import media, warc
from spindrift.llm.common import Scratch
from spindrift.llm.files import listing, open_fs

from ..oracle import by_spark, by_sql
from .fixtures import documents, empty


def test_png_round_trip():
    for data in (b"", b"abc", b"x" * 192, bytes(range(256)) * 9):
        payload = media.pad(data)
        assert len(payload) % 192 == 0 and payload.startswith(data)
        assert media.from_png(media.to_png(payload, len(data))) == (payload, len(data))


def test_damaged_image():
    image = bytearray(media.to_png(media.pad(b"abc"), 3))
    image[60] ^= 1
    with pytest.raises((ValueError, zlib.error)):
        media.from_png(bytes(image))


def test_archives_give_back_every_row(spark, monkeypatch):
    docs = documents(spark).repartition(3)
    folder = Scratch(spark, "t").folder("a")
    media.write_archives(docs, folder)
    found = media.read_archives(spark, folder, rangeBytes="1000")
    assert found.rdd.getNumPartitions() > 5
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["payload_sha256"], r["tail_crc32"], r["media_sha256"]) for r in media.describe(found).collect())
    expected = []
    for r in docs.collect():
        data = (r["text"] or "").encode()
        payload = media.pad(data)
        expected.append((-1 if r["doc_id"] is None else r["doc_id"], len(data), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), hashlib.sha256(media.to_png(payload, len(data))).hexdigest()))
    assert got == sorted(expected)


def test_a_bad_member_is_told_and_others_are_read(spark):
    folder = Scratch(spark, "t").folder("a")
    media.write_archives(documents(spark, [(1, "one"), (2, "two" * 999), (3, "three")]).coalesce(1), folder)
    path, _ = listing(folder, ".zip")[0]
    with open(path, "r+b") as f:
        data = f.read()
        at = data.index(media.SIGNATURE, data.index(media.SIGNATURE) + 10) + 70
        f.seek(at)
        f.write(bytes([data[at] ^ 1]))
    rows = {r["doc_id"]: r["error"] for r in media.read_archives(spark, folder, strict="false").collect()}
    assert rows[1] is None and rows[3] is None and "CRC" in rows[2]
    with pytest.raises(Exception, match="CRC"):
        media.read_archives(spark, folder).collect()


def test_empty_media(spark):
    folder = Scratch(spark, "t").folder("a")
    media.write_archives(empty(spark), folder)
    assert media.describe(media.read_archives(spark, folder)).collect() == []


PAGES = [(5, "http://a/x", "p" * 200), (3, "http://b/y?z", "p" * 200), (4, None, "p" * 200), (1, "u\r\nEvil: 1", "small"), (2, "http://c", "small"), (6, "http://d", None), (7, "http://e", ""), (8, "http://f", "é" * 60), (9, "http://g", "é" * 60)]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, digest string, row string")


def captured(spark, rows, tmp_path):
    folder = str(tmp_path / "sf")
    pages(spark, rows).write.parquet(f"{folder}/pages.parquet")
    return warc.op10_warc_transactions(spark, folder)


def test_warc_against_sql(spark, tmp_path):
    expected = by_sql(warc.ORACLE, {"pages": pd.DataFrame(PAGES, columns=["page_id", "url", "html"])})
    assert by_spark(captured(spark, PAGES, tmp_path)) == expected


def test_repeated_rows_and_null_ids(spark, tmp_path):
    rows = [(1, "u", "q" * 300), (1, "u", "q" * 300), (None, "v", "q" * 300), (None, None, None)]
    got = sorted((r["page_id"] or -1, r["record_type"], r["refers_to"], r["payload_bytes"]) for r in captured(spark, rows, tmp_path).collect())
    assert got == [(-1, "response", None, 0), (-1, "revisit", 1, 300), (1, "response", None, 300), (1, "revisit", 1, 300)]


def test_empty_warc(spark, tmp_path):
    assert captured(spark, [], tmp_path).collect() == []


def test_assembly_by_either_side(spark):
    rows = [("request", "q1", None), ("response", "r1", "q1"), ("metadata", "m1", "r1"), ("request", "q2", "r2"), ("request", "q2b", "r2"), ("response", "r2", None), ("metadata", "m3", "gone"), ("warcinfo", "w", None)]
    records = spark.createDataFrame(rows, "record_type string, record_id string, concurrent_to string").withColumn("fields", F.create_map(F.lit("k"), F.lit("v")))
    got = {r["record_id"]: r for r in warc.assemble(records).collect()}
    assert set(got) == {"r1", "r2", "gone"}
    assert got["r1"]["request"]["record_id"] == "q1" and got["r1"]["metadata"]["record_id"] == "m1"
    assert got["r2"]["request"]["record_id"] == "q2" and got["r2"]["n_requests"] == 2 and got["r2"]["metadata"] is None
    assert got["gone"]["response"] is None and got["gone"]["n_metadata"] == 1


def test_payloads_are_read_back(spark):
    scratch = Scratch(spark, "t")
    folder = scratch.folder("w")
    warc.write(pages(spark), folder, scratch)
    rows = warc.read(spark, folder, with_payload=True).filter("record_type = 'response'").collect()
    assert {bytes(r["payload"]).decode() for r in rows} == {"p" * 200, "small", "", "é" * 60}
    assert not any("Evil" in (r["target_uri"] or "") and "\n" in r["target_uri"] for r in rows)


def test_a_task_writes_several_archives(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 1)
    monkeypatch.setattr(media, "ARCHIVE_BYTES", 1)
    scratch = Scratch(spark, "t")
    folder, docs = scratch.folder("w"), documents(spark).coalesce(2)
    warc.write(pages(spark).coalesce(1), folder, scratch)
    assert len(listing(folder, ".warc.gz")) == len(PAGES)
    assert warc.read(spark, folder).filter("record_type in ('response', 'revisit')").count() == len(PAGES)
    media.write_archives(docs, scratch.folder("m"))
    folder = f"{scratch.path}/{scratch._n:02d}-m"
    assert len(listing(folder, ".zip")) == docs.count() == media.read_archives(spark, folder).count()


def test_files_of_lost_attempts_are_not_read(spark):
    """A second attempt that deals its rows otherwise leaves files, but only what the manifest names is read, each row once."""
    scratch = Scratch(spark, "t")
    folder, other = scratch.folder("w"), scratch.folder("other")
    warc.write(pages(spark), folder, scratch)
    warc.write(pages(spark, PAGES[::-1]).coalesce(1), other, scratch)
    system, path = open_fs(folder)
    for lost, _ in listing(other, ".warc.gz"):
        fs.copy_files(lost, f"{path}/{lost.rpartition('/')[2]}", system, system)
    ids = [r["fields"]["page-id"] for r in warc.read(spark, folder).filter("record_type = 'metadata'").collect()]
    assert sorted(map(int, ids)) == sorted(r[0] for r in PAGES)
    docs = documents(spark)
    folder = scratch.folder("m")
    media.write_archives(docs, folder)
    with open(f"{open_fs(folder)[1]}/000000-0000-lost.zip", "wb") as f:
        f.write(b"part of an arch")
    assert media.read_archives(spark, folder).count() == docs.count()


def test_hot_payloads_and_marks_of_digests(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BITS", 4)  # most marks are shared by several digests
    rows = [(i, "u", "h" * 200) for i in range(400, 0, -1)] + [(1000 + i, "u", f"{i % 40:0100d}") for i in range(80)] + [(2000 + i, "u", f"{i} alone" * 30) for i in range(40)]
    expected = by_sql(warc.ORACLE, {"pages": pd.DataFrame(rows, columns=["page_id", "url", "html"])})
    assert by_spark(captured(spark, rows, tmp_path)) == expected
