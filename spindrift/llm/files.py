"""Files that tasks write and read in the shared folder, by pyarrow's file systems.

A task writes each of its files once, under a name that no other attempt uses,
and returns a row for it: name, bytes, n. Spark writes these rows as the
manifest of the folder and commits those of one attempt of each task, so the
files of lost and of speculative attempts are never read, and nothing is
renamed or overwritten.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

MANIFEST = "name string, bytes long, n long"


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI: local, HDFS, and object stores, by Hadoop's names for them too."""
    scheme, mark, rest = uri.partition("://")
    return fs.FileSystem.from_uri(("s3" if scheme in ("s3a", "s3n") else scheme) + mark + rest)


@contextmanager
def new_file(folder: str, name: str, suffix: str):
    """(stream, row) of a new file; ``row`` is complete when the block has ended, but for ``n``."""
    system, path = open_fs(folder)
    system.create_dir(path, recursive=True)
    row = {"name": f"{name}-{uuid.uuid4().hex[:12]}{suffix}", "bytes": 0, "n": 0}
    with system.open_output_stream(f"{path}/{row['name']}", compression=None) as out:
        yield out, row
        row["bytes"] = out.tell()


def publish(rows: DataFrame, folder: str) -> None:
    """Write the manifest of a folder; its files are written by the same job."""
    rows.write.parquet(f"{folder}/manifest")


def listing(uri: str, suffix: str) -> list[tuple[str, int]]:
    """(path, size) of the published files in a folder, by name; all files of a folder without a manifest."""
    system, path = open_fs(uri)
    if system.get_file_info(f"{path}/manifest").type == fs.FileType.NotFound:
        found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
        return sorted((f.path, f.size) for f in found if f.is_file and f.path.endswith(suffix))
    rows = ds.dataset(f"{path}/manifest", filesystem=system, format="parquet").to_table(["name", "bytes"]).to_pylist()
    return sorted((f"{path}/{r['name']}", r["bytes"]) for r in rows)


def published(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """name of the files in a folder, as a table."""
    system, path = open_fs(folder)
    if system.get_file_info(f"{path}/manifest").type == fs.FileType.NotFound:
        return spark.createDataFrame([(p.rpartition("/")[2],) for p, _ in listing(folder, suffix)], "name string")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").select("name")
