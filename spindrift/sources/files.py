"""Sources and sinks: text files of unknown encoding, JSON lines, chunk collections, reports."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Encodings tried after UTF-8, and file types that can be read.
ENCODINGS = ("utf-8-sig", "gb18030", "gbk", "gb2312", "big5")
READABLE = ("txt", "md")

#: The temporary folder of a local session that names none.
_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share; a temporary one only if none is set and Spark is local."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _OWN.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="spindrift-")
        _OWN[spark.sparkContext.applicationId] = root
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for a stored table of one run, in the folder that driver and executors share."""
    root = shared_folder(spark)
    return f"{root if '://' in root else 'file://' + root}/spindrift-{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str = "rows") -> DataFrame:
    """``df`` written to a table of its own in the shared folder, and read back."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once and cut off from its lineage, in the folder that driver and executors share."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with their place (from 1) in ``order``: a range shuffle, a count for each range, and a window within each, so no task sees all rows."""
    spark = rows.sparkSession
    ranged = settled(rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("_range", F.spark_partition_id()))
    before, total = [], 0
    for r in sorted(ranged.groupBy("_range").count().collect()):  # one row for each range
        before.append((r["_range"], total))
        total += r["count"]
    bases = F.broadcast(spark.createDataFrame(before, "_range int, _base long"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.join(bases, "_range").withColumn(name, F.col("_base") + place).drop("_range", "_base")


def spread(df: DataFrame) -> DataFrame:
    """``df`` on all cores where its files give fewer partitions than there are cores; large tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


@functools.cache
def _decoder():
    @F.pandas_udf("string")
    def decode(contents: pd.Series) -> pd.Series:
        def one(data: bytes | None) -> str | None:
            if data is None:
                return None
            for name in ENCODINGS:
                try:
                    return data.decode(name)
                except UnicodeDecodeError:
                    continue
            return data.decode("utf-8", "replace")

        return contents.map(one)

    return decode


def decode(content: Column) -> Column:
    """Text of file bytes: UTF-8 on the JVM where it is valid, else the first encoding that fits, else with replacements."""
    return F.when(F.is_valid_utf8(content.cast("string")), F.regexp_replace(content.cast("string"), "^\ufeff", "")).otherwise(_decoder()(content))


def load(spark: SparkSession, path: str) -> DataFrame:
    """Files under a folder: source (relative path), ext, category (first folder), text, n_bytes, error.

    A file of another type gives a row with ``error``, so one bad file never
    stops the rest.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    relative = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "^" + _quoted(path.rstrip("/") + "/"), "")
    rows = files.select(relative.alias("source"), "content", F.col("length").alias("n_bytes"))
    ext = F.lower(F.regexp_extract("source", "\\.([^./]+)$", 1))
    ok = ext.isin(*READABLE)
    folder = F.regexp_extract("source", "^([^/]+)/", 1)
    return rows.select("source", ext.alias("ext"), F.when(folder != "", folder).alias("category"), F.when(ok, decode(F.col("content"))).alias("text"), "n_bytes", F.when(~ok, F.concat(F.lit("unsupported type: "), ext)).alias("error"))


def _quoted(text: str) -> str:
    return "\\Q" + text.replace("file://", "") + "\\E"


def safe_filename(name: Column) -> Column:
    """Base name without NUL and .., other odd characters as underscores; ``upload`` if nothing is left."""
    base = F.regexp_replace(F.regexp_replace(name, "\\x00", ""), "^.*[/\\\\]", "")
    clean = F.regexp_replace(F.replace(base, F.lit(".."), F.lit("")), "[^\\w.\\-\\u4e00-\\u9fff]", "_")
    return F.when(F.regexp_replace(clean, "[._]", "") == "", "upload").otherwise(clean)


EVAL = T.StructType([T.StructField("query", T.StringType()), T.StructField("reference", T.StringType()), T.StructField("metadata", T.MapType(T.StringType(), T.StringType()))])


def eval_samples(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Samples of JSON-lines files: set (file stem), query, reference, metadata. Blank, comment, broken and query-less lines are left out."""
    lines = spark.read.text(path).select(F.regexp_extract(F.col("_metadata.file_name"), "^(.*?)(?:\\.[^.]*)?$", 1).alias("set"), F.trim("value").alias("line"))
    lines = lines.filter((F.col("line") != "") & ~F.col("line").startswith("#"))
    parsed = lines.withColumn("j", F.from_json("line", EVAL)).filter("coalesce(j.query, '') <> ''")
    out = parsed.select("set", "j.query", F.coalesce("j.reference", F.lit("")).alias("reference"), "j.metadata")
    return out.limit(limit) if limit else out


def new_chunks(chunks: DataFrame, existing: DataFrame) -> DataFrame:
    """Chunks (collection, text, ...) with a content hash that their collection doesn't hold yet, once each."""
    hashed = chunks.withColumn("content_hash", F.substring(F.sha2("text", 256), 1, 16)).dropDuplicates(["collection", "content_hash"])
    return hashed.join(existing.select("collection", "content_hash"), ["collection", "content_hash"], "left_anti")


def append_chunks(chunks: DataFrame, path: str) -> int:
    """Append new chunks to a store partitioned by collection; returns how many."""
    spark = chunks.sparkSession
    try:
        existing = spark.read.parquet(path).select("collection", "content_hash")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        existing = spark.createDataFrame([], "collection string, content_hash string")
    fresh = new_chunks(chunks, existing)
    seen = spark.read.parquet(path).count() if existing.columns and existing.take(1) else 0
    fresh.write.mode("append").partitionBy("collection").parquet(path)
    return spark.read.parquet(path).count() - seen


def collection_info(store: DataFrame) -> DataFrame:
    """Collections with their number of chunks and whether that is healthy."""
    return store.groupBy("collection").agg(F.count("*").alias("chunks")).withColumn("status", F.when(F.col("chunks") > 0, "ok").otherwise("empty"))


def drop_collection(spark: SparkSession, path: str, collection: str) -> None:
    """Drop a collection's partition; nothing happens if there is none."""
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/collection={collection}")
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def migrate(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """Old columns under their new names where the new one is missing or null."""
    out = rows
    for old, new in names.items():
        if old in out.columns:
            value = F.coalesce(F.col(f"`{new}`"), F.col(f"`{old}`")) if new in out.columns else F.col(f"`{old}`")
            out = out.withColumn(new, value)
    return out


def scalar_columns(rows: DataFrame) -> DataFrame:
    """Columns that a flat store keeps: no lists, maps, structs, or names that begin with an underscore."""
    flat = [f.name for f in rows.schema if not f.name.startswith("_") and not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    return rows.select(*(f"`{c}`" for c in flat))


def write_report(rows: DataFrame, path: str, title: str) -> str:
    """JSON lines without ``raw_scores`` beside a Markdown table of a small report; returns the Markdown."""
    kept = rows.drop("raw_scores")
    kept.write.mode("overwrite").json(path)
    lines = [f"# {title}", "", "| " + " | ".join(kept.columns) + " |", "|" + "---|" * len(kept.columns)]
    lines += ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in kept.limit(1000).collect()]  # a report page
    return "\n".join(lines)
