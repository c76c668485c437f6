"""The corpus pipeline: quality, language, near duplicates, packing.

Each stage takes (spark, docs, sf_dir), works on all that the one before it
kept, and returns a DataFrame; all but the last return the columns of
``documents``.

Defined results: null and empty texts are scored as texts without words and
have no language, so they go in the first or second stage; equal rows are
judged alike, and near duplicates keep one of them. Rows that share an id are
one document, of which the row with the smallest text stays; rows without an
id can't be grouped and stay. Columns may be null. An empty table gives an
empty result of each stage.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import jaccard_join, language_id, packing, quality
from spindrift.llm.common import Scratch, marked, small_batches
from spindrift.llm.tokens import default_path

#: A language is rejected below this share of the scores of all; four equal ones have 0.25.
LEAST_LANGUAGE = 0.3


def apart(docs: DataFrame) -> DataFrame:
    """``docs`` with all columns but doc_id and text under names that no stage uses for its own."""
    return docs.toDF(*(c if c in ("doc_id", "text") else f"column_{i}" for i, c in enumerate(docs.columns)))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    small_batches(spark)
    model = quality.train(docs, spark.read.parquet(os.path.join(sf_dir, "labels.parquet")), 5, 0)
    rows = apart(docs)
    return quality.score(rows, model).filter(F.col("score") >= quality.THRESHOLD).select(rows.columns).toDF(*docs.columns)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; all of them if no document names its language."""
    small_batches(spark)
    model = language_id.train(docs, 3, 1)
    if model is None:
        return docs
    rows = apart(docs)
    found = language_id.predict(rows, model)
    return found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE)).select(rows.columns).toDF(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id.

    Most documents stay and are passed on as they are. A bit for each id that
    goes, or that several rows share, leads to the scan, so only such rows are
    shuffled with their texts; documents without an id stay.
    """
    scratch = Scratch(spark, "groups")
    names, docs = docs.columns, apart(docs)
    groups = jaccard_join.near_duplicates(docs, scratch).filter("doc_id is not null").groupBy(F.col("doc_id").alias("_id"))
    groups = groups.agg(F.count("*").alias("_n"), F.bool_or(F.col("doc_id") == F.col("component_id")).alias("_kept"))
    look = scratch.table(groups.filter("_n > 1 or not _kept"), "look")
    rows = marked(docs.withColumn("_id", F.col("doc_id").cast("long")), look, "_id").withColumn("_maybe", F.col("_maybe") & F.col("_id").isNotNull())
    met = rows.filter("_maybe").join(look, "_id", "left")
    order = F.struct("text", *(c for c in docs.columns if c not in ("doc_id", "text")))
    several = met.filter("_n > 1 and _kept").groupBy("doc_id").agg(F.min(order).alias("row")).select("doc_id", "row.*").select(docs.columns)
    return rows.filter("not _maybe").select(docs.columns).unionByName(met.filter("_n is null").select(docs.columns)).unionByName(several).toDF(*names)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each document's pieces in sequences of at most 4096 tokens."""
    return packing.pack(docs, default_path("word_bpe_49k.json"), 1, 4096, Scratch(spark, "packing"))


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("packing", packing_stage),
]

#: The classifiers and the packing can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each written as Parquet and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return docs
