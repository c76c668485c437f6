"""Queries of chunking and streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import chunking, enhance, layout
from ..streaming import cache, tracking
from ..sources.files import scratch, shared_folder
from .registry import query, table
from .tracing_queries import EVENTS_SQL, HISTORY_SQL, _events, _expanded


@query()
def chunk_greedy(spark, sf_dir):
    return chunking.chunks(table(spark, sf_dir, "documents"), 400, 100)


@query()
def chunk_adaptive(spark, sf_dir):
    """Each section with the size and overlap of its content type."""
    return chunking.chunks(table(spark, sf_dir, "documents"))


@query()
def layout_sections(spark, sf_dir):
    """The sections of every document by its titles, or by its subjects where it has none."""
    return layout.layout_sections(table(spark, sf_dir, "documents"))


@query("SELECT doc_id, CAST(length(text) AS BIGINT) AS covered, length(text) > 2000 AS long FROM documents WHERE text <> ''")
def layout_cover(spark, sf_dir):
    """What the sections of every document cover together, if none leaves a gap or overlaps the next; null otherwise."""
    w = Window.partitionBy("doc_id").orderBy("section")
    rows = layout_sections(spark, sf_dir).withColumn("gap", F.col("start") != F.coalesce(F.lag("end").over(w), F.lit(0)))
    whole = rows.groupBy("doc_id").agg(F.bool_or("gap").alias("gap"), F.sum(F.col("end") - F.col("start")).alias("n"), F.bool_or(F.col("method") != "whole").alias("long"))
    return whole.select("doc_id", F.when(~F.col("gap"), F.col("n")).alias("covered"), "long")


@query()
def semantic_cache_stream(spark, sf_dir):
    """All vectors as probes of a cache for each label, within an hour of event time."""
    v = table(spark, sf_dir, "embeddings").filter("label is not null and vec_id is not null")
    ts = F.timestamp_seconds(F.lit(1_700_000_000) + F.pmod(F.col("vec_id"), F.lit(3600)))
    probes = v.select(F.col("label").alias("collection"), F.col("vec_id").alias("probe_id"), ts.alias("ts"), "embedding")
    return cache.answered(spark, scratch(spark, "cache"), probes).select("collection", "probe_id", "entry_id", "similarity", "hit")


@query()
def textrank_keywords(spark, sf_dir):
    """The eight best words of every document by TextRank."""
    found = enhance.text_rank(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.posexplode("words").alias("place", "w")).select("doc_id", (F.col("place") + 1).alias("rank"), "w.word", "w.weight")


@query(r"""
WITH c AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS t, CASE WHEN doc_id % 3 > 0 THEN '[' || coalesce(lang, 'xx') || ' > 第 题]' END AS heading FROM documents),
k AS (SELECT *, CASE WHEN t = '' THEN 'empty' WHEN doc_id % 11 = 0 THEN 'merged_qa' WHEN contains(t, '```') OR contains(t, '~~~') OR regexp_matches(text, '(^|\n)\s{4,}\S') THEN 'code_mixed'
    WHEN regexp_matches(t, '(^|\n)\|.+\|(\n|$)') AND regexp_matches(t, '(^|\n)\|[-:| ]+\|(\n|$)') THEN 'table' WHEN regexp_matches(t, '(?s)\$\$.+?\$\$') THEN 'formula' WHEN regexp_matches(text, '(^|\n)#{1,4}\s+') THEN 'section'
    WHEN regexp_matches(text, '(^|\n)\s*[-*+]\s+') OR regexp_matches(text, '(^|\n)\s*\d+[.)、]\s+') THEN 'list' WHEN heading IS NOT NULL THEN 'exercise'
    WHEN regexp_matches(text, 'def |class |import |from .* import ') THEN 'code_mixed' ELSE 'text' END AS content_type FROM c)
SELECT doc_id, CASE WHEN heading IS NULL THEN '' ELSE replace(heading[2:-2], ' > ', ', ') END AS heading_keywords, CASE WHEN heading IS NULL THEN '' ELSE replace(replace(lower(heading[2:-2]), ' > ', '/'), ' ', '-') END AS heading_slug, heading IS NOT NULL AS has_heading, content_type,
  content_type IN ('section', 'list', 'exercise', 'answer', 'code_mixed', 'merged_qa') AS is_structured, contains(text, '```') OR contains(text, '~~~') OR regexp_matches(text, '(^|\n)\s{4,}\S') AS has_code_block,
  CASE WHEN text = '' THEN 0 ELSE len(string_split(regexp_replace(text, '\n$', ''), chr(10))) END AS line_count, greatest(1, len(regexp_extract_all(text, '[\x00-\x7f]')) // 4 + length(text) - len(regexp_extract_all(text, '[\x00-\x7f]'))) AS estimated_tokens,
  'Note.' || doc_id AS source_name, '.md' AS source_ext FROM k
""")
def enhanced_documents(spark, sf_dir):
    """The fields of the enhancer for every document as one chunk, but for its words, which ``textrank_keywords`` gives."""
    i = F.col("doc_id")
    heading = F.when(i % 3 > 0, F.concat(F.lit("["), F.coalesce("lang", F.lit("xx")), F.lit(" > 第 题]")))
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", F.concat(F.lit("a.b/"), F.lit("Note."), i, F.lit(".MD")).alias("source"), F.when(i % 11 == 0, "merged_qa").alias("role"), heading.alias("heading_path"), "text")
    return enhance.enhance(rows).drop("source", "role", "heading_path", "text", "keywords")


@query("SELECT doc_id, len(list_filter(regexp_split_to_array(regexp_replace(text, '([。！？；.!?;])', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '')) AS n FROM documents")
def sentence_split(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(chunking.split_sentences(F.col("text"))).cast("long").alias("n"))


def _stream(spark, sf_dir, build):
    """Run a stream over the events to its end and read its output."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex[:12]}"
    rows = _events(spark, sf_dir).select("user_id", "kp", "ts", "event_id", "delta")
    rows.unionByName(tracking.closing_row(rows)).write.parquet(f"{folder}/events")
    events = spark.readStream.schema("user_id long, kp long, ts timestamp, event_id long, delta double").parquet(f"{folder}/events")
    out = build(events)
    q = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out").filter("user_id >= 0")


@query(_expanded(f"""
WITH RECURSIVE {HISTORY_SQL}
SELECT user_id, kp, event_id, round(mastery, 9) AS mastery, round(confidence, 6) AS confidence, round(change, 9) AS delta, false AS late FROM h
"""))
def stream_mastery(spark, sf_dir):
    out = _stream(spark, sf_dir, lambda e: tracking.mastery_stream(e, "1 minute"))
    return out.select("user_id", "kp", "event_id", F.round("mastery", 9).alias("mastery"), F.round("confidence", 6).alias("confidence"), F.round("delta", 9).alias("delta"), "late")


@query(f"WITH {EVENTS_SQL} SELECT user_id, CAST(ts AS DATE) AS day, round(avg(delta), 9) AS avg_delta, count(*) AS event_count FROM dl GROUP BY ALL")
def stream_daily_trend(spark, sf_dir):
    return _stream(spark, sf_dir, lambda e: tracking.daily_trend_stream(e, "1 minute"))


@query(f"""
WITH {EVENTS_SQL}, g AS (
  SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM dl
), n AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts) + INTERVAL 30 MINUTE) AS end_us, count(*) AS event_count FROM n GROUP BY user_id, session
""")
def stream_sessions(spark, sf_dir):
    out = _stream(spark, sf_dir, lambda e: tracking.session_stream(e, delay="1 minute"))
    return out.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "event_count")
