"""Knowledge tracing: event deltas, decayed mastery, history, profiles and trends."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Base delta and outcome weight of each event type.
DELTAS = {
    "qa_high_confidence": (0.06, 1.0), "qa_low_confidence": (0.0, 1.0), "quiz_correct": (0.10, 1.0), "quiz_partial": (0.03, 0.5),
    "quiz_wrong": (-0.06, 1.0), "grading_excellent": (0.12, 1.0), "grading_pass": (0.05, 1.0), "grading_fail": (-0.08, 1.0),
}
CORE = {"data_structure": 57, "computer_organization": 40, "operating_system": 45, "computer_network": 42}
Z = 1.96


def event_delta(event_type: Column, difficulty: Column, outcome: Column, penalty_by_failure: bool = False) -> Column:
    """Change of mastery by an event; unknown types change nothing.

    Gains grow with difficulty and count at least 0.3 of the outcome; losses
    shrink with difficulty and are multiplied by the outcome, or by its
    complement with ``penalty_by_failure``.
    """
    share = (1 - outcome) if penalty_by_failure else outcome
    out = F.lit(0.0)
    for kind, (base, weight) in DELTAS.items():
        value = base * difficulty * weight * F.greatest(outcome, F.lit(0.3)) if base > 0 else base * (1.0 / difficulty) * weight * share
        out = F.when(event_type == kind, value).otherwise(out)
    return out


def wilson(positive: Column, negative: Column) -> Column:
    """Lower bound of the Wilson interval, from 0 to 1; 0 without trials."""
    n = (positive + negative).cast("double")
    p = positive / n
    lower = (p + Z * Z / (2 * n) - Z * F.sqrt((p * (1 - p) + Z * Z / (4 * n)) / n)) / (1 + Z * Z / n)
    return F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), lower))).otherwise(0.0)


def retained(mastery: Column, confidence: Column, hours: Column) -> Column:
    """Mastery after ``hours``: unchanged within a day, then exponential decay that confidence slows."""
    return F.when(hours < 24, mastery).otherwise(mastery * F.exp(-hours / (72 * (1 + confidence * 4))))


def hours_between(earlier: Column, later: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 3.6e9


def step(state: tuple | None, ts_us: int, delta: float) -> tuple[tuple, float]:
    """The state (ts_us, mastery, confidence, positive, negative) after an event, and the change that history records."""
    gain = delta >= 0
    if state is None:
        before, positive, negative = 0.0, int(gain), int(not gain)
        mastery = max(0.0, min(1.0, delta))
    else:
        at, before, confidence, positive, negative = state
        hours = (ts_us - at) / 3.6e9
        kept = before if hours < 24 else before * math.exp(-hours / (72 * (1 + confidence * 4)))
        positive, negative = positive + gain, negative + (not gain)
        mastery = max(0.0, min(1.0, kept + delta))
    n = positive + negative
    p = positive / n
    lower = (p + Z * Z / (2 * n) - Z * math.sqrt((p * (1 - p) + Z * Z / (4 * n)) / n)) / (1 + Z * Z / n)
    after = (ts_us, mastery, max(0.0, min(1.0, lower)), positive, negative)
    return after, delta if state is None else mastery - before


HISTORY = "user_id long, kp long, seq long, created_at timestamp, event_id long, event_type string, mastery double, confidence double, positive long, negative long, delta double, effective_score double"


def history(events: DataFrame) -> DataFrame:
    """One row for each event with the state after it, in the order of (ts, event_id) of its user and point.

    ``events``: user_id, kp, ts, event_id, event_type, delta. Each state
    depends on the decayed one before it, so a pair's events are one ordered
    fold. Rows arrive sorted and stream through: a task keeps one state, not a
    pair's events.
    """

    def run(batches):
        key = state = None
        seq = 0
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(6)]
            out = [[] for _ in range(7)]
            for user, kp, ts_us, _, _, delta in zip(*cols):
                if (user, kp) != key:
                    key, state, seq = (user, kp), None, 0
                state, change = step(state, ts_us, delta)
                seq += 1
                for column, value in zip(out, (seq, state[1], state[2], state[3], state[4], change, state[1] * state[2])):
                    column.append(value)
            seqs, mastery, confidence, positive, negative, change, score = out
            longs, doubles = (lambda x: pa.array(x, pa.int64())), (lambda x: pa.array(x, pa.float64()))
            created = batch.column(2).cast(pa.timestamp("us")).cast(pa.timestamp("us", "UTC"))
            arrays = [batch.column(0), batch.column(1), longs(seqs), created, batch.column(3), batch.column(4), doubles(mastery), doubles(confidence), longs(positive), longs(negative), doubles(change), doubles(score)]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in HISTORY.split(", ")])

    rows = events.select(
        F.col("user_id").cast("long"), F.col("kp").cast("long"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), F.col("event_id").cast("long"), F.col("event_type").cast("string"), F.col("delta").cast("double")
    )
    return rows.repartition("user_id", "kp").sortWithinPartitions("user_id", "kp", "ts_us", "event_id").mapInArrow(run, HISTORY)


def states(rows: DataFrame) -> DataFrame:
    """The last state of each (user, kp) of a history: mastery, confidence, interactions, last_interaction_at."""
    last = F.max_by(F.struct("mastery", "confidence", "created_at", "event_type"), "seq")
    return rows.groupBy("user_id", "kp").agg(last.alias("s"), F.max("seq").alias("interactions")).select("user_id", "kp", "s.mastery", "s.confidence", "interactions", F.col("s.created_at").alias("last_interaction_at"), "s.event_type")


def effective(rows: DataFrame, as_of: Column) -> DataFrame:
    """Add effective mastery and score as of a moment."""
    m = retained(F.col("mastery"), F.col("confidence"), hours_between(F.col("last_interaction_at"), as_of))
    return rows.withColumn("effective_mastery", m).withColumn("effective_score", F.col("effective_mastery") * F.col("confidence"))


def profile(rows: DataFrame, registry: DataFrame, core: dict[str, int] | None = None) -> DataFrame:
    """Per user and category: tracked, mastered (0.6 and more), weak (under 0.3), means; core categories always appear.

    ``rows`` are effective states with a category, ``registry`` (kp, category).
    """
    totals = registry.filter("category <> ''").groupBy("category").agg(F.count("*").alias("registered"))
    stats = rows.groupBy("user_id", "category").agg(
        F.count("*").alias("tracked"), F.count_if(F.col("effective_score") >= 0.6).alias("mastered"), F.count_if(F.col("effective_score") < 0.3).alias("weak"),
        F.round(F.avg("effective_mastery"), 3).alias("avg_mastery"), F.round(F.avg("effective_score"), 3).alias("avg_score"),
    )
    fallback = F.lit(None).cast("long")
    if core:  # a user's categories are few, so the missing ones are added to their list and the states are read once
        fallback = F.try_element_at(F.create_map(*(F.lit(x) for pair in core.items() for x in pair)), F.col("category")).cast("long")
        fields = ("tracked", "mastered", "weak", "avg_mastery", "avg_score")
        lists = stats.groupBy("user_id").agg(F.collect_list(F.struct("category", *fields)).alias("c"))
        empty = lambda x: F.struct(x.alias("category"), *(F.lit(None).cast(stats.schema[f].dataType).alias(f) for f in fields))
        missing = F.transform(F.filter(F.array(*map(F.lit, core)), lambda x: ~F.exists("c", lambda y: y["category"] == x)), empty)
        stats = lists.select("user_id", F.explode(F.concat("c", missing)).alias("r")).select("user_id", "r.*")
    stats = stats.withColumn("fallback", fallback)
    out = stats.join(totals, "category", "left")
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("tracked", "mastered", "weak")} | {c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("avg_mastery", "avg_score")}
    out = out.withColumns(zero).withColumn("total", F.coalesce("registered", "fallback", "tracked"))
    return out.select("user_id", "category", "tracked", "mastered", "weak", "avg_mastery", "avg_score", "total")


def weak_points(rows: DataFrame, registry: DataFrame, threshold: float = 0.3, limit: int = 10) -> DataFrame:
    """The weakest known points of each user below the threshold, weakest first."""
    weak = rows.filter(F.col("effective_score") < threshold).join(registry, "kp")
    w = Window.partitionBy("user_id").orderBy("effective_score", "kp")
    return weak.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= limit)


def daily_trend(rows: DataFrame) -> DataFrame:
    """Means, number and kinds of events of each user and day.

    A tiny amount settles means that lie between two roundings.
    """
    return rows.groupBy("user_id", F.to_date("created_at").alias("day")).agg(
        F.round(F.avg("mastery") + 1e-9, 3).alias("avg_mastery"), F.round(F.avg("effective_score") + 1e-9, 3).alias("avg_effective_score"), F.count("*").alias("event_count"),
        F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("event_types"),
    )


def time_ago(hours: Column) -> Column:
    """Text for a time span: now, minutes, hours or days, rounded down."""
    return (
        F.when(hours * 60 < 1, "刚刚")
        .when(hours < 1, F.concat(F.floor(hours * 60).cast("string"), F.lit("分钟前")))
        .when(hours < 24, F.concat(F.floor(hours).cast("string"), F.lit("小时前")))
        .otherwise(F.concat(F.floor(hours / 24).cast("string"), F.lit("天前")))
    )


def grading_event(answer: Column) -> tuple[Column, Column, Column]:
    """(event type, outcome, difficulty) of a graded answer: the score of 100 after its label, 50 without one."""
    score = F.coalesce(F.regexp_extract(answer, "评分[：:]\\s*(\\d+)\\s*/\\s*100", 1).try_cast("long"), F.lit(50))
    kind = F.when(score >= 80, "grading_excellent").when(score >= 50, "grading_pass").otherwise("grading_fail")
    level = F.regexp_extract(answer, "难度[：:]\\s*(基础|理解|综合|创新)", 1)
    difficulty = F.when(level == "基础", 1.0).when(level == "综合", 1.6).when(level == "创新", 2.0).otherwise(1.3)
    return kind, score / 100.0, difficulty
