"""Knowledge tracing as streams: mastery per user and point, daily trends, late events.

The state of a user holds the last state of each of its points and the events
that the watermark hasn't passed; they are applied in the order of (ts, event_id)
once it has, so the result equals the batch fold on the same events. One state
for each user, not each point, leaves far fewer groups to call Python for. Events
older than what was applied go to the late output. A stream that ends closes
with ``closing_row``, whose time moves the watermark past all events; without
it the last events and windows would stay in the state.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.tracing import step

OUTPUT = "user_id long, kp long, event_id long, ts timestamp, mastery double, confidence double, delta double, late boolean"
STATE = "points array<struct<kp: long, ts_us: long, mastery: double, confidence: double, positive: long, negative: long>>, pending array<struct<ts_us: long, event_id: long, delta: double, kp: long>>"


def _update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last, pending = {}, []
    if state.exists:
        points, kept = state.get
        last = {kp: tuple(rest) for kp, *rest in points or []}
        pending = [tuple(x) for x in kept or []]
    rows = []
    for batch in batches:
        points = batch["kp"].astype(object).where(batch["kp"].notna(), None)
        for at, event_id, delta, kp in zip((batch["ts"].to_numpy("datetime64[ns]").astype("int64") // 1000).tolist(), batch["event_id"].tolist(), batch["delta"].tolist(), points):
            kp = None if kp is None else int(kp)
            if kp in last and at < last[kp][0]:
                rows.append((kp, event_id, at, None, None, delta, True))
            else:
                pending.append((at, event_id, delta, kp))
    mark = state.getCurrentWatermarkMs() * 1000
    pending.sort(key=lambda e: e[:3])
    n = bisect.bisect_left(pending, mark, key=lambda e: e[0])
    ready, pending = pending[:n], pending[n:]
    for at, event_id, delta, kp in ready:
        last[kp], change = step(last.get(kp), at, delta)
        rows.append((kp, event_id, at, last[kp][1], last[kp][2], change, False))
    state.update(([(kp, *x) for kp, x in last.items()], pending))
    if pending:
        state.setTimeoutTimestamp(max(pending[0][0] // 1000 + 1, state.getCurrentWatermarkMs() + 1))
    if rows:
        kp, event_id, at, mastery, confidence, change, late = zip(*rows)
        out = {"kp": pd.array(kp, "Int64"), "event_id": event_id, "ts": np.array(at, "datetime64[us]"), "mastery": np.array(mastery, float), "confidence": np.array(confidence, float), "delta": change, "late": late}
        yield pd.DataFrame({"user_id": pd.array([key[0]] * len(rows), "Int64"), **out})


def mastery_stream(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Mastery after each event of a stream (user_id, kp, ts, event_id, delta); late events carry no mastery."""
    marked = events.withWatermark("ts", delay).select("user_id", "kp", "ts", "event_id", "delta")
    return marked.groupBy("user_id").applyInPandasWithState(_update, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def closing_row(events: DataFrame, days: int = 3650) -> DataFrame:
    """One row for the end of ``events`` (user_id, kp, ts, event_id, delta): user -1, long after the last event, never part of a result."""
    last = events.agg((F.max("ts") + F.expr(f"INTERVAL {days} DAYS")).alias("ts")).filter("ts is not null")
    return last.select(F.lit(-1).cast("long").alias("user_id"), F.lit(-1).cast("long").alias("kp"), "ts", F.lit(-1).cast("long").alias("event_id"), F.lit(0.0).alias("delta"))


def daily_trend_stream(states: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Means and number of events of each user and day, as days close."""
    daily = states.withWatermark("ts", delay).groupBy("user_id", F.window("ts", "1 day")).agg(F.round(F.avg("delta"), 9).alias("avg_delta"), F.count("*").alias("event_count"))
    return daily.select("user_id", F.to_date("window.start").alias("day"), "avg_delta", "event_count")


def session_stream(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Study sessions of each user: start, end, number of events."""
    out = events.withWatermark("ts", delay).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("event_count"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_count")
