"""A semantic cache as the state of a stream: similar questions are answered from what was stored, in event time.

Each collection has its own entries, at most ``capacity``. A probe that finds a
live entry similar enough is a hit and makes it the most recently used; any
other probe is stored as an entry, and the least recently used one goes when
there are too many. Entries live for ``ttl`` seconds; those that are past it go
at the next probe or when their timer is due.

Probes wait in the state until the watermark has passed them and are then
taken in the order of (ts, probe_id), so the result is that of a cache asked in
this order, however rows are dealt to files and batches. The state of a
collection is bounded by its entries and by the probes within the delay.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

OUTPUT = "collection long, probe_id long, ts timestamp, entry_id long, similarity double, hit boolean"
NAMES = [f.split()[0] for f in OUTPUT.split(", ")]
#: Similarity of a hit, seconds that an entry lives, entries of a collection.
THRESHOLD, TTL, CAPACITY = 0.88, 1800, 500
#: State that a processor keeps in lists and timers needs this store.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def unit(vector) -> np.ndarray | None:
    """The vector at length one; None for one without direction or with entries that aren't numbers."""
    if vector is None or not len(vector) or any(x is None for x in vector):
        return None
    v = np.asarray(vector, float)
    norm = float(np.sqrt(v @ v))
    return v / norm if np.isfinite(norm) and norm > 0 else None


class Entries:
    """The entries of a collection: number, when stored and last used (microseconds), and unit vector of each."""

    def __init__(self, rows, threshold: float, ttl: int, capacity: int):
        rows = list(rows)
        self.ids, self.stored, self.used = ([r[i] for r in rows] for i in range(3))
        self.vectors = [np.asarray(r[3], float) for r in rows]
        self.threshold, self.ttl, self.capacity = threshold, ttl * 1_000_000, capacity

    def rows(self) -> list[tuple]:
        return [(i, s, u, v.tolist()) for i, s, u, v in zip(self.ids, self.stored, self.used, self.vectors)]

    def drop(self, gone: list[int]) -> None:
        for k in sorted(gone, reverse=True):
            for some in (self.ids, self.stored, self.used, self.vectors):
                del some[k]

    def expire(self, at: int) -> None:
        self.drop([k for k, s in enumerate(self.stored) if at - s > self.ttl])

    def ask(self, probe: int, at: int, vector) -> tuple[int | None, float | None, bool]:
        """(entry, similarity, hit) of a probe, which is stored unless it is a hit; the smallest id of equally similar ones."""
        self.expire(at)
        v = unit(vector)
        if v is None:
            return None, None, False
        same = [k for k, x in enumerate(self.vectors) if len(x) == len(v)]
        best = None
        if same:
            score = np.round(np.stack([self.vectors[k] for k in same]) @ v, 6)
            best = min(zip((-score).tolist(), (self.ids[k] for k in same), same))
        if best is not None and -best[0] >= self.threshold:
            self.used[best[2]] = at
            return best[1], -best[0], True
        self.ids.append(probe)
        self.stored.append(at)
        self.used.append(at)
        self.vectors.append(v)
        if len(self.ids) > self.capacity:
            self.drop([min(range(len(self.ids)), key=lambda k: (self.used[k], self.ids[k]))])
        return (None, None, False) if best is None else (best[1], -best[0] + 0.0, False)


class CacheProcessor(StatefulProcessor):
    """Waiting probes and entries of a collection as list states, with a timer for the first that waits or expires."""

    def __init__(self, threshold: float, ttl: int, capacity: int):
        self.options = threshold, ttl, capacity

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ts_us long, probe_id long, embedding array<double>")
        self.entries = handle.getListState("entries", "id long, stored_us long, used_us long, vector array<double>")

    def _rest(self, entries: Entries, waiting: list[tuple]) -> None:
        """Keep what is left, and a timer for when it changes next."""
        for state, rows in ((self.waiting, waiting), (self.entries, entries.rows())):
            state.put(rows) if rows else state.clear()
        due = [w[0] // 1000 + 1 for w in waiting[:1]] + [(min(entries.stored) + entries.ttl) // 1000 + 1 for _ in entries.ids[:1]]
        for at in self.handle.listTimers():
            self.handle.deleteTimer(at[0] if isinstance(at, tuple) else at)
        if due:
            self.handle.registerTimer(min(due))

    def _held(self) -> tuple[Entries, list[tuple]]:
        return Entries(self.entries.get(), *self.options), [tuple(w) for w in self.waiting.get()]

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        entries, waiting = self._held()
        for batch in rows:
            for ts, probe, embedding in zip(batch["ts"], batch["probe_id"], batch["embedding"]):
                vector = None if embedding is None else [None if x is None else float(x) for x in embedding]
                waiting.append((int(pd.Timestamp(ts).value // 1000), int(probe), vector if unit(vector) is not None else []))
        yield self._answered(key, entries, waiting, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        yield self._answered(key, *self._held(), timerValues.getCurrentWatermarkInMs())

    def _answered(self, key: tuple, entries: Entries, waiting: list[tuple], mark: int) -> pd.DataFrame:
        waiting.sort(key=lambda w: w[:2])
        ready = [w for w in waiting if w[0] < mark * 1000]
        out = [(key[0], probe, pd.Timestamp(at, unit="us"), *entries.ask(probe, at, vector)) for at, probe, vector in ready]
        if not ready:
            entries.expire(mark * 1000)
        self._rest(entries, waiting[len(ready) :])
        frame = pd.DataFrame(out, columns=NAMES)
        return frame.astype({"entry_id": "Int64", "similarity": "float64", "hit": "bool"})

    def close(self) -> None:
        pass


def cache_stream(probes: DataFrame, threshold: float = THRESHOLD, ttl: int = TTL, capacity: int = CAPACITY, delay: str = "10 minutes") -> DataFrame:
    """A row for each probe of a stream (collection, probe_id, ts, embedding): its best live entry, similarity, and whether that is a hit.

    Vectors without direction find nothing and aren't stored. The session
    needs the settings in STORE when the stream starts.
    """
    rows = probes.select(F.col("collection").cast("long").alias("collection"), F.col("probe_id").cast("long").alias("probe_id"), "ts", F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.withWatermark("ts", delay).groupBy("collection").transformWithStateInPandas(CacheProcessor(threshold, ttl, capacity), OUTPUT, "append", "eventTime")


def answered(spark: SparkSession, folder: str, probes: DataFrame, **options) -> DataFrame:
    """Run all ``probes`` through a cache as a stream from files under ``folder``, to its end."""
    schema = "collection long, probe_id long, ts timestamp, embedding array<double>"
    rows = probes.select(F.col("collection").cast("long"), F.col("probe_id").cast("long"), "ts", F.col("embedding").cast("array<double>"))
    # a row long after all others moves the watermark past them; collection -1 is its own
    last = rows.agg((F.max("ts") + F.expr("INTERVAL 3650 DAYS")).alias("ts")).filter("ts is not null")
    end = last.select(F.lit(-1).cast("long").alias("collection"), F.lit(-1).cast("long").alias("probe_id"), "ts", F.expr("cast(array() as array<double>)").alias("embedding"))
    rows.write.parquet(f"{folder}/probes")
    end.write.mode("append").parquet(f"{folder}/probes")
    before = {k: spark.conf.get(k, None) for k in STORE}
    try:
        for k, v in STORE.items():
            spark.conf.set(k, v)
        out = cache_stream(spark.readStream.schema(schema).parquet(f"{folder}/probes"), **options)
        out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(OUTPUT).parquet(f"{folder}/out").filter("collection >= 0")
