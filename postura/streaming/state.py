"""Live traces on Spark's state API: setup depth, bounded distinct values and bounded sessions, with state that expires.

The operators run with the RocksDB state store, which keeps state outside of the heap and
checkpoints what changed: with_state_store() asks for it. Timers go off with the next batch of
data, as batches without data, which would follow each other without end, are off. State is read and written by key, so
that a batch touches what it has values for; no batch is put together into one frame.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Milliseconds after which a key without events is forgotten.
IDLE = 10 * 60 * 1000


def with_state_store(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    return spark


def depths(steps: np.ndarray, before: int) -> np.ndarray:
    """How deep a counter that stops at zero stands after each step."""
    sums = before + np.cumsum(steps)
    return sums - np.minimum(0, np.minimum.accumulate(sums))


def table(rows: list[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    """A frame of the rows, whose texts are plain objects; none of no rows."""
    if rows:
        yield pd.DataFrame({c: pd.Series(v, dtype=object if isinstance(next((x for x in v if x is not None), ""), str) else None) for c, v in zip(columns, zip(*rows, strict=True), strict=True)})


class Setups(StatefulProcessor):
    """Counts a thread's calls outside of setups, and ignores those inside; leaving never takes the depth below zero."""

    def __init__(self, enter: str, leave: str, idle: int = IDLE):
        self.enter, self.leave, self.idle = enter, leave, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.depth = handle, handle.getValueState("depth", "depth int, timer long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        known = self.depth.get() if self.depth.exists() else None
        times, events = [], []
        for frame in rows:  # of each event its time and a category, whatever else the rows hold
            times.append(frame["ts"].to_numpy(np.float64))
            events.append(frame["event"].fillna("").astype("category"))
        order = np.argsort(np.concatenate(times), kind="stable")
        names, codes = np.unique(np.concatenate([e.cat.categories.to_numpy(str)[e.cat.codes] for e in events]), return_inverse=True)
        codes = codes[order]
        steps = np.where(names == self.enter, 1, np.where(names == self.leave, -1, 0))[codes]
        after = depths(steps, known[0] if known else 0)
        inside = np.concatenate([[known[0] if known else 0], after[:-1]]) > 0
        counted, ignored = (np.bincount(codes[m], minlength=len(names)) for m in (~inside, inside))
        if known and known[1]:
            self.handle.deleteTimer(known[1])
        timer = timerValues.getCurrentProcessingTimeInMs() + self.idle
        self.handle.registerTimer(timer)
        self.depth.update((int(after[-1]), timer))
        kept = [i for i, n in enumerate(names) if n not in (self.enter, self.leave) and counted[i] + ignored[i]]
        yield from table([(key[0], str(names[i]), int(counted[i]), int(ignored[i])) for i in kept], ["pid", "event", "counted", "ignored"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.depth.clear()  # a thread that went away in the middle of a setup doesn't silence its successor
        yield from ()

    def close(self) -> None:
        pass


class Distinct(StatefulProcessor):
    """Counts at most so many distinct values of a key; the rest is counted as dropped. A value is forgotten once it has not come for a while."""

    def __init__(self, most: int, idle: int | None = None):
        self.most, self.idle = most, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "value string", "times long", self.idle)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        room = None
        for frame in rows:
            out: list[tuple] = []
            for value, n in frame["value"].fillna("").value_counts().sort_index().items():
                known = self.seen.containsKey((value,))
                if not known and room is None:
                    room = self.most - sum(1 for _ in self.seen.keys())  # at most that many
                if known or room > 0:
                    room = room if known else room - 1
                    self.seen.updateValue((value,), ((self.seen.getValue((value,))[0] if known else 0) + int(n),))
                    out.append((key[0], value, int(n), 0))
                else:
                    out.append((key[0], None, 0, int(n)))
            yield from table(out, ["key", "value", "count", "dropped"])

    def close(self) -> None:
        pass


class Sessions(StatefulProcessor):
    """Counts of a key's events within a bounded time from its first one on, given out once that time is over."""

    def __init__(self, seconds: float):
        self.length = int(seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.start = handle.getValueState("start", "start long")
        self.counts = handle.getMapState("counts", "event string", "times long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        late: dict[str, int] = {}
        for frame in rows:
            at = (frame["at"].to_numpy("datetime64[ms]").astype(np.int64)).astype(np.int64)
            if not self.start.exists():
                self.start.update((int(at.min()),))
                self.handle.registerTimer(int(at.min()) + self.length)
            inside = at < self.start.get()[0] + self.length
            for event, n in frame["event"][inside].value_counts().items():
                before = self.counts.getValue((event,))[0] if self.counts.containsKey((event,)) else 0
                self.counts.updateValue((event,), (before + int(n),))
            for event, n in frame["event"][~inside].value_counts().items():
                late[event] = late.get(event, 0) + int(n)
        yield from table([(key[0], e, 0, n) for e, n in late.items()], ["key", "event", "count", "late"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        yield from table([(key[0], e[0], n[0], 0) for e, n in self.counts.iterator()], ["key", "event", "count", "late"])
        self.counts.clear()
        self.start.clear()

    def close(self) -> None:
        pass


def without_setup(events: DataFrame, enter: str, leave: str, idle: int = IDLE) -> DataFrame:
    """(pid, event, counted, ignored) of events (pid, event, ts): a batch's events of a thread are taken by time."""
    rows = events.select("pid", F.col("event").cast("string").alias("event"), F.col("ts").cast("double").alias("ts"))
    return rows.groupBy("pid").transformWithStateInPandas(Setups(enter, leave, idle), "pid long, event string, counted long, ignored long", "append", "ProcessingTime")


def bounded_distinct(events: DataFrame, key: str, value: str, most: int, idle: int | None = None) -> DataFrame:
    """(key, value, count, dropped): what a batch adds to counts of at most so many distinct values a key."""
    rows = events.select(F.col(key).cast("string").alias("key"), F.col(value).cast("string").alias("value"))
    return rows.groupBy("key").transformWithStateInPandas(Distinct(most, idle), "key string, value string, count long, dropped long", "append", "None" if idle is None else "ProcessingTime")


def sessions(events: DataFrame, key: str, seconds: float, delay: str = "0 seconds") -> DataFrame:
    """(key, event, count, late) of events (key, event, at): a session's counts once the watermark has passed its end; late: events after it, before the next one begins."""
    rows = events.select(F.col(key).cast("string").alias("key"), F.col("event").cast("string").alias("event"), F.col("at").cast("timestamp").alias("at")).withWatermark("at", delay)
    return rows.groupBy("key").transformWithStateInPandas(Sessions(seconds), "key string, event string, count long, late long", "append", "EventTime")
