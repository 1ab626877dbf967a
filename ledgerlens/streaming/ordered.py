"""Velocity over a stream whose events come out of order: every event waits until the watermark has passed it, so what leaves is
in event order and exact, whatever the order of arrival.

An entity's state is two lists: events that wait, to which a batch only appends, and the times and amounts of the last window
before the latest event that left. A timer at the earliest waiting event wakes the entity when the watermark passes; events
that come later than the watermark allows are dropped (and counted) by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Ordered(StatefulProcessor):
    """Counts and sums of the window before each event."""

    def __init__(self, window_us: int):
        self.window_us = window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "t long, row_id long, amount double")
        self.seen = handle.getListState("seen", "t long, amount double")

    def close(self) -> None:
        pass

    def wake(self, t: int) -> None:
        """Once the watermark (milliseconds) is past the event's microseconds."""
        self.handle.registerTimer(t // 1000 + 1)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            self.waiting.appendList([(int(t), int(i), float(a)) for t, i, a in zip(part["t"], part["row_id"], part["amount"], strict=True)])
            low = int(part["t"].min())
            first = low if first is None else min(first, low)
        if first is not None:
            self.wake(first)
        return iter([])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(tuple(x) for x in self.waiting.get()) if self.waiting.exists() else []
        ready, rest = [x for x in waiting if x[0] < passed], [x for x in waiting if x[0] >= passed]
        if not ready:
            return
        held = sorted(tuple(x) for x in self.seen.get()) if self.seen.exists() else []
        t, ids, amounts = (np.array(x) for x in zip(*ready, strict=True))
        # what was seen lies before all that is ready, so one order holds both
        every = np.concatenate([np.array([x[0] for x in held], np.int64), t])
        sums = np.append(0.0, np.cumsum(np.concatenate([[x[1] for x in held], amounts])))
        at = len(held) + np.arange(len(t))
        low = np.searchsorted(every, t - self.window_us)
        kept = int(np.searchsorted(every, every[-1] - self.window_us))
        self.seen.put([(int(a), float(b)) for a, b in zip(every[kept:], np.diff(sums)[kept:], strict=True)])
        if rest:
            self.waiting.put(rest)
            self.wake(rest[0][0])
        else:
            self.waiting.clear()
        yield pd.DataFrame({"key": [key[0]] * len(t), "row_id": ids, "t": t, "n": at - low, "total": sums[at] - sums[low]})


def ordered_velocity(events: DataFrame, key: str, row_id: str, t: str, amount: str, window_us: int, time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """(key, row_id, t, n, total): count and sum of the entity's events in the window before each event (by time and row id),
    once the watermark of `time` has passed it. `t` is `time` in microseconds. Sets the session's state store to RocksDB,
    which lists and timers need."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    kind = events.schema[key].dataType.simpleString()
    rows = events.withWatermark(time, late).select(F.col(time).alias("ts"), F.col(key).alias("key"), F.col(row_id).cast("long").alias("row_id"), F.col(t).cast("long").alias("t"), F.col(amount).cast("double").alias("amount"))
    return rows.groupBy("key").transformWithStateInPandas(Ordered(window_us), f"key {kind}, row_id long, t long, n long, total double", "append", "EventTime")
