"""Velocity over streams: sliding counts, burst sessions, exact counts before each event."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_velocity(events: DataFrame, key: str, time: str, amount: str, window: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums by tumbling or sliding window; rows later than the watermark are dropped."""
    w = F.window(time, window, slide) if slide else F.window(time, window)
    out = events.withWatermark(time, late).groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum(amount).alias("total"))
    return out.select(key, F.col("w.start").alias("from_ts"), F.col("w.end").alias("to_ts"), "n", "total")


def burst_sessions(events: DataFrame, key: str, time: str, amount: str, gap: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """Runs of events that follow each other within the gap."""
    s = F.session_window(time, gap)
    out = events.withWatermark(time, late).groupBy(s.alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum(amount).alias("total"))
    return out.select(key, F.col("w.start").alias("from_ts"), F.col("w.end").alias("to_ts"), "n", "total")


def prior_velocity(events: DataFrame, key: str, row_id: str, t: str, amount: str, window_us: int, time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """(key, row_id, t, n, total): count and sum of the entity's events in the window before each event, exactly.

    The state of an entity holds the times and amounts of its last window and no more; it is dropped once the watermark
    of `time` is a window past its last event. Events of a batch are put in order; one that is older than what the state has seen counts what
    the state still holds before it.
    """
    import pandas as pd

    def run(k: tuple, parts: Iterator[Any], state: GroupState) -> Iterator[Any]:
        if state.hasTimedOut:
            state.remove()
            return
        held, amounts = (np.array(x) for x in state.get) if state.exists else (np.zeros(0, np.int64), np.zeros(0))
        rows = pd.concat(list(parts)).sort_values(["t", "row_id"])
        t, new = rows["t"].to_numpy(np.int64), rows["amount"].to_numpy(float)
        # held times and the batch's own earlier rows are both in order: a window is a stretch of either
        lo, hi, own = np.searchsorted(held, t - window_us), np.searchsorted(held, t, "right"), np.searchsorted(t, t - window_us)
        before, mine, at = np.append(0, np.cumsum(amounts)), np.append(0, np.cumsum(new)), np.arange(len(t))
        n, total = np.maximum(hi - lo, 0) + at - own, np.where(hi > lo, before[hi] - before[lo], 0) + mine[at] - mine[own]
        every, sums = np.concatenate([held, t]), np.concatenate([amounts, new])
        order = np.argsort(every, kind="stable")
        every, sums = every[order], sums[order]
        kept = every >= every[-1] - window_us
        state.update((every[kept].tolist(), sums[kept].tolist()))
        state.setTimeoutTimestamp(max((int(every[-1]) + window_us) // 1000, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({"key": k[0], "row_id": rows["row_id"].to_numpy(), "t": t, "n": n, "total": total})

    kind = events.schema[key].dataType.simpleString()
    rows = events.withWatermark(time, late).select(F.col(time).alias("ts"), F.col(key).alias("key"), F.col(row_id).cast("long").alias("row_id"), F.col(t).alias("t"), F.col(amount).cast("double").alias("amount"))
    return rows.groupBy("key").applyInPandasWithState(run, f"key {kind}, row_id long, t long, n long, total double", "times array<long>, amounts array<double>", "append", GroupStateTimeout.EventTimeTimeout)
