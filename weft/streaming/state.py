"""Fetch streams: throttle and health as keyed state, first sightings, sessions, windows.

The state functions share their step functions with the batch folds, so a replayed
stream gives what the batch gives. A host that is idle for a day in event time is forgotten
and begins anew; rows later than the watermark are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from weft.operators.state import MIN_DELAY, START, next_delay, next_health

LATE = "10 minutes"
IDLE_MS = 86_400_000


def _value(x):
    return None if x is None or pd.isna(x) else x


def _forget_after(state, rows: pd.DataFrame) -> None:
    """The state goes a day after its last row; rows that come at the watermark may set no time before it."""
    state.setTimeoutTimestamp(max(int(rows["ts"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + IDLE_MS)


def throttle(fetches: DataFrame, late: str = LATE) -> DataFrame:
    """(host, fetch_id, delay) after each fetch of a stream of (fetch_id, host, ts, latency, status, retry_after)."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        delay = state.get[0] if state.exists else MIN_DELAY
        rows = pd.concat(list(batches)).sort_values(["ts", "fetch_id"], kind="stable")
        out = []
        for r in rows.itertuples(index=False):
            status, wait = _value(r.status), _value(r.retry_after)
            delay = next_delay(delay, _value(r.latency), None if status is None else int(status), wait)
            out.append((key[0], r.fetch_id, delay))
        state.update((delay,))
        _forget_after(state, rows)
        yield pd.DataFrame(out, columns=["host", "fetch_id", "delay"])

    return fetches.withWatermark("ts", late).groupBy("host").applyInPandasWithState(step, "host string, fetch_id long, delay double", "delay double", "append", "EventTimeTimeout")


def health(fetches: DataFrame, late: str = LATE) -> DataFrame:
    """(host, fetch_id, score) after each fetch; rests end by event time."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        score, until = state.get if state.exists else (START, None)
        rows = pd.concat(list(batches)).sort_values(["ts", "fetch_id"], kind="stable")
        out = []
        for r in rows.itertuples(index=False):
            status = _value(r.status)
            score, until = next_health(score, _value(until), r.ts.timestamp(), None if status is None else int(status))
            out.append((key[0], r.fetch_id, score))
        state.update((score, until))
        _forget_after(state, rows)
        yield pd.DataFrame(out, columns=["host", "fetch_id", "score"])

    return fetches.withWatermark("ts", late).groupBy("host").applyInPandasWithState(step, "host string, fetch_id long, score int", "score int, until double", "append", "EventTimeTimeout")


def first_sightings(fetches: DataFrame, late: str = LATE) -> DataFrame:
    """The first row of every (host, url) within the watermark."""
    return fetches.withWatermark("ts", late).dropDuplicatesWithinWatermark(["host", "url"])


def sessions(fetches: DataFrame, idle: str = "300 seconds", late: str = LATE) -> DataFrame:
    """(host, started, ended, fetches) of sessions that end after idle time; late rows beyond the watermark are dropped."""
    s = fetches.withWatermark("ts", late).groupBy("host", F.session_window("ts", idle).alias("w")).agg(F.count(F.lit(1)).alias("fetches"))
    return s.select("host", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "fetches")


def per_window(fetches: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = LATE) -> DataFrame:
    """(started, ended, fetches) by tumbling or sliding windows."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return fetches.withWatermark("ts", late).groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("fetches")).select(F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "fetches")


class Progress(StreamingQueryListener):
    """Tells a function of (query name, batch, input rows, rows a second) about every batch of every stream.

    ``spark.streams.addListener(Progress(told))``; a function that fails stops no stream.
    """

    def __init__(self, told) -> None:
        self.told = told

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        try:
            self.told(p.name, p.batchId, p.numInputRows, p.processedRowsPerSecond)
        except Exception:
            pass

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass
