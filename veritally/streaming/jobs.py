"""Job control on event streams: the last write wins, stale jobs, sessions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupStateTimeout


def progress(events: DataFrame, key: str, at: str, state: str) -> DataFrame:
    """Latest state of each job."""
    return events.groupBy(key).agg(F.max_by(state, at).alias("state"), F.max(at).alias("last_seen"))


def stale(events: DataFrame, key: str, at: str, state: str, now, seconds: int, running: tuple[str, ...]) -> DataFrame:
    """Running jobs whose last event is older than the limit; now: a column, or a table with one row and one column."""
    last = progress(events, key, at, state)
    if isinstance(now, DataFrame):
        last, now = last.crossJoin(F.broadcast(now)), F.col(now.columns[0])
    age = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("last_seen").cast("timestamp"))
    return last.where(F.col("state").isin(*running)).withColumn("silent", age).where(F.col("silent") > seconds)


def sessions(events: DataFrame, key: str, at: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Session windows; on a stream, with a watermark."""
    timed = events.withColumn("__at", F.col(at).cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("__at", late)
    out = timed.groupBy(key, F.session_window("__at", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def heartbeats(events: DataFrame, key: str, at: str, silent_seconds: int, late: str = "10 minutes") -> DataFrame:
    """key, last_seen, timed_out of a stream: a row for each batch that a job is heard in, and one when it falls silent.

    Silence is measured in event time: it is over `silent_seconds` once the watermark has passed the last event by that
    much.  State holds one time for each live job.
    """
    def step(k, frames, state):
        if state.hasTimedOut:
            last = state.get[0]
            state.remove()
            yield pd.DataFrame({key: [k[0]], "last_seen": [last], "timed_out": [True]})
            return
        seen = [int(f["__ms"].max()) for f in frames if len(f)]
        last = max([*seen, state.get[0] if state.exists else 0])
        state.update((last,))
        state.setTimeoutTimestamp(max(last + silent_seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [k[0]], "last_seen": [last], "timed_out": [False]})

    timed = events.select(key, F.col(at).cast("timestamp").alias("__at")).withWatermark("__at", late).withColumn("__ms", F.unix_millis("__at"))
    kind = dict(events.dtypes)[key]
    out = timed.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, last_seen long, timed_out boolean", "last long", "append", GroupStateTimeout.EventTimeTimeout)
    return out.select(key, F.timestamp_millis("last_seen").alias("last_seen"), "timed_out")
