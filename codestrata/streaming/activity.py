"""Activity streams: windowed counts, viewer sessions that expire, and a running index of newest records.

Each function takes a streaming or a batch DataFrame and gives one of the same kind, so results of a stream can be checked against a batch run.
Late rows beyond the watermark are dropped by design of a stream; in a batch none are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed(events: DataFrame, size: str = "1 day", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Events and their value by type and window of event time; null times belong to no window."""
    at: Column = F.window("ts", size, slide) if slide else F.window("ts", size)
    rows = events.where("ts IS NOT NULL").withWatermark("ts", late).groupBy(at.alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("value"))
    return rows.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "events", "value")


def sessions(events: DataFrame, gap: str = "90 seconds", late: str = "1 day") -> DataFrame:
    """A viewer's activity without a pause longer than ``gap``: begin, end and events of each session."""
    rows = events.where("ts IS NOT NULL AND user_id IS NOT NULL").withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("events"))
    return rows.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def live_viewers(events: DataFrame, ttl_seconds: int = 90) -> DataFrame:
    """(user_id, seen, events, expired) as viewers come and run out of their time to live; state is one small row a viewer."""
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            seen, n = state.get
            state.remove()
            yield pd.DataFrame({"user_id": [key[0]], "seen": [pd.Timestamp(seen, unit="ms")], "events": [n], "expired": [True]})
            return
        seen, n = state.get if state.exists else (0, 0)
        for b in batches:
            seen, n = max(seen, int(b["ts"].max().timestamp() * 1000)), n + len(b)
        state.update((seen, n))
        state.setTimeoutTimestamp(max(seen, state.getCurrentWatermarkMs()) + ttl_seconds * 1000)
        yield pd.DataFrame({"user_id": [key[0]], "seen": [pd.Timestamp(seen, unit="ms")], "events": [n], "expired": [False]})

    return events.where("ts IS NOT NULL AND user_id IS NOT NULL").withWatermark("ts", "0 seconds").groupBy("user_id").applyInPandasWithState(
        step, "user_id long, seen timestamp, events long, expired boolean", "seen long, n long", "update", GroupStateTimeout.EventTimeTimeout)


def run_to_end(spark: SparkSession, schema, path: str, transform: Callable[[DataFrame], DataFrame], name: str, mode: str = "complete") -> DataFrame:
    """Stream the Parquet files of a folder through ``transform`` until all are read, and give the result table."""
    import uuid

    from codestrata.tables import scratch_dir

    stream = spark.readStream.schema(schema).parquet(path)
    q = (transform(stream).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{scratch_dir(spark)}/streams/{name}-{uuid.uuid4().hex}").trigger(availableNow=True).start())
    try:
        q.awaitTermination()
    finally:
        q.stop()
    return spark.table(name)


def progress(spark: SparkSession) -> float:
    """The share of the tasks of all running stages that are done, from 0 to 1; 1 where nothing runs."""
    tracker = spark.sparkContext.statusTracker()
    stages = [i for s in tracker.getActiveStageIds() if (i := tracker.getStageInfo(s))]
    total = sum(i.numTasks for i in stages)
    return sum(i.numCompletedTasks for i in stages) / total if total else 1.0


def progress_stream(spark: SparkSession, running: Callable[[], bool], every: float = 0.5) -> Iterator[float]:
    """Progress of work in another thread while it is ``running``, never falling, and 1 at the end."""
    import time

    seen = 0.0
    while running():
        seen = max(seen, min(progress(spark), 0.99))
        yield seen
        time.sleep(every)
    yield 1.0
