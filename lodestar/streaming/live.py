"""Live sessions of a stream: keyed state with timers, and the number of active sessions at each tick.

A session is active from its first event until ``horizon_s`` seconds have passed since its last one. State holds the last event of each active session only: a timer by event time ends a session and drops its state, so state is bounded by the sessions of one horizon and the lateness.
The stream tells changes, ``at`` and ``change`` (+1 or -1), and the count at a tick is the sum of the changes up to it, whatever batches they came in. Late events (behind the watermark) don't count; of events of one batch order doesn't matter.
Events without a session or a time go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGES = "session_id string, ms long, change int"


class LiveSessions(StatefulProcessor):
    def __init__(self, horizon_s: int):
        self.horizon = 1000 * horizon_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = np.sort(np.concatenate([frame["ms"].to_numpy(np.int64) for frame in rows]))
        last = self.last.get()[0] if self.last.exists() else None
        upto = seen if last is None else np.maximum(seen, last)
        before = np.append(seen[0] if last is None else last, upto[:-1])
        # Sessions that ended in between, before their timer was due: each ends, and the next begins.
        again = seen > before + self.horizon
        at = np.column_stack([before[again] + self.horizon + 1, seen[again]]).ravel()
        change = np.tile(np.array([-1, 1], np.int32), int(again.sum()))
        if last is None:
            at, change = np.append(seen[0], at), np.append(np.int32(1), change)
        newest = int(upto[-1])
        if newest != last:
            if last is not None:
                self.handle.deleteTimer(last + self.horizon + 1)
            self.last.update((newest,))
            self.handle.registerTimer(newest + self.horizon + 1)
        # One frame for all changes of a key: a frame each costs more than all else.
        if len(at):
            yield pd.DataFrame({"session_id": [key[0]] * len(at), "ms": at, "change": change})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0]
        self.last.clear()
        yield pd.DataFrame({"session_id": [key[0]], "ms": [last + self.horizon + 1], "change": np.array([-1], np.int32)})

    def close(self) -> None:
        pass


def live_changes(events: DataFrame, session: str = "session_id", ts: str = "last_seen", horizon_s: int = 300, late: str = "0 seconds") -> DataFrame:
    """``session_id, at, change`` of a stream of events. The session needs the RocksDB state store (``PROVIDER``)."""
    rows = events.select(F.col(session).cast("string").alias("session_id"), F.col(ts).alias("ts")).filter("session_id is not null and ts is not null")
    marked = rows.withWatermark("ts", late).withColumn("ms", F.unix_millis("ts"))
    changes = marked.groupBy("session_id").transformWithStateInPandas(LiveSessions(horizon_s), outputStructType=CHANGES, outputMode="Append", timeMode="EventTime")
    return changes.select("session_id", F.timestamp_millis("ms").alias("at"), "change")


def follow(spark: SparkSession, events: DataFrame, target: str, checkpoint: str, **options) -> None:
    """Writes the changes until all of the stream is read; the state store is set for this query and put back."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        query = live_changes(events, **options).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)
    query.awaitTermination()


def ticks(changes: DataFrame, every: str = "1 minute") -> DataFrame:
    """``tick, active``: the sessions that are active at the end of each span in which one began or ended. Changes are summed by span first, so the running sum goes over spans, not over sessions."""
    spans = changes.groupBy(F.window("at", every).alias("w")).agg(F.sum("change").alias("n"))
    return spans.select(F.col("w.end").alias("tick"), F.sum("n").over(Window.orderBy("w.end")).alias("active"))
