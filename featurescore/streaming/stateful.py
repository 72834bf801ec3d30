"""Stateful stream processors: flushes after a count across micro-batches, and summaries of ticks when they close."""

from __future__ import annotations

import threading
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

#: The state store that these processors need.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FLUSH = "lane int, flush long, place int, item binary"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Within it queries that start keep their state in RocksDB; the session's setting is put back."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, STORE)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


class CountFlush(StatefulProcessor):
    """Keeps items until there are size of them, and gives those as a flush; the rest waits for later micro-batches.

    With idle_ms a lane that has got nothing for so long is flushed as it is.
    """

    def __init__(self, size: int, idle_ms: int = 0):
        self.size, self.idle_ms = size, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "item binary")
        self.flushed = handle.getValueState("flushed", "flush long")

    def _flush(self, lane: int, items: list) -> pd.DataFrame:
        number = self.flushed.get()[0] if self.flushed.exists() else 0
        self.flushed.update((number + 1,))
        return pd.DataFrame({"lane": lane, "flush": number, "place": range(len(items)), "item": items})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = [x[0] for x in self.waiting.get()] if self.waiting.exists() else []
        for batch in rows:
            for item in batch["item"]:
                held.append(bytes(item))
                if len(held) == self.size:
                    yield self._flush(key[0], held)
                    held = []
        self.waiting.put([(x,) for x in held]) if held else self.waiting.clear()
        if self.idle_ms:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if held:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = [x[0] for x in self.waiting.get()] if self.waiting.exists() else []
        if held:
            self.waiting.clear()
            yield self._flush(key[0], held)

    def close(self) -> None:
        pass


def count_flushes(rows: DataFrame, size: int, idle_ms: int = 0) -> DataFrame:
    """Rows (lane, flush, place, item) of a stream (lane int, item binary): each flush of a lane has exactly size items.

    A lane is what one buffer is: items of a lane meet in one task, so there should be many, none with most of the rows
    (a hash of the request, modulo a number of lanes). State is under size items for each lane, and the number of its
    flushes, both in checkpoints: they outlive a restart. Items of a micro-batch are taken in the order in which they come.
    """
    kept = rows.select(F.col("lane").cast("int").alias("lane"), F.col("item").cast("binary").alias("item"))
    return kept.groupBy("lane").transformWithStateInPandas(CountFlush(size, idle_ms), FLUSH, "append", "processingTime" if idle_ms else "none")


class TickSummary(StatefulProcessor):
    """Keeps the values of a tick, and gives their summary when the watermark has passed its end."""

    def __init__(self, shares: dict[str, float]):
        self.shares = shares

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.values = handle.getListState("values", "values binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if not self.values.exists():
            self.handle.registerTimer(int(key[1]))
        for batch in rows:
            self.values.appendValue((np.sort(batch["value"].to_numpy(dtype=np.float64)).tobytes(),))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        v = np.concatenate([np.frombuffer(x[0], dtype=np.float64) for x in self.values.get()])
        self.values.clear()
        places = sorted({int(np.floor(len(v) * s)) for s in self.shares.values()})
        v = np.partition(v, places)
        found = {name: [v[int(np.floor(len(v) * s))]] for name, s in self.shares.items()}
        yield pd.DataFrame({"start_ms": [key[0]], "n": [len(v)], "avg": [v.mean()], **found})

    def close(self) -> None:
        pass


def tick_summaries(events: DataFrame, ts: str, value: str, width: str, delay: str, shares: dict[str, float]) -> DataFrame:
    """Rows (window_start, n, avg, a column for each share) of a stream, one for each tick that the watermark has closed.

    The state is the values of the open ticks, as 8 bytes each, and ticks are dealt to tasks; a tick's values meet in one
    task when it closes, which suits ticks of seconds. Exact summaries of longer windows over stored rows are
    latency_summary's, which has no such group. A row counts as late when its tick is closed; late rows are dropped and
    counted in the progress of the query (see run_counted). Nulls are left out.
    """
    rows = events.select(F.col(ts).cast("timestamp").alias("at"), F.col(value).cast("double").alias("value")).where("value is not null").withWatermark("at", delay)
    # the window column carries the watermark: its end decides what is late
    ticks = rows.select(F.window("at", width).alias("w"), "value").select("w", "value", F.unix_millis("w.start").alias("start_ms"), F.unix_millis("w.end").alias("end_ms"))
    schema = "start_ms long, n long, avg double, " + ", ".join(f"{name} double" for name in shares)
    out = ticks.groupBy("start_ms", "end_ms").transformWithStateInPandas(TickSummary(shares), schema, "append", "eventTime")
    return out.select(F.timestamp_millis("start_ms").alias("window_start"), "n", "avg", *shares)


class Counts(StreamingQueryListener):
    """Sums of what the micro-batches of a query report, however many there are."""

    def __init__(self):
        self.rows = self.late = 0
        self.run, self.ended = None, threading.Event()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        if event.progress.runId == self.run:
            self.rows += event.progress.numInputRows
            self.late += sum(o.numRowsDroppedByWatermark for o in event.progress.stateOperators)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        if event.runId == self.run:
            self.ended.set()


def run_counted(stream: DataFrame, path: str, checkpoint: str) -> dict[str, int]:
    """Writes what is available of a stream with state as Parquet under path, and ends; gives rows in and late rows dropped."""
    spark, counts = stream.sparkSession, Counts()
    with state_store(spark):
        writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True)
        query = writer.start(path)
        # of a query that is over before the listener is there, the progress is at hand
        counts.run = query.runId
        spark.streams.addListener(counts)
        try:
            query.awaitTermination()
            counts.ended.wait(10)
        finally:
            spark.streams.removeListener(counts)
    kept = query.recentProgress
    rows, late = sum(p.numInputRows for p in kept), sum(o.numRowsDroppedByWatermark for p in kept for o in p.stateOperators)
    return {"rows": max(rows, counts.rows), "late": max(late, counts.late)}
