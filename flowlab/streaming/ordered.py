"""The element-wise drift detector in the order of time, whatever the order of arrival.

Elements wait in keyed state, in slots of an hour, until the watermark has passed their slot.
Then they go through the adaptive window by ``(ts, event_id)``. So the drifts are those
of one pass over the sorted stream, for one file or many, in any order that the lateness
allows; a row behind the watermark is dropped by Spark and counted (`late_rows_dropped`).

State per key: the window's blocks (O(log n) of them), the number of elements, and the waiting
slots, which hold the lateness's worth of elements. The store is RocksDB, on the executors'
disks and in the checkpoint; a timer stands at the end of the earliest slot.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from flowlab.session import fresh_path
from flowlab.streaming.adwin import AdaptiveWindow
from flowlab.streaming.drift import AVAILABLE

SLOT = 3_600_000_000
#: The closing row: past all elements, and a time that pandas holds.
END = "2200-01-01"
FOUND = "stream_key string, us long, event_id long, n long, mean_old double, mean_new double"
VALUES = "stream_key string, ts timestamp, event_id long, value double"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class OrderedDetector(StatefulProcessor):
    """Waiting slots and an adaptive window per key."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.blocks = handle.getListState("blocks", "level int, total double, square double")
        self.seen = handle.getValueState("seen", "seen long")
        self.waiting = handle.getMapState("waiting", "slot long", "us array<long>, event_id array<long>, value array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        earliest = None
        for chunk in rows:
            chunk = chunk[chunk["value"].notna()]  # the closing row has none
            for slot, part in chunk.groupby(chunk["us"] // SLOT):
                columns = tuple(part[c].tolist() for c in ("us", "event_id", "value"))
                if self.waiting.containsKey((slot,)):
                    columns = tuple([*old, *new] for old, new in zip(self.waiting.getValue((slot,)), columns, strict=True))
                self.waiting.updateValue((slot,), columns)
                earliest = slot if earliest is None else min(earliest, slot)
        if earliest is not None:
            self._wake(earliest)
        return iter(())

    def _wake(self, slot: int) -> None:
        """Have the timer stand at the end of ``slot`` or of an earlier one."""
        at = (slot + 1) * SLOT // 1000
        timers = list(self.handle.listTimers())
        if not timers or at < min(timers):
            for timer in timers:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        slots = sorted(slot for (slot,) in self.waiting.keys())
        due = [slot for slot in slots if (slot + 1) * SLOT <= mark]
        blocks = list(self.blocks.get())
        levels, sums, squares = (list(c) for c in zip(*blocks, strict=True)) if blocks else ([], [], [])
        window = AdaptiveWindow(levels, sums, squares, self.seen.get()[0] if self.seen.exists() else 0)
        found = []
        for slot in due:
            us, ids, values = (np.asarray(c) for c in self.waiting.getValue((slot,)))
            for i in np.lexsort((ids, us)):
                drift = window.add(float(values[i]))
                if drift:
                    found.append((key[0], int(us[i]), int(ids[i]), drift[2], drift[0], drift[1]))
            self.waiting.removeKey((slot,))
        if due:
            self.blocks.put(list(zip(window.levels, window.sums, window.squares, strict=True)))
            self.seen.update((window.seen,))
        if len(slots) > len(due):
            self._wake(slots[len(due)])
        if found:
            yield pd.DataFrame(found, columns=[c.split()[0] for c in FOUND.split(", ")])

    def close(self) -> None:
        pass


def detect_ordered(values: DataFrame, lateness: str) -> DataFrame:
    """Drift events of a stream ``(stream_key, ts, event_id, value)``, value in [0, 1], in the order of time.

    A drift carries the element it was found at. Elements without a time or value are not
    read. Start the stream under `rocks_store`.
    """
    rows = values.select("stream_key", "ts", F.unix_micros("ts").alias("us"), "event_id", F.col("value").cast("double").alias("value"))
    found = (
        rows.filter("ts is not null")
        .withWatermark("ts", lateness)
        .groupBy("stream_key")
        .transformWithStateInPandas(OrderedDetector(), FOUND, "append", "eventtime")
    )
    return found.withColumn("ts", F.timestamp_micros("us")).select("stream_key", "ts", "event_id", "n", "mean_old", "mean_new")


@contextmanager
def rocks_store(spark: SparkSession) -> Iterator[None]:
    """Streams that start meanwhile keep their state in RocksDB."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def write_ordered_drifts(
    values: DataFrame, out: str, checkpoint: str, closing: str, lateness: str, trigger: Mapping[str, object] = AVAILABLE
) -> StreamingQuery:
    """Start a query that appends the drifts of ``values`` to ``out``; ``closing`` is a folder for `close_stream`.

    Started again on the same folders it goes on from its checkpoint.
    """
    spark = values.sparkSession
    spark.createDataFrame([], VALUES).write.mode("append").parquet(closing)
    ends = spark.readStream.schema(VALUES).parquet(closing)
    present = values.filter("value is not null").select("stream_key", "ts", "event_id", F.col("value").cast("double").alias("value"))
    found = detect_ordered(present.union(ends), lateness)
    with rocks_store(spark):
        writer = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        return writer.outputMode("append").trigger(**trigger).start()


def close_stream(spark: SparkSession, closing: str) -> None:
    """Have the next run take all that waits: a row far in the future carries the watermark past every slot.

    For a stream that has ended; rows that come after it are late.
    """
    end = spark.range(1).select(
        F.lit(None).cast("string").alias("stream_key"), F.lit(END).cast("timestamp").alias("ts"),
        F.lit(None).cast("long").alias("event_id"), F.lit(None).cast("double").alias("value"),
    )
    end.coalesce(1).write.mode("append").parquet(closing)


def late_rows_dropped(query: StreamingQuery) -> int:
    """Rows that came behind the watermark, by the progress reports that the query still holds."""
    return sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators)


def ordered_drifts(values: DataFrame, lateness: str, name: str = "ordered") -> DataFrame:
    """The drifts of all that is now available of a stream, which then is closed."""
    spark = values.sparkSession
    out, marks, closing = (fresh_path(spark, f"{name}-{part}") for part in ("drifts", "marks", "closing"))
    for last in (False, True):
        if last:
            close_stream(spark, closing)
        query = write_ordered_drifts(values, out, marks, closing, lateness)
        query.awaitTermination()
        if late := late_rows_dropped(query):
            raise ValueError(f"{late} rows came later than {lateness}")
    return spark.read.schema(drift_schema()).parquet(out)


def drift_schema() -> str:
    return "stream_key string, ts timestamp, event_id long, n long, mean_old double, mean_new double"
