"""Error streams and concept-drift detection.

A stream is first counted per key and time slice: every micro-batch appends its partial
counts (`accumulate_windows`), which are summed when read (`windows_so_far`). So nothing
is late, no slice stays open, and answers do not depend on how the rows came in batches.
The slices' error rates go to the adaptive window (`detect_windows`), or `compare_windows`
tests each slice against the ones before. `detect` updates the window element by element
instead; it is sequential within a key, and in the order of arrival across micro-batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from flowlab import fixed
from flowlab.session import fresh_path
from flowlab.streaming.adwin import AdaptiveWindow

DRIFT_SCHEMA = "stream_key string, ts timestamp, n long, mean_old double, mean_new double"
STATE_SCHEMA = "levels array<int>, sums array<double>, squares array<double>, seen long"


def error_bit(y_true: Column, y_pred: Column) -> Column:
    """0 for a right prediction, 1 for a wrong one."""
    return (~y_true.eqNullSafe(y_pred)).cast("int")


def with_error(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    return df.withColumn("error", error_bit(F.col(y_true), F.col(y_pred)))


def _update(
    key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState
) -> Iterator[pd.DataFrame]:
    window = AdaptiveWindow()
    if state.exists:
        levels, sums, squares, seen = state.get
        window = AdaptiveWindow(list(levels), list(sums), list(squares), seen)
    parts = [[c["ts"].to_numpy(), c["event_id"].to_numpy(), c["value"].to_numpy()] for c in chunks]
    ts, ids, values = (np.concatenate(column) for column in zip(*parts))
    found = []
    for i in np.lexsort((ids, ts)):
        drift = window.add(float(values[i]))
        if drift:
            found.append((key[0], pd.Timestamp(ts[i]), drift[2], drift[0], drift[1]))
    state.update((window.levels, window.sums, window.squares, window.seen))
    if found:
        yield pd.DataFrame(found, columns=["stream_key", "ts", "n", "mean_old", "mean_new"])


def detect(values: DataFrame) -> DataFrame:
    """Drift events of a stream ``(stream_key, ts, event_id, value)``, value in [0, 1].

    Each micro-batch is ordered by ``(ts, event_id)`` within its key. A task holds three
    numbers per element of one key and micro-batch, which the stream's admission limit
    (``maxFilesPerTrigger`` or the like) bounds; the window itself needs O(log n).
    """
    return (
        values.select("stream_key", "ts", "event_id", F.col("value").cast("double").alias("value"))
        .groupBy("stream_key")
        .applyInPandasWithState(
            _update, DRIFT_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout
        )
    )


def first_drift(drifts: DataFrame) -> DataFrame:
    """The earliest drift of each key: where a consumer that stops at a drift would stop."""
    first = drifts.groupBy("stream_key").agg(
        F.min(F.struct("ts", "n", "mean_old", "mean_new")).alias("d")
    )
    return first.select("stream_key", "d.*")


def error_windows(errors: DataFrame, width: str) -> DataFrame:
    """Elements and errors per key and tumbling window of a table."""
    return (
        errors.groupBy("stream_key", F.window("ts", width).alias("w"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("error").cast("long").alias("errors"))
        .select("stream_key", F.col("w.start").alias("ts"), F.col("w.end").alias("until"), "n", "errors")
    )


WINDOW_SCHEMA = "stream_key string, ts timestamp, until timestamp, n long, errors long"
AVAILABLE = {"availableNow": True}


def accumulate_windows(
    errors: DataFrame, width: str, out: str, checkpoint: str, trigger: Mapping[str, object] = AVAILABLE
) -> StreamingQuery:
    """Start a query that appends every micro-batch's window counts to ``out``.

    A batch that runs again replaces what it wrote. ``trigger`` is passed to the writer.
    """
    spark = errors.sparkSession
    spark.createDataFrame([], WINDOW_SCHEMA).write.mode("overwrite").parquet(f"{out}/batch=-1")

    def act(batch: DataFrame, number: int) -> None:
        error_windows(batch, width).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return errors.writeStream.foreachBatch(act).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def windows_so_far(spark: SparkSession, out: str) -> DataFrame:
    """The windows of all batches at ``out``, whole however their rows were dealt over batches."""
    parts = spark.read.schema(WINDOW_SCHEMA).parquet(out)
    sums = [F.sum(c).alias(c) for c in ("n", "errors")]
    return parts.groupBy("stream_key", "ts", "until").agg(*sums)


def step_path(out: str, table: str, number: int) -> str:
    """Where a running table stands after a micro-batch; before the first one there is none."""
    return f"{out}/{table}/batch={number}"


def read_step(spark: SparkSession, out: str, table: str, number: int, schema: str) -> DataFrame:
    """A running table after micro-batch ``number``, read without listing the other batches."""
    if number < 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(step_path(out, table, number))


def _write_step(df: DataFrame, out: str, table: str, number: int) -> None:
    df.write.mode("overwrite").parquet(step_path(out, table, number))


def drop_step(spark: SparkSession, out: str, table: str, number: int) -> None:
    """Remove a running table that no batch needs any more: a batch that runs again needs the one before it."""
    if number >= 0:
        place = spark._jvm.org.apache.hadoop.fs.Path(step_path(out, table, number))
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def _summed(windows: DataFrame) -> DataFrame:
    return windows.groupBy("stream_key", "ts", "until").agg(*[F.sum(c).alias(c) for c in ("n", "errors")])


def running_windows(
    errors: DataFrame, width: str, out: str, checkpoint: str, lateness: str = "1 day", trigger: Mapping[str, object] = AVAILABLE
) -> StreamingQuery:
    """Start a query that keeps only the open windows as its state.

    The mark follows the latest window's end at the distance ``lateness``. A window that ends
    up to the mark is closed: it moves to the base table, which no later batch reads. Rows that
    arrive for a closed window are late: they are counted in a side table of their own, and
    still added to the base. So a micro-batch reads itself and the open windows, however
    old the stream is, and `windows_of` is right in any order of arrival. A batch that runs again
    starts from the same open windows and replaces what it wrote.
    """
    spark = errors.sparkSession

    def act(batch: DataFrame, number: int) -> None:
        _write_step(error_windows(batch, width), out, "own", number)
        own = read_step(spark, out, "own", number, WINDOW_SCHEMA)
        before = read_step(spark, out, "open", number - 1, WINDOW_SCHEMA)
        mark = read_step(spark, out, "mark", number - 1, "mark timestamp").agg(F.max("mark")).first()[0]
        latest = own.agg((F.max("until") - F.expr(f"interval {lateness}")).alias("mark")).first()[0]
        after = max((m for m in (mark, latest) if m is not None), default=None)
        is_late = F.coalesce(F.col("until") <= F.lit(mark).cast("timestamp"), F.lit(False))
        is_closed = F.coalesce(F.col("until") <= F.lit(after).cast("timestamp"), F.lit(False))
        late, live = own.filter(is_late), _summed(before.union(own.filter(~is_late)))
        _write_step(live.filter(~is_closed), out, "open", number)
        _write_step(late, out, "late", number)
        _write_step(live.filter(is_closed).union(late), out, "base", number)
        _write_step(spark.createDataFrame([(after,)], "mark timestamp"), out, "mark", number)
        for table in ("open", "mark", "own"):
            drop_step(spark, out, table, number - 2)

    return errors.writeStream.foreachBatch(act).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def _last_step(spark: SparkSession, out: str, table: str, schema: str) -> DataFrame:
    every = spark.read.schema(f"{schema}, batch long").parquet(f"{out}/{table}")
    return every.filter(F.col("batch") == every.agg(F.max("batch")).first()[0]).drop("batch")


def windows_of(spark: SparkSession, out: str) -> DataFrame:
    """All windows of `running_windows` so far, closed and open."""
    closed = spark.read.schema(WINDOW_SCHEMA).parquet(f"{out}/base").drop("batch")
    return _summed(closed.union(_last_step(spark, out, "open", WINDOW_SCHEMA)))


def late_rows(spark: SparkSession, out: str) -> DataFrame:
    """(stream_key, late): rows that came after their window was closed."""
    late = spark.read.schema(WINDOW_SCHEMA).parquet(f"{out}/late")
    return late.groupBy("stream_key").agg(F.sum("n").alias("late"))


def stream_windows(errors: DataFrame, width: str, name: str = "windows") -> DataFrame:
    """Count all that is now available of a stream, and read the counts."""
    spark = errors.sparkSession
    out = fresh_path(spark, name)
    accumulate_windows(errors, width, out, fresh_path(spark, f"{name}-checkpoint")).awaitTermination()
    return windows_so_far(spark, out)


def detect_windows(windows: DataFrame) -> DataFrame:
    """Drift events of window counts, in the order of time: one element per window, its error rate.

    A group is one key's windows, so its size follows the time span and not the traffic.
    """
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        window, found = AdaptiveWindow(), []
        rows = rows.sort_values(["ts", "event_id"])
        for ts, value in zip(rows["ts"], rows["value"], strict=True):
            drift = window.add(float(value))
            if drift:
                found.append((key[0], ts, drift[2], drift[0], drift[1]))
        return pd.DataFrame(found, columns=["stream_key", "ts", "n", "mean_old", "mean_new"])

    return window_rates(windows).groupBy("stream_key").applyInPandas(run, DRIFT_SCHEMA)


def window_rates(windows: DataFrame) -> DataFrame:
    """Windows as elements for `detect`: the value is the window's error rate."""
    return windows.select(
        "stream_key", "ts", F.lit(0).cast("long").alias("event_id"),
        (F.col("errors") / F.col("n")).alias("value"),
    )


def compare_windows(windows: DataFrame, delta: float = fixed.DRIFT_DELTA) -> DataFrame:
    """Test each window of a key against all windows before it.

    Runs over window counts, so its size depends on the time span and not on the
    traffic. The bound is that of the adaptive window.
    """
    past = Window.partitionBy("stream_key").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    n0, e0 = F.sum("n").over(past), F.sum("errors").over(past)
    rows = windows.withColumns({"n_old": n0, "errors_old": e0}).filter("n_old is not null")
    width = F.col("n_old") + F.col("n")
    rate = (F.col("errors_old") + F.col("errors")) / width
    inverse_m = F.lit(1.0) / F.col("n_old") + F.lit(1.0) / F.col("n")
    log_term = F.log(F.lit(2.0) * F.log(width) / F.lit(delta))
    bound = F.sqrt(2.0 * inverse_m * rate * (1 - rate) * log_term) + inverse_m * log_term * (2.0 / 3.0)
    old, new = F.col("errors_old") / F.col("n_old"), F.col("errors") / F.col("n")
    return rows.select(
        "stream_key", "ts", "n", "n_old", old.alias("mean_old"), new.alias("mean_new"),
        bound.alias("bound"), (F.abs(old - new) > bound).cast("int").alias("drift"),
    )


def refit_on_drift(
    errors: DataFrame,
    width: str,
    refit: Callable[[datetime, int], None],
    out: str,
    checkpoint: str,
    detector: Callable[[DataFrame], DataFrame] | None = None,
    trigger: Mapping[str, object] = AVAILABLE,
) -> StreamingQuery:
    """Start a query that calls ``refit`` when the windows so far show a drift.

    Every micro-batch adds its counts to a running table at ``out``; the detector reads the
    windows of all batches there (by default those where `compare_windows` finds a drift; `detect_windows` fits
    as well). ``refit`` gets the end of the last window with a drift and the batch number,
    again whenever a batch changes what lies before that end. So the last call is the same
    however the rows came in batches.
    """
    spark = errors.sparkSession
    detector = detector or (lambda windows: compare_windows(windows).filter("drift = 1"))

    def act(batch: DataFrame, number: int) -> None:
        # The windows of all batches are one running table, so a batch reads only the one before it.
        _write_step(error_windows(batch, width), out, "own", number)
        own = read_step(spark, out, "own", number, WINDOW_SCHEMA)
        _write_step(_summed(read_step(spark, out, "windows", number - 1, WINDOW_SCHEMA).union(own)), out, "windows", number)
        windows = read_step(spark, out, "windows", number, WINDOW_SCHEMA)
        drifts = detector(windows).select("stream_key", "ts").join(windows, ["stream_key", "ts"])
        last = drifts.agg(F.max("until")).first()[0]
        before = read_step(spark, out, "last", number - 1, "until timestamp").first()
        _write_step(spark.createDataFrame([(last,)], "until timestamp"), out, "last", number)
        first = own.agg(F.min("ts")).first()[0]
        edges = [t for t in (last, before["until"] if before else None) if t is not None]
        if last is not None and first is not None and first < max(edges):
            refit(last, number)
        for table in ("own", "windows", "last"):
            drop_step(spark, out, table, number - 2)

    return errors.writeStream.foreachBatch(act).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over everything now available, into a Parquet table, and read that."""
    spark = stream.sparkSession
    out, marks = fresh_path(spark, name), fresh_path(spark, f"{name}-checkpoint")
    query = (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", marks)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
