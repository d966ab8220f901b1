from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlab.operators.sample import replay_first
from flowlab.plans.catalog.streams import planted
from flowlab.session import fresh_path
from flowlab.sources.tables import table, table_stream
from flowlab.streaming import drift, replay
from flowlab.streaming.adwin import AdaptiveWindow


def feed(values):
    window, found = AdaptiveWindow(), []
    for i, v in enumerate(values):
        hit = window.add(float(v))
        if hit:
            found.append((i, *hit))
    return window, found


def test_silent_on_a_constant_stream():
    window, found = feed([0.0] * 5000)
    assert not found and window.width() == 5000 and len(window.levels) < 80


def test_silent_on_stationary_noise():
    _, found = feed(np.random.default_rng(3).random(5000) < 0.2)
    assert len(found) <= 1


def test_fires_after_a_step_and_forgets_the_past():
    rng = np.random.default_rng(4)
    window, found = feed(np.r_[rng.random(2000) < 0.1, rng.random(2000) < 0.6])
    first = found[0]
    assert 2000 <= first[0] < 2200 and first[1] < 0.2 < first[2]
    assert window.width() < 2300


def test_blocks_hold_every_value():
    values = np.random.default_rng(5).random(777)
    window = AdaptiveWindow()
    for v in values:
        window.add(float(v), delta=1e-12)
    assert window.width() == 777 and sum(window.sums) == pytest.approx(values.sum())
    assert window.levels == sorted(window.levels, reverse=True)
    assert max(window.levels.count(level) for level in window.levels) <= 5


@pytest.fixture(scope="module")
def files(spark):
    """An error stream in three files, one key holding most rows."""
    path = fresh_path(spark, "errors")
    rows = spark.range(3000).select(
        F.when(F.col("id") % 10 < 7, "hot").otherwise("cold").alias("stream_key"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 60).alias("ts"),
        F.col("id").alias("event_id"),
        F.when(F.col("id") < 1500, F.col("id") % 10 == 0).otherwise(F.col("id") % 2 == 0).cast("double").alias("value"),
    )
    for i in range(3):
        rows.filter(f"event_id div 1000 = {i}").coalesce(1).write.mode("append").parquet(path)
    return path, rows


def test_detector_over_micro_batches_equals_one_pass(spark, files):
    path, rows = files
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = sorted((r["stream_key"], r["n"], round(r["mean_new"], 9)) for r in drift.run_to_table(drift.detect(stream), "t").collect())
    expected = []
    for key in ("hot", "cold"):
        values = [r["value"] for r in rows.filter(F.col("stream_key") == key).orderBy("event_id").collect()]
        expected += [(key, f[3], round(f[2], 9)) for f in feed(values)[1]]
    assert got == sorted(expected) and got
    first = drift.first_drift(drift.run_to_table(drift.detect(
        spark.readStream.schema(rows.schema).parquet(path)), "t"))
    assert {r["stream_key"] for r in first.collect()} == {"hot", "cold"}


def test_windows_of_a_stream_equal_those_of_a_table(spark, files):
    path, rows = files
    errors = lambda df: df.withColumn("error", F.col("value").cast("int"))
    stream = errors(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path))
    got = drift.stream_windows(stream, "7 hours")
    every = drift.error_windows(errors(rows), "7 hours")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, every.collect()))
    drifts = drift.compare_windows(drift.error_windows(errors(rows), "1 hour")).filter("drift = 1 and stream_key = 'hot'")
    assert drifts.agg(F.min("ts")).first()[0] >= rows.filter("event_id = 1440").first()["ts"]
    found = drift.first_drift(drift.detect_windows(drift.error_windows(errors(rows), "10 minutes"))).collect()
    step, later = (rows.filter(f"event_id = {i}").first()["ts"] for i in (1500, 2500))
    assert {r["stream_key"]: step <= r["ts"] <= later for r in found} == {"hot": True, "cold": True}


@pytest.fixture(scope="module")
def larger(data):
    """The same tables at a larger scale, beside the test data."""
    return str(Path(data).parent / "sf0.01")


STREAMED = [
    "error_bits_stream", "error_windows_stream", "drift_windows_stream", "adwin_stream", "adwin_first_drift",
    "adwin_slices_stream", "drift_refit", "replay_stream", "running_windows_stream",
]


@pytest.fixture(scope="module")
def shuffled(spark, larger):
    """The events as a folder of many part files, not in the order of time."""
    folder = fresh_path(spark, "shuffled")
    table(spark, larger, "events").repartition(24, F.xxhash64("event_id")).write.parquet(f"{folder}/events.parquet")
    return folder


@pytest.mark.parametrize("name", STREAMED)
def test_streams_do_not_depend_on_files_and_batches(spark, larger, shuffled, name, monkeypatch):
    from flowlab.plans.catalog import streams

    run = lambda folder: sorted(map(repr, getattr(streams, name)(spark, folder).collect()))
    expected = run(larger)
    assert expected
    for per_trigger in (7, 64):
        monkeypatch.setattr(streams, "table_stream", lambda s, f, n, k=per_trigger: table_stream(s, f, n, k))
        assert run(shuffled) == expected


def test_a_missing_table_is_an_error(spark, data):
    with pytest.raises(Exception, match="absent"):
        table_stream(spark, data, "absent")


def test_replay_stream_equals_batch(spark, files):
    path, rows = files
    order = ["ts", "event_id"]
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    admitted = drift.run_to_table(replay.admit(stream, "stream_key", order, 40), "t")
    assert admitted.count() <= 2 * replay.SHARDS * 40
    got = replay.buffer(admitted, "stream_key", order, 40)
    expected = replay_first(rows, "stream_key", order, 40)
    assert sorted(r["event_id"] for r in got.collect()) == sorted(r["event_id"] for r in expected.collect())


def test_null_prediction_is_an_error(spark):
    df = spark.createDataFrame([(1, 1), (1, None), (0, 1)], "y_true int, y_pred int")
    assert [r["error"] for r in drift.with_error(df).collect()] == [0, 1, 1]


@pytest.mark.parametrize(("drifting", "expected"), [(True, 1), (False, 0)])
def test_refit_is_called_only_on_drift(spark, data, drifting, expected):
    calls = []
    drift.refit_on_drift(
        planted(table_stream(spark, data, "events")),
        "1 day",
        lambda until, number: calls.append((until, number)),
        fresh_path(spark, "refit"),
        fresh_path(spark, "marks"),
        lambda windows: windows.filter(F.lit(drifting)),
    ).awaitTermination()
    assert len(calls) == expected


def test_the_adaptive_window_triggers_the_refit(spark, files):
    path, rows = files
    calls = []
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    drift.refit_on_drift(
        stream.withColumn("error", F.col("value").cast("int")), "10 minutes", lambda until, number: calls.append((until, number)),
        fresh_path(spark, "refit"), fresh_path(spark, "marks"), drift.detect_windows,
    ).awaitTermination()
    step = rows.filter("event_id = 1500").first()["ts"]
    assert calls and all(until > step for until, _ in calls)


def test_the_buffer_does_not_depend_on_arrival(spark, files):
    path, rows = files
    order = ["ts", "event_id"]
    backwards = fresh_path(spark, "backwards")
    for i in (2, 0, 1):
        rows.filter(f"event_id div 1000 = {i}").coalesce(1).write.mode("append").parquet(backwards)
    expected = sorted(map(tuple, replay_first(rows, "stream_key", order, 40).collect()))
    for per_trigger in (1, 3):
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", per_trigger).parquet(backwards)
        out = fresh_path(spark, "buffer")
        replay.keep_first(stream, "stream_key", order, out, fresh_path(spark, "marks"), 40).awaitTermination()
        assert sorted(map(tuple, replay.latest(spark, out, rows.schema).collect())) == expected


def stream_of(spark, parts):
    """A stream of one file a batch."""
    folder = fresh_path(spark, "parts")
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, "stream_key string, ts timestamp, error int").coalesce(1).write.parquet(f"{folder}/{i:03}")
    schema = "stream_key string, ts timestamp, error int"
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(folder)


def hourly(day):
    return [("a" if h % 3 else "b", np.datetime64("2024-01-01") + np.timedelta64(24 * day + h, "h"), h % 2) for h in range(24)]


def as_rows(parts):
    return [[(k, t.astype("datetime64[us]").item(), e) for k, t, e in part] for part in parts]


@pytest.mark.parametrize("late_days", [(), (0, 3)])
def test_running_windows_read_open_windows_only(spark, late_days, monkeypatch):
    """Twenty days, a day a batch, then late ones: a batch reads three days at most, and nothing is lost."""
    days = [*range(20), *late_days]
    parts = as_rows([hourly(d) for d in days])
    out, read = fresh_path(spark, "running"), []
    whole = drift.read_step

    def seen(session, where, table, number, schema):
        df = whole(session, where, table, number, schema)
        read.append((table, df.count(), len(df.inputFiles())))
        return df

    monkeypatch.setattr(drift, "read_step", seen)
    drift.running_windows(stream_of(spark, parts), "1 hour", out, fresh_path(spark, "marks"), lateness="1 day").awaitTermination()
    assert max(n for table, n, _ in read if table == "open") <= 48
    assert max(files for _, _, files in read) <= 16
    expected = drift.error_windows(spark.createDataFrame([r for p in parts for r in p], "stream_key string, ts timestamp, error int"), "1 hour")
    found = drift.windows_of(spark, out)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.collect()))
    assert {r["stream_key"]: r["late"] for r in drift.late_rows(spark, out).collect()} == ({"a": 32, "b": 16} if late_days else {})


def test_running_windows_go_on_after_a_restart(spark):
    days = as_rows([hourly(d) for d in (0, 1, 2, 5, 1)])
    folder, out, marks = fresh_path(spark, "parts"), fresh_path(spark, "running"), fresh_path(spark, "marks")
    schema = "stream_key string, ts timestamp, error int"
    for i, rows in enumerate(days):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
        drift.running_windows(stream, "1 day", out, marks, lateness="1 day").awaitTermination()
    expected = drift.error_windows(spark.createDataFrame([r for d in days for r in d], schema), "1 day")
    assert sorted(map(tuple, drift.windows_of(spark, out).collect())) == sorted(map(tuple, expected.collect()))
    assert drift.late_rows(spark, out).agg(F.sum("late")).first()[0] == 24
