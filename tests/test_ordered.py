"""The detector in the order of time: any order of arrival, restarts, late rows."""

import random

import pytest
from pyspark.sql import functions as F

from flowlab.session import fresh_path
from flowlab.streaming import ordered
from flowlab.streaming.adwin import AdaptiveWindow

START = 1_700_000_000


@pytest.fixture(scope="module")
def elements():
    r = random.Random(3)
    out = []
    for i in range(1500):
        key = "hot" if r.random() < 0.7 else "cold"
        out.append((key, START + i * 60 // 2, i, float(r.random() < (0.1 if i < 800 else 0.8))))
    return out


def expected(elements):
    found = []
    for key in ("hot", "cold"):
        window = AdaptiveWindow()
        for _, s, i, v in sorted((e for e in elements if e[0] == key), key=lambda e: (e[1], e[2])):
            if drift := window.add(v):
                found.append((key, i, drift[2], round(drift[0], 9), round(drift[1], 9)))
    return sorted(found)


def frame(spark, rows):
    schema = "stream_key string, s long, event_id long, value double"
    return spark.createDataFrame(rows, schema).select("stream_key", F.timestamp_seconds("s").alias("ts"), "event_id", "value")


def stream(spark, folder, files=1):
    return spark.readStream.schema(ordered.VALUES).option("maxFilesPerTrigger", files).parquet(folder)


def as_rows(drifts):
    return sorted((r.stream_key, r.event_id, r.n, round(r.mean_old, 9), round(r.mean_new, 9)) for r in drifts.collect())


@pytest.mark.parametrize("files", [1, 6])
def test_same_drifts_in_any_order_of_arrival(spark, elements, files):
    rows = elements[:]
    random.Random(files).shuffle(rows)
    # A missing value or time is no element.
    rows += [("hot", START, 5000, None), ("cold", None, 5001, 1.0)]
    folder = fresh_path(spark, "elements")
    for i in range(files):
        frame(spark, rows[i::files]).coalesce(1).write.mode("append").parquet(folder)
    got = as_rows(ordered.ordered_drifts(stream(spark, folder, 3), "2 days"))
    assert got == expected(elements) and {g[0] for g in got} == {"hot", "cold"}


def test_goes_on_from_its_checkpoint_and_keeps_a_short_lateness(spark, elements):
    folder, out, marks, closing = (fresh_path(spark, n) for n in ("elements", "drifts", "marks", "closing"))
    for start in range(0, 1500, 500):
        frame(spark, elements[start : start + 500]).coalesce(1).write.mode("append").parquet(folder)
        query = ordered.write_ordered_drifts(stream(spark, folder), out, marks, closing, "1 hour")
        query.awaitTermination()
        assert ordered.late_rows_dropped(query) == 0
    ordered.close_stream(spark, closing)
    ordered.write_ordered_drifts(stream(spark, folder), out, marks, closing, "1 hour").awaitTermination()
    assert as_rows(spark.read.schema(ordered.drift_schema()).parquet(out)) == expected(elements)


def test_late_rows_are_an_error(spark, elements):
    folder = fresh_path(spark, "elements")
    # Spark drops what is behind the mark of the batch before: the second file still counts, the third does not.
    for part in (elements[1000:], elements[100:120], elements[:20]):
        frame(spark, part).coalesce(1).write.mode("append").parquet(folder)
    with pytest.raises(ValueError, match="20 rows came later"):
        ordered.ordered_drifts(stream(spark, folder), "1 hour")


def test_an_empty_stream_has_no_drifts(spark):
    folder = fresh_path(spark, "elements")
    frame(spark, []).write.parquet(folder)
    assert ordered.ordered_drifts(stream(spark, folder), "1 hour").count() == 0
