"""Queries for error streams, drift detection and the streaming replay buffer."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlab.functions.cells import label_code
from flowlab.operators import learn
from flowlab.plans.catalog import inputs
from flowlab.plans.catalog import gradient_sql as g
from flowlab.plans.catalog.learning import CLASSES, sql
from flowlab.plans.catalog.registry import query, round_all, table
from flowlab.session import fresh_path
from flowlab.sources.tables import table_stream
from flowlab.streaming import drift, ordered, replay

# Errors with a step planted in the middle of the month.
ERRORS_SQL = """
errors as (
  select (user_id % 2)::varchar as stream_key, ts, event_id,
    (event_type = 'error' or (ts >= timestamp '2024-01-16' and event_id % 3 = 0))::int as error
  from events)
"""


def planted(events):
    ts = F.col("ts").cast("timestamp")
    late = (ts >= F.lit("2024-01-16").cast("timestamp")) & (F.col("event_id") % 3 == 0)
    return events.select(
        (F.col("user_id") % 2).cast("string").alias("stream_key"),
        ts.alias("ts"),
        "event_id",
        ((F.col("event_type") == "error") | late).cast("int").alias("error"),
    )


def day(df):
    return df.withColumn("ts", F.date_format("ts", "yyyy-MM-dd"))


@query("error_bits", f"with {inputs.PREDICTED_SQL} select event_id, (y_pred <> y_true)::int as error from predicted")
def error_bits(spark, sf):
    return drift.with_error(inputs.predicted(spark, sf)).select("event_id", "error")


@query("error_bits_stream", f"with {inputs.PREDICTED_SQL} select event_id, (y_pred <> y_true)::int as error from predicted")
def error_bits_stream(spark, sf):
    events = table_stream(spark, sf, "events")
    truth = label_code(F.col("event_type"), inputs.EVENT_CODES)
    guess = ((F.col("user_id") * 7 + F.col("event_id")) % 6).cast("int")
    rows = events.select("event_id", "user_id", truth.alias("y_true"), guess.alias("guess"))
    rows = rows.withColumn(
        "y_pred", F.when(F.col("user_id") % 3 == 0, F.col("y_true")).otherwise(F.col("guess"))
    )
    return drift.run_to_table(drift.with_error(rows).select("event_id", "error"), "error-bits")


WINDOWS_SQL = ERRORS_SQL + """
, windows as (
  select stream_key, date_trunc('day', ts) as day, count(*) as n, sum(error)::bigint as errors
  from errors group by all)
"""
COMPARE_SQL_CTES = WINDOWS_SQL + """
, running as (
  select *, sum(n) over past as n0, sum(errors) over past as e0 from windows
  window past as (partition by stream_key order by day rows between unbounded preceding and 1 preceding))
, terms as (
  select *, e0 / n0 as old, errors / n as new, (e0 + errors) / (n0 + n) as p, 1.0 / n0 + 1.0 / n as m,
    ln(2 * ln(n0 + n) / 0.002) as l from running where n0 is not null)
, bounds as (select *, sqrt(2 * m * p * (1 - p) * l) + 2.0 / 3.0 * m * l as bound from terms)
, compared as (
  select stream_key, strftime(day, '%Y-%m-%d') as ts, n, n0::bigint as n_old, round(old, 6) + 0.0 as mean_old,
    round(new, 6) + 0.0 as mean_new, round(bound, 6) + 0.0 as bound, (abs(old - new) > bound)::int as drift
  from bounds)
"""
COMPARE_SQL = COMPARE_SQL_CTES + "select * from compared"


@query("drift_windows", f"with {COMPARE_SQL}")
def drift_windows(spark, sf):
    windows = drift.error_windows(planted(table(spark, sf, "events")), "1 day")
    return round_all(day(drift.compare_windows(windows)), "mean_old", "mean_new", "bound")


@query("error_windows_stream", f"with {WINDOWS_SQL}" + """
select stream_key, strftime(day, '%Y-%m-%d') as ts, n, errors from windows
""")
def error_windows_stream(spark, sf):
    windows = drift.stream_windows(planted(table_stream(spark, sf, "events")), "1 day")
    return day(windows).select("stream_key", "ts", "n", "errors")


@query("running_windows_stream", f"with {WINDOWS_SQL}" + """
select stream_key, strftime(day, '%Y-%m-%d') as ts, n, errors from windows
""")
def running_windows_stream(spark, sf):
    """The daily windows, closed ones in the base table and open ones as the state."""
    out = fresh_path(spark, "running")
    errors = planted(table_stream(spark, sf, "events"))
    drift.running_windows(errors, "1 day", out, fresh_path(spark, "running-marks"), lateness="2 days").awaitTermination()
    return day(drift.windows_of(spark, out)).select("stream_key", "ts", "n", "errors")


@query("drift_windows_stream", f"with {COMPARE_SQL}")
def drift_windows_stream(spark, sf):
    windows = drift.stream_windows(planted(table_stream(spark, sf, "events")), "1 day")
    return round_all(day(drift.compare_windows(windows)), "mean_old", "mean_new", "bound")


@query("adwin_stream")
def adwin_stream(spark, sf):
    """Drifts of the hourly error rates."""
    return drift.detect_windows(drift.stream_windows(planted(table_stream(spark, sf, "events")), "1 hour"))


@query("adwin_first_drift")
def adwin_first_drift(spark, sf):
    return drift.first_drift(adwin_stream(spark, sf))


@query("adwin_slices_stream")
def adwin_slices_stream(spark, sf):
    """Drifts of the error rates of quarters of an hour."""
    return drift.detect_windows(drift.stream_windows(planted(table_stream(spark, sf, "events")), "15 minutes"))


CHANGE = "2024-01-16"


def switched(events):
    """A tenth of errors before the change, nine tenths after it."""
    ts = F.col("ts").cast("timestamp")
    after = ts >= F.lit(CHANGE).cast("timestamp")
    return events.select(
        (F.col("user_id") % 3).cast("string").alias("stream_key"), ts.alias("ts"), "event_id",
        (after != (F.col("event_id") % 10 == 0)).cast("double").alias("value"),
    )


@query("ordered_detector_stream", f"""
select (user_id % 3)::varchar as stream_key, count(*) filter (ts < timestamp '{CHANGE}') as elements_before,
  0 as drifts_before, 1 as found from events group by all
""")
def ordered_detector_stream(spark, sf):
    """Of each key: no drift before the planted change, and one within 96 elements after it."""
    drifts = ordered.ordered_drifts(switched(table_stream(spark, sf, "events")), "40 days")
    change = F.lit(CHANGE).cast("timestamp")
    first = drifts.groupBy("stream_key").agg(
        F.min(F.when(F.col("ts") >= change, F.struct("ts", "event_id"))).alias("at"),
        F.count(F.when(F.col("ts") < change, 1)).alias("drifts_before"),
    )
    elements = switched(table(spark, sf, "events")).join(first, "stream_key", "left")
    until = (F.col("ts") >= change) & (F.struct("ts", "event_id") <= F.col("at"))
    return elements.groupBy("stream_key").agg(
        F.count(F.when(F.col("ts") < change, 1)).alias("elements_before"),
        F.max(F.coalesce("drifts_before", F.lit(0))).cast("int").alias("drifts_before"),
        F.count(F.when(until, 1)).between(1, 96).cast("int").alias("found"),
    )


@query("drift_refit", sql(
    COMPARE_SQL_CTES, """
rows as (
  select event_id as id, 0 as g, 1.0::double as w, (event_id % 3)::int as y,
    [ln(1 + abs(value)), (user_id % 7) / 7.0::double, 1.0] as x from events
  where ts < (select max(ts::timestamp) + interval 1 day from compared where drift = 1))""",
    g.zeros("zero", CLASSES, 2),
    g.steps("s", "rows", "zero", 2, 0.1, mask="q.j > 1", pull=g.PullSql("zero")),
    final="select * from (" + g.named("s2", 2) + ") where exists (select * from compared where drift = 1)",
))
def drift_refit(spark, sf):
    """Refit a model on the rows up to the last window that shows a drift."""
    out = fresh_path(spark, "refit")
    spark.createDataFrame([], learn.PARAMETER_SCHEMA).write.parquet(f"{out}/models/batch=-1")
    events = table(spark, sf, "events")

    def refit(until, number):
        value = F.log1p(F.abs(F.col("value")))
        rows = events.filter(F.col("ts").cast("timestamp") < F.lit(until)).select(
            F.array(value, (F.col("user_id") % 7) / 7.0).alias("x"),
            (F.col("event_id") % CLASSES).cast("int").alias("y"),
        )
        old = learn.SoftmaxModel.zeros(CLASSES, 2)
        fit = learn.refit_softmax(rows, old, None, [0], steps=2, rate=0.1)
        fit.model.table(spark).write.mode("overwrite").parquet(f"{out}/models/batch={number}")

    errors = planted(table_stream(spark, sf, "events"))
    drift.refit_on_drift(errors, "1 day", refit, out, fresh_path(spark, "refit-marks")).awaitTermination()
    models = spark.read.schema(f"{learn.PARAMETER_SCHEMA}, batch int").parquet(f"{out}/models")
    last = models.filter(F.col("batch") == models.agg(F.max("batch")).first()[0])
    return round_all(last.select("key", "idx", "value"), "value")


@query("replay_stream", """
with seen as (
  select event_id, event_type, row_number() over (
    partition by event_type order by ts, event_id) as rn from events)
select event_id, event_type from seen where rn <= 200
""")
def replay_stream(spark, sf):
    events = table_stream(spark, sf, "events").select(
        "event_id", "event_type", F.col("ts").cast("timestamp").alias("ts")
    )
    out = fresh_path(spark, "replay")
    replay.keep_first(events, "event_type", ["ts", "event_id"], out, fresh_path(spark, "replay-marks")).awaitTermination()
    return replay.latest(spark, out, events.schema).drop("ts")
