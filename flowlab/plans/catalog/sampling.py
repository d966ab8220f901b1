"""Queries for sampling, splitting, numbering and the data profile."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlab import fixed
from flowlab.operators import profile, sample
from flowlab.plans.catalog import inputs
from flowlab.plans.catalog.registry import query, round_all, table

DOC_ORDER = "md5(doc_id::varchar || ':42'), doc_id"
EVENT_ORDER = "md5(event_id::varchar || ':42'), event_id"
EVENT_COLUMNS = "event_id, event_type, user_id, value, props"


def capped_sql(source: str, label: str, order: str, cap: str, columns: str) -> str:
    return f"""
select {columns} from (
  select *, row_number() over (partition by {label} order by {order}) as rn from {source})
where rn <= {cap}
"""


@query("class_cap", capped_sql("documents", "lang", DOC_ORDER, "120", "doc_id, lang, source, n_chars, text"))
def class_cap(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars", "text")
    return sample.class_cap(docs, "lang", "doc_id", 120)


@query("class_cap_by_label", capped_sql(
    "events", "event_type", EVENT_ORDER, "case event_type when 'error' then 700 else 150 end",
    EVENT_COLUMNS,
))
def class_cap_by_label(spark, sf):
    events = inputs.whole_events(spark, sf)
    return sample.class_cap(events, "event_type", "event_id", 150, {"error": 700})


@query("balanced_two_classes", capped_sql(
    "(select * from events where event_type in ('error', 'click'))", "event_type", EVENT_ORDER, "500",
    EVENT_COLUMNS,
))
def balanced_two_classes(spark, sf):
    events = inputs.whole_events(spark, sf)
    return sample.balanced_classes(events, "event_type", "event_id", ["error", "click"], 500)


RANKED_SQL = f"""
ranked as (
  select *, row_number() over (order by {EVENT_ORDER}) as rn, count(*) over () as n from events)
"""


def split_sql(fraction: str) -> str:
    return f"with {RANKED_SQL} select {EVENT_COLUMNS}, case when rn <= n - ceil({fraction} * n) then 1 else 2 end as part from ranked"


@query("split_exact", split_sql("0.8"))
def split_exact(spark, sf):
    return sample.split_exact(inputs.whole_events(spark, sf), "event_id")


@query("holdout_by_mode", split_sql("0.3"))
def holdout_by_mode(spark, sf):
    return sample.hold_out(inputs.whole_events(spark, sf), "event_id", "multi")


@query("client_partition", f"""
with {RANKED_SQL} select {EVENT_COLUMNS}, least((rn - 1) // (n // 7), 6)::int as client from ranked
""")
def client_partition(spark, sf):
    return sample.client_partition(inputs.whole_events(spark, sf), "event_id", 7)


@query("shuffle_rows", f"with {RANKED_SQL} select {EVENT_COLUMNS}, rn from ranked")
def shuffle_rows(spark, sf):
    """The shuffled rows with their place in the output."""
    shuffled = sample.shuffle_rows(inputs.whole_events(spark, sf), "event_id")
    placed = shuffled.withColumn("place", F.monotonically_increasing_id())
    return sample.number_sorted(placed, [F.col("place")], "rn").drop("place")


@query("global_rank", f"with {RANKED_SQL} select {EVENT_COLUMNS}, rn from ranked")
def global_rank(spark, sf):
    return sample.global_rank(inputs.whole_events(spark, sf), "event_id", target="rn")


@query("batch_number", f"with {RANKED_SQL} select {EVENT_COLUMNS}, (rn - 1) // 64 as batch from ranked")
def batch_number(spark, sf):
    return sample.batch_number(inputs.whole_events(spark, sf), "event_id")


REPLAY_SQL = """
seen as (
  select event_id, event_type, row_number() over (
    partition by event_type order by ts, event_id) as rn from events),
buffer as (select event_id, event_type from seen where rn <= 200)
"""


def buffer(spark, sf):
    events = table(spark, sf, "events").select("event_id", "event_type", "ts")
    return sample.replay_first(events, "event_type", ["ts", "event_id"]).drop("ts")


@query("replay_first_n", f"with {REPLAY_SQL} select * from buffer")
def replay_first_n(spark, sf):
    return buffer(spark, sf)


@query("replay_draw", f"""
with {REPLAY_SQL}, drawn as (
  select *, row_number() over (partition by event_type order by {EVENT_ORDER}) as place from buffer)
select event_id, event_type from drawn where place <= 3
""")
def replay_draw(spark, sf):
    return sample.replay_draw(buffer(spark, sf), "event_type", "event_id", fixed.REPLAY_DRAW)


@query("fifo_replay", f"""
with newest as (select event_id, event_type from events order by ts desc, event_id desc limit 5000)
select * from newest order by {EVENT_ORDER} limit 16
""")
def fifo_replay(spark, sf):
    events = table(spark, sf, "events").select("event_id", "event_type", "ts")
    return sample.fifo_draw(events, ["ts", "event_id"], "event_id", 16).drop("ts")


@query("intake_guard", """
with placed as (
  select conv_id // 8 as batch, conv_id * 1000 + turn as position, row_number() over (
    partition by conv_id // 8 order by conv_id * 1000 + turn) as rn from conversations)
select batch, position from placed where rn <= 20
""")
def intake_guard(spark, sf):
    turns = table(spark, sf, "conversations").select(
        F.floor(F.col("conv_id") / 8).alias("batch"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("position"),
    )
    return sample.intake_guard(turns, "batch", "position", 20)


@query("profile_shape", """
select count(*) as rows, 3 as columns, 'doc_id,quality,toxic' as column_list from labels
""")
def profile_shape(spark, sf):
    return profile.shape(table(spark, sf, "labels"))


@query("profile_labels", """
with c as (select lang, count(*) as n from documents group by lang)
select lang, n, round_even(100.0::double * n / sum(n) over (), 2) as percent from c
""")
def profile_labels(spark, sf):
    return profile.label_distribution(table(spark, sf, "documents"), "lang")


@query("profile_label_names", f"""
with c as (select {inputs.EVENT_CODE_SQL} as code, count(*) as n from events group by 1)
select code, n, round_even(100.0::double * n / sum(n) over (), 2) as percent,
  case code when 0 then 'click' when 1 then 'error' when 2 then 'purchase' else 'unknown' || code end as name
from c
""")
def profile_label_names(spark, sf):
    names = {"click": 0, "error": 1, "purchase": 2}
    return profile.label_distribution(inputs.events_coded(spark, sf), "code", names)


@query("label_status", """
select 'new_label' as label, 'missing' as status, count(*) as rows from documents
""")
def label_status(spark, sf):
    return profile.label_status(table(spark, sf, "documents"), "new_label")


@query("profile_nulls", "with " + inputs.TAGGED_SQL + """
select sum((tag is null)::int + (x is null or isnan(x))::int)::bigint as null_cells from (
  select tag, case when doc_id % 9 = 0 then 'nan'::double when doc_id % 9 = 1 then null
    else n_chars::double end as x from tagged)
""")
def profile_nulls(spark, sf):
    left = F.col("doc_id") % 9
    x = F.when(left == 0, F.lit(float("nan"))).when(left != 1, F.col("n_chars").cast("double"))
    return profile.null_total(inputs.tagged(spark, sf).select("doc_id", "tag", x.alias("x")))


@query("label_bincount", f"""
with c as (select 2 * {inputs.EVENT_CODE_SQL} as code, count(*) as n from events group by 1)
select g.code::bigint as code, coalesce(n, 0) as n from range(0, 9) g(code) left join c on c.code = g.code
""")
def label_bincount(spark, sf):
    events = inputs.events_coded(spark, sf).select((2 * F.col("code")).alias("code"))
    return profile.bin_counts(events, "code")


@query("matrix_moments", """
with cells as (
  select l_quantity as v from lineitem union all select l_extendedprice from lineitem
  union all select l_discount from lineitem union all select l_tax from lineitem)
select count(*)::bigint as n, round(avg(v), 4) + 0.0 as mean, round(stddev_samp(v), 4) + 0.0 as std from cells
""")
def matrix_moments(spark, sf):
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    out = profile.matrix_moments(table(spark, sf, "lineitem"), columns)
    return out.select("n", *[(F.round(c, 4) + F.lit(0.0)).alias(c) for c in ("mean", "std")])


@query("class_count", "select count(distinct event_type) as classes from events")
def class_count(spark, sf):
    return profile.class_count(table(spark, sf, "events"), "event_type")


@query("class_weights", """
with c as (select lang, count(*) as n from documents group by lang)
select lang, n, round(sum(n) over ()::double / (count(*) over () * n), 6) + 0.0 as weight from c
""")
def class_weights(spark, sf):
    return round_all(profile.class_weights(table(spark, sf, "documents"), "lang"), "weight")


@query("smoothed_class_weights", f"""
with c as (select {inputs.EVENT_CODE_SQL} as code, count(*) as n from events group by 1),
w as (select code, n, sqrt(sum(n) over ()::double / (count(*) over () * n)) as w,
  row_number() over (order by code) - 1 as place, count(*) over () as k from c)
select code, n, round(case when k > 3 and place = 3 then w * 0.5 else w end, 6) + 0.0 as weight from w
""")
def smoothed_class_weights(spark, sf):
    events = inputs.events_coded(spark, sf)
    return round_all(profile.smoothed_weights(events, "code"), "weight")


@query("profile_report", """
with d as (
  select case when doc_id % 7 = 0 then null else source end as source, doc_id // 2 as half, text, lang, n_chars from documents
  union all select source, -1, text, lang, n_chars from documents), c as (select count(*) as n from d)
select 'rows' as item, n from c
union all select 'null_cells', (select count(*) from d where source is null) from c
union all select 'duplicate_rows', n - (select count(*) from (select distinct * from d)) from c
union all select 'label ' || lang, count(*) from d group by lang
""")
def profile_report(spark, sf):
    """All columns of the documents, with gaps and copies put in."""
    docs, key = table(spark, sf, "documents"), F.col("doc_id")
    gaps = docs.withColumn("source", F.when(key % 7 != 0, F.col("source"))).withColumn("half", F.floor(key / 2))
    docs = gaps.drop("doc_id").unionByName(docs.withColumn("half", F.lit(-1).cast("long")).drop("doc_id"))
    report = profile.profile(docs, "lang", None)
    line = lambda df, name, value: df.select(name.alias("item"), F.col(value).cast("long").alias("n"))
    return (
        line(report["shape"], F.lit("rows"), "rows")
        .union(line(report["nulls"], F.lit("null_cells"), "null_cells"))
        .union(line(report["duplicates"], F.lit("duplicate_rows"), "duplicate_rows"))
        .union(line(report["distribution"], F.concat(F.lit("label "), F.col("lang")), "n"))
    )
