"""Queries for sources, cleaning, deduplication and the preparation jobs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlab import fixed
from flowlab.functions import cells
from flowlab.operators import clean, dedup, profile
from flowlab.operators.sample import class_cap, replay_first
from flowlab.plans import prep
from flowlab.plans.catalog import inputs
from flowlab.plans.catalog.registry import query, table
from flowlab.session import fresh_path, materialise
from flowlab.sources import flows as flow_files

LANGS = {"en": 0, "fr": 1, "de": 2, "es": 3}


@query("prepared_label_distribution", """
with named as (
  select doc_id, text, lang, doc_id % 5 = 0 as is_test,
    case lang when 'en' then 0 when 'fr' then 1 when 'de' then 2 when 'es' then 3 end as label
  from documents
), distinct_docs as (
  select min(doc_id) as doc_id, label, text, is_test from named group by label, text, is_test
), leakfree as (
  select * from distinct_docs t where not is_test or not exists (
    select 1 from distinct_docs g where not g.is_test and g.label = t.label and g.text = t.text)
), ranked as (
  select *, row_number() over (
    partition by is_test, label order by md5(doc_id::varchar || ':42'), doc_id) as rn from leakfree
), counts as (select is_test, label, count(*) as n from ranked where rn <= 40 group by all)
select case when is_test then 'test' else 'train' end as split, label::int as label, n,
  round_even(100.0::double * n / sum(n) over (partition by is_test), 2) as percent
from counts
""")
def prepared_label_distribution(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", F.col("lang").alias("attack_cat"))
    named = clean.map_labels(docs, "attack_cat", "label", LANGS).withColumn(
        "is_test", F.col("doc_id") % 5 == 0
    )
    pair = materialise(dedup.dedup_pair(named, "doc_id", "is_test"), "documents")
    sides = []
    for split, side in (("train", ~F.col("is_test")), ("test", F.col("is_test"))):
        capped = class_cap(pair.filter(side), "label", "doc_id", 40)
        sides.append(profile.label_distribution(capped, "label").select(F.lit(split).alias("split"), "*"))
    return sides[0].union(sides[1])


@query("csv_roundtrip", """
select o_orderkey, case when o_orderkey % 10 = 0 then null else o_orderstatus end as status,
  case when o_orderkey % 7 = 0 then null else o_totalprice end as price,
  o_orderpriority as priority
from orders
""")
def csv_roundtrip(spark, sf):
    key = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(key % 10 == 0, "NA").otherwise(F.col("o_orderstatus")).alias("status"),
        F.when(key % 7 == 0, "NaN").otherwise(F.col("o_totalprice").cast("string")).alias("price"),
        F.col("o_orderpriority").alias("priority"),
    )
    path = fresh_path(spark, "orders-csv")
    flow_files.write_csv(rows, path)
    schema = T.StructType([
        T.StructField("o_orderkey", T.LongType()),
        T.StructField("status", T.StringType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("priority", T.StringType()),
    ])
    return flow_files.read_csv(spark, path, schema)


MIXED_ORDERS_SQL = """
mixed as (
  select o_orderkey as id,
    case when o_orderkey % 10 = 0 then null else o_totalprice end as price,
    case when o_orderkey % 7 = 0 then null else o_custkey end as customer,
    (o_orderkey % 3 = 0) as third,
    o_orderdate as day,
    case when o_orderkey = (select max(o_orderkey) from orders) then 'unknown' else (o_custkey % 5)::varchar end as priority
  from orders)
"""


def mixed_orders(spark, sf):
    """A CSV folder with gaps, one column of numbers with a single word in it, and no schema."""
    key, orders = F.col("o_orderkey"), table(spark, sf, "orders")
    last = orders.agg(F.max("o_orderkey")).first()[0]
    rows = orders.select(
        key.alias("id"),
        F.when(key % 10 == 0, "NA").otherwise(F.col("o_totalprice").cast("string")).alias("price"),
        F.when(key % 7 == 0, " ").otherwise(F.col("o_custkey").cast("string")).alias("customer"),
        (key % 3 == 0).cast("string").alias("third"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
        F.when(key == last, "unknown").otherwise((F.col("o_custkey") % 5).cast("string")).alias("priority"),
    )
    path = fresh_path(spark, "mixed-csv")
    flow_files.write_csv(rows, path)
    return path


@query("csv_inferred", f"""with {MIXED_ORDERS_SQL}
select id + 0 as id, price, customer // 2 as half_customer, not third as not_third,
  strftime(day + interval 1 day, '%Y-%m-%d') as next_day, priority || '!' as priority from mixed
""")
def csv_inferred(spark, sf):
    """Types found from the cells: the expressions below need them."""
    read = flow_files.read_csv(spark, mixed_orders(spark, sf))
    kinds = dict(read.dtypes)
    if kinds != {"id": "bigint", "price": "double", "customer": "bigint", "third": "boolean", "day": "timestamp", "priority": "string"}:
        raise ValueError(f"unexpected types: {kinds}")
    return read.select(
        "id", "price", F.expr("customer div 2").alias("half_customer"), (~F.col("third")).alias("not_third"),
        F.date_format(F.col("day") + F.expr("interval 1 day"), "yyyy-MM-dd").alias("next_day"), F.concat("priority", F.lit("!")).alias("priority"),
    )


@query("csv_inferred_types", f"""with {MIXED_ORDERS_SQL}
select 'id' as column, 'bigint' as type, max(length(id::varchar))::int as width, count(*) - count(id) as missing from mixed
union all select 'price', 'double', null, count(*) - count(price) from mixed
union all select 'customer', 'bigint', max(length(customer::varchar))::int, count(*) - count(customer) from mixed
union all select 'third', 'boolean', max(length(third::varchar))::int, count(*) - count(third) from mixed
union all select 'day', 'timestamp', 10, count(*) - count(day) from mixed
union all select 'priority', 'string', max(length(priority))::int, count(*) - count(priority) from mixed
""")
def csv_inferred_types(spark, sf):
    """The width of floating-point numbers is left out: engines write them differently."""
    types = flow_files.csv_types(spark, mixed_orders(spark, sf))
    return types.withColumn("width", F.when(F.col("type") != "double", F.col("width")))


@query("csv_by_mode", f"""
select event_id, {inputs.EVENT_CODE_SQL} as new_label from events
""")
def csv_by_mode(spark, sf):
    events = inputs.events_coded(spark, sf).select("event_id", F.col("code").alias("new_label"))
    folder = fresh_path(spark, "modes")
    flow_files.write_csv(events, flow_files.mode_path(folder, "train", "multi"))
    schema = T.StructType(
        [T.StructField("event_id", T.LongType()), T.StructField("new_label", T.IntegerType())]
    )
    return flow_files.read_mode(spark, folder, "train", "multi", schema)


@query("source_report", """
select 'events' as name, 'found' as status, count(*) as rows from events
union all select 'labels', 'found', count(*) from labels
union all select 'absent', 'missing', 0
""")
def source_report(spark, sf):
    out = None
    for name in ("events", "labels", "absent"):
        found = flow_files.source_status(spark, f"{sf}/{name}.parquet").first()["status"] == "found"
        rows = table(spark, sf, name) if found else spark.range(0)
        line = rows.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("name"), F.lit("found" if found else "missing").alias("status"), "rows"
        )
        out = line if out is None else out.union(line)
    return out


@query("described_source", "select l_orderkey, l_quantity, l_returnflag from lineitem")
def described_source(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_quantity", "l_returnflag")
    data, description = fresh_path(spark, "lines-csv"), fresh_path(spark, "features-csv")
    flow_files.write_csv(lines, data)
    kinds = {"bigint": "Integer", "double": "Float", "string": "nominal"}
    features = [(i, name, kinds[dtype]) for i, (name, dtype) in enumerate(lines.dtypes, 1)]
    flow_files.write_csv(
        spark.createDataFrame(features, "`No.` int, Name string, Type string"), description
    )
    return flow_files.read_described(spark, data, description)[0]


@query("clean_documents", "with " + inputs.TAGGED_SQL + """
select doc_id,
  case when regexp_matches(tag, '^\\s*$') then null else tag end as blanked,
  nullif(tag, '-') as nulled,
  case when tag = '-' then 'unknown' else tag end as tokened,
  regexp_replace(regexp_replace(coalesce(tag, 'Normal'), '^\\s+', ''), '\\s+$', '') as filled
from tagged
""")
def clean_documents(spark, sf):
    tag = F.col("tag")
    return inputs.tagged(spark, sf).select(
        "doc_id",
        cells.blank_to_null(tag).alias("blanked"),
        cells.sentinel_to_null(tag).alias("nulled"),
        cells.sentinel_to_token(tag).alias("tokened"),
        cells.strip(F.coalesce(tag, F.lit("Normal"))).alias("filled"),
    )


@query("drop_incomplete_rows", "with " + inputs.TAGGED_SQL + """
select doc_id, tag, n_chars from tagged
where tag is not null and not regexp_matches(tag, '^\\s*$')
""")
def drop_incomplete_rows(spark, sf):
    rows = clean.drop_incomplete(clean.blanks_to_null(inputs.tagged(spark, sf)))
    return rows.drop("source", "id", "not_there")


@query("label_map_binary_merge", "with " + inputs.TAGGED_SQL + """
, coded as (
  select doc_id, case trim(tag, ' ' || chr(9))
    when 'en' then 0 when 'fr' then 1 when 'de' then 2 when 'es' then 3 end as code
  from tagged)
select doc_id, code, case when code = 0 then 0 else 1 end as binary_label,
  case when code in (2, 3) then 2 else code end as merged_label,
  case when doc_id % 13 = 0 then 'unknown9'
    else case code when 0 then 'en' when 1 then 'fr' when 2 then 'de' else 'es' end end as name
from coded where code is not null
""")
def label_map_binary_merge(spark, sf):
    coded = clean.map_labels(inputs.tagged(spark, sf), "tag", "code", LANGS)
    shown = F.when(F.col("doc_id") % 13 == 0, 9).otherwise(F.col("code"))
    return coded.select(
        "doc_id",
        "code",
        cells.to_binary(F.col("code")).alias("binary_label"),
        cells.merge_classes(F.col("code"), (2, 3), 2).alias("merged_label"),
        cells.label_name(shown, LANGS).alias("name"),
    )


@query("remove_classes", f"""
select * from (select event_id, {inputs.EVENT_CODE_SQL} as code from events)
where code not in (2, 4)
""")
def remove_classes(spark, sf):
    events = inputs.events_coded(spark, sf).select("event_id", "code")
    return clean.remove_classes(events, "code", [2, 4])


@query("keep_classes", f"""
select * from (select event_id, {inputs.EVENT_CODE_SQL} as code from events)
where code in (0, 3)
""")
def keep_classes(spark, sf):
    events = inputs.events_coded(spark, sf).select("event_id", "code")
    return clean.keep_classes(events, "code", fixed.TWO_CLASSES)


LINE_COLUMNS = ["l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
LINE_SQL = """
lines as (
  select l_quantity, l_discount, nullif(l_tax, 0) as l_tax, l_returnflag, l_linestatus,
    l_orderkey % 5 = 0 as is_test from lineitem),
train as (select distinct * exclude (is_test) from lines where not is_test),
test as (select distinct * exclude (is_test) from lines where is_test)
"""


def line_sets(spark, sf):
    lines = table(spark, sf, "lineitem").withColumn("l_tax", F.nullif(F.col("l_tax"), F.lit(0.0)))
    is_test = F.col("l_orderkey") % 5 == 0
    return [
        dedup.drop_duplicates(lines.filter(side).select(*LINE_COLUMNS)) for side in (~is_test, is_test)
    ]


@query("dedup_rows", """
select distinct l_quantity, l_discount, l_tax, l_returnflag, l_linestatus from lineitem
""")
def dedup_rows(spark, sf):
    return dedup.drop_duplicates(table(spark, sf, "lineitem").select(*LINE_COLUMNS))


@query("dedup_features", """
select min(o_orderkey) as o_orderkey, o_orderstatus, o_orderpriority, o_custkey
from orders group by all
""")
def dedup_features(spark, sf):
    orders = table(spark, sf, "orders")
    return dedup.dedup_features(orders, ["o_totalprice", "o_orderdate"], "o_orderkey")


@query("duplicate_count", """
select (count(*) - (select count(*) from (select distinct p_type, p_size from part)))::bigint
  as duplicate_rows from part
""")
def duplicate_count(spark, sf):
    return dedup.duplicate_count(table(spark, sf, "part").select("p_type", "p_size"))


@query("removal_report", """
with a as (select p_brand, p_type, p_size from part),
b as (select distinct * from a),
c as (select distinct p_type, p_size from a)
select (select count(*) from a) as rows_in,
  (select count(*) from a) - (select count(*) from b) as removed_whole,
  (select count(*) from b) - (select count(*) from c) as removed_feature,
  (select count(*) from c) as rows_out
""")
def removal_report(spark, sf):
    part = table(spark, sf, "part").select("p_brand", "p_type", "p_size")
    return dedup.removal_report(part, ["p_brand"])


@query("leak_train_minus_test", f"with {LINE_SQL} select * from train except select * from test")
def leak_train_minus_test(spark, sf):
    train, test = line_sets(spark, sf)
    return dedup.remove_leaks(train, test)


@query("leak_test_minus_train", f"with {LINE_SQL} select * from test except select * from train")
def leak_test_minus_train(spark, sf):
    train, test = line_sets(spark, sf)
    return dedup.remove_leaks(test, train)


LEAK_ROWS_SQL = f"with {LINE_SQL}" + """
select l.l_quantity, l.l_discount, l.l_tax, l.l_returnflag, l.l_linestatus
from lines l where l.is_test and not exists (
  select 1 from train t where t.l_quantity = l.l_quantity and t.l_discount = l.l_discount
    and t.l_tax is not distinct from l.l_tax and t.l_returnflag = l.l_returnflag
    and t.l_linestatus = l.l_linestatus)
"""


@query("leak_rows_kept", LEAK_ROWS_SQL)
def leak_rows_kept(spark, sf):
    lines = table(spark, sf, "lineitem").withColumn("l_tax", F.nullif(F.col("l_tax"), F.lit(0.0)))
    is_test = F.col("l_orderkey") % 5 == 0
    return dedup.remove_leaks(
        lines.filter(is_test).select(*LINE_COLUMNS), lines.filter(~is_test).select(*LINE_COLUMNS)
    )


@query("leak_rows_filtered", LEAK_ROWS_SQL)
def leak_rows_filtered(spark, sf):
    lines = table(spark, sf, "lineitem").withColumn("l_tax", F.nullif(F.col("l_tax"), F.lit(0.0)))
    is_test = F.col("l_orderkey") % 5 == 0
    return dedup.remove_leaks_filtered(
        lines.filter(is_test).select(*LINE_COLUMNS), lines.filter(~is_test).select(*LINE_COLUMNS)
    )


@query("leak_mixed_types", f"with {LINE_SQL}" + """
select l.l_quantity, l.l_discount, l.l_tax, l.l_returnflag, l.l_linestatus
from lines l where l.is_test and not exists (
  select 1 from train t where t.l_quantity = l.l_quantity and t.l_discount = l.l_discount
    and t.l_tax is not distinct from l.l_tax and t.l_returnflag = l.l_returnflag
    and t.l_linestatus = l.l_linestatus)
""")
def leak_mixed_types(spark, sf):
    """The victim's quantities are whole numbers, the guard's are doubles."""
    lines = table(spark, sf, "lineitem").withColumn("l_tax", F.nullif(F.col("l_tax"), F.lit(0.0)))
    is_test = F.col("l_orderkey") % 5 == 0
    victim = lines.filter(is_test).select(*LINE_COLUMNS).withColumn("l_quantity", F.col("l_quantity").cast("int"))
    left = dedup.remove_leaks(victim, lines.filter(~is_test).select(*LINE_COLUMNS))
    return left.withColumn("l_quantity", F.col("l_quantity").cast("double"))


@query("pair_removal_report", """
with o as (select o_orderstatus, o_orderpriority, o_custkey, o_orderkey % 5 = 0 as is_test from orders),
g as (select o_orderstatus, o_orderpriority, o_custkey, count(*) filter (is_test) as n_test,
  count(*) filter (not is_test) as n_train from o group by all),
s as (
  select 'train' as split, n_train as n, greatest(n_train - 1, 0) as copies, 0 as leaks from g
  union all select 'test', n_test, greatest(n_test - 1, 0), (n_test > 0 and n_train > 0)::int from g)
select split, sum(n)::bigint as rows_in, sum(copies)::bigint as copies, sum(leaks)::bigint as leaks,
  sum(n - copies - leaks)::bigint as rows_out from s group by split
""")
def pair_removal_report(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_custkey")
    return dedup.pair_report(orders.withColumn("is_test", F.col("o_orderkey") % 5 == 0), "o_orderkey", "is_test")


@query("dedup_pair", """
with sides as (
  select doc_id, lang, text, doc_id % 5 = 0 as is_test from documents),
firsts as (select min(doc_id) as doc_id, lang, text, is_test from sides group by lang, text, is_test)
select doc_id, lang, md5(text) as digest, is_test::int as is_test from firsts t
where not is_test or not exists (
  select 1 from firsts g where not g.is_test and g.lang = t.lang and g.text = t.text)
""")
def dedup_pair(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "text")
    pair = dedup.dedup_pair(docs.withColumn("is_test", F.col("doc_id") % 5 == 0), "doc_id", "is_test")
    return pair.select(
        "doc_id", "lang", F.md5(F.col("text").cast("binary")).alias("digest"),
        F.col("is_test").cast("int").alias("is_test"),
    )


@query("union_and_split_back", """
select o_orderkey, o_orderstatus, case when o_orderkey % 5 = 0 then 'test' else 'train' end as side from orders
""")
def union_and_split_back(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    is_test = F.col("o_orderkey") % 5 == 0
    both = dedup.union_sets(orders.filter(~is_test), orders.filter(is_test))
    sides = [dedup.take_set(both, side).withColumn("side", F.lit(side)) for side in ("train", "test")]
    return sides[0].union(sides[1])


@query("replay_append", """
with seen as (
  select event_id, event_type, row_number() over (
    partition by event_type order by ts, event_id) as rn from events where event_id % 2 = 0)
select event_id, event_type, 1 as replayed from seen where rn <= 200
union all
select event_id, event_type, 0 from events where event_id % 2 = 1
""")
def replay_append(spark, sf):
    events = table(spark, sf, "events").select("event_id", "event_type", "ts")
    old, new = events.filter("event_id % 2 = 0"), events.filter("event_id % 2 = 1")
    buffer = replay_first(old, "event_type", ["ts", "event_id"])
    return dedup.append_replay(new.drop("ts"), buffer.drop("ts"))


FLOW_OUT = "id, dur, proto, service, state, spkts, sbytes, rate, sttl, tcprtt, ct_srv_src, new_label"


def capped_sql(cap: str) -> str:
    return "with " + inputs.CLEAN_FLOWS_SQL + f"""
, ranked as (
  select *, row_number() over (partition by is_test, new_label
    order by md5(id::varchar || ':42'), id) as rn from leakfree)
select {FLOW_OUT}, is_test::int as is_test from ranked where rn <= {cap}
"""


def _both(pair):
    train, test = pair
    return train.withColumn("is_test", F.lit(0)).unionByName(test.withColumn("is_test", F.lit(1)))


@query("offline_preparation", capped_sql("150"))
def offline_preparation(spark, sf):
    return _both(prep.prepare_offline(*inputs.flow_pair(spark, sf), cap=150))


@query("offline_preparation_by_class", capped_sql("case when new_label = 0 then 200 else 50 end"))
def offline_preparation_by_class(spark, sf):
    return _both(prep.prepare_offline(*inputs.flow_pair(spark, sf), cap=50, special={0: 200}))


@query("offline_counters", "with " + inputs.CLEAN_FLOWS_SQL + """
, per_class as (
  select is_test, new_label, count(*) as n, least(count(*), 150) as kept from leakfree group by all)
select case when t.is_test then 'test' else 'train' end as split,
  (select count(*) from flows where (id % 5 = 0) = t.is_test) as rows_in,
  (select count(*) from flows where (id % 5 = 0) = t.is_test) - (select count(*) from cleaned c where c.is_test = t.is_test) as gaps,
  (select count(*) from cleaned c where c.is_test = t.is_test) - (select count(*) from distinct_flows d where d.is_test = t.is_test) as copies,
  (select count(*) from labelled l where l.is_test = t.is_test and new_label is null) as unlabelled,
  (select count(*) from coded c where c.is_test = t.is_test) - (select count(*) from leakfree f where f.is_test = t.is_test) as leaks,
  (select sum(n - kept) from per_class p where p.is_test = t.is_test)::bigint as capped,
  (select sum(kept) from per_class p where p.is_test = t.is_test)::bigint as rows_out
from (values (true), (false)) t(is_test)
""")
def offline_counters(spark, sf):
    """What the offline preparation removes, as its own job counts it."""
    counts = prep.prepare_offline_counted(*inputs.flow_pair(spark, sf), cap=150)[1]
    return spark.createDataFrame(counts, COUNTERS + ", unlabelled long, capped long")


COUNTERS = "split string, rows_in long, gaps long, copies long, leaks long, rows_out long"
ONLINE_SQL = "with " + inputs.FLOWS_SQL + """
, cleaned as (
  select *, id % 5 = 0 as is_test from flows where service <> '-' and tcprtt is not null
), labelled as (
  select * exclude (attack_cat, label), {label} as label from cleaned
), firsts as (
  select min(id) as id, * exclude (id) from labelled group by all
), kept as (
  select * from firsts t where t.is_test or not exists (
    select 1 from firsts g where g.is_test and g.dur = t.dur and g.proto = t.proto
      and g.service = t.service and g.state = t.state and g.spkts = t.spkts
      and g.sbytes = t.sbytes and g.rate = t.rate and g.sttl = t.sttl
      and g.tcprtt = t.tcprtt and g.ct_srv_src = t.ct_srv_src and g.label = t.label)
), bounds as (
  select min(dur) as dur0, max(dur) - min(dur) as dur1, min(sbytes) as sb0,
    max(sbytes) - min(sbytes) as sb1, min(sttl) as st0, max(sttl) - min(sttl) as st1
  from kept where not is_test
)
select id, is_test::int as is_test, label::int as label,
  round((dur - dur0) / dur1, 6) + 0.0 as dur,
  round((sbytes - sb0)::double / sb1, 6) + 0.0 as sbytes,
  round((sttl - st0)::double / st1, 6) + 0.0 as sttl,
  (proto = 'F')::int::double as "proto_F",
  (service = '1-URGENT')::int::double as "service_1-URGENT",
  (state = 'S2')::int::double as "state_S2"
from kept, bounds
"""


def _online(spark, sf, mode):
    both = _both(prep.prepare_online(*inputs.flow_pair(spark, sf), mode))
    shown = ["dur", "sbytes", "sttl", "proto_F", "service_1-URGENT", "state_S2"]
    return both.select(
        "id", "is_test", F.col("label").cast("int").alias("label"),
        *[(F.round(F.col(f"`{c}`"), 6) + F.lit(0.0)).alias(c) for c in shown],
    )


@query("online_counters", "with " + inputs.FLOWS_SQL + """
, cleaned as (
  select *, id % 5 = 0 as is_test from flows where service <> '-' and tcprtt is not null
), labelled as (
  select * exclude (attack_cat, label, id), case when label = 0 then 0 else 1 end as label from cleaned
), grouped as (
  select * exclude (is_test), count(*) filter (is_test) as n_test, count(*) filter (not is_test) as n_train
  from labelled group by all
), sides as (
  select 'train' as split, n_train as n, (n_train > 0 and n_test > 0)::int as leak from grouped
  union all select 'test', n_test, 0 from grouped
), totals as (select case when id % 5 = 0 then 'test' else 'train' end as split, count(*) as rows_in from flows group by all)
select split, rows_in, rows_in - sum(n)::bigint as gaps, sum(greatest(n - 1, 0))::bigint as copies,
  sum(leak)::bigint as leaks, sum(least(n, 1) - leak)::bigint as rows_out
from sides join totals using (split) group by split, rows_in
""")
def online_counters(spark, sf):
    """What the online preparation removes, as its own job counts it."""
    return spark.createDataFrame(prep.prepare_online_counted(*inputs.flow_pair(spark, sf), "binary")[1], COUNTERS)


@query("online_preparation_binary", ONLINE_SQL.replace("{label}", "case when label = 0 then 0 else 1 end"))
def online_preparation_binary(spark, sf):
    return _online(spark, sf, "binary")


@query("online_preparation_multi", ONLINE_SQL.replace(
    "{label}",
    """case trim(attack_cat, ' ' || chr(9))
    when 'Analysis' then 0 when 'Backdoor' then 1 when 'DoS' then 2 when 'Exploits' then 3
    when 'Fuzzers' then 4 when 'Generic' then 5 when 'Mystery' then 6 when 'Normal' then 7
    when 'Reconnaissance' then 8 when 'Shellcode' then 9 else 10 end""",
))
def online_preparation_multi(spark, sf):
    return _online(spark, sf, "multi")
