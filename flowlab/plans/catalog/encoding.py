"""Queries for encoding, scaling, selection, column routing and reshaping."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from flowlab.operators import clean, encode, preparation
from flowlab.plans import prep
from flowlab.plans.catalog import inputs
from flowlab.plans.catalog.preparing import _both
from flowlab.plans.catalog.registry import query, r6, round_all, table
from flowlab.session import fresh_path


def order_pair(spark, sf, *columns):
    orders = table(spark, sf, "orders").select("o_orderkey", *columns)
    is_test = F.col("o_orderkey") % 5 == 0
    return orders.filter(~is_test), orders.filter(is_test)


STATUSES, PRIORITIES = ["F", "O", "P"], ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
ONE_HOT_SQL = ", ".join(
    [f"(o_orderstatus = '{v}')::int as \"o_orderstatus_{v}\"" for v in STATUSES]
    + [f"(o_orderpriority = '{v}')::int as \"o_orderpriority_{v}\"" for v in PRIORITIES]
)


@query("onehot_union", f"select o_orderkey, {ONE_HOT_SQL}, (o_orderkey % 5 = 0)::int as is_test from orders")
def onehot_union(spark, sf):
    pair = order_pair(spark, sf, "o_orderstatus", "o_orderpriority")
    return _both(encode.one_hot_pair(*pair, ["o_orderstatus", "o_orderpriority"]))


@query("onehot_self", f"select o_orderkey, {ONE_HOT_SQL} from orders")
def onehot_self(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return encode.one_hot_self(orders, ["o_orderstatus", "o_orderpriority"])


@query("ordinal_union", """
with s as (select distinct o_orderstatus as v from orders),
p as (select distinct o_orderpriority as v from orders)
select o_orderkey, (select count(*) from s where v < o_orderstatus)::int as o_orderstatus,
  (select count(*) from p where v < o_orderpriority)::int as o_orderpriority,
  (o_orderkey % 5 = 0)::int as is_test from orders
""")
def ordinal_union(spark, sf):
    pair = order_pair(spark, sf, "o_orderstatus", "o_orderpriority")
    return _both(encode.ordinal_pair(*pair, ["o_orderstatus", "o_orderpriority"]))


@query("ordinal_many_values", """
select o_orderkey, (dense_rank() over (order by o_custkey) - 1)::int as o_custkey from orders
""")
def ordinal_many_values(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    encoder = encode.OrdinalEncoder.fit("o_custkey", orders)
    return encoder.apply(orders)


@query("label_encode", f"""
select event_id, case code when 0 then 0 else 1 end as code, (event_id % 5 = 0)::int as is_test
from (select event_id, {inputs.EVENT_CODE_SQL} as code from events) where code in (0, 3)
""")
def label_encode(spark, sf):
    events = inputs.events_coded(spark, sf).select("event_id", "code").filter("code in (0, 3)")
    is_test = F.col("event_id") % 5 == 0
    train, test, _ = encode.encode_labels(events.filter(~is_test), events.filter(is_test), "code")
    return _both((train, test))


PART_FEATURES = ["p_size", "p_retailprice", "fixed"]


def part_pair(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice", F.lit(7).alias("fixed"))
    is_test = F.col("p_partkey") % 5 == 0
    return parts.filter(~is_test), parts.filter(is_test)


@query("minmax_scale", """
with b as (select min(p_size) as s0, max(p_size) - min(p_size) as s1, min(p_retailprice) as r0,
    max(p_retailprice) - min(p_retailprice) as r1 from part where p_partkey % 5 <> 0)
select p_partkey, (p_partkey % 5 = 0)::int as is_test,
  round((p_size - s0)::double / s1, 6) + 0.0 as p_size,
  round((p_retailprice - r0) / r1, 6) + 0.0 as p_retailprice, 0.0::double as fixed
from part, b
""")
def minmax_scale(spark, sf):
    return round_all(_both(encode.minmax_pair(*part_pair(spark, sf), PART_FEATURES)), *PART_FEATURES)


@query("standard_scale", """
with b as (select avg(p_size) as s0, stddev_pop(p_size) as s1, avg(p_retailprice) as r0,
    stddev_pop(p_retailprice) as r1 from part where p_partkey % 5 <> 0)
select p_partkey, (p_partkey % 5 = 0)::int as is_test,
  round((p_size - s0) / s1, 6) + 0.0 as p_size,
  round((p_retailprice - r0) / r1, 6) + 0.0 as p_retailprice, 0.0::double as fixed
from part, b
""")
def standard_scale(spark, sf):
    return round_all(
        _both(encode.standardise_pair(*part_pair(spark, sf), PART_FEATURES)), *PART_FEATURES
    )


LINE_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "fixed"]


def priced_lines(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", *LINE_FEATURES[:4], F.lit(1).alias("fixed"),
        (F.col("l_extendedprice") > 50000).cast("int").alias("label"),
    )


@query("corr_select", """
with l as (select *, (l_extendedprice > 50000)::int as label from lineitem),
c as (
  select 'l_quantity' as feature, corr(l_quantity, label) as c from l
  union all select 'l_extendedprice', corr(l_extendedprice, label) from l
  union all select 'l_discount', corr(l_discount, label) from l
  union all select 'l_tax', corr(l_tax, label) from l)
select feature, round(c, 6) + 0.0 as corr from c where abs(c) > 0.1
""")
def corr_select(spark, sf):
    return round_all(encode.select_features(priced_lines(spark, sf), LINE_FEATURES, "label"), "corr")


@query("corr_all", """
with l as (select *, (l_extendedprice > 50000)::int as label from lineitem)
select 'l_quantity' as feature, round(corr(l_quantity, label), 6) + 0.0 as corr from l
union all select 'l_extendedprice', round(corr(l_extendedprice, label), 6) + 0.0 from l
union all select 'l_discount', round(corr(l_discount, label), 6) + 0.0 from l
union all select 'l_tax', round(corr(l_tax, label), 6) + 0.0 from l
union all select 'fixed', null
""")
def corr_all(spark, sf):
    return round_all(encode.correlations(priced_lines(spark, sf), LINE_FEATURES, "label"), "corr")


@query("corr_select_count", """
with l as (select *, (l_extendedprice > 50000)::int as label from lineitem)
select (abs(corr(l_quantity, label)) > 0.1)::int::bigint + (abs(corr(l_extendedprice, label)) > 0.1)::int
  + (abs(corr(l_discount, label)) > 0.1)::int + (abs(corr(l_tax, label)) > 0.1)::int as selected from l
""")
def corr_select_count(spark, sf):
    chosen = encode.select_features(priced_lines(spark, sf), LINE_FEATURES, "label")
    return chosen.agg(F.count(F.lit(1)).alias("selected"))


@query("corr_select_frame", """
select l_orderkey, l_extendedprice, (l_extendedprice > 50000)::int as label from lineitem
""")
def corr_select_frame(spark, sf):
    return encode.project_selected(
        priced_lines(spark, sf), LINE_FEATURES, "label", keep=["l_orderkey"]
    )


def exploded(df, key, source):
    """A nested array as rows ``(key, i, j, value)``."""
    return df.select(key, F.posexplode(source).alias("i", "row")).select(
        key, "i", F.posexplode("row").alias("j", "value")
    )


# Each row's rescaled values ``c`` and their sines, by position.
POLAR_SQL = """
v as (select vec_id, [x::double for x in embedding] as e from embeddings),
x as (select vec_id, unnest(range(1, 65)) as i, list_min(e) as lo, list_max(e) as hi, e from v),
s as (select vec_id, i, case when hi > lo then (2 * e[i] - hi - lo) / (hi - lo) else 0 end as c from x),
t as (select vec_id, sum(c) as sc, sum(sqrt(greatest(1 - c * c, 0))) as ss from s group by vec_id)
"""


def vector_images(spark, sf):
    return encode.image(table(spark, sf, "embeddings").select("vec_id", "embedding"), "embedding")


@query("gaf_image", f"with {POLAR_SQL}" + """
select s.vec_id, (i - 1)::int as i, round(2 * c * c - 1, 6) + 0.0 as diagonal,
  round(c * sc - sqrt(greatest(1 - c * c, 0)) * ss, 6) + 0.0 as row_sum,
  round(c * c0 - sqrt(greatest(1 - c * c, 0)) * sqrt(greatest(1 - c0 * c0, 0)), 6) + 0.0 as first
from s join t on t.vec_id = s.vec_id join (select vec_id, c as c0 from s where i = 1) z on z.vec_id = s.vec_id
""")
def gaf_image(spark, sf):
    lines = vector_images(spark, sf).select("vec_id", F.posexplode("image").alias("i", "line"))
    return lines.select(
        "vec_id", "i", r6(F.get("line", F.col("i"))).alias("diagonal"),
        r6(F.aggregate("line", F.lit(0.0), lambda acc, v: acc + v)).alias("row_sum"),
        r6(F.get("line", F.lit(0))).alias("first"),
    )


@query("gaf_image_full", f"with {POLAR_SQL}" + """
select vec_id, 64 as side, round(sc * sc - ss * ss, 4) + 0.0 as mass from t
""")
def gaf_image_full(spark, sf):
    summed = F.aggregate(F.flatten("image"), F.lit(0.0), lambda acc, v: acc + v)
    return vector_images(spark, sf).select(
        "vec_id", F.size("image").alias("side"), (F.round(summed, 4) + F.lit(0.0)).alias("mass")
    )


@query("assemble_vector", """
select l_orderkey, l_linenumber, l_partkey,
  l_quantity::float::double as f0, l_extendedprice::float::double as f1, l_tax::float::double as f2
from lineitem
""")
def assemble_vector(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_tax"
    )
    out = encode.assemble(lines, ["l_quantity", "l_extendedprice", "l_tax"])
    values = vector_to_array("features")
    return out.select(
        "l_orderkey", "l_linenumber", "l_partkey", *[values[i].alias(f"f{i}") for i in range(3)]
    )


def shape_sql(rows: int) -> str:
    width = 64 // rows
    return f"""
with v as (select vec_id, embedding as e, unnest(range(0, 64)) as pos from embeddings)
select vec_id, (pos // {width})::int as i, (pos % {width})::int as j,
  round(e[pos + 1]::double, 6) + 0.0 as value from v
"""


def shaped(spark, sf, rows):
    vectors = table(spark, sf, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("v")
    )
    out = exploded(clean.reshape(vectors, "v", rows), "vec_id", "x")
    return out.withColumn("value", r6(F.col("value")))


@query("reshape_sequence", shape_sql(16))
def reshape_sequence(spark, sf):
    return shaped(spark, sf, 16)


@query("reshape_square", shape_sql(8))
def reshape_square(spark, sf):
    return shaped(spark, sf, 8)


@query("feature_label_split", """
select p_partkey, p_size::double as x0, p_retailprice as x1, 7.0::double as x2,
  (p_size > 25)::int as label from part
""")
def feature_label_split(spark, sf):
    parts = table(spark, sf, "part").select(
        "p_partkey", "p_size", "p_retailprice", F.lit(7).alias("fixed"),
        (F.col("p_size") > 25).cast("int").alias("big"),
    )
    out = clean.feature_label(parts, "big", keep=["p_partkey"])
    return out.select("p_partkey", *[F.col("x")[i].alias(f"x{i}") for i in range(3)], "label")


def order_numbers(spark, sf):
    """Numeric order columns under flow-table names."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf, "orders").select(
        key.alias("id"),
        (cust % 7).alias("dur"), (cust % 13).alias("spkts"), (cust % 17).alias("sbytes"),
        (key % 3).alias("sttl"), (key % 11).alias("sinpkt"), (key % 5).alias("synack"),
        (key % 9).alias("ct_srv_src"), (cust % 4).alias("ct_flw_http_mthd"),
        (cust % 19).alias("swin"), F.col("o_orderstatus").alias("proto"),
        (cust % 10).cast("int").alias("new_label"),
    )


NUMBERS_SQL = """
numbers as (
  select o_orderkey as id, o_custkey % 7 as dur, o_custkey % 13 as spkts, o_custkey % 17 as sbytes,
    o_orderkey % 3 as sttl, o_orderkey % 11 as sinpkt, o_orderkey % 5 as synack,
    o_orderkey % 9 as ct_srv_src, o_custkey % 4 as ct_flw_http_mthd, o_custkey % 19 as swin,
    case o_orderstatus when 'F' then 0 when 'O' then 1 else 2 end as proto, (o_custkey % 10)::int as new_label from orders)
"""


def flat(df, static, dynamic, *keep):
    """Group vectors as one column per element."""
    return df.select(
        *keep,
        *[F.col("x_static")[i].alias(f"s{i}") for i in range(static)],
        *[F.col("x_dynamic")[i].alias(f"d{i}") for i in range(dynamic)],
    )


@query("group_columns", f"with {NUMBERS_SQL}" + """
select id, spkts::double as s0, sbytes::double as s1, synack::double as s2, ct_srv_src::double as s3,
  swin::double as s4, dur::double as d0, sttl::double as d1, sinpkt::double as d2,
  ct_flw_http_mthd::double as d3 from numbers
""")
def group_columns(spark, sf):
    rows = order_numbers(spark, sf).drop("proto")
    groups = clean.semantic_groups(rows.drop("id", "new_label").columns)
    return flat(clean.group_columns(rows, groups, ["id"]), 5, 4, "id")


@query("group_columns_listed", f"with {NUMBERS_SQL}" + """
select id, spkts::double as s0, sbytes::double as s1, sttl::double as s2, ct_srv_src::double as s3,
  ct_flw_http_mthd::double as s4, swin::double as s5, dur::double as d0, sinpkt::double as d1,
  synack::double as d2 from numbers
""")
def group_columns_listed(spark, sf):
    rows = order_numbers(spark, sf).drop("proto")
    static, dynamic = clean.listed_groups(rows.drop("id", "new_label").columns)
    present = [[c for c in g if c in rows.columns] for g in (static, dynamic)]
    return flat(clean.group_columns(rows, (present[0], present[1]), ["id"]), 6, 3, "id")


@query("concat_groups", f"with {NUMBERS_SQL}" + """
select id, 9 as width, (spkts + sbytes + synack + ct_srv_src + swin)::double as first_five,
  ct_flw_http_mthd::double as last_one from numbers
""")
def concat_groups(spark, sf):
    rows = order_numbers(spark, sf).drop("proto")
    groups = clean.semantic_groups(rows.drop("id", "new_label").columns)
    x = clean.concat_groups(clean.group_columns(rows, groups, ["id"]))
    first = F.aggregate(F.slice("x", 1, 5), F.lit(0.0), lambda acc, v: acc + v)
    return x.select(
        "id", F.size("x").alias("width"), first.alias("first_five"), F.col("x")[8].alias("last_one")
    )


@query("reorder_columns", f"with {NUMBERS_SQL}" + """
select 'spkts,sbytes,dur,sinpkt,synack,ct_srv_src,ct_flw_http_mthd,id,sttl,swin,proto,new_label' as column_list,
  count(*) as n, sum(spkts)::bigint as first_sum, sum(new_label)::bigint as last_sum from numbers
""")
def reorder_columns(spark, sf):
    rows = clean.reorder_columns(order_numbers(spark, sf))
    first, last = rows.columns[0], rows.columns[-1]
    return rows.agg(
        F.lit(",".join(rows.columns)).alias("column_list"), F.count(F.lit(1)).alias("n"),
        F.sum(first).alias("first_sum"), F.sum(last).cast("long").alias("last_sum"),
    )


# Model-input loaders.
def loaded_sql(label: str, where: str = "true") -> str:
    names = ["dur", "spkts", "sbytes", "sttl", "sinpkt", "synack", "ct_srv_src", "ct_flw_http_mthd", "swin", "proto"]
    fit = ", ".join(f"avg({c}) as {c}_m, stddev_pop({c}) as {c}_s" for c in names)
    out = ", ".join(f"round(({c} - {c}_m) / {c}_s, 6) + 0.0 as {c}" for c in names)
    return f"""
with {NUMBERS_SQL}, chosen as (
  select *, id % 5 = 0 as is_test, {label} as y from numbers where {where}
), fit as (select {fit} from chosen where not is_test)
select id, is_test::int as is_test, y as new_label, {out} from chosen, fit
"""


def number_pair(spark, sf):
    rows = order_numbers(spark, sf)
    is_test = F.col("id") % 5 == 0
    return rows.filter(~is_test), rows.filter(is_test)


def _loaded(pair):
    both = _both(pair)
    return round_all(both, *[c for c in both.columns if c not in ("id", "new_label", "is_test")])


@query("load_baseline_binary", loaded_sql("case when new_label = 0 then 0 else 1 end"))
def load_baseline_binary(spark, sf):
    return _loaded(prep.load_baseline(*number_pair(spark, sf), "binary"))


@query("load_baseline_multi", loaded_sql("least(new_label, 6)"))
def load_baseline_multi(spark, sf):
    return _loaded(prep.load_baseline(*number_pair(spark, sf), "multi"))


@query("load_reordered", loaded_sql("least(new_label, 6)"))
def load_reordered(spark, sf):
    return _loaded(prep.load_reordered(*number_pair(spark, sf), "multi"))


def grouped_sql(label: str, where: str = "true") -> str:
    static = ["spkts", "sbytes", "synack", "ct_srv_src", "swin", "proto"]
    dynamic = ["dur", "sttl", "sinpkt", "ct_flw_http_mthd"]
    columns = [f"{c} as s{i}" for i, c in enumerate(static)] + [f"{c} as d{i}" for i, c in enumerate(dynamic)]
    return f"select id, is_test, new_label, {', '.join(columns)} from ({loaded_sql(label, where)})"


def _grouped(pair):
    out = flat(_both(pair), 6, 4, "id", "is_test", "new_label")
    return round_all(out, *[c for c in out.columns if c[0] in "sd"])


@query("load_grouped", grouped_sql("case when new_label = 0 then 0 else 1 end"))
def load_grouped(spark, sf):
    return _grouped(prep.load_grouped(*number_pair(spark, sf), "binary"))


@query("load_without_rare", grouped_sql("new_label", "new_label < 6"))
def load_without_rare(spark, sf):
    return _grouped(prep.load_without_rare(*number_pair(spark, sf)))


@query("load_two_class", """
with numbers as (select * from (""" + f"with {NUMBERS_SQL}" + """
  select *, id % 5 = 0 as is_test, row_number() over (partition by id % 5 = 0, new_label
    order by md5(id::varchar || ':42'), id) as rn from numbers where new_label in (0, 3)) where rn <= 100),
fit as (select avg(dur) as m0, stddev_pop(dur) as s0, avg(swin) as m1, stddev_pop(swin) as s1
  from numbers where not is_test)
select id, is_test::int as is_test, case new_label when 0 then 0 else 1 end as new_label,
  round((dur - m0) / s0, 6) + 0.0 as dur, round((swin - m1) / s1, 6) + 0.0 as swin from numbers, fit
""")
def load_two_class(spark, sf):
    both = _both(prep.load_two_class(*number_pair(spark, sf), cap=100))
    return round_all(both.select("id", "is_test", "new_label", "dur", "swin"), "dur", "swin")


SAVED_SQL = """
rows as (
  select o_orderkey, o_orderkey % 5 = 0 as is_test, o_orderstatus as status, o_orderpriority as priority, o_totalprice as price,
    (o_custkey % 7)::double as noise, o_totalprice * 2 + o_custkey as echo
  from orders where o_orderkey % 11 <> 0),
train as (select * from rows where not is_test and status <> 'P'),
codes as (
  select *, (row_number() over (partition by name order by value) - 1)::int as code from (
    select distinct 'status' as name, status as value from train union all select distinct 'priority', priority from train)),
sizes as (select name, count(*)::int as size from codes group by name),
moments as (select avg(price) as price_mean, stddev_pop(price) as price_sd, abs(corr(noise, price)) > 0.1 as noisy from train)
"""


def saved_preparation(spark, sf, layout):
    """A preparation fitted on some orders, saved, loaded, and applied to the others."""
    key = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(
        key,
        F.when(key % 11 == 0, " ").otherwise(F.col("o_orderstatus")).alias("status"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_totalprice").alias("price"),
        (F.col("o_custkey") % 7).cast("double").alias("noise"),
        (F.col("o_totalprice") * 2 + F.col("o_custkey")).alias("echo"),
    )
    stages = [
        preparation.Cleaning(),
        preparation.Selection(inputCols=["noise", "echo"], labelCol="price", threshold=0.1),
        preparation.Codes(inputCols=["status", "priority"], layout=layout, unseen="other"),
        preparation.Scaling(inputCols=["price"]),
    ]
    fitted = Pipeline(stages=stages).fit(rows.filter((key % 5 != 0) & (F.col("status") != "P")))
    path = fresh_path(spark, "preparation")
    fitted.write().save(path)
    return PipelineModel.load(path).transform(rows.filter(key % 5 == 0))


@query("preparation_saved", f"with {SAVED_SQL}" + """
select o_orderkey, coalesce(s.code, (select size from sizes where name = 'status')) as status,
  coalesce(p.code, (select size from sizes where name = 'priority')) as priority,
  round((price - price_mean) / price_sd, 6) + 0.0 as price, noisy as has_noise, true as has_echo
from rows r cross join moments
  left join codes s on s.name = 'status' and s.value = r.status left join codes p on p.name = 'priority' and p.value = r.priority
where is_test
""")
def preparation_saved(spark, sf):
    out = saved_preparation(spark, sf, "ordinal")
    flags = [F.lit(c in out.columns).alias(f"has_{c}") for c in ("noise", "echo")]
    return round_all(out.select("o_orderkey", "status", "priority", "price", *flags), "price")


@query("preparation_saved_onehot", f"with {SAVED_SQL}" + """
select o_orderkey, (select sum(size + 1)::int from sizes) as size,
  coalesce(s.code, a.size)::int as status_place, (a.size + 1 + coalesce(p.code, b.size))::int as priority_place
from rows r left join codes s on s.name = 'status' and s.value = r.status left join codes p on p.name = 'priority' and p.value = r.priority
  join sizes a on a.name = 'status' join sizes b on b.name = 'priority'
where is_test
""")
def preparation_saved_onehot(spark, sf):
    out = saved_preparation(spark, sf, "onehot")
    return out.select("o_orderkey", "onehot.size", *[F.col("onehot.indices")[i].alias(f"{c}_place") for i, c in enumerate(("status", "priority"))])
