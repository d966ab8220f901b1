"""Views of the given tables that several queries start from, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlab.functions.cells import label_code
from flowlab.sources.tables import table

EVENT_CODES = {"click": 0, "error": 1, "purchase": 2, "signup": 3, "view": 4}
EVENT_CODE_SQL = (
    "case event_type when 'click' then 0 when 'error' then 1 when 'purchase' then 2 "
    "when 'signup' then 3 when 'view' then 4 end"
)


def events_coded(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn(
        "code", label_code(F.col("event_type"), EVENT_CODES)
    )


# A tag with blanks, tabs, a sentinel and gaps, from the document language.
TAGGED_SQL = """
tagged as (
  select doc_id, source, n_chars,
    case when doc_id % 17 = 0 then '  '
         when doc_id % 17 = 1 then chr(9) || lang || ' '
         when doc_id % 17 = 2 then '-'
         when doc_id % 17 = 3 then null
         else lang end as tag
  from documents)
"""


def tagged(spark: SparkSession, sf: str) -> DataFrame:
    left = F.col("doc_id") % 17
    tag = (
        F.when(left == 0, "  ")
        .when(left == 1, F.concat(F.lit("\t"), F.col("lang"), F.lit(" ")))
        .when(left == 2, "-")
        .when(left == 3, F.lit(None))
        .otherwise(F.col("lang"))
    )
    return table(spark, sf, "documents").select("doc_id", "source", "n_chars", tag.alias("tag"))


# A raw flow table from orders: few distinct features, padded and unknown labels, blank
# cells, sentinels.
FLOWS_SQL = """
flows as (
  select o_orderkey as id,
    (o_custkey % 7) / 2.0 as dur,
    o_orderstatus as proto,
    case when o_custkey % 5 = 0 then '-' else o_orderpriority end as service,
    case when o_orderkey % 19 = 0 then ' ' else 'S' || (o_custkey % 3)::varchar end as state,
    o_custkey % 13 as spkts,
    (o_custkey % 13) * 100 + o_custkey % 2 as sbytes,
    (o_custkey % 13) / 4.0 as rate,
    o_orderkey % 3 as sttl,
    case when o_orderkey % 23 = 0 then null else o_custkey % 4 end as tcprtt,
    o_custkey % 2 as ct_srv_src,
    case o_custkey % 12
      when 0 then 'Normal' when 1 then ' Generic' when 2 then 'Exploits ' when 3 then 'Fuzzers'
      when 4 then 'DoS' when 5 then chr(9) || 'Reconnaissance' when 6 then 'Analysis'
      when 7 then 'Backdoor' when 8 then 'Shellcode' when 9 then 'Worms'
      when 10 then 'Mystery' else case when o_orderkey % 2 = 0 then 'Normal' else 'Normal ' end
    end as attack_cat,
    case when o_custkey % 12 in (0, 11) then 0 else o_custkey % 12 end as label
  from orders)
"""


def flows(spark: SparkSession, sf: str) -> DataFrame:
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    kind = cust % 12
    attack = (
        F.when(kind == 0, "Normal").when(kind == 1, " Generic").when(kind == 2, "Exploits ")
        .when(kind == 3, "Fuzzers").when(kind == 4, "DoS").when(kind == 5, "\tReconnaissance")
        .when(kind == 6, "Analysis").when(kind == 7, "Backdoor").when(kind == 8, "Shellcode")
        .when(kind == 9, "Worms").when(kind == 10, "Mystery")
        .otherwise(F.when(key % 2 == 0, "Normal").otherwise("Normal "))
    )
    return table(spark, sf, "orders").select(
        key.alias("id"),
        ((cust % 7) / 2.0).alias("dur"),
        F.col("o_orderstatus").alias("proto"),
        F.when(cust % 5 == 0, "-").otherwise(F.col("o_orderpriority")).alias("service"),
        F.when(key % 19 == 0, " ").otherwise(F.concat(F.lit("S"), (cust % 3).cast("string"))).alias("state"),
        (cust % 13).alias("spkts"),
        ((cust % 13) * 100 + cust % 2).alias("sbytes"),
        ((cust % 13) / 4.0).alias("rate"),
        (key % 3).alias("sttl"),
        F.when(key % 23 != 0, cust % 4).alias("tcprtt"),
        (cust % 2).alias("ct_srv_src"),
        attack.alias("attack_cat"),
        F.when(kind.isin(0, 11), 0).otherwise(kind).alias("label"),
    )


def flow_pair(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    every = flows(spark, sf)
    is_test = F.col("id") % 5 == 0
    return every.filter(~is_test), every.filter(is_test)


# Distinct cleaned flows, the test set without the rows the train set has.
CLEAN_FLOWS_SQL = FLOWS_SQL + """
, cleaned as (
  select *, id % 5 = 0 as is_test from flows
  where regexp_matches(state, '^\\s*$') = false and tcprtt is not null
), distinct_flows as (
  select min(id) as id, dur, proto,
    case when service = '-' then 'unknown' else service end as service, state, spkts, sbytes,
    rate, sttl, tcprtt, ct_srv_src, attack_cat, is_test
  from cleaned group by all
), labelled as (
  select * exclude (attack_cat), case trim(attack_cat, ' ' || chr(9))
    when 'Normal' then 0 when 'Generic' then 1 when 'Exploits' then 2 when 'Fuzzers' then 3
    when 'DoS' then 4 when 'Reconnaissance' then 5 when 'Analysis' then 6 when 'Backdoor' then 7
    when 'Shellcode' then 8 when 'Worms' then 9 end as new_label
  from distinct_flows
), coded as (
  select * from labelled where new_label is not null
), leakfree as (
  select * from coded t where not t.is_test or not exists (
    select 1 from coded g where not g.is_test and g.dur = t.dur and g.proto = t.proto
      and g.service = t.service and g.state = t.state and g.spkts = t.spkts
      and g.sbytes = t.sbytes and g.rate = t.rate and g.sttl = t.sttl
      and g.tcprtt = t.tcprtt and g.ct_srv_src = t.ct_srv_src and g.new_label = t.new_label)
)
"""

# Predictions for events: right for a third of the users, else a fixed mix that also
# predicts a class that never occurs.
PREDICTED_SQL = f"""
coded as (select *, {EVENT_CODE_SQL} as y_true from events),
predicted as (
  select *, case when user_id % 3 = 0 then y_true
    else ((user_id * 7 + event_id) % 6)::int end as y_pred
  from coded)
"""


def predicted(spark: SparkSession, sf: str) -> DataFrame:
    coded = events_coded(spark, sf).withColumnRenamed("code", "y_true")
    guess = ((F.col("user_id") * 7 + F.col("event_id")) % 6).cast("int")
    return coded.withColumn(
        "y_pred", F.when(F.col("user_id") % 3 == 0, F.col("y_true")).otherwise(guess)
    )


# Logits and labels from embeddings, as doubles.
LOGITS_SQL = """
vectors as (
  select vec_id, label, [v::double for v in embedding] as e from embeddings),
scored as (
  select vec_id, label as y_true, e[1:10] as logits, e[11:20] as old_logits,
    e[1:32] as x_static, e[33:64] as x_dynamic, e from vectors)
"""


def scored(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("embedding").cast("array<double>")
    return table(spark, sf, "embeddings").select(
        "vec_id",
        F.col("label").alias("y_true"),
        F.slice(e, 1, 10).alias("logits"),
        F.slice(e, 11, 10).alias("old_logits"),
        F.slice(e, 1, 32).alias("x_static"),
        F.slice(e, 33, 32).alias("x_dynamic"),
        e.alias("e"),
    )


# A score in (0, 1) whose denominator is prime, so none lies on a threshold.
SCORES_SQL = """
scores as (
  select doc_id, quality as y_true,
    (2 * ((doc_id * 37) % 1000) + 1 + 1000 * quality) / 3001.0::double as prob
  from labels)
"""


def scores(spark: SparkSession, sf: str) -> DataFrame:
    prob = (2 * ((F.col("doc_id") * 37) % 1000) + 1 + 1000 * F.col("quality")) / F.lit(3001.0)
    return table(spark, sf, "labels").select(
        "doc_id", F.col("quality").alias("y_true"), prob.alias("prob")
    )


def whole_events(spark, sf):
    """Events with what a sampling or numbering job carries along; the time is left out, as its text differs between engines."""
    return table(spark, sf, "events").select("event_id", "event_type", "user_id", "value", "props")
