"""Queries for classifier evaluation and losses."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlab.functions import vectors
from flowlab.operators import evaluate, loss, profile
from flowlab.plans.catalog import inputs
from flowlab.plans.catalog.registry import query, r6, round_all, table
from flowlab.session import fresh_path
from flowlab.sources import models

CELLS_SQL = inputs.PREDICTED_SQL + """
, cells as (select y_true, y_pred, count(*) as n from predicted group by all)
, labels as (select y_true as label from cells union select y_pred from cells)
, per_class as (
  select label,
    coalesce((select sum(n) from cells where y_true = label), 0)::bigint as support,
    coalesce((select sum(n) from cells where y_pred = label), 0)::bigint as predicted,
    coalesce((select sum(n) from cells where y_true = label and y_pred = label), 0)::bigint as hits
  from labels)
, metrics as (
  select label, support, hits,
    case when predicted = 0 then 0 else hits::double / predicted end as precision,
    case when support = 0 then 0 else hits::double / support end as recall,
    case when predicted + support = 0 then 0 else 2.0::double * hits / (predicted + support) end as f1
  from per_class)
, averages as (
  select sum(hits)::double / sum(support) as accuracy,
    sum(precision * support) / sum(support) as weighted_precision,
    sum(recall * support) / sum(support) as weighted_recall,
    sum(f1 * support) / sum(support) as weighted_f1,
    avg(precision) as macro_precision, avg(recall) as macro_recall, avg(f1) as macro_f1,
    sum(support)::bigint as support from metrics)
"""
AVERAGES = [
    "accuracy", "weighted_precision", "weighted_recall", "weighted_f1",
    "macro_precision", "macro_recall", "macro_f1",
]
AVERAGES_SQL = ", ".join(f"round({c}, 6) + 0.0 as {c}" for c in AVERAGES)


def cells(spark, sf):
    return evaluate.confusion_cells(inputs.predicted(spark, sf))


@query("confusion", f"with {CELLS_SQL}" + """
select a.label as y_true, b.label as y_pred, coalesce(n, 0)::bigint as n
from labels a, labels b left join cells c on c.y_true = a.label and c.y_pred = b.label
""")
def confusion(spark, sf):
    return evaluate.confusion_matrix(cells(spark, sf))


@query("confusion_wide", f"with {inputs.PREDICTED_SQL} select g.label::int as y_true, " + ", ".join(
    f"count(*) filter (y_pred = {p} and y_true is not null) as pred_{p}" for p in range(6)
) + " from range(0, 6) g(label) left join predicted p on p.y_true = g.label group by g.label")
def confusion_wide(spark, sf):
    return evaluate.confusion_wide(cells(spark, sf), range(6))


CLASS_REPORT_SQL = f"with {CELLS_SQL}" + """
select label::varchar as label, round(precision, 6) + 0.0 as precision, round(recall, 6) + 0.0 as recall,
  round(f1, 6) + 0.0 as f1, support from metrics
union all select 'accuracy', null, null, round(accuracy, 6), support from averages
union all select 'macro avg', round(macro_precision, 6), round(macro_recall, 6), round(macro_f1, 6), support from averages
union all select 'weighted avg', round(weighted_precision, 6), round(weighted_recall, 6), round(weighted_f1, 6), support from averages
"""


@query("class_report", CLASS_REPORT_SQL)
def class_report(spark, sf):
    return round_all(evaluate.class_report(cells(spark, sf)), "precision", "recall", "f1")


@query("report_saved", CLASS_REPORT_SQL)
def report_saved(spark, sf):
    """The class report, written with the whole evaluation and read back."""
    folder = fresh_path(spark, "reports")
    report = evaluate.evaluate(inputs.predicted(spark, sf).select("y_true", "y_pred"), None, predictor="given")
    models.save_report(report, folder, "multi")
    return round_all(models.load_report(spark, folder, "multi", list(report))["report"], "precision", "recall", "f1")


@query("avg_metrics", f"with {CELLS_SQL} select {AVERAGES_SQL}, support from averages")
def avg_metrics(spark, sf):
    return round_all(evaluate.average_metrics(cells(spark, sf)), *AVERAGES)


# Row loss and probabilities of the logits.
LOSS_SQL = inputs.LOGITS_SQL + """
, losses as (
  select *, ln(list_sum([exp(z) for z in logits])) - logits[y_true + 1] as ce from scored)
"""


@query("log_loss", f"with {LOSS_SQL} select round(avg(ce), 6) + 0.0 as log_loss from losses")
def log_loss(spark, sf):
    return round_all(evaluate.mean_log_loss(inputs.scored(spark, sf)), "log_loss")


@query("argmax_predict", f"""
with {inputs.LOGITS_SQL} select vec_id, list_position(logits, list_max(logits)) - 1 as y_pred from scored
""")
def argmax_predict(spark, sf):
    return evaluate.predict_argmax(inputs.scored(spark, sf)).select("vec_id", "y_pred")


@query("softmax_probability", f"""
with {inputs.LOGITS_SQL}
select vec_id, round(exp(logits[2]) / list_sum([exp(z) for z in logits]), 6) + 0.0 as prob from scored
""")
def softmax_probability(spark, sf):
    out = evaluate.positive_probability(inputs.scored(spark, sf)).select("vec_id", "prob")
    return round_all(out, "prob")


@query("threshold_predict", f"""
with {inputs.SCORES_SQL}
select doc_id, (prob > 0.5)::int as at_default, (prob > 0.6)::int as at_raised from scores
""")
def threshold_predict(spark, sf):
    out = evaluate.predict_threshold(inputs.scores(spark, sf), target="at_default")
    out = evaluate.predict_threshold(out, threshold=0.6, target="at_raised")
    return out.select("doc_id", "at_default", "at_raised")


SWEEP_SQL = inputs.SCORES_SQL + """
, swept as (
  select k / 100.0::double as threshold,
    count(*) filter (prob > k / 100.0::double and y_true = 1) as hits,
    count(*) filter (prob > k / 100.0::double) as predicted,
    count(*) filter (y_true = 1) as positives
  from scores, range(10, 91) g(k) group by k)
, f1s as (
  select threshold, hits, predicted, case when predicted + positives = 0 then 0
    else 2.0::double * hits / (predicted + positives) end as f1 from swept)
, best as (select threshold, f1 from f1s order by f1 desc, threshold limit 1)
"""
UNEVEN = (0.9, 0.1, 0.11, 0.12, 0.13, 0.34, 0.335)
UNEVEN_SQL = SWEEP_SQL.replace("k / 100.0::double", "k::double").replace("range(10, 91) g(k)", f"unnest({list(UNEVEN)}) g(k)")


@query("threshold_sweep", f"with {SWEEP_SQL} select threshold, round(f1, 6) + 0.0 as f1, hits, predicted from f1s")
def threshold_sweep(spark, sf):
    return round_all(evaluate.threshold_sweep(inputs.scores(spark, sf)), "f1")


@query("threshold_sweep_uneven", f"with {UNEVEN_SQL} select threshold, round(f1, 6) + 0.0 as f1, hits, predicted from f1s")
def threshold_sweep_uneven(spark, sf):
    return round_all(evaluate.threshold_sweep(inputs.scores(spark, sf), grid=UNEVEN), "f1")


@query("best_threshold", f"with {SWEEP_SQL} select threshold, round(f1, 6) + 0.0 as f1 from best")
def best_threshold(spark, sf):
    return round_all(evaluate.best_threshold(evaluate.threshold_sweep(inputs.scores(spark, sf))), "f1")


CURVE_SQL = """
rated as (
  select l.quality as y_true, d.n_chars / 20000.0::double as prob from labels l join documents d using (doc_id)),
curve as (
  select t.threshold, (select count(*) from rated where prob > t.threshold and y_true = 1) as hits,
    (select count(*) from rated where prob > t.threshold) as predicted, (select count(*) from rated where y_true = 1) as positives
  from (select distinct prob as threshold from rated union all select -1) t),
f1s as (select threshold, hits, predicted, coalesce(hits / nullif(predicted, 0)::double, 0) as precision,
    coalesce(hits / nullif(positives, 0)::double, 0) as recall, 2.0::double * hits / (predicted + positives) as f1 from curve)
"""


def rated(spark, sf):
    """The labelled documents' quality, scored by length."""
    docs = table(spark, sf, "documents").select("doc_id", (F.col("n_chars") / F.lit(20000.0)).alias("prob"))
    return table(spark, sf, "labels").join(docs, "doc_id").select(F.col("quality").alias("y_true"), "prob")


@query("threshold_curve", f"with {CURVE_SQL}" + """
select round(threshold, 6) + 0.0 as threshold, hits, predicted, round(precision, 6) + 0.0 as precision,
  round(recall, 6) + 0.0 as recall, round(f1, 6) + 0.0 as f1 from f1s
""")
def threshold_curve(spark, sf):
    curve = evaluate.threshold_curve(rated(spark, sf))
    curve = curve.withColumn("threshold", F.greatest("threshold", F.lit(-1.0)))
    return round_all(curve, "threshold", "precision", "recall", "f1")


@query("best_threshold_exact", f"with {CURVE_SQL}" + """
select round(min(threshold), 6) + 0.0 as threshold, round(max(f1), 6) + 0.0 as f1 from f1s where f1 = (select max(f1) from f1s)
""")
def best_threshold_exact(spark, sf):
    best = evaluate.best_threshold(evaluate.threshold_curve(rated(spark, sf)))
    return round_all(best.withColumn("threshold", F.greatest("threshold", F.lit(-1.0))), "threshold", "f1")


@query("threshold_report", f"with {SWEEP_SQL}" + """
select y_true, (prob > threshold)::int as y_pred, count(*) as n from scores, best group by all
""")
def threshold_report(spark, sf):
    return evaluate.evaluate_threshold(inputs.scores(spark, sf))["confusion"].filter("n > 0")


@query("evaluate_argmax", f"with {LOSS_SQL}" + """
, p as (select y_true, list_position(logits, list_max(logits)) - 1 as y_pred, ce from losses)
, per_class as (
  select g.c as label, count(*) filter (y_true = g.c) as support, count(*) filter (y_pred = g.c) as predicted,
    count(*) filter (y_true = g.c and y_pred = g.c) as hits from p, range(0, 10) g(c) group by g.c)
, m as (select support, hits, case when predicted = 0 then 0 else hits::double / predicted end as precision,
    case when support = 0 then 0 else hits::double / support end as recall,
    case when predicted + support = 0 then 0 else 2.0::double * hits / (predicted + support) end as f1
  from per_class)
select round(sum(hits)::double / sum(support), 6) as accuracy,
  round(sum(precision * support) / sum(support), 6) as weighted_precision,
  round(sum(f1 * support) / sum(support), 6) as weighted_f1, round(avg(recall), 6) as macro_recall,
  (select round(avg(ce), 6) from p) as log_loss
from m
""")
def evaluate_argmax(spark, sf):
    columns = ["accuracy", "weighted_precision", "weighted_f1", "macro_recall", "log_loss"]
    out = evaluate.evaluate(inputs.scored(spark, sf))["metrics"].select(*columns)
    return round_all(out, *columns)


@query("evaluate_raised_threshold", f"""
with {inputs.SCORES_SQL}
, p as (select y_true, (prob > 0.6)::int as y_pred from scores)
, c as (select count(*) filter (y_true = 1 and y_pred = 1)::double as tp, count(*) filter (y_true = 0 and y_pred = 0)::double as tn,
  count(*) filter (y_true = 1)::double as p1, count(*) filter (y_true = 0)::double as p0 from p)
select round((tp + tn) / (p0 + p1), 6) as accuracy, round((tp / p1 + tn / p0) / 2, 6) as macro_recall,
  round((tp + tn) / (p0 + p1), 6) as weighted_recall from c
""")
def evaluate_raised_threshold(spark, sf):
    columns = ["accuracy", "macro_recall", "weighted_recall"]
    out = evaluate.evaluate(
        inputs.scores(spark, sf), None, predictor="threshold", threshold=0.6
    )["metrics"].select(*columns)
    return round_all(out, *columns)


@query("epoch_loss", f"with {LOSS_SQL}" + """
, batches as (select vec_id // 64 as batch, avg(ce) as loss from losses group by all)
select (batch % 4)::bigint as epoch, round(avg(loss), 6) + 0.0 as mean_loss from batches group by all
""")
def epoch_loss(spark, sf):
    rows = loss.with_cross_entropy(inputs.scored(spark, sf))
    batches = rows.groupBy(F.floor(F.col("vec_id") / 64).alias("batch")).agg(F.avg("ce").alias("loss"))
    return round_all(
        evaluate.epoch_loss(batches.withColumn("epoch", F.col("batch") % 4)), "mean_loss"
    )


WEIGHTED_SQL = LOSS_SQL + """
, weights as (
  select y_true as c, sqrt(sum(count(*)) over ()::double / (count(*) over () * count(*))) as w,
    row_number() over (order by y_true) as place, count(*) over () as k from losses group by y_true)
, weighted as (
  select l.*, case when k > 3 and place = 4 then w * 0.5 else w end as weight
  from losses l join weights on c = y_true)
"""


def weighted(spark, sf):
    rows = loss.with_cross_entropy(inputs.scored(spark, sf))
    return loss.with_class_weight(rows, profile.smoothed_weights(rows, "y_true"))


@query("weighted_ce", f"with {WEIGHTED_SQL} select round(sum(ce * weight) / sum(weight), 6) + 0.0 as weighted_ce from weighted")
def weighted_ce(spark, sf):
    return round_all(loss.weighted_cross_entropy(weighted(spark, sf)), "weighted_ce")


@query("focal_loss", f"with {WEIGHTED_SQL}" + """
select round(avg(pow(1 - exp(-ce), 2) * ce), 6) + 0.0 as plain,
  round(avg(pow(1 - exp(-ce * weight), 2) * ce * weight), 6) + 0.0 as balanced from weighted
""")
def focal_loss(spark, sf):
    rows = weighted(spark, sf)
    plain = loss.focal_loss(rows).first()[0]
    return loss.focal_loss(rows, alpha="weight").select(
        r6(F.lit(plain)).alias("plain"), r6(F.col("focal_loss")).alias("balanced")
    )


DISTILL_SQL = inputs.LOGITS_SQL + """
, norms as (
  select *, ln(list_sum([exp(z / 2.0) for z in logits])) as new_norm,
    ln(list_sum([exp(z / 2.0) for z in old_logits])) as old_norm,
    ln(list_sum([exp(z) for z in logits])) - logits[y_true + 1] as ce from scored)
, terms as (
  select vec_id, any_value(ce) as ce, sum(exp(o / 2.0 - old_norm) * ((o / 2.0 - old_norm) - (z / 2.0 - new_norm))) as kl
  from (select vec_id, ce, new_norm, old_norm, unnest(logits) as z, unnest(old_logits) as o from norms)
  group by vec_id)
"""


@query("distill_loss", f"with {DISTILL_SQL} select round(avg(kl) * 4, 6) + 0.0 as distill_loss from terms")
def distill_loss(spark, sf):
    return round_all(
        loss.distillation_loss(inputs.scored(spark, sf), "logits", "old_logits"), "distill_loss"
    )


@query("composite_loss", f"with {DISTILL_SQL}" + """
select round(avg(ce), 6) as ce, 2.5::double as ewc, round(avg(kl) * 4, 6) as lwf,
  round(avg(ce) + 0.05 * 2.5 + 0.1 * avg(kl) * 4, 6) as loss from terms
""")
def composite_loss(spark, sf):
    out = loss.composite_loss(
        inputs.scored(spark, sf), 2.5, new="logits", old="old_logits"
    )
    return round_all(out, "ce", "lwf", "loss")


@query("cosine_decouple", f"with {inputs.LOGITS_SQL}" + """
, c as (
  select list_dot_product(x_static, x_dynamic) / (
    greatest(sqrt(list_dot_product(x_static, x_static)), 1e-8)
    * greatest(sqrt(list_dot_product(x_dynamic, x_dynamic)), 1e-8)) as sim from scored)
select round(avg(sim), 6) + 0.0 as similarity, 0.0::double as early, round(0.05 * avg(sim), 6) + 0.0 as late from c
""")
def cosine_decouple(spark, sf):
    rows = inputs.scored(spark, sf)
    early = loss.decoupling_loss(rows, epoch=2, epochs=10).first()
    return loss.decoupling_loss(rows, epoch=3, epochs=10).select(
        r6(F.col("similarity")).alias("similarity"),
        r6(F.lit(early["decouple_loss"])).alias("early"),
        r6(F.col("decouple_loss")).alias("late"),
    )


@query("row_cross_entropy", f"with {LOSS_SQL} select vec_id, round(ce, 6) + 0.0 as ce from losses")
def row_cross_entropy(spark, sf):
    return inputs.scored(spark, sf).select(
        "vec_id", r6(vectors.cross_entropy(F.col("logits"), F.col("y_true"))).alias("ce")
    )
