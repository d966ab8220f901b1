"""Classifier evaluation.

Everything derives from one grouping of the predictions by (true, predicted) class, whose
size depends on the number of classes only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlab import fixed
from flowlab.functions import vectors
from flowlab.session import materialise, settle


def predict_argmax(df: DataFrame, logits: str = "logits", target: str = "y_pred") -> DataFrame:
    return df.withColumn(target, vectors.argmax(F.col(logits)))


def positive_probability(df: DataFrame, logits: str = "logits", target: str = "prob") -> DataFrame:
    return df.withColumn(target, F.get(vectors.softmax(F.col(logits)), F.lit(1)))


def above(score: Column, threshold: Column) -> Column:
    """Strictly above the threshold; a missing score is not above anything."""
    return F.when(F.isnan(score), 0).otherwise(F.coalesce((score > threshold).cast("int"), F.lit(0)))


def predict_threshold(
    df: DataFrame,
    score: str = "prob",
    threshold: float = fixed.DEFAULT_THRESHOLD,
    target: str = "y_pred",
) -> DataFrame:
    return df.withColumn(target, above(F.col(score), F.lit(threshold)))


def confusion_cells(
    df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred", loss: Column | None = None
) -> DataFrame:
    """Occupied cells of the confusion matrix; with ``loss``, its sum per cell too."""
    terms = [F.count(F.lit(1)).alias("n")]
    if loss is not None:
        terms.append(F.sum(loss).alias("loss"))
    return df.groupBy(F.col(y_true).alias("y_true"), F.col(y_pred).alias("y_pred")).agg(*terms)


def confusion_matrix(cells: DataFrame) -> DataFrame:
    """All cells over the union of true and predicted labels, zeros included."""
    labels = cells.agg(
        F.array_union(F.collect_set("y_true"), F.collect_set("y_pred")).alias("labels")
    )
    grid = labels.select("labels", F.explode("labels").alias("y_true")).select(
        "y_true", F.explode("labels").alias("y_pred")
    )
    return grid.join(cells.select("y_true", "y_pred", "n"), ["y_true", "y_pred"], "left").select(
        "y_true", "y_pred", F.coalesce("n", F.lit(0)).cast("long").alias("n")
    )


def confusion_wide(cells: DataFrame, labels: Sequence) -> DataFrame:
    """One row per true label, one column per predicted label."""
    matrix = confusion_matrix(cells).filter(F.col("y_true").isin(*labels))
    return matrix.groupBy("y_true").agg(
        *[
            F.sum(F.when(F.col("y_pred") == p, F.col("n")).otherwise(0)).alias(f"pred_{p}")
            for p in labels
        ]
    )


def class_metrics(cells: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per label; an undefined ratio is 0."""
    hit = F.when(F.col("y_true").eqNullSafe(F.col("y_pred")), F.col("n")).otherwise(0)
    zero = F.lit(0).cast("long")
    views = F.array(
        F.struct(
            F.col("y_true").alias("label"), F.col("n").alias("support"),
            zero.alias("predicted"), hit.cast("long").alias("hits"),
        ),
        F.struct(
            F.col("y_pred").alias("label"), zero.alias("support"),
            F.col("n").alias("predicted"), zero.alias("hits"),
        ),
    )
    sums = (
        cells.select(F.explode(views).alias("v"))
        .groupBy("v.label")
        .agg(*[F.sum(f"v.{c}").alias(c) for c in ("support", "predicted", "hits")])
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    return sums.select(
        "label",
        ratio(F.col("hits"), F.col("predicted")).alias("precision"),
        ratio(F.col("hits"), F.col("support")).alias("recall"),
        ratio(2 * F.col("hits"), F.col("predicted") + F.col("support")).alias("f1"),
        "support",
        "hits",
    )


def _averages() -> list[Column]:
    weighted = lambda c: F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support"))
    names = ("precision", "recall", "f1")
    return [
        F.try_divide(F.sum("hits").cast("double"), F.sum("support")).alias("accuracy"),
        *[weighted(c).alias(f"weighted_{c}") for c in names],
        *[F.avg(c).alias(f"macro_{c}") for c in names],
        F.sum("support").alias("support"),
    ]


def average_metrics(cells: DataFrame) -> DataFrame:
    """Accuracy, and precision, recall and F1 both weighted by support and unweighted."""
    return class_metrics(cells).agg(*_averages())


def class_report(cells: DataFrame) -> DataFrame:
    """A row per label, then accuracy, macro average and weighted average."""
    names = ("precision", "recall", "f1")
    per_class = F.collect_list(
        F.struct(F.col("label").cast("string").alias("label"), *names, "support")
    )
    summed = class_metrics(cells).agg(per_class.alias("rows"), *_averages())
    blank = F.lit(None).cast("double")
    extra = [
        F.struct(
            F.lit("accuracy").alias("label"), blank.alias("precision"), blank.alias("recall"),
            F.col("accuracy").alias("f1"), "support",
        ),
        *[
            F.struct(
                F.lit(f"{kind} avg").alias("label"),
                *[F.col(f"{kind}_{c}").alias(c) for c in names],
                "support",
            )
            for kind in ("macro", "weighted")
        ],
    ]
    return summed.select(F.explode(F.concat("rows", F.array(*extra))).alias("r")).select("r.*")


def mean_log_loss(df: DataFrame, logits: str = "logits", y_true: str = "y_true") -> DataFrame:
    """Mean cross-entropy over all rows."""
    return df.agg(F.avg(vectors.cross_entropy(F.col(logits), F.col(y_true))).alias("log_loss"))


def epoch_loss(df: DataFrame, epoch: str = "epoch", batch_loss: str = "loss") -> DataFrame:
    """Mean of the batch losses per epoch: every batch counts the same."""
    return df.groupBy(epoch).agg(F.avg(batch_loss).alias("mean_loss"))


def passed_thresholds(score: Column, grid: Sequence[float]) -> Column:
    """How many thresholds of an ascending grid lie strictly below the score.

    On an even grid the position is estimated from the step and then corrected against the
    grid values themselves, so the outcome is that of the comparisons; on any other grid
    the comparisons are made.
    """
    if not grid:
        return F.lit(0)
    low, last = grid[0], len(grid) - 1
    step = (grid[-1] - low) / last if last else 0.0
    if step <= 0 or any(abs(t - (low + i * step)) > step / 4 for i, t in enumerate(grid)):
        below = F.size(F.filter(vectors.constant(grid), lambda t: t < score))
        return F.when(score.isNull() | F.isnan(score), 0).otherwise(below)
    guess = F.floor((score - low) / step).cast("int")
    near = F.greatest(F.lit(0), F.least(F.lit(last), guess))
    values = vectors.constant(grid)
    beats = lambda i: F.when(
        (i >= 0) & (i <= last), (F.get(values, i) < score).cast("int")
    ).otherwise(F.when(i < 0, 1).otherwise(0))
    # Everything before near - 1 is below the score and nothing after near + 1 is.
    exact = near - 1 + beats(near - 1) + beats(near) + beats(near + 1)
    return F.when(score.isNull() | F.isnan(score) | (score <= low), 0).when(
        score > grid[-1], len(grid)
    ).otherwise(exact)


def threshold_sweep(
    df: DataFrame,
    y_true: str = "y_true",
    score: str = "prob",
    grid: Sequence[float] = tuple(fixed.THRESHOLD_GRID),
) -> DataFrame:
    """F1 of the positive class at every threshold, from one pass over the scores.

    Scores are counted by the number of thresholds they pass; the sweep then sums these
    few counts from the top. The grid may be uneven and in any order.
    """
    grid = sorted(set(grid))
    counts = df.groupBy(passed_thresholds(F.col(score), grid).alias("passed")).agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col(y_true) == 1).cast("long")).alias("positives")
    )
    spread = counts.select("*", F.posexplode(vectors.constant(grid)).alias("i", "threshold"))
    flagged = lambda c: F.sum(F.when(F.col("passed") > F.col("i"), F.col(c)).otherwise(0))
    sums = spread.groupBy("i", "threshold").agg(
        flagged("positives").alias("hits"), flagged("n").alias("predicted"),
        F.sum("positives").alias("positives"),
    )
    f1 = F.try_divide(2.0 * F.col("hits"), F.col("predicted") + F.col("positives"))
    return sums.select("threshold", F.coalesce(f1, F.lit(0.0)).alias("f1"), "hits", "predicted")


def threshold_curve(df: DataFrame, y_true: str = "y_true", score: str = "prob") -> DataFrame:
    """Hits, flagged rows, precision, recall and F1 at every distinct score: the sweep without a grid.

    A row is flagged if its score is over the threshold; the threshold minus infinity flags every
    row that has a score. Null and NaN scores are never flagged, but their positives count. Every
    score is one record with its counts; these are dealt by ranges, summed within a range from
    its top, and shifted by the totals of the ranges above (one row a partition). No task sees more than a range,
    and as scores are distinct there, no value can fill one.
    """
    positive = (F.col(y_true) == 1).cast("long")
    known = F.when(~F.isnan(F.col(score).cast("double")), F.col(score).cast("double"))
    counts = df.groupBy(known.alias("threshold")).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(positive), F.lit(0)).alias("positives")
    )
    ranges = counts.repartitionByRange(F.desc("threshold")).withColumn("range", F.spark_partition_id())
    ranges = materialise(ranges, "curve")
    scored = ranges.filter("threshold is not null")
    totals = scored.groupBy("range").agg(F.sum("n").alias("n"), F.sum("positives").alias("positives"))
    # One row a partition of the ranges: their number, not the data's, bounds this window and the broadcast.
    over = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    above = totals.select("range", *[F.coalesce(F.sum(c).over(over), F.lit(0)).alias(f"{c}_above") for c in ("n", "positives")])
    within = Window.partitionBy("range").orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, -1)
    inside = lambda c: F.coalesce(F.sum(c).over(within), F.lit(0))
    local = scored.select("range", "threshold", inside("n").alias("predicted"), inside("positives").alias("hits"))
    curve = local.join(F.broadcast(above), "range").select(
        "threshold", (F.col("hits") + F.col("positives_above")).alias("hits"), (F.col("predicted") + F.col("n_above")).alias("predicted")
    )
    whole = totals.agg(F.sum("positives").alias("hits"), F.sum("n").alias("predicted")).filter("predicted is not null")
    curve = curve.unionByName(whole.withColumn("threshold", F.lit(float("-inf"))))
    every = ranges.agg(F.coalesce(F.sum("positives"), F.lit(0))).first()[0]
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return curve.select(
        "threshold", "hits", "predicted",
        ratio(F.col("hits"), F.col("predicted")).alias("precision"),
        ratio(F.col("hits"), F.lit(every)).alias("recall"),
        ratio(2.0 * F.col("hits"), F.col("predicted") + F.lit(every)).alias("f1"),
    )


def best_threshold(sweep: DataFrame, default: float = fixed.DEFAULT_THRESHOLD) -> DataFrame:
    """The lowest threshold of the highest F1; the default if no F1 exceeds 0."""
    top = sweep.agg(F.max(F.struct("f1", (-F.col("threshold")).alias("neg"))).alias("top"))
    none = F.coalesce(F.col("top.f1"), F.lit(0.0)) <= 0
    return top.select(
        F.when(none, F.lit(default)).otherwise(-F.col("top.neg")).alias("threshold"),
        F.when(none, F.lit(0.0)).otherwise(F.col("top.f1")).alias("f1"),
    )


def evaluate(
    df: DataFrame,
    logits: str | None = "logits",
    y_true: str = "y_true",
    predictor: str = "argmax",
    threshold: float = fixed.DEFAULT_THRESHOLD,
    score: str = "prob",
) -> dict[str, DataFrame]:
    """Metrics, report and confusion matrix of scored rows, from one pass over them.

    ``predictor`` is ``argmax`` (of the logits), ``threshold`` (on the positive
    probability) or ``given`` (a ``y_pred`` column).

    A threshold picked on the rows it is then reported on looks better than it is: sweep
    on a validation split.
    """
    if predictor == "argmax":
        scored = predict_argmax(df, logits)
    elif predictor == "threshold":
        scored = df if score in df.columns else positive_probability(df, logits, score)
        scored = predict_threshold(scored, score, threshold)
    elif predictor == "given":
        scored = df
    else:
        raise ValueError("predictor must be 'argmax', 'threshold' or 'given'")
    loss = vectors.cross_entropy(F.col(logits), F.col(y_true)) if logits else None
    cells = settle(confusion_cells(scored, y_true, "y_pred", loss))
    metrics = average_metrics(cells)
    if loss is not None:
        mean = cells.agg(F.try_divide(F.sum("loss"), F.sum("n"))).first()[0]
        metrics = metrics.withColumn("log_loss", F.lit(mean).cast("double"))
    return {
        "metrics": metrics,
        "report": class_report(cells),
        "confusion": confusion_matrix(cells),
    }


def evaluate_threshold(
    df: DataFrame, y_true: str = "y_true", score: str = "prob"
) -> dict[str, DataFrame]:
    """Sweep the thresholds, predict with the best one, and report."""
    best = best_threshold(threshold_sweep(df, y_true, score)).first()
    out = evaluate(df, None, y_true, "threshold", best["threshold"], score)
    out["best"] = df.sparkSession.createDataFrame([tuple(best)], "threshold double, f1 double")
    return out
