import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlab import fixed
from flowlab.functions import vectors
from flowlab.operators import evaluate, loss


def test_prediction_of_an_unknown_class_is_counted(spark):
    df = spark.createDataFrame([(0, 0), (0, 2), (1, 1)], "y_true int, y_pred int")
    cells = evaluate.confusion_cells(df)
    assert evaluate.confusion_matrix(cells).count() == 9
    row = evaluate.average_metrics(cells).first()
    assert row["macro_recall"] == pytest.approx(0.5) and row["accuracy"] == pytest.approx(2 / 3)


def brute_sweep(y, p, grid):
    out = []
    for t in grid:
        pred = p > t
        tp, denominator = int((pred & (y == 1)).sum()), int(pred.sum() + (y == 1).sum())
        out.append(2 * tp / denominator if denominator else 0.0)
    return out


@pytest.mark.parametrize("grid", [fixed.THRESHOLD_GRID, list(np.linspace(0.1, 0.9, 81))])
def test_sweep_equals_brute_force_even_on_the_grid(spark, grid):
    rng = np.random.default_rng(0)
    p = np.concatenate([rng.random(400), grid, np.nextafter(grid, 1), np.nextafter(grid, 0), [0.0, 1.0, -3.0, 9.0]])
    y = rng.integers(0, 2, len(p))
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "y_true int, prob double")
    got = {r["threshold"]: r["f1"] for r in evaluate.threshold_sweep(df, grid=grid).collect()}
    assert [got[float(t)] for t in grid] == pytest.approx(brute_sweep(y, p, grid), abs=1e-12)


def test_best_threshold_ties_and_default(spark):
    df = spark.createDataFrame([(1, 0.95), (0, 0.05)], "y_true int, prob double")
    assert tuple(evaluate.best_threshold(evaluate.threshold_sweep(df)).first()) == (0.1, 1.0)
    none = spark.createDataFrame([(0, 0.95), (0, 0.05)], "y_true int, prob double")
    assert tuple(evaluate.best_threshold(evaluate.threshold_sweep(none)).first()) == (0.5, 0.0)


def test_nan_and_null_scores_pass_no_threshold(spark):
    df = spark.createDataFrame([(1, math.nan), (1, None), (1, 0.7)], "y_true int, prob double")
    assert sorted(r["y_pred"] for r in evaluate.predict_threshold(df).collect()) == [0, 0, 1]
    sweep = {r["threshold"]: r["predicted"] for r in evaluate.threshold_sweep(df).collect()}
    assert sweep[0.1] == 1 and sweep[0.7] == 0


def test_argmax_takes_the_first_maximum(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],)], "logits array<double>")
    assert evaluate.predict_argmax(df).first()["y_pred"] == 1


def test_softmax_of_large_logits(spark):
    df = spark.createDataFrame([([1000.0, 1000.0],), ([-1000.0, 0.0],)], "logits array<double>")
    assert [r["prob"] for r in evaluate.positive_probability(df).collect()] == pytest.approx([0.5, 1.0])
    ce = df.select(vectors.cross_entropy(F.col("logits"), F.lit(0)).alias("c")).collect()
    assert [r["c"] for r in ce] == pytest.approx([math.log(2), 1000.0])


def test_facade_predictors(spark):
    df = spark.createDataFrame(
        [(0, [2.0, 0.0]), (1, [0.0, 0.3]), (1, [0.0, 3.0])], "y_true int, logits array<double>"
    )
    top = evaluate.evaluate(df)["metrics"].first()
    assert top["accuracy"] == 1.0 and top["log_loss"] > 0
    raised = evaluate.evaluate(df, predictor="threshold", threshold=0.6)
    assert raised["metrics"].first()["accuracy"] == pytest.approx(2 / 3)
    assert raised["report"].count() == 5 and raised["confusion"].count() == 4
    with pytest.raises(ValueError):
        evaluate.evaluate(df, predictor="guess")
    scores = df.withColumn("prob", F.get(vectors.softmax(F.col("logits")), F.lit(1)))
    out = evaluate.evaluate_threshold(scores)
    assert out["best"].first()["f1"] == 1.0 and out["metrics"].first()["accuracy"] == 1.0


def test_epoch_loss_is_the_mean_of_batch_means(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 3.0), (2, 5.0)], "epoch int, loss double")
    assert {r[0]: r[1] for r in evaluate.epoch_loss(df).collect()} == {1: 2.0, 2: 5.0}


def test_distillation_of_equal_logits_is_zero(spark):
    df = spark.createDataFrame([([0.5, -2.0, 1.0],)] * 3, "l array<double>")
    value = loss.distillation_loss(df, "l", "l").first()[0]
    assert value == pytest.approx(0.0, abs=1e-15)


def test_cosine_of_zero_vector(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0])], "x_static array<double>, x_dynamic array<double>")
    assert loss.decoupling_loss(df, 9, 10).first()["similarity"] == 0.0


@pytest.mark.parametrize("grid", [[0.10, 0.11, 0.12, 0.13, 0.90], [0.9, 0.1, 0.5], [0.4], [0.1, 0.1000001, 0.2]])
def test_sweep_over_any_grid(spark, grid):
    scores = [(i % 2, (i * 37 % 101) / 100) for i in range(101)] + [(1, None), (0, 0.125), (1, 0.5), (1, 0.1)]
    df = spark.createDataFrame(scores, "y_true int, prob double")
    got = {r.threshold: (r.hits, r.predicted) for r in evaluate.threshold_sweep(df, grid=grid).collect()}
    passed = lambda t: [y for y, p in scores if p is not None and p > t]
    assert got == {t: (sum(passed(t)), len(passed(t))) for t in set(grid)}


@pytest.mark.parametrize("label", [3, -1, None])
def test_a_label_outside_the_logits_is_an_error(spark, label):
    df = spark.createDataFrame([([0.1, 0.2, 0.3], 1), ([0.1, 0.2, 0.3], label)], "logits array<double>, y_true int")
    with pytest.raises(Exception, match="label outside the logits"):
        evaluate.mean_log_loss(df).collect()


def test_curve_over_every_score(spark):
    r = np.random.default_rng(4)
    p = [None if x < 0.02 else float("nan") if x < 0.04 else round(float(x), 2) for x in r.random(700)] + [0.5] * 300
    y = [int(v) if v < 2 else None for v in r.integers(0, 3, len(p))]
    df = spark.createDataFrame(list(zip(y, p, strict=True)), "y_true int, prob double").repartition(7)
    got = {row.threshold: row for row in evaluate.threshold_curve(df).collect()}
    known = {x for x in p if x is not None and not math.isnan(x)}
    assert set(got) == known | {float("-inf")}
    positives = sum(v == 1 for v in y)
    for t, row in got.items():
        flagged = [v for v, x in zip(y, p, strict=True) if x is not None and x > t]
        hits = sum(v == 1 for v in flagged)
        assert (row.hits, row.predicted) == (hits, len(flagged))
        assert row.precision == pytest.approx(hits / len(flagged) if flagged else 0) and row.recall == pytest.approx(hits / positives)
        assert row.f1 == pytest.approx(2 * hits / (len(flagged) + positives))
    best = evaluate.best_threshold(evaluate.threshold_curve(df)).first()
    assert best.f1 == max(row.f1 for row in got.values()) >= max(evaluate.threshold_sweep(df).toPandas()["f1"])


def test_curve_without_scores(spark):
    none = spark.createDataFrame([], "y_true int, prob double")
    assert evaluate.threshold_curve(none).count() == 0
    unscored = spark.createDataFrame([(1, None), (0, None)], "y_true int, prob double")
    assert evaluate.threshold_curve(unscored).count() == 0
    assert evaluate.best_threshold(evaluate.threshold_curve(none)).first()["threshold"] == fixed.DEFAULT_THRESHOLD


def test_reports_are_saved_by_mode_and_replaced(spark):
    from flowlab.session import fresh_path
    from flowlab.sources import models

    folder = fresh_path(spark, "reports")
    for mode, right in (("multi", 1), ("binary", 0), ("multi", 0)):
        df = spark.createDataFrame([(1, right), (0, 0)], "y_true int, y_pred int")
        paths = models.save_report(evaluate.evaluate(df, None, predictor="given"), folder, mode)
        assert set(paths) == {"metrics", "report", "confusion"} and all(p.endswith(mode) for p in paths.values())
        kept = models.load_report(spark, folder, mode, paths)
        assert kept["metrics"].first()["accuracy"] == (1 + right) / 2
        assert kept["confusion"].agg(F.sum("n")).first()[0] == 2
