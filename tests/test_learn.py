import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlab.operators import federate, learn, loss, profile
from flowlab.plans import continual
from flowlab.session import fresh_path
from flowlab.sources import models


def softmax(z):
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 4))
    y = np.argmax(x[:, :3] + 0.1 * rng.normal(size=(600, 3)), axis=1)
    df = spark.createDataFrame(
        [(i, [float(v) for v in a], int(b)) for i, (a, b) in enumerate(zip(x, y))],
        "id long, x array<double>, y int",
    ).repartition(5)
    return df.cache(), x, y


def brute_fit(x, y, k, steps, rate, w=None):
    theta, onehot = np.zeros((k, x.shape[1] + 1)), np.eye(k)[y]
    ones = np.hstack([x, np.ones((len(x), 1))])
    w = np.ones(len(x)) if w is None else w
    for _ in range(steps):
        error = (softmax(ones @ theta.T) - onehot) * w[:, None]
        theta = theta - rate * error.T @ ones / w.sum()
    return theta


def test_gradient_fit_equals_numpy(planted):
    df, x, y = planted
    fit = learn.fit_softmax(df, 3, steps=5, rate=0.5)
    expected = brute_fit(x, y, 3, 5, 0.5)
    assert np.allclose(fit.model.weight, expected[:, :4]) and np.allclose(fit.model.bias, expected[:, 4])
    assert fit.losses == sorted(fit.losses, reverse=True)
    assert fit.history(df.sparkSession).count() == 5


def test_fit_learns_the_planted_label(planted):
    df, x, y = planted
    model = learn.fit_softmax(df, 3, steps=30, rate=2.0).model
    good = learn.score(df, model).filter("y = y_pred").count()
    assert good / len(y) > 0.9


def test_scores_agree(planted):
    df, x, _ = planted
    model = learn.SoftmaxModel(np.arange(12.0).reshape(3, 4), np.array([1.0, 0.0, -1.0]))
    a = {r["id"]: r["logits"] for r in learn.score(df, model).collect()}
    b = {r["id"]: r["z"] for r in df.select("id", model.logits(F.col("x")).alias("z")).collect()}
    for i in a:
        assert a[i] == pytest.approx(b[i])
    empty = learn.score(df.filter("id < 0"), model)
    assert empty.count() == 0 and "logits" in empty.columns


def test_clipping():
    assert np.linalg.norm(learn.clip_norm(np.array([3.0, 4.0]), 1.0)) == pytest.approx(1.0)
    assert learn.clip_norm(np.array([0.3, 0.4]), 1.0).tolist() == [0.3, 0.4]


@pytest.mark.parametrize("hot_rows", [10**6, 200, 1])
def test_fisher_equals_numpy(planted, hot_rows):
    """Batches of 50 rows and one of 300, which is dealt over tasks if it counts as hot."""
    df, x, y = planted
    model = learn.SoftmaxModel(np.ones((3, 4)) * [[0.1], [0.2], [0.3]], np.zeros(3))
    batched = df.withColumn("batch", F.least(F.floor(F.col("id") / 50), F.lit(6)))
    got = np.zeros(15)
    for r in learn.fisher_diagonal(batched, model, "batch", hot_rows=hot_rows).collect():
        got[r["idx"] + (12 if r["key"] == "bias" else 0)] = r["value"]
    ones, total = np.hstack([x, np.ones((600, 1))]), 0
    error = softmax(x @ model.weight.T) - np.eye(3)[y]
    for lo, hi in [*((b * 50, b * 50 + 50) for b in range(6)), (300, 600)]:
        total = total + (error[lo:hi].T @ ones[lo:hi] / (hi - lo)) ** 2
    expected = total / 7
    assert np.allclose(got[:12].reshape(3, 4), expected[:, :4]) and np.allclose(got[12:], expected[:, 4])


def test_penalty_is_zero_at_the_anchor(planted, spark):
    model = learn.SoftmaxModel(np.ones((3, 4)), np.ones(3))
    table = model.table(spark)
    assert loss.ewc_penalty(table, table, table).first()[0] == 0.0


def test_refit_keeps_frozen_weights_and_stays_near(planted):
    df, _, _ = planted
    old = learn.fit_softmax(df, 3, steps=3, rate=1.0).model
    free = learn.refit_softmax(df, old, None, [1], steps=3, rate=1.0).model
    assert np.array_equal(free.weight[:, 1], old.weight[:, 1])
    assert not np.allclose(free.weight[:, 0], old.weight[:, 0])
    held = learn.refit_softmax(df, old, np.full(15, 4.0), [1], steps=3, rate=1.0).model
    assert np.abs(held.flat() - old.flat()).sum() < np.abs(free.flat() - old.flat()).sum()


def test_parameter_table_round_trip(planted, spark):
    model = learn.SoftmaxModel(np.arange(12.0).reshape(3, 4), np.arange(3.0)).freeze_features([2])
    folder = fresh_path(spark, "t")
    models.save_softmax(spark, model, folder, "multi")
    back = models.load_softmax(spark, folder, "multi")
    assert np.array_equal(back.weight, model.weight) and np.array_equal(back.mask(), model.mask())
    with pytest.raises(ValueError):
        models.model_path(folder, "softmax", "other")


@pytest.mark.parametrize("kind", ["logistic", "perceptron"])
def test_pipeline_fit_save_and_score(planted, spark, kind):
    df, _, y = planted
    model = learn.fit_pipeline(df, ["x"], "y", kind, classes=3, iterations=40)
    folder = fresh_path(spark, "t")
    models.save_pipeline(model, folder, "multi")
    out = learn.score_pipeline(df, models.load_pipeline(folder, "multi"), ["x"])
    assert out.filter("y = y_pred").count() / len(y) > 0.85
    assert {"logits", "probabilities"} <= set(out.columns)


def test_weighted_pipeline(planted):
    df, _, _ = planted
    weighted = loss.with_class_weight(df, profile.class_weights(df, "y"), "y")
    assert learn.fit_pipeline(weighted, ["x"], "y", weight="weight") is not None
    with pytest.raises(ValueError):
        learn.fit_pipeline(weighted, ["x"], "y", "perceptron", 3, weight="weight")


def test_average_of_equal_parameters_is_the_identity(spark):
    fit = federate.ClientFit(learn.SoftmaxModel(np.arange(6.0).reshape(2, 3), np.ones(2)), 0)
    fits = {c: federate.ClientFit(fit.model, n) for c, n in ((0, 10), (1, 3), (2, 7))}
    back = federate.federated_average(federate.client_table(spark, fits)).withColumn("trainable", F.lit(True))
    model = learn.SoftmaxModel.from_table(back, 2)
    assert np.allclose(model.flat(), fit.model.flat())


def test_clients_equal_separate_fits_with_one_large_client(planted):
    df, x, y = planted
    clients = df.withColumn("client", F.when(F.col("id") < 400, 0).otherwise(F.col("id") % 3).cast("int"))
    kept = learn.prepare_rows(clients, group="client")
    fits = federate.fit_clients(kept, learn.SoftmaxModel.zeros(3, 4), learn.group_sizes(kept), 3, 0.5)
    ids = np.arange(600)
    owner = np.where(ids < 400, 0, ids % 3)
    for c in range(3):
        expected = brute_fit(x[owner == c], y[owner == c], 3, 3, 0.5)
        assert np.allclose(fits[c].model.weight, expected[:, :4]) and fits[c].rows == (owner == c).sum()


def test_rounds_and_phases_report_metrics(planted):
    df, _, _ = planted
    clients = df.withColumn("client", (F.col("id") % 2).cast("int"))
    _, log = federate.run_rounds(clients, df, 3, rounds=3, epochs=2, rate=1.0)
    rows = sorted(log.collect())
    assert [r["round"] for r in rows] == [1, 2, 3] and rows[-1]["log_loss"] < rows[0]["log_loss"]
    first, second, phases = continual.two_phase(df, df, 3, "id", [3], steps=5, rate=1.0)
    assert phases.count() == 2
    assert np.array_equal(first.model.weight[:, 3], second.model.weight[:, 3])


@pytest.mark.parametrize(
    "bad", [([1.0, 2.0], 0), ([1.0, 2.0, 3.0], -1), ([1.0, 2.0, 3.0], None), (None, 1), ([1.0, 2.0, 3.0], 5)]
)
def test_a_fit_refuses_bad_rows(spark, bad):
    df = spark.createDataFrame([([0.0, 1.0, 2.0], 0), ([1.0, 0.0, 2.0], 1), bad], "x array<double>, y int").coalesce(1)
    with pytest.raises(Exception, match="one width|class numbers|classes"):
        learn.fit_softmax(df, 2, steps=1)


def test_a_frozen_group_keeps_its_weights(spark):
    rng = np.random.default_rng(8)
    a, b = rng.normal(5, 3, (200, 3)), rng.normal(-2, 0.1, (200, 2))
    y = (a[:, 0] + 20 * b[:, 1] > -35).astype(int)
    rows = [(a[i].tolist(), b[i].tolist(), int(y[i])) for i in range(200)]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>, y int")
    scaled, scales = learn.scale_groups(df, ["a", "b"])
    assert scales["a"] == pytest.approx((a.mean(), a.std())) and scales["b"] == pytest.approx((b.mean(), b.std()))
    before = learn.fit_groups(df, ["a", "b"], 2, ["a"], 5, 0, 0.3).model
    after = learn.fit_groups(df, ["a", "b"], 2, ["a"], 5, 5, 0.3).model
    assert np.allclose(before.weight[:, :3], after.weight[:, :3]) and not np.allclose(before.weight[:, 3:], after.weight[:, 3:])
