"""Mini-batch fits against plain numpy on the same order of batches."""

import hashlib

import numpy as np
import pytest

from flowlab import fixed
from flowlab.operators import minibatch as q
from flowlab.operators.learn import SoftmaxModel

R = np.random.default_rng(3)
N, WIDTH, CLASSES = 230, 5, 3
X = R.normal(size=(N, WIDTH))
Y = (X[:, 0] + 0.5 * X[:, 1] > 0).astype(int) + (X[:, 2] > 1)
W = R.random(N) + 0.5


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, X[i].tolist(), int(Y[i]), float(W[i])) for i in range(N)]
    return spark.createDataFrame(data, "id long, x array<double>, y int, w double").repartition(5)


def order(epoch):
    """The ids in the seeded hash order of the library."""
    return sorted(range(N), key=lambda i: (hashlib.md5(f"{i}:{fixed.SEED + epoch}".encode()).hexdigest(), i))


def plain(start, objective, epochs, batch, rule, mask, tasks, weights):
    state = q.State(start)
    for epoch in range(epochs):
        ids = order(epoch)
        batches = [sorted(ids[k : k + batch]) for k in range(0, N, batch)]
        ends, sizes = [], []
        for task in range(tasks):
            now, seen = state, 0
            for own in batches[task::tasks]:
                g, _, mass = objective(now.flat, X[own], Y[own], weights[own], epoch)
                now, seen = now.moved(g / mass, rule, mask), seen + len(own)
            if seen:
                ends.append(now)
                sizes.append(seen)
        mean = lambda f: np.average([f(e) for e in ends], axis=0, weights=sizes)
        state = q.State(mean(lambda e: e.flat), mean(lambda e: e.m), mean(lambda e: e.v), float(mean(lambda e: e.steps)))
    return state


@pytest.mark.parametrize(("tasks", "batch", "weight"), [(1, 32, None), (1, 500, "w"), (3, 16, "w"), (20, 64, None)])
def test_fit_equals_numpy(rows, tasks, batch, weight):
    objective, rule = q.cross_entropy(CLASSES, WIDTH), q.Adam(rate=0.03, norm_limit=0.5)
    start = np.linspace(-0.2, 0.2, CLASSES * (WIDTH + 1))
    got, losses = q.fit(rows, start, objective, epochs=3, batch=batch, rule=rule, tasks=tasks, weight=weight)
    mask = np.ones(len(start), bool)
    expected = plain(start, objective, 3, batch, rule, mask, tasks, W if weight else np.ones(N))
    for name in ("flat", "m", "v"):
        assert getattr(got, name) == pytest.approx(getattr(expected, name), abs=1e-12)
    assert got.steps == pytest.approx(expected.steps) and losses[-1] < losses[0]


def slopes(objective, flat, epoch, step=1e-6):
    out = []
    for k in range(len(flat)):
        e = np.zeros(len(flat))
        e[k] = step
        out.append((objective(flat + e, X, Y, W, epoch)[1] - objective(flat - e, X, Y, W, epoch)[1]) / (2 * step))
    return np.array(out)


BRANCHES = q.Branches(left=2, right=3, hidden=4, classes=CLASSES)


@pytest.mark.parametrize("epoch", [0, 5])
def test_gradients_equal_finite_differences(epoch):
    for objective, size in (
        (q.cross_entropy(CLASSES, WIDTH), CLASSES * (WIDTH + 1)),
        (q.focal(CLASSES, WIDTH), CLASSES * (WIDTH + 1)),
        (BRANCHES.objective(10), BRANCHES.size()),
    ):
        flat = np.random.default_rng(epoch).normal(size=size) * 0.5
        assert objective(flat, X, Y, W, epoch)[0] == pytest.approx(slopes(objective, flat, epoch), abs=1e-4)


def test_the_decoupling_term_begins_after_the_warm_up():
    flat = BRANCHES.start()
    early, late = (BRANCHES.objective(10)(flat, X, Y, W, e)[1] for e in (2, 3))
    assert early == BRANCHES.objective(10, weight=0.0)(flat, X, Y, W, 9)[1] and late != early


def test_a_frozen_branch_keeps_its_parameters(rows):
    rule = q.Adam(rate=0.05)
    first, losses = q.fit_branches(rows, BRANCHES, epochs=6, batch=32, rule=rule)
    assert losses[-1] < losses[0]
    after, _ = q.fit_branches(rows, BRANCHES, epochs=2, batch=32, rule=rule, frozen=["left"], start=first)
    before, now = BRANCHES.parts(first), BRANCHES.parts(after)
    for name in before:
        assert np.array_equal(before[name], now[name]) == name.startswith("left")


def test_decoupled_branches_are_less_alike(rows):
    def likeness(weight):
        state, _ = q.fit(rows, BRANCHES.start(), BRANCHES.objective(8, weight=weight, warmup=0.0), epochs=8, batch=32, rule=q.Adam(rate=0.05))
        p = BRANCHES.parts(state.flat)
        a, b = np.tanh(X[:, :2] @ p["left_weight"] + p["left_bias"]), np.tanh(X[:, 2:] @ p["right_weight"] + p["right_bias"])
        return ((a * b).sum(1) / np.linalg.norm(a, axis=1) / np.linalg.norm(b, axis=1)).mean()

    assert likeness(2.0) < likeness(0.0)


def test_softmax_model_and_bad_labels(spark, rows):
    model = SoftmaxModel.zeros(CLASSES, WIDTH).freeze_features([1])
    out = q.fit_minibatch(rows, model, epochs=1, batch=50, rule=q.Adam(rate=0.1))
    assert not out.model.weight[:, 1].any() and out.model.weight[:, 0].any()
    focal = q.fit_minibatch(rows, SoftmaxModel.zeros(CLASSES, WIDTH), objective=q.focal(CLASSES, WIDTH), epochs=2, batch=50, rule=q.Adam(rate=0.1))
    assert focal.losses[1] < focal.losses[0]
    with pytest.raises(Exception, match="class numbers"):
        q.fit_minibatch(spark.createDataFrame([(1, [1.0] * WIDTH, -1)], "id long, x array<double>, y int"), model, epochs=1)


def test_no_rows(spark):
    empty = spark.createDataFrame([], "id long, x array<double>, y int")
    state, losses = q.fit(empty, np.arange(4.0), q.cross_entropy(1, 3), epochs=2)
    assert state.flat.tolist() == [0, 1, 2, 3] and losses == [0.0, 0.0]
