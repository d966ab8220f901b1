"""Mini-batch fits with first and second moments, as one Spark job per epoch.

Every epoch reshuffles the rows by a seeded hash of their key and cuts that order into exact
batches. Batches are dealt to tasks; a task takes its batches' steps in their order, from the
parameters and moments all tasks begin the epoch with. At the end of the epoch parameters
and moments are averaged in Spark, weighted by the tasks' rows. One task makes the plain
sequential fit; more make local steps with periodic averaging, whose result depends on how
many tasks there are (``tasks``), not on how Spark partitions or retries them.

A task holds one batch at a time. Only parameters reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlab import fixed
from flowlab.operators.learn import Fit, SoftmaxModel, _log_softmax, _matrix, clip_norm
from flowlab.operators.sample import batch_number
from flowlab.session import materialise

#: An objective gives the summed gradient and the summed loss of a batch and its weight.
Objective = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int], tuple[np.ndarray, float, float]]


@dataclass(frozen=True)
class Adam:
    """Steps by decaying means of the gradient and of its square."""

    rate: float = fixed.LEARNING_RATE
    first: float = 0.9
    second: float = 0.999
    floor: float = 1e-8
    norm_limit: float | None = None


@dataclass
class State:
    """Parameters with their moments and the number of steps they have seen."""

    flat: np.ndarray
    m: np.ndarray = field(default=None)
    v: np.ndarray = field(default=None)
    steps: float = 0.0

    def __post_init__(self) -> None:
        self.m = np.zeros_like(self.flat) if self.m is None else self.m
        self.v = np.zeros_like(self.flat) if self.v is None else self.v

    def moved(self, gradient: np.ndarray, rule: Adam, trainable: np.ndarray) -> State:
        gradient = clip_norm(np.where(trainable, gradient, 0.0), rule.norm_limit)
        t = self.steps + 1
        m = rule.first * self.m + (1 - rule.first) * gradient
        v = rule.second * self.v + (1 - rule.second) * gradient**2
        step = (m / (1 - rule.first**t)) / (np.sqrt(v / (1 - rule.second**t)) + rule.floor)
        return State(self.flat - rule.rate * np.where(trainable, step, 0.0), m, v, t)


def cross_entropy(classes: int, width: int) -> Objective:
    """Of a softmax model whose parameters are the weights class by class, then the biases."""

    def objective(flat, x, y, w, epoch):
        weight, bias = flat[: classes * width].reshape(classes, width), flat[classes * width :]
        log_p = _log_softmax(x @ weight.T + bias)
        error = np.exp(log_p)
        error[np.arange(len(y)), y] -= 1.0
        error *= w[:, None]
        return np.concatenate([(error.T @ x).ravel(), error.sum(0)]), float(-(w * log_p[np.arange(len(y)), y]).sum()), float(w.sum())

    return objective


def focal(classes: int, width: int, gamma: float = 2.0) -> Objective:
    """Cross-entropy of which well-classified rows weigh less: each by (1 - p) to the power ``gamma``."""

    def objective(flat, x, y, w, epoch):
        weight, bias = flat[: classes * width].reshape(classes, width), flat[classes * width :]
        log_p = _log_softmax(x @ weight.T + bias)
        own = np.arange(len(y)), y
        p, log_own = np.exp(log_p[own]), log_p[own]
        # The loss depends on the logits through p of the true class alone.
        slope = w * (gamma * (1 - p) ** (gamma - 1) * p * log_own - (1 - p) ** gamma)
        error = -slope[:, None] * np.exp(log_p)
        error[own] += slope
        return np.concatenate([(error.T @ x).ravel(), error.sum(0)]), float((-w * (1 - p) ** gamma * log_own).sum()), float(w.sum())

    return objective


@dataclass(frozen=True)
class Branches:
    """Two hidden branches over two groups of features, and a softmax layer over both.

    ``left`` and ``right`` count the groups' features, ``hidden`` each branch's outputs:
    ``h = tanh(x A + a)`` for either, logits ``[h_left, h_right] W + b``.
    """

    left: int
    right: int
    hidden: int
    classes: int

    def shapes(self) -> list[tuple[str, tuple[int, ...]]]:
        h = self.hidden
        return [
            ("left_weight", (self.left, h)), ("left_bias", (h,)), ("right_weight", (self.right, h)), ("right_bias", (h,)),
            ("top_weight", (2 * h, self.classes)), ("top_bias", (self.classes,)),
        ]

    def parts(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, shape in self.shapes():
            size = int(np.prod(shape))
            out[name] = flat[at : at + size].reshape(shape)
            at += size
        return out

    def size(self) -> int:
        return sum(int(np.prod(shape)) for _, shape in self.shapes())

    def mask(self, frozen: Sequence[str] = ()) -> np.ndarray:
        """Which parameters may move; ``frozen`` names branches: left, right."""
        return np.concatenate([np.full(int(np.prod(shape)), name.split("_")[0] not in frozen) for name, shape in self.shapes()])

    def start(self, seed: int = fixed.SEED) -> np.ndarray:
        """Small weights by a formula of their place, so that every engine can make them."""
        place = np.arange(self.size())
        return ((place * 7919 + seed * 104729) % 1009 - 504) / 1009.0

    def logits(self, flat: np.ndarray, x: np.ndarray) -> np.ndarray:
        p = self.parts(flat)
        h = [np.tanh(x[:, : self.left] @ p["left_weight"] + p["left_bias"]), np.tanh(x[:, self.left :] @ p["right_weight"] + p["right_bias"])]
        return np.concatenate(h, 1) @ p["top_weight"] + p["top_bias"]

    def objective(
        self, epochs: int, weight: float = fixed.DECOUPLE_WEIGHT, warmup: float = fixed.DECOUPLE_WARMUP, floor: float = 1e-8
    ) -> Objective:
        """Cross-entropy plus, after the first ``warmup`` of the epochs, ``weight`` times the cosine of the branches."""

        def objective(flat, x, y, w, epoch):
            p, k = self.parts(flat), self.hidden
            xs = x[:, : self.left], x[:, self.left :]
            a = np.tanh(xs[0] @ p["left_weight"] + p["left_bias"])
            b = np.tanh(xs[1] @ p["right_weight"] + p["right_bias"])
            both = np.concatenate([a, b], 1)
            log_p = _log_softmax(both @ p["top_weight"] + p["top_bias"])
            error = np.exp(log_p)
            error[np.arange(len(y)), y] -= 1.0
            error *= w[:, None]
            loss = -(w * log_p[np.arange(len(y)), y]).sum()
            back = error @ p["top_weight"].T
            da, db = back[:, :k], back[:, k:]
            if epoch >= epochs * warmup:
                na, nb = (np.maximum(np.linalg.norm(h, axis=1), floor) for h in (a, b))
                cos = (a * b).sum(1) / (na * nb)
                loss += weight * (w * cos).sum()
                # Where a norm is at its floor it is a constant.
                free = [(np.linalg.norm(h, axis=1) > floor)[:, None] for h in (a, b)]
                pull = weight * w[:, None]
                da = da + pull * (b / (na * nb)[:, None] - free[0] * cos[:, None] * a / (na**2)[:, None])
                db = db + pull * (a / (na * nb)[:, None] - free[1] * cos[:, None] * b / (nb**2)[:, None])
            da, db = da * (1 - a * a), db * (1 - b * b)
            gradient = [xs[0].T @ da, da.sum(0), xs[1].T @ db, db.sum(0), both.T @ error, error.sum(0)]
            return np.concatenate([g.ravel() for g in gradient]), float(loss), float(w.sum())

        return objective


def epoch_state(
    rows: DataFrame, state: State, objective: Objective, rule: Adam, trainable: np.ndarray, batch: int, tasks: int, epoch: int, seed: int
) -> tuple[State, float]:
    """One epoch over ``rows`` (id, x, y, w): the averaged state and the mean loss of its steps' batches."""
    numbered = batch_number(rows, "id", batch, seed + epoch, "_batch")
    # The order within a batch changes no step; it fixes the order of sums.
    dealt = numbered.withColumn("_task", F.col("_batch") % tasks).repartition(tasks, "_task").sortWithinPartitions("_task", "_batch", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A Spark partition may hold several of the numbered tasks; each starts anew.
        totals: list[np.ndarray] = []
        here, now, seen, loss, held, number = None, state, 0.0, 0.0, [], None

        def step() -> None:
            nonlocal now, seen, loss, held
            if held:
                x, y, w = (np.concatenate(c) for c in zip(*held, strict=True))
                gradient, value, mass = objective(now.flat, x, y, w, epoch)
                if mass:
                    now = now.moved(gradient / mass, rule, trainable)
                seen, loss, held = seen + len(y), loss + value, []

        def close() -> None:
            step()
            if seen:
                totals.append(np.concatenate([seen * now.flat, seen * now.m, seen * now.v, [seen * now.steps, loss, seen]]))

        for block in batches:
            if not block.num_rows:
                continue
            if block.column("y").null_count or pa.compute.min(block.column("y")).as_py() < 0:
                raise ValueError("labels must be class numbers from 0")
            x, y, w = _matrix(block.column("x")), block.column("y").to_numpy(), block.column("w").to_numpy()
            keys = np.stack([block.column("_task").to_numpy(), block.column("_batch").to_numpy()], 1)
            edges = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1), True]).tolist()
            for lo, hi in zip(edges, edges[1:], strict=False):
                task, this = keys[lo].tolist()
                if task != here:
                    close()
                    here, now, seen, loss, number = task, state, 0.0, 0.0, this
                elif this != number:
                    step()
                    number = this
                held.append((x[lo:hi], y[lo:hi], w[lo:hi]))
        close()
        if totals:
            total = np.sum(totals, 0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["place", "value"])

    sums = dealt.select("id", "x", "y", "w", "_task", "_batch").mapInArrow(run, "place int, value double")
    found = {r["place"]: r["value"] for r in sums.groupBy("place").agg(F.sum("value").alias("value")).collect()}
    if not found:
        return state, 0.0
    flat = np.array([found[i] for i in range(len(found))])
    n, size = flat[-1], len(state.flat)
    mean = flat[: 3 * size + 1] / n
    return State(mean[:size], mean[size : 2 * size], mean[2 * size : 3 * size], float(mean[-1])), float(flat[-2] / n)


def fit(
    df: DataFrame,
    start: np.ndarray,
    objective: Objective,
    epochs: int = fixed.EPOCHS,
    batch: int = fixed.BATCH_SIZE,
    rule: Adam = Adam(),
    trainable: np.ndarray | None = None,
    tasks: int = 1,
    key: str = "id",
    x: str = "x",
    y: str = "y",
    weight: str | None = None,
    seed: int = fixed.SEED,
) -> tuple[State, list[float]]:
    """Parameters after ``epochs`` over shuffled exact batches, and each epoch's mean loss.

    ``tasks`` is how many local fits an epoch averages: about one per core, and 1 for the
    sequential fit. The rows are written once; every epoch reads them.
    """
    rows = df.select(
        F.col(key).cast("long").alias("id"), F.col(x).cast("array<double>").alias("x"), F.col(y).cast("int").alias("y"),
        (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"),
    )
    rows = materialise(rows, "rows")
    state, losses = State(np.asarray(start, float)), []
    trainable = np.ones(len(state.flat), bool) if trainable is None else trainable
    for epoch in range(epochs):
        state, loss = epoch_state(rows, state, objective, rule, trainable, batch, tasks, epoch, seed)
        losses.append(loss)
    return state, losses


def fit_minibatch(df: DataFrame, model: SoftmaxModel, **settings) -> Fit:
    """`fit` of a softmax model by cross-entropy, from ``model`` and with its mask."""
    classes, width = model.weight.shape
    state, losses = fit(df, model.flat(), settings.pop("objective", None) or cross_entropy(classes, width), trainable=model.mask(), **settings)
    out = SoftmaxModel(state.flat[: classes * width].reshape(classes, width), state.flat[classes * width :], model.trainable)
    return Fit(out, losses)


def fit_branches(
    df: DataFrame, branches: Branches, epochs: int = fixed.EPOCHS, frozen: Sequence[str] = (), start: np.ndarray | None = None, **settings
) -> tuple[np.ndarray, list[float]]:
    """The two-branch model with the decoupling term inside its loss; frozen branches keep their parameters."""
    begin = branches.start() if start is None else start
    state, losses = fit(df, begin, branches.objective(epochs), epochs=epochs, trainable=branches.mask(frozen), **settings)
    return state.flat, losses
