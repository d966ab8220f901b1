"""Learning two tasks in turn without forgetting the first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlab import fixed
from flowlab.operators.evaluate import evaluate
from flowlab.operators.learn import Fit, fisher_of, fit_softmax, refit_softmax, score
from flowlab.operators.sample import replay_first, split_exact


def two_phase(
    train: DataFrame,
    test: DataFrame,
    classes: int,
    key: str,
    frozen: Sequence[int] = (),
    fraction: float = fixed.TASK2_FRACTION,
    steps: int = fixed.EPOCHS,
    rate: float = fixed.LEARNING_RATE,
    per_class: int = fixed.REPLAY_PER_CLASS,
    batch: int = fixed.BATCH_SIZE,
    seed: int = fixed.SEED,
    x: str = "x",
    y: str = "y",
) -> tuple[Fit, Fit, DataFrame]:
    """Fit on the first part of ``train``, refit on the rest.

    The refit starts from the first model, keeps the ``frozen`` features' weights, is
    held back by EWC and distillation, and replays the first part's buffer. Returns both
    fits and the metrics on ``test`` after each phase.
    """
    parted = split_exact(train, key, fraction, seed)
    tasks = [parted.filter(F.col("part") == i).drop("part") for i in (1, 2)]
    first = fit_softmax(tasks[0], classes, steps, rate, x=x, y=y)
    frozen_model = first.model.freeze_features(frozen)
    fisher = fisher_of(tasks[0], frozen_model, key, batch, x, y)
    replay = replay_first(tasks[0], y, [key], per_class)
    second = refit_softmax(tasks[1], first.model, fisher, frozen, replay, steps, rate, x, y)

    held = test.select(F.col(x).alias("x"), F.col(y).alias("y_true")).persist()
    log = []
    for phase, fit in enumerate((first, second), start=1):
        row = evaluate(score(held, fit.model), "logits", "y_true", "given")["metrics"].first()
        log.append((phase, row["accuracy"], row["weighted_f1"], row["log_loss"]))
    held.unpersist()
    table = train.sparkSession.createDataFrame(
        log, "phase int, accuracy double, weighted_f1 double, log_loss double"
    )
    return first, second, table
