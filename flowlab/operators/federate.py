"""Federated averaging: local fits per client, weighted averaging, rounds.

Each local step is one gradient job over all clients at once, grouped by client, so a
client's rows stay spread over as many tasks as they fill.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlab import fixed
from flowlab.operators.evaluate import evaluate
from flowlab.operators.learn import (
    SoftmaxModel,
    gradient_sums,
    group_sizes,
    prepare_rows,
    row_width,
    score,
)

CLIENT_SCHEMA = "client int, n long, key string, idx int, value double"


@dataclass
class ClientFit:
    """One client's parameters after its local fit, and its row count."""

    model: SoftmaxModel
    rows: int


def fit_clients(
    rows: DataFrame,
    start: SoftmaxModel,
    sizes: dict[int, int],
    epochs: int = fixed.LOCAL_EPOCHS,
    rate: float = fixed.LEARNING_RATE,
) -> dict[int, ClientFit]:
    """Every client's local fit from the same global parameters.

    ``rows`` comes from `learn.prepare_rows` with the client as its group.
    """
    models = {client: start.copy() for client in sizes}
    for _ in range(epochs):
        sums = gradient_sums(rows, models)
        models = {c: m.moved(-rate * sums[c][0] / sums[c][1]) for c, m in models.items()}
    return {c: ClientFit(models[c], sizes[c]) for c in sizes}


def client_table(spark: SparkSession, fits: dict[int, ClientFit]) -> DataFrame:
    """Client parameters as rows ``(client, n, key, idx, value)``."""
    tables = []
    for client, fit in sorted(fits.items()):
        part = fit.model.arrow().select(["key", "idx", "value"])
        part = part.add_column(0, "n", pa.array([fit.rows] * len(part), pa.int64()))
        tables.append(part.add_column(0, "client", pa.array([client] * len(part), pa.int32())))
    return spark.createDataFrame(pa.concat_tables(tables), CLIENT_SCHEMA)


def federated_average(clients: DataFrame) -> DataFrame:
    """Average of each parameter over the clients, weighted by their row counts."""
    return clients.groupBy("key", "idx").agg(
        (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("value")
    )


def run_rounds(
    train: DataFrame,
    test: DataFrame,
    classes: int,
    client: str = "client",
    rounds: int = fixed.ROUNDS,
    epochs: int = fixed.LOCAL_EPOCHS,
    rate: float = fixed.LEARNING_RATE,
    x: str = "x",
    y: str = "y",
) -> tuple[SoftmaxModel, DataFrame]:
    """Rounds of local fits and averaging. Returns the model and metrics per round."""
    spark = train.sparkSession
    rows = prepare_rows(train, x, y, group=client)
    held = test.select(F.col(x).cast("array<double>").alias("x"), F.col(y).alias("y_true")).persist()
    try:
        model = SoftmaxModel.zeros(classes, row_width(rows))
        sizes = group_sizes(rows)
        log = []
        for number in range(1, rounds + 1):
            fits = fit_clients(rows, model, sizes, epochs, rate)
            averaged = federated_average(client_table(spark, fits))
            model = SoftmaxModel.from_table(averaged.withColumn("trainable", F.lit(True)), classes)
            metrics = evaluate(score(held, model), "logits", "y_true", "given")["metrics"].first()
            log.append((number, metrics["accuracy"], metrics["weighted_f1"], metrics["log_loss"]))
        table = spark.createDataFrame(
            log, "round int, accuracy double, weighted_f1 double, log_loss double"
        )
        return model, table
    finally:
        rows.unpersist()
        held.unpersist()
