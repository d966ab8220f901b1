"""Saving and loading models, reports and parameter tables, by mode."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from flowlab import fixed
from flowlab.operators.learn import SoftmaxModel


def model_path(folder: str, kind: str, mode: str) -> str:
    return f"{folder}/{kind}_{fixed.check_mode(mode)}"


def save_softmax(spark: SparkSession, model: SoftmaxModel, folder: str, mode: str) -> str:
    path = model_path(folder, "softmax", mode)
    model.table(spark).write.mode("overwrite").parquet(path)
    return path


def load_softmax(spark: SparkSession, folder: str, mode: str) -> SoftmaxModel:
    table = spark.read.parquet(model_path(folder, "softmax", mode))
    classes = table.filter("key = 'bias'").count()
    return SoftmaxModel.from_table(table, classes)


def save_pipeline(model: PipelineModel, folder: str, mode: str) -> str:
    path = model_path(folder, "classifier", mode)
    model.write().overwrite().save(path)
    return path


def load_pipeline(folder: str, mode: str) -> PipelineModel:
    return PipelineModel.load(model_path(folder, "classifier", mode))


def save_report(report: dict[str, DataFrame], folder: str, mode: str) -> dict[str, str]:
    """Write every table of a report; returns their paths."""
    paths = {}
    for name, df in report.items():
        paths[name] = model_path(folder, name, mode)
        df.write.mode("overwrite").parquet(paths[name])
    return paths


def load_report(spark: SparkSession, folder: str, mode: str, names: Iterable[str]) -> dict[str, DataFrame]:
    """The named tables of a saved report."""
    return {name: spark.read.parquet(model_path(folder, name, mode)) for name in names}
