"""Data-quality profile of a labelled table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlab import fixed
from flowlab.functions import cells
from flowlab.operators.dedup import duplicate_count
from flowlab.session import settle


def shape(df: DataFrame) -> DataFrame:
    return _shape(df.agg(F.count(F.lit(1)).alias("rows")), df.columns)


def _shape(counted: DataFrame, columns: Sequence[str]) -> DataFrame:
    return counted.select(
        "rows",
        F.lit(len(columns)).alias("columns"),
        F.lit(",".join(columns)).alias("column_list"),
    )


def label_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def label_distribution(
    df: DataFrame, label: str, names: Mapping[str, int] | None = None
) -> DataFrame:
    """Rows and share in percent per label; nulls are not counted."""
    counts = label_counts(df.filter(F.col(label).isNotNull()), label)
    share = F.col("n") * F.lit(100.0) / F.sum("n").over(Window.partitionBy())
    out = counts.withColumn("percent", F.bround(share, 2))
    if names is not None:
        out = out.withColumn("name", cells.label_name(F.col(label), names))
    return out.orderBy(label)


def label_status(df: DataFrame, label: str) -> DataFrame:
    """One row saying whether the label column is there, and over how many rows."""
    return _label_status(df.agg(F.count(F.lit(1)).alias("rows")), label in df.columns, label)


def _label_status(counted: DataFrame, found: bool, label: str) -> DataFrame:
    return counted.select(
        F.lit(label).alias("label"),
        F.lit("present" if found else "missing").alias("status"),
        "rows",
    )


def _missing_cells(df: DataFrame) -> Column:
    missing = sum(
        (cells.is_missing(F.col(f"`{c}`"), dtype).cast("int") for c, dtype in df.dtypes), F.lit(0)
    )
    return F.coalesce(F.sum(missing), F.lit(0)).cast("long").alias("null_cells")


def null_total(df: DataFrame) -> DataFrame:
    """Missing cells over the whole table, NaN included, in one pass."""
    return df.agg(_missing_cells(df))


def bin_counts(df: DataFrame, label: str) -> DataFrame:
    """Count of every code 0..max(label), zero for absent codes. Labels are class codes."""
    counts = label_counts(df, label)
    codes = counts.agg(F.max(label).alias("top")).select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("top").cast("long"))).alias(label)
    )
    return codes.join(counts.withColumn(label, F.col(label).cast("long")), label, "left").select(
        label, F.coalesce("n", F.lit(0)).cast("long").alias("n")
    )


def matrix_moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean and sample deviation over all cells of a numeric matrix.

    Per-column moments are merged, so the cells are not stacked into rows.
    """
    terms = []
    for i, c in enumerate(columns):
        x = F.col(f"`{c}`").cast("double")
        terms += [
            F.count(x).alias(f"n_{i}"),
            F.coalesce(F.avg(x), F.lit(0.0)).alias(f"m_{i}"),
            F.coalesce(F.var_pop(x), F.lit(0.0)).alias(f"v_{i}"),
        ]
    span = range(len(columns))
    n = sum((F.col(f"n_{i}") for i in span), F.lit(0))
    mass = sum((F.col(f"n_{i}") * F.col(f"m_{i}") for i in span), F.lit(0.0))
    with_mean = df.agg(*terms).withColumn("n", n).withColumn("mean", F.try_divide(mass, F.col("n")))
    squares = sum(
        (
            F.col(f"n_{i}") * (F.col(f"v_{i}") + F.pow(F.col(f"m_{i}") - F.col("mean"), 2))
            for i in span
        ),
        F.lit(0.0),
    )
    return with_mean.select(
        "n", "mean", F.sqrt(F.try_divide(squares, F.col("n") - 1)).alias("std")
    )


def class_count(df: DataFrame, label: str) -> DataFrame:
    return df.select(label).distinct().agg(F.count(label).alias("classes"))


def output_size(df: DataFrame, label: str, mode: str) -> int:
    """Width of a classifier's output: 2 for binary, the classes present for multi."""
    if fixed.check_mode(mode) == "binary":
        return 2
    return class_count(df, label).first()["classes"]


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights n / (k * count), one row per class."""
    every = Window.partitionBy()
    return (
        label_counts(df.filter(F.col(label).isNotNull()), label)
        .withColumn("n_all", F.sum("n").over(every))
        .withColumn("classes", F.count(F.lit(1)).over(every))
        .select(label, "n", (F.col("n_all") / (F.col("classes") * F.col("n"))).alias("weight"))
    )


def smoothed_weights(
    df: DataFrame,
    label: str,
    position: int = fixed.SUPPRESSED_CLASS,
    factor: float = fixed.SUPPRESSED_FACTOR,
) -> DataFrame:
    """Square roots of the balanced weights.

    With more than ``position`` classes, the class at that position in label order is
    scaled by ``factor``.
    """
    place = F.row_number().over(Window.orderBy(label)) - 1
    root = F.sqrt("weight")
    return (
        class_weights(df, label)
        .withColumn("_place", place)
        .withColumn("weight", F.when(F.col("_place") == position, root * factor).otherwise(root))
        .drop("_place")
    )


def profile(
    df: DataFrame, label: str = "new_label", names: Mapping[str, int] | None = fixed.ATTACK_CODES
) -> dict[str, DataFrame]:
    """The whole report: shape, label status and distribution, missing cells, duplicates.

    Rows and missing cells come from one pass; labels and duplicates from a grouping each.
    """
    counted = settle(df.agg(F.count(F.lit(1)).alias("rows"), _missing_cells(df)))
    report = {
        "shape": _shape(counted, df.columns),
        "label_status": _label_status(counted, label in df.columns, label),
        "nulls": counted.select("null_cells"),
        "duplicates": duplicate_count(df),
    }
    if label in df.columns:
        report["distribution"] = label_distribution(df, label, names)
    return report
