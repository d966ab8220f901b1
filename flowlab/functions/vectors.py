"""Expressions on ``array<double>`` columns.

`bind` names an intermediate value inside an expression, so that a lambda uses it without
computing it again for every element.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def constant(values: Iterable[float]) -> Column:
    """A literal ``array<double>``, as one expression however long it is."""
    def text(v: float) -> str:
        return f"{float(v)!r}D" if math.isfinite(v) else f"double('{float(v)}')"

    return F.expr(f"array({', '.join(text(v) for v in values)})")


def doubles(c: Column) -> Column:
    return c.cast("array<double>")


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x)


def dot(xs: Column, ys: Column) -> Column:
    return total(F.zip_with(xs, ys, lambda x, y: x * y))


def log_sum_exp(z: Column) -> Column:
    return bind(
        F.array_max(z),
        lambda peak: peak
        + F.log(F.aggregate(z, F.lit(0.0), lambda acc, x: acc + F.exp(x - peak))),
    )


def log_softmax(z: Column) -> Column:
    return bind(log_sum_exp(z), lambda norm: F.transform(z, lambda x: x - norm))


def softmax(z: Column) -> Column:
    return bind(log_sum_exp(z), lambda norm: F.transform(z, lambda x: F.exp(x - norm)))


def cross_entropy(z: Column, y: Column) -> Column:
    """Negative log-likelihood of class ``y`` under logits ``z``; a label outside them is an error."""
    message = F.concat(F.lit("label outside the logits: "), F.coalesce(y.cast("string"), F.lit("null")))
    inside = (y >= 0) & (y < F.size(z))
    return log_sum_exp(z) - F.when(z.isNull() | inside, F.get(z, y)).otherwise(F.raise_error(message).cast("double"))


def argmax(z: Column) -> Column:
    """Index of the first maximum."""
    return (F.array_position(z, F.array_max(z)) - 1).cast("int")


def cosine(xs: Column, ys: Column, floor: float = 1e-8) -> Column:
    """Cosine similarity with each norm floored, so a zero vector gives 0."""
    left = F.greatest(F.sqrt(dot(xs, xs)), F.lit(floor))
    right = F.greatest(F.sqrt(dot(ys, ys)), F.lit(floor))
    return dot(xs, ys) / (left * right)


def divergence(old: Column, new: Column, temperature: float) -> Column:
    """KL(softmax(old/T) || softmax(new/T)) of one row."""
    cold = F.transform(old, lambda x: x / F.lit(temperature))
    warm = F.transform(new, lambda x: x / F.lit(temperature))
    return total(
        F.zip_with(log_softmax(cold), log_softmax(warm), lambda p, q: F.exp(p) * (p - q))
    )


def rows_of(xs: Column, steps: int) -> Column:
    """Cut a vector into ``steps`` consecutive rows of equal width."""
    width = F.floor(F.size(xs) / steps).cast("int")
    cut = F.transform(
        F.sequence(F.lit(0), F.lit(steps - 1)),
        lambda i: F.slice(xs, i * width + 1, width),
    )
    uneven = F.raise_error(F.lit(f"vector length is not a multiple of {steps}"))
    return F.when(F.size(xs) % steps == 0, cut).otherwise(uneven)


def rescale_row(xs: Column) -> Column:
    """Map a row linearly onto [-1, 1]; a constant row maps to zeros."""
    return bind(
        F.struct(F.array_min(xs).alias("low"), F.array_max(xs).alias("high")),
        lambda r: F.transform(
            xs,
            lambda x: F.when(
                r["high"] > r["low"],
                (F.lit(2.0) * x - r["high"] - r["low"]) / (r["high"] - r["low"]),
            ).otherwise(F.lit(0.0)),
        ),
    )


def angular_field(xs: Column) -> Column:
    """Summation Gramian angular field: cos(a_i + a_j) with cos(a) the rescaled row."""
    polar = F.transform(
        rescale_row(xs),
        lambda x: F.struct(
            x.alias("c"), F.sqrt(F.greatest(F.lit(1.0) - x * x, F.lit(0.0))).alias("s")
        ),
    )
    return bind(
        polar,
        lambda p: F.transform(
            p, lambda a: F.transform(p, lambda b: a["c"] * b["c"] - a["s"] * b["s"])
        ),
    )
