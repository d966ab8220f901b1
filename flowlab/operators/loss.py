"""Losses and regularisers as row expressions and one aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlab import fixed
from flowlab.functions import vectors
from flowlab.session import settle


def with_cross_entropy(
    df: DataFrame, logits: str = "logits", y_true: str = "y_true", target: str = "ce"
) -> DataFrame:
    return df.withColumn(target, vectors.cross_entropy(F.col(logits), F.col(y_true)))


def with_class_weight(
    df: DataFrame, weights: DataFrame, y_true: str = "y_true", label: str | None = None
) -> DataFrame:
    """Add each row's class weight; ``weights`` has a row per class.

    The weights are evaluated first and broadcast if they are few: a shuffle by class
    would send a dominant class to one task.
    """
    side = settle(weights.select(F.col(label or weights.columns[0]).alias("_class"), "weight"))
    return df.join(side, F.col(y_true) == F.col("_class"), "left").drop("_class")


def weighted_cross_entropy(df: DataFrame, ce: str = "ce", weight: str = "weight") -> DataFrame:
    """Sum of weighted losses over the sum of the weights."""
    return df.agg(
        F.try_divide(F.sum(F.col(ce) * F.col(weight)), F.sum(weight)).alias("weighted_ce")
    )


def focal_loss(
    df: DataFrame, ce: str = "ce", gamma: float = fixed.FOCAL_GAMMA, alpha: str | None = None
) -> DataFrame:
    """Cross-entropy damped where the model is already sure.

    ``alpha`` names a class-weight column; the weighted loss also sets the damping.
    """
    loss = F.col(ce) * F.col(alpha) if alpha else F.col(ce)
    return df.agg(F.avg(F.pow(1 - F.exp(-loss), F.lit(gamma)) * loss).alias("focal_loss"))


def distillation_loss(
    df: DataFrame,
    new: str = "new_logits",
    old: str = "old_logits",
    temperature: float = fixed.TEMPERATURE,
) -> DataFrame:
    """Mean divergence of the new outputs from the old, softened, times T squared."""
    row = vectors.divergence(F.col(old), F.col(new), temperature)
    return df.agg((F.avg(row) * temperature * temperature).alias("distill_loss"))


def decoupling_loss(
    df: DataFrame,
    epoch: int,
    epochs: int,
    left: str = "x_static",
    right: str = "x_dynamic",
    weight: float = fixed.DECOUPLE_WEIGHT,
    warmup: float = fixed.DECOUPLE_WARMUP,
) -> DataFrame:
    """Mean cosine similarity of two branches and its share in the loss at an epoch."""
    similarity = F.avg(vectors.cosine(F.col(left), F.col(right)))
    active = 0.0 if epoch < epochs * warmup else weight
    return df.agg(
        similarity.alias("similarity"), (similarity * active).alias("decouple_loss")
    )


def ewc_penalty(fisher: DataFrame, anchor: DataFrame, current: DataFrame) -> DataFrame:
    """Sum over parameters of Fisher information times squared distance from the anchor.

    All three tables are ``(key, idx, value)``; only parameters in ``fisher`` count.
    """
    named = lambda t, name: t.select("key", "idx", F.col("value").alias(name))
    joined = (
        named(fisher, "f").join(named(anchor, "a"), ["key", "idx"])
        .join(named(current, "c"), ["key", "idx"])
    )
    distance = F.col("c") - F.col("a")
    return joined.agg(
        F.coalesce(F.sum(F.col("f") * distance * distance), F.lit(0.0)).alias("ewc_penalty")
    )


def composite_loss(
    scored: DataFrame,
    penalty: float,
    ewc_weight: float = fixed.EWC_WEIGHT,
    lwf_weight: float = fixed.LWF_WEIGHT,
    temperature: float = fixed.TEMPERATURE,
    new: str = "new_logits",
    old: str = "old_logits",
    y_true: str = "y_true",
) -> DataFrame:
    """Cross-entropy plus weighted EWC penalty and distillation loss, from one pass."""
    ce = F.avg(vectors.cross_entropy(F.col(new), F.col(y_true)))
    lwf = F.avg(vectors.divergence(F.col(old), F.col(new), temperature)) * temperature**2
    return scored.agg(ce.alias("ce"), lwf.alias("lwf")).select(
        "ce",
        F.lit(penalty).alias("ewc"),
        "lwf",
        (F.col("ce") + ewc_weight * F.lit(penalty) + lwf_weight * F.col("lwf")).alias("loss"),
    )
