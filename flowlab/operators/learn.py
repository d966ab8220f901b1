"""Distributed fitting of a softmax model, and Spark ML fits.

A gradient step is one job: every task turns its rows into one partial gradient per
group, and these are summed. A group can be the whole table or one of several clients;
no group's rows are ever gathered. Only parameters, whose number depends on classes and
features, reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel

from flowlab import fixed
from flowlab.functions import vectors
from flowlab.operators.encode import assemble
from flowlab.operators.sample import batch_number
from flowlab.session import settle

# A mini-batch with more rows than this is dealt over so many tasks.
HOT_BATCH = 1_000_000
HOT_TASKS = 256

# Bytes of features per packed record: an Arrow batch of 10,000 records stays below 200 MB.
BLOCK_BYTES = 16_384
CHUNK_ROWS = 65_536

PARAMETER_SCHEMA = "model string, key string, idx int, value double, trainable boolean"


@dataclass
class SoftmaxModel:
    """Weights (classes x features) and biases, with a mask of what may be trained."""

    weight: np.ndarray
    bias: np.ndarray
    trainable: np.ndarray | None = None

    @classmethod
    def zeros(cls, classes: int, features: int) -> "SoftmaxModel":
        return cls(np.zeros((classes, features)), np.zeros(classes))

    def copy(self) -> "SoftmaxModel":
        mask = None if self.trainable is None else self.trainable.copy()
        return SoftmaxModel(self.weight.copy(), self.bias.copy(), mask)

    def flat(self) -> np.ndarray:
        """Weights row by row, then biases."""
        return np.concatenate([self.weight.ravel(), self.bias])

    def moved(self, step: np.ndarray) -> "SoftmaxModel":
        flat = self.flat() + np.where(self.mask(), step, 0.0)
        k, d = self.weight.shape
        return SoftmaxModel(flat[: k * d].reshape(k, d), flat[k * d :], self.trainable)

    def mask(self) -> np.ndarray:
        size = self.weight.size + self.bias.size
        return np.ones(size, bool) if self.trainable is None else self.trainable

    def freeze_features(self, features: Sequence[int]) -> "SoftmaxModel":
        """A copy whose weights on the given features stay as they are."""
        out = self.copy()
        grid = out.mask()[: out.weight.size].reshape(out.weight.shape).copy()
        grid[:, list(features)] = False
        out.trainable = np.concatenate([grid.ravel(), out.mask()[out.weight.size :]])
        return out

    def arrow(self, name: str = "softmax") -> pa.Table:
        """The parameters as rows ``(model, key, idx, value, trainable)``."""
        flat, in_weight = self.flat(), np.arange(self.flat().size) < self.weight.size
        index = np.arange(flat.size)
        return pa.table({
            "model": [name] * flat.size,
            "key": np.where(in_weight, "weight", "bias"),
            "idx": np.where(in_weight, index, index - self.weight.size).astype(np.int32),
            "value": flat,
            "trainable": self.mask(),
        })

    def table(self, spark: SparkSession, name: str = "softmax") -> DataFrame:
        return spark.createDataFrame(self.arrow(name), PARAMETER_SCHEMA)

    @classmethod
    def from_table(cls, table: DataFrame, classes: int) -> "SoftmaxModel":
        parts: dict[str, list] = {"weight": [], "bias": []}
        for row in sorted(table.select("key", "idx", "value", "trainable").collect()):
            parts[row["key"]].append((row["value"], row["trainable"]))
        values = {k: np.array([v for v, _ in rows]) for k, rows in parts.items()}
        mask = np.array([t for k in ("weight", "bias") for _, t in parts[k]])
        return cls(values["weight"].reshape(classes, -1), values["bias"], mask)

    def logits(self, x):
        """Logits as a column expression: one dot product per class."""
        rows = F.array(
            *[
                F.struct(vectors.constant(w).alias("w"), F.lit(float(b)).alias("b"))
                for w, b in zip(self.weight, self.bias)
            ]
        )
        return F.transform(rows, lambda r: vectors.dot(x, r["w"]) + r["b"])


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix, without copying cell by cell."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    widths = pa.compute.list_value_length(column)
    if len(column) and (widths.null_count or pa.compute.min(widths) != pa.compute.max(widths)):
        raise ValueError("vectors must have one width")
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64, copy=False)


def _log_softmax(z: np.ndarray) -> np.ndarray:
    shifted = z - z.max(axis=1, keepdims=True)
    return shifted - np.log(np.exp(shifted).sum(axis=1, keepdims=True))


def _softmax(z: np.ndarray) -> np.ndarray:
    return np.exp(_log_softmax(z))


@dataclass
class Pull:
    """What holds a refit near an older model: EWC on parameters, LwF on outputs."""

    old: SoftmaxModel
    fisher: np.ndarray | None = None
    ewc_weight: float = fixed.EWC_WEIGHT
    lwf_weight: float = fixed.LWF_WEIGHT
    temperature: float = fixed.TEMPERATURE


def prepare_rows(
    df: DataFrame,
    x: str = "x",
    y: str = "y",
    weight: str | None = None,
    group: str | None = None,
) -> DataFrame:
    """The columns a fit reads, packed for the steps to come and kept.

    A step is dominated by moving rows to Python, so they are moved one by one only here:
    each kept record ``(g, d, n, x, y, w)`` holds n rows of one group as raw numbers.
    Kept partitions spill to disk and are recomputed if an executor is lost.
    """
    rows = df.select(
        F.col(x).cast("array<double>").alias("x"),
        F.col(y).cast("int").alias("y"),
        (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"),
        (F.col(group).cast("int") if group else F.lit(0)).alias("g"),
    )
    schema = "g int, d int, n int, x binary, y binary, w binary"
    return rows.mapInArrow(_pack, schema).persist(StorageLevel.MEMORY_AND_DISK)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows == 0:
            continue
        x, g = _matrix(batch.column("x")), batch.column("g").to_numpy()
        if batch.column("y").null_count or pa.compute.min(batch.column("y")).as_py() < 0:
            raise ValueError("labels must be class numbers from 0")
        y, w = batch.column("y").to_numpy(), batch.column("w").to_numpy()
        width = x.shape[1]
        step = max(1, BLOCK_BYTES // (8 * max(width, 1)))
        blocks = []
        for group in np.unique(g):
            at = np.flatnonzero(g == group)
            blocks += [(group, at[i : i + step]) for i in range(0, len(at), step)]
        raw = lambda values, dtype: pa.array(
            [np.ascontiguousarray(values[at], dtype).tobytes() for _, at in blocks], pa.binary()
        )
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([int(group) for group, _ in blocks], pa.int32()),
                pa.array([width] * len(blocks), pa.int32()),
                pa.array([len(at) for _, at in blocks], pa.int32()),
                raw(x, np.float64), raw(y, np.int32), raw(w, np.float64),
            ],
            names=["g", "d", "n", "x", "y", "w"],
        )


def _numbers(column: pa.Array, dtype) -> np.ndarray:
    """All values of a packed column in one array; the records lie next to each other."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    wide = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    edges = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[edges[0] : edges[-1]].view(dtype)


def row_width(rows: DataFrame) -> int:
    """Number of features of prepared rows."""
    return rows.select("d").first()["d"]


def group_sizes(rows: DataFrame) -> dict[int, int]:
    return {r["g"]: r["n"] for r in rows.groupBy("g").agg(F.sum("n").alias("n")).collect()}


def gradient_sums(
    rows: DataFrame, models: Mapping[int, SoftmaxModel], pull: Pull | None = None
) -> dict[int, tuple[np.ndarray, float, float]]:
    """Per group: summed weighted gradient, summed weight, summed weighted loss.

    The gradient and loss cover the rows' cross-entropy and, with ``pull``, the
    distillation term (which is not class-weighted, so it needs unit weights).
    """
    def add(acc: list, model: SoftmaxModel, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> None:
        z = x @ model.weight.T + model.bias
        each = np.arange(len(y))
        log_p = _log_softmax(z)
        loss = -log_p[each, y]
        error = np.exp(log_p)
        error[each, y] -= 1.0
        if pull is not None and pull.lwf_weight:
            t = pull.temperature
            old = _log_softmax((x @ pull.old.weight.T + pull.old.bias) / t)
            new = _log_softmax(z / t)
            error += pull.lwf_weight * t * (np.exp(new) - np.exp(old))
            kl = (np.exp(old) * (old - new)).sum(axis=1)
            loss = loss + pull.lwf_weight * t * t * kl
        error *= w[:, None]
        acc[0] += np.concatenate([(error.T @ x).ravel(), error.sum(axis=0)])
        acc[1] += w.sum()
        acc[2] += (w * loss).sum()

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            width = batch.column("d")[0].as_py()
            x = _numbers(batch.column("x"), np.float64).reshape(-1, width)
            y, w = _numbers(batch.column("y"), np.int32), _numbers(batch.column("w"), np.float64)
            classes = min(len(model.bias) for model in models.values())
            if len(y) and y.max() >= classes:
                raise ValueError(f"a label is {y.max()}, the model has {classes} classes")
            if any(model.weight.shape[1] != width for model in models.values()):
                raise ValueError(f"vectors have {width} numbers, the model takes others")
            g = np.repeat(batch.column("g").to_numpy(), batch.column("n").to_numpy())
            for lo in range(0, len(y), CHUNK_ROWS):
                here = slice(lo, lo + CHUNK_ROWS)
                present = np.unique(g[here])
                for group in present:
                    own = here if len(present) == 1 else lo + np.flatnonzero(g[here] == group)
                    model = models[int(group)]
                    acc = sums.setdefault(int(group), [np.zeros(model.flat().size), 0.0, 0.0])
                    add(acc, model, x[own], y[own], w[own])
        for group, (flat, mass, loss) in sums.items():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([group], pa.int32()),
                    pa.array([np.concatenate([flat, [mass, loss]])], pa.list_(pa.float64())),
                ],
                names=["g", "part"],
            )

    parts = rows.mapInArrow(partial, "g int, part array<double>")
    totals = (
        parts.select("g", F.posexplode("part").alias("idx", "value"))
        .groupBy("g", "idx")
        .agg(F.sum("value").alias("value"))
    )
    size = next(iter(models.values())).flat().size
    out: dict[int, np.ndarray] = {}
    for row in totals.collect():
        out.setdefault(row["g"], np.zeros(size + 2))[row["idx"]] = row["value"]
    return {g: (v[:size], v[size], v[size + 1]) for g, v in out.items()}


def clip_norm(gradient: np.ndarray, limit: float | None) -> np.ndarray:
    """Scale a gradient down to the given norm if it is longer."""
    norm = float(np.linalg.norm(gradient))
    return gradient if limit is None or norm <= limit else gradient * (limit / norm)


@dataclass
class Fit:
    model: SoftmaxModel
    losses: list[float] = field(default_factory=list)

    def history(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            [(i, float(v)) for i, v in enumerate(self.losses)], "epoch int, loss double"
        )


def fit_softmax(
    df: DataFrame,
    classes: int,
    steps: int = fixed.EPOCHS,
    rate: float = fixed.LEARNING_RATE,
    start: SoftmaxModel | None = None,
    weight: str | None = None,
    pull: Pull | None = None,
    norm_limit: float | None = None,
    x: str = "x",
    y: str = "y",
) -> Fit:
    """Full-batch gradient descent; each step is one pass over the kept rows."""
    rows = prepare_rows(df, x, y, weight)
    try:
        if start is None:
            start = SoftmaxModel.zeros(classes, row_width(rows))
        fit = Fit(start.copy())
        for _ in range(steps):
            total, mass, loss = gradient_sums(rows, {0: fit.model}, pull)[0]
            gradient, value = total / mass, loss / mass
            if pull is not None and pull.fisher is not None:
                distance = fit.model.flat() - pull.old.flat()
                gradient = gradient + pull.ewc_weight * 2.0 * pull.fisher * distance
                value += pull.ewc_weight * float((pull.fisher * distance**2).sum())
            gradient = clip_norm(np.where(fit.model.mask(), gradient, 0.0), norm_limit)
            fit.losses.append(float(value))
            fit.model = fit.model.moved(-rate * gradient)
        return fit
    finally:
        rows.unpersist()


def scale_groups(df: DataFrame, groups: Sequence[str]) -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """Every feature group (an array column) by its own mean and deviation over all rows and places.

    A constant group keeps its distances. One pass finds all groups' sums.
    """
    terms = []
    for g in groups:
        x = F.col(g).cast("array<double>")
        square = F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v * v)
        terms += [F.sum(F.size(x)).alias(f"n_{g}"), F.sum(vectors.total(x)).alias(f"s_{g}"), F.sum(square).alias(f"q_{g}")]
    sums = df.agg(*terms).first()
    scales = {}
    for g in groups:
        n = sums[f"n_{g}"] or 1
        mean = (sums[f"s_{g}"] or 0.0) / n
        deviation = max((sums[f"q_{g}"] or 0.0) / n - mean * mean, 0.0) ** 0.5
        scales[g] = (mean, deviation or 1.0)

    def scaled(g: str):
        mean, deviation = scales[g]
        return F.transform(F.col(g).cast("array<double>"), lambda v: (v - mean) / deviation)

    return df.withColumns({g: scaled(g) for g in groups}), scales


def fit_groups(
    df: DataFrame,
    groups: Sequence[str],
    classes: int,
    frozen: Sequence[str],
    steps: int = fixed.EPOCHS,
    frozen_steps: int = fixed.EPOCHS,
    rate: float = fixed.LEARNING_RATE,
    y: str = "y",
) -> Fit:
    """A model on several feature groups, each scaled on its own.

    After ``steps`` over all groups, ``frozen_steps`` follow in which the ``frozen`` groups'
    weights stay.
    """
    scaled, _ = scale_groups(df, groups)
    first = scaled.select(*[F.size(g).alias(g) for g in groups]).first()
    starts = np.concatenate([[0], np.cumsum([first[g] for g in groups])])
    held = [j for i, g in enumerate(groups) if g in frozen for j in range(starts[i], starts[i + 1])]
    joined = scaled.select(F.concat(*groups).alias("x"), F.col(y).alias("y"))
    together = fit_softmax(joined, classes, steps, rate)
    after = fit_softmax(joined, classes, frozen_steps, rate, start=together.model.freeze_features(held))
    return Fit(after.model, together.losses + after.losses)


def refit_softmax(
    df: DataFrame,
    old: SoftmaxModel,
    fisher: np.ndarray | None,
    frozen: Sequence[int],
    replay: DataFrame | None = None,
    steps: int = fixed.EPOCHS,
    rate: float = fixed.LEARNING_RATE,
    x: str = "x",
    y: str = "y",
) -> Fit:
    """Warm start from ``old`` on new rows and replayed ones.

    Weights on the ``frozen`` features stay; the loss holds the EWC and distillation
    terms. ``replay`` is a buffer filled from earlier tasks.
    """
    columns = df.select(x, y)
    if replay is not None:
        columns = columns.unionByName(replay.select(x, y))
    return fit_softmax(
        columns,
        old.bias.size,
        steps,
        rate,
        start=old.freeze_features(frozen),
        pull=Pull(old, fisher),
        x=x,
        y=y,
    )


def fisher_diagonal(
    df: DataFrame,
    model: SoftmaxModel,
    batch: str,
    x: str = "x",
    y: str = "y",
    hot_rows: int = HOT_BATCH,
) -> DataFrame:
    """Mean over mini-batches of the squared batch-mean gradient: ``(key, idx, value)``.

    Rows are brought together and sorted by batch, so a task streams through its batches
    with one running sum and emits one vector, however many rows it saw. Should a batch
    hold more than ``hot_rows``, its rows are dealt over tasks instead, each of which
    emits that batch's partial sum.
    """
    k, d = model.weight.shape
    rows = df.select(
        F.col(batch).cast("long").alias("b"),
        F.col(x).cast("array<double>").alias("x"),
        F.col(y).cast("int").alias("y"),
    )
    sizes = rows.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    hot = settle(sizes.filter(F.col("n") > hot_rows).select(F.col("b").alias("h")))
    deal = F.when(F.col("h").isNotNull(), F.pmod(F.xxhash64("x"), F.lit(HOT_TASKS)))
    spread = (
        rows.join(hot, F.col("b") == F.col("h"), "left")
        .withColumn("s", F.coalesce(deal, F.lit(0)).cast("int"))
        .select("b", "x", "y", "s", F.col("h").isNotNull().alias("hot"))
    )

    def partial(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = k * d + k
        squares, done = np.zeros(size), 0
        running, n, current, dealt = np.zeros(size), 0, None, False

        def out(batch_id, count, values):
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([batch_id], pa.int64()), pa.array([count], pa.int64()),
                    pa.array([values], pa.list_(pa.float64())),
                ],
                names=["b", "n", "part"],
            )

        for block in blocks:
            if block.num_rows == 0:
                continue
            xs, ys = _matrix(block.column("x")), block.column("y").to_numpy()
            ids = block.column("b").to_numpy()
            is_hot = block.column("hot").to_numpy(zero_copy_only=False)
            error = _softmax(xs @ model.weight.T + model.bias)
            error[np.arange(len(ys)), ys] -= 1.0
            edges = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1], True])
            for lo, hi in zip(edges[:-1], edges[1:]):
                if n and ids[lo] != current:
                    if dealt:
                        yield out(current, n, running)
                    else:
                        squares, done = squares + (running / n) ** 2, done + 1
                    running, n = np.zeros(size), 0
                current, dealt, e = ids[lo], bool(is_hot[lo]), error[lo:hi]
                running = running + np.concatenate([(e.T @ xs[lo:hi]).ravel(), e.sum(axis=0)])
                n += int(hi - lo)
        if n and dealt:
            yield out(current, n, running)
        elif n:
            squares, done = squares + (running / n) ** 2, done + 1
        if done:
            yield out(None, done, squares)

    parts = (
        spread.repartition("b", "s").sortWithinPartitions("b")
        .mapInArrow(partial, "b long, n long, part array<double>")
    )
    by_batch = (
        parts.select("b", "n", F.posexplode("part").alias("pos", "value"))
        .groupBy("b", "pos")
        .agg(F.sum("value").alias("value"), F.sum("n").alias("n"))
    )
    # A whole batch's sum becomes its squared mean; the others are squared already.
    mean = F.col("value") / F.col("n")
    whole = F.col("b").isNotNull()
    sums = by_batch.groupBy("pos").agg(
        (
            F.sum(F.when(whole, mean * mean).otherwise(F.col("value")))
            / F.sum(F.when(whole, 1).otherwise(F.col("n")))
        ).alias("value")
    )
    in_weight = F.col("pos") < k * d
    return sums.select(
        F.when(in_weight, "weight").otherwise("bias").alias("key"),
        F.when(in_weight, F.col("pos")).otherwise(F.col("pos") - k * d).cast("int").alias("idx"),
        "value",
    )


def fisher_of(
    df: DataFrame, model: SoftmaxModel, key: str, size: int = fixed.BATCH_SIZE, x: str = "x", y: str = "y"
) -> np.ndarray:
    """Fisher diagonal over shuffled mini-batches, as a vector for a refit.

    Frozen parameters have none.
    """
    table = fisher_diagonal(batch_number(df, key, size), model, "batch", x, y)
    out = np.zeros(model.flat().size)
    for row in table.collect():
        out[row["idx"] + (model.weight.size if row["key"] == "bias" else 0)] = row["value"]
    return np.where(model.mask(), out, 0.0)


def score(df: DataFrame, model: SoftmaxModel, x: str = "x") -> DataFrame:
    """Logits and predicted class for every row, in Arrow batches.

    Columns are passed through; the model travels with the task.
    """
    names = df.columns
    spot = names.index(x)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                z = _matrix(batch.column(spot)) @ model.weight.T + model.bias
            else:
                z = np.zeros((0, model.bias.size))
            offsets = np.arange(0, z.size + 1, model.bias.size, dtype=np.int32)
            logits = pa.ListArray.from_arrays(pa.array(offsets), pa.array(z.ravel()))
            best = z.argmax(axis=1).astype(np.int32) if len(z) else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, logits, pa.array(best)], names=[*names, "logits", "y_pred"]
            )

    added = [
        T.StructField("logits", T.ArrayType(T.DoubleType())),
        T.StructField("y_pred", T.IntegerType()),
    ]
    return df.mapInArrow(apply, T.StructType([*df.schema.fields, *added]))


def fit_pipeline(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    kind: str = "logistic",
    classes: int | None = None,
    weight: str | None = None,
    hidden: Sequence[int] = (32,),
    iterations: int = fixed.EPOCHS,
    seed: int = fixed.SEED,
) -> PipelineModel:
    """A Spark ML classifier on numeric columns or on one array column.

    ``kind`` is ``logistic`` or ``perceptron``; only the former takes row weights.
    """
    prepared = as_vector(df, features)
    if kind == "logistic":
        estimator = LogisticRegression(
            featuresCol="features", labelCol=label, maxIter=iterations, family="multinomial"
        )
        if weight:
            estimator = estimator.setWeightCol(weight)
    elif kind == "perceptron":
        if weight:
            raise ValueError("the perceptron takes no row weights")
        width = prepared.select("features").first()["features"].size
        k = classes or prepared.select(label).distinct().count()
        estimator = MultilayerPerceptronClassifier(
            featuresCol="features", labelCol=label, maxIter=iterations, seed=seed,
            layers=[width, *hidden, k],
        )
    else:
        raise ValueError("kind must be 'logistic' or 'perceptron'")
    return Pipeline(stages=[estimator]).fit(prepared)


def as_vector(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """The feature vector a Spark ML model reads; nested arrays are flattened."""
    if len(features) == 1 and dict(df.dtypes)[features[0]].startswith("array"):
        source = F.col(features[0])
        if dict(df.dtypes)[features[0]].startswith("array<array"):
            source = F.flatten(source)
        return df.withColumn("features", array_to_vector(source.cast("array<double>")))
    return assemble(df, features)


def score_pipeline(df: DataFrame, model: PipelineModel, features: Sequence[str]) -> DataFrame:
    """Batch scoring with a Spark ML model: logits, probabilities, predicted class."""
    out = model.transform(as_vector(df, features))
    return out.select(
        *df.columns,
        vector_to_array("rawPrediction").alias("logits"),
        vector_to_array("probability").alias("probabilities"),
        F.col("prediction").cast("int").alias("y_pred"),
    )
