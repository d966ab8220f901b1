"""Preparation as Spark ML stages: fitted once, saved with its tables, applied to new ones.

A fitted stage's state is a table (codes by value, shifts and divisors by column, chosen
columns). It is saved as Parquet beside the stage's parameters, so that a `PipelineModel` of
these stages prepares rows that arrive in a later session just as it prepared the first ones.
No state passes the driver unless it is small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasLabelCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlab import fixed
from flowlab.functions import cells
from flowlab.operators import clean, encode
from flowlab.operators.sample import number_sorted
from flowlab.session import materialise, small_or_none


class _Writer(MLWriter):
    """Parameters as Spark ML writes them, the state as Parquet beside them."""

    def __init__(self, stage: StatefulModel):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.stage, path, self.sparkSession)
        self.stage.state.write.parquet(f"{path}/state")


class _Reader(MLReader):
    def __init__(self, cls: type[StatefulModel]):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> StatefulModel:
        spark = self.sparkSession
        stage = self.cls(spark.read.parquet(f"{path}/state"))
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        stage._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(stage, metadata)
        return stage


class StatefulModel(Model, MLWritable, MLReadable):
    """A fitted stage whose state is a table."""

    def __init__(self, state: DataFrame | None = None):
        super().__init__()
        self.state = state

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)

    def _rows(self) -> list:
        """The state, for stages that have a row per column."""
        return self.state.collect()


class Cleaning(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Blank cells become missing, a column's sentinel its token, incomplete rows go, columns are dropped."""

    sentinelCol = Param(Params._dummy(), "sentinelCol", "column that may hold the sentinel", TypeConverters.toString)
    sentinel = Param(Params._dummy(), "sentinel", "what stands for an unknown value", TypeConverters.toString)
    token = Param(Params._dummy(), "token", "what the sentinel becomes; empty: a missing value", TypeConverters.toString)
    dropCols = Param(Params._dummy(), "dropCols", "columns dropped when present", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, sentinelCol: str = "service", sentinel: str = fixed.SERVICE_SENTINEL, token: str = fixed.SERVICE_UNKNOWN, dropCols: Sequence[str] = ()):
        super().__init__()
        self._setDefault(sentinelCol="service", sentinel=fixed.SERVICE_SENTINEL, token=fixed.SERVICE_UNKNOWN, dropCols=[])
        self._set(**{k: list(v) if k == "dropCols" else v for k, v in self._input_kwargs.items()})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        name, token = self.getOrDefault("sentinelCol"), self.getOrDefault("token")
        df = clean.blanks_to_null(dataset.drop(*self.getOrDefault("dropCols")))
        if name in df.columns:
            change = cells.sentinel_to_token if token else lambda c, s, _: cells.sentinel_to_null(c, s)
            df = df.withColumn(name, change(F.col(f"`{name}`"), self.getOrDefault("sentinel"), token))
        return clean.drop_incomplete(df)


class _CodeParams(HasInputCols):
    layout = Param(Params._dummy(), "layout", "ordinal: the code in place; onehot: a sparse vector of all columns", TypeConverters.toString)
    unseen = Param(Params._dummy(), "unseen", "null, error or other: the code after the last one", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "the one-hot vector's column", TypeConverters.toString)


LAYOUTS, UNSEEN = ("ordinal", "onehot"), ("null", "error", "other")


class Codes(Estimator, _CodeParams, DefaultParamsReadable, DefaultParamsWritable):
    """Codes of categories: a value's rank among the sorted distinct values of the fitted table."""

    @keyword_only
    def __init__(self, *, inputCols: Sequence[str] = (), layout: str = "ordinal", unseen: str = "null", outputCol: str = "onehot"):
        super().__init__()
        self._setDefault(inputCols=[], layout="ordinal", unseen="null", outputCol="onehot")
        self._set(**{k: list(v) if k == "inputCols" else v for k, v in self._input_kwargs.items()})
        if layout not in LAYOUTS or unseen not in UNSEEN:
            raise ValueError(f"layout is one of {LAYOUTS}, unseen one of {UNSEEN}")

    def _fit(self, dataset: DataFrame) -> CodesModel:
        """One pass finds all columns' values; they are numbered by a distributed sort."""
        columns = self.getOrDefault("inputCols")
        pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("place"), F.col(f"`{c}`").cast("string").alias("value")) for i, c in enumerate(columns)]))
        values = dataset.select(pairs.alias("p")).select("p.*").where("value is not null").distinct()
        ranked = number_sorted(values, [F.col("place"), F.col("value")], "_rank")
        first = ranked.groupBy("place").agg(F.min("_rank").alias("_first"), F.count("*").alias("size"))
        ranked = ranked.join(F.broadcast(first), "place")  # one row per input column
        state = ranked.select("place", "value", (F.col("_rank") - F.col("_first")).cast("int").alias("code"), "size")
        return self._copyValues(CodesModel(materialise(state, "codes")))


class CodesModel(StatefulModel, _CodeParams):
    """Codes looked up in the fitted values; ``state`` has place, value, code and its column's size."""

    def __init__(self, state: DataFrame | None = None):
        super().__init__(state)
        self._setDefault(inputCols=[], layout="ordinal", unseen="null", outputCol="onehot")

    def sizes(self) -> list[int]:
        """The number of values of each column."""
        found = {r["place"]: r["size"] for r in self.state.groupBy("place").agg(F.max("size").alias("size")).collect()}
        return [found.get(i, 0) for i in range(len(self.getOrDefault("inputCols")))]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        columns, sizes = self.getOrDefault("inputCols"), self.sizes()
        small = small_or_none(self.state.select("place", "value", "code"), encode.SMALL_ROWS)
        df, codes = dataset, []
        for i, name in enumerate(columns):
            target = f"_code_{i}"
            cell = F.col(f"`{name}`").cast("string")
            side = self.state.where(F.col("place") == i).select(F.col("value").alias(f"_value_{i}"), F.col("code").alias(target))
            # A column whose values were measured as few is looked up without a shuffle.
            side = F.broadcast(side) if small is not None else side
            df = df.join(side, cell == F.col(f"_value_{i}"), "left").drop(f"_value_{i}")
            codes.append(self._known(F.col(target), cell, name, sizes[i]))
        if self.getOrDefault("layout") == "ordinal":
            df = df.withColumns(dict(zip(columns, codes, strict=True)))
            return df.drop(*[f"_code_{i}" for i in range(len(columns))])
        extra = int(self.getOrDefault("unseen") == "other")
        starts = [sum(sizes[:i]) + extra * i for i in range(len(columns))]
        places = F.filter(F.array(*[c + s for c, s in zip(codes, starts, strict=True)]), lambda k: k.isNotNull())
        onehot = F.struct(F.lit(sum(sizes) + extra * len(columns)).alias("size"), places.alias("indices"))
        kept = [F.col(f"`{c}`") for c in dataset.columns if c not in columns]
        return df.select(*kept, onehot.alias(self.getOrDefault("outputCol")))

    def _known(self, code, cell, name: str, size: int):
        rule = self.getOrDefault("unseen")
        if rule == "null":
            return code
        if rule == "other":
            return F.coalesce(code, F.lit(size))
        message = F.concat(F.lit(f"unseen value in {name}: "), F.coalesce(cell, F.lit("null")))
        return F.coalesce(code, F.raise_error(message).cast("int"))


class Scaling(Estimator, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Columns shifted and divided by the fitted table's mean and deviation, or minimum and range."""

    kind = Param(Params._dummy(), "kind", "standard or minmax", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCols: Sequence[str] = (), kind: str = "standard"):
        super().__init__()
        self._setDefault(inputCols=[], kind="standard")
        self._set(**{k: list(v) if k == "inputCols" else v for k, v in self._input_kwargs.items()})
        if kind not in ("standard", "minmax"):
            raise ValueError("kind is standard or minmax")

    def _fit(self, dataset: DataFrame) -> ScalingModel:
        columns = self.getOrDefault("inputCols")
        fit = encode.Scaler.standard if self.getOrDefault("kind") == "standard" else encode.Scaler.minmax
        scaler = fit(dataset, columns)
        rows = [(c, scaler.shift[c], scaler.divisor[c]) for c in columns]
        state = dataset.sparkSession.createDataFrame(rows, "column string, shift double, divisor double")
        return self._copyValues(ScalingModel(state))


class ScalingModel(StatefulModel, HasInputCols):
    """``state`` has a shift and a divisor for each column."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        rows = self._rows()
        scaler = encode.Scaler({r["column"]: r["shift"] for r in rows}, {r["column"]: r["divisor"] for r in rows})
        return scaler.apply(dataset)


class Selection(Estimator, HasInputCols, HasLabelCol, DefaultParamsReadable, DefaultParamsWritable):
    """Keeps those input columns whose correlation with the label exceeds the threshold, either way."""

    threshold = Param(Params._dummy(), "threshold", "least absolute correlation, exclusive", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, inputCols: Sequence[str] = (), labelCol: str = "label", threshold: float = fixed.CORRELATION_THRESHOLD):
        super().__init__()
        self._setDefault(inputCols=[], labelCol="label", threshold=fixed.CORRELATION_THRESHOLD)
        self._set(**{k: list(v) if k == "inputCols" else v for k, v in self._input_kwargs.items()})

    def _fit(self, dataset: DataFrame) -> SelectionModel:
        columns = self.getOrDefault("inputCols")
        found = encode.correlations(dataset, columns, self.getOrDefault("labelCol"))
        state = found.select(F.col("feature").alias("column"), "corr", F.coalesce(F.abs("corr") > self.getOrDefault("threshold"), F.lit(False)).alias("chosen"))
        return self._copyValues(SelectionModel(materialise(state, "selection")))


class SelectionModel(StatefulModel, HasInputCols, HasLabelCol):
    """``state`` has each column's correlation and whether it was chosen."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.drop(*[r["column"] for r in self._rows() if not r["chosen"]])
