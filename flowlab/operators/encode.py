"""Categorical encoding, scaling, feature selection, images.

Each fit is one aggregation whose result has a row per category or a row per column; the
apply step is then a projection.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlab import fixed
from flowlab.functions import vectors
from flowlab.operators.sample import number_sorted
from flowlab.session import SMALL_ROWS, small_or_none

# A category list longer than this becomes a table to join, not a literal in the plan.
LITERAL_CATEGORIES = 200
# One output column per category: beyond this a one-hot table needs ``layout="sparse"``.
ONE_HOT_CATEGORIES = 10_000
LAYOUTS = ("columns", "sparse")


def domain_table(column: str, *tables: DataFrame) -> DataFrame:
    """Distinct non-null values of a column over all tables."""
    parts = [t.select(column).filter(F.col(column).isNotNull()).distinct() for t in tables]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.union(part)
    return merged.distinct() if len(parts) > 1 else merged


def domains(columns: Sequence[str], *tables: DataFrame, limit: int) -> dict[str, list] | None:
    """Sorted distinct values of several columns, from one pass over each table.

    The columns are stacked before the distinct, so that all share one shuffle of at most
    one record per value and task. None if there are more than ``limit`` values.
    """
    if not columns:
        return {}
    stacked = [
        F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns
    ]
    merged = None
    for t in tables:
        pairs = t.select(F.explode(F.array(*stacked)).alias("p")).select("p.*")
        merged = pairs if merged is None else merged.union(pairs)
    rows = small_or_none(merged.filter("value is not null").distinct(), limit)
    if rows is None:
        return None
    found: dict[str, list] = {c: [] for c in columns}
    for row in rows:
        found[row["name"]].append(row["value"])
    return {c: sorted(values) for c, values in found.items()}


def one_hot(df: DataFrame, categories: Mapping[str, Sequence[str]]) -> DataFrame:
    """Replace each column by one 0/1 column per category, after the other columns."""
    kept = [c for c in df.columns if c not in categories]
    flags = [
        F.coalesce((F.col(c).cast("string") == v).cast("int"), F.lit(0)).alias(f"{c}_{v}")
        for c, values in categories.items()
        for v in values
    ]
    return df.select(*[F.col(f"`{c}`") for c in kept], *flags)


def one_hot_pair(
    train: DataFrame,
    test: DataFrame,
    columns: Sequence[str] = tuple(fixed.CATEGORICALS),
    domain: str = "union",
    layout: str = "columns",
) -> tuple[DataFrame, DataFrame]:
    """One-hot two sets over a shared domain: both sets' values, or the train set's.

    The layout is the caller's and does not change with the data: a column per value, or one
    sparse column (`one_hot_sparse`) for any number of values.
    """
    tables = (train, test) if domain == "union" else (train,)
    expand = one_hot_like(columns, *tables, layout=layout)
    return expand(train), expand(test)


def one_hot_self(df: DataFrame, columns: Sequence[str] = tuple(fixed.CATEGORICALS), layout: str = "columns") -> DataFrame:
    return one_hot_like(columns, df, layout=layout)(df)


def one_hot_like(columns: Sequence[str], *tables: DataFrame, layout: str = "columns") -> Callable[[DataFrame], DataFrame]:
    """The one-hot expansion over the values of all ``tables``.

    More than ONE_HOT_CATEGORIES values do not fit the layout of columns: that is an error.
    """
    if layout not in LAYOUTS:
        raise ValueError(f"layout is one of {LAYOUTS}")
    if layout == "columns":
        found = domains(columns, *tables, limit=ONE_HOT_CATEGORIES)
        if found is None:
            raise ValueError(f'more than {ONE_HOT_CATEGORIES} values for a column each; use layout="sparse"')
        return lambda df: one_hot(df, found)
    encoders = fit_ordinals(columns, *tables)
    sizes = [domain_table(c, *tables).count() for c in columns]
    return lambda df: one_hot_sparse(df, encoders, sizes)


def one_hot_sparse(df: DataFrame, encoders: Sequence[OrdinalEncoder], sizes: Sequence[int]) -> DataFrame:
    """Replace the encoders' columns by one column ``onehot``: its size and the places that hold 1.

    The places are those of the columns that `one_hot` would make; a missing or unseen
    value has none.
    """
    codes, offset, total = [], 0, sum(sizes)
    out = df
    for i, (encoder, size) in enumerate(zip(encoders, sizes, strict=True)):
        out = encoder.apply(out, f"_code_{i}")
        codes.append(F.col(f"_code_{i}") + offset)
        offset += size
    places = F.filter(F.array(*codes), lambda k: k.isNotNull())
    gone = {e.column for e in encoders}
    kept = [F.col(f"`{c}`") for c in df.columns if c not in gone]
    return out.select(*kept, F.struct(F.lit(total).alias("size"), places.alias("indices")).alias("onehot"))


@dataclass
class OrdinalEncoder:
    """Codes for one column: a value's rank among the sorted distinct values.

    Few values are held as a list. More become a broadcast table ``(value, code)``, and
    beyond `SMALL_ROWS` the table is numbered and joined without passing the driver.
    """

    column: str
    values: list | None
    table: DataFrame | None = None

    @classmethod
    def fit(cls, column: str, *tables: DataFrame) -> "OrdinalEncoder":
        found = domain_table(column, *tables)
        rows = small_or_none(found, SMALL_ROWS)
        if rows is not None:
            # Spark's own order, which puts NaN last, as on the path of many values.
            ordered = found.sparkSession.createDataFrame(rows, found.schema).orderBy(column).collect()
            return cls.of(found, column, [r[0] for r in ordered])
        ranked = number_sorted(found, [F.col(column)], "_code")
        return cls(column, None, ranked.withColumn("_code", F.col("_code") - 1))

    @classmethod
    def of(cls, df: DataFrame, column: str, values: list) -> "OrdinalEncoder":
        if len(values) <= LITERAL_CATEGORIES:
            return cls(column, values)
        dtype = df.schema[column].dataType
        schema = T.StructType(
            [T.StructField(column, dtype), T.StructField("_code", T.LongType())]
        )
        pairs = [(v, i) for i, v in enumerate(values)]
        return cls(column, None, F.broadcast(df.sparkSession.createDataFrame(pairs, schema)))

    def apply(self, df: DataFrame, target: str | None = None, unseen: str = "null") -> DataFrame:
        """Add the code. An unseen value gives null, or an error with ``unseen="error"``."""
        target = target or self.column
        source = F.col(self.column)
        if self.values is not None:
            pairs = [F.lit(x) for i, v in enumerate(self.values) for x in (v, i)]
            code = F.try_element_at(F.create_map(*pairs), source) if pairs else F.lit(None)
            joined = df
        else:
            side = self.table.select(
                F.col(self.column).alias("_value"), F.col("_code").cast("int").alias("_code")
            )
            joined = df.join(side, source == F.col("_value"), "left").drop("_value")
            code = F.col("_code")
        if unseen == "error":
            message = F.concat(
                F.lit(f"unseen label in {self.column}: "),
                F.coalesce(source.cast("string"), F.lit("null")),
            )
            code = F.coalesce(code, F.raise_error(message).cast("int"))
        return joined.withColumn(target, code.cast("int")).drop("_code")


def ordinal_pair(
    train: DataFrame,
    test: DataFrame,
    columns: Sequence[str] = tuple(fixed.CATEGORICALS),
    domain: str = "union",
) -> tuple[DataFrame, DataFrame]:
    """Ordinal-encode several columns of two sets over a shared domain."""
    tables = (train, test) if domain == "union" else (train,)
    for encoder in fit_ordinals(columns, *tables):
        train, test = encoder.apply(train), encoder.apply(test)
    return train, test


def fit_ordinals(columns: Sequence[str], *tables: DataFrame) -> list[OrdinalEncoder]:
    """One encoder per column; short string domains come from a single pass."""
    first = tables[0]
    if all(first.schema[c].dataType == T.StringType() for c in columns):
        found = domains(columns, *tables, limit=SMALL_ROWS)
        if found is not None:
            return [OrdinalEncoder.of(first, c, found[c]) for c in columns]
    return [OrdinalEncoder.fit(c, *tables) for c in columns]


def unseen_labels(train: DataFrame, test: DataFrame, label: str) -> DataFrame:
    """Labels of the test set that the train set lacks."""
    return domain_table(label, test).join(domain_table(label, train), label, "left_anti")


def encode_labels(
    train: DataFrame, test: DataFrame, label: str
) -> tuple[DataFrame, DataFrame, OrdinalEncoder]:
    """Compact labels to 0..k-1 by the train set; a label only the test set has is an error."""
    encoder = OrdinalEncoder.fit(label, train)
    if encoder.values is not None:
        known = F.col(label).isin(*encoder.values)
        unseen = test.filter(F.col(label).isNotNull() & ~known).select(label).distinct()
    else:
        unseen = unseen_labels(train, test, label)
    foreign = unseen.limit(20).collect()
    if foreign:
        names = ", ".join(sorted(str(r[0]) for r in foreign))
        raise ValueError(f"labels of the test set unknown to the train set: {names}")
    return encoder.apply(train), encoder.apply(test), encoder


@dataclass
class Scaler:
    """A per-column shift and divisor fitted on one table."""

    shift: dict[str, float]
    divisor: dict[str, float]

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str], low, spread) -> "Scaler":
        terms = []
        for i, c in enumerate(columns):
            x = F.col(f"`{c}`").cast("double")
            terms += [low(x).alias(f"low_{i}"), spread(x).alias(f"spread_{i}")]
        row = df.agg(*terms).first()
        shift = {c: row[f"low_{i}"] for i, c in enumerate(columns)}
        divisor = {c: row[f"spread_{i}"] for i, c in enumerate(columns)}
        return cls(shift, divisor)

    @classmethod
    def minmax(cls, df: DataFrame, columns: Sequence[str]) -> "Scaler":
        return cls.fit(df, columns, F.min, lambda x: F.max(x) - F.min(x))

    @classmethod
    def standard(cls, df: DataFrame, columns: Sequence[str]) -> "Scaler":
        return cls.fit(df, columns, F.avg, F.stddev_pop)

    def expression(self, column: str) -> Column:
        x = F.col(f"`{column}`").cast("double")
        spread = self.divisor[column]
        # A constant column has no spread: its train values become 0, others keep
        # their distance.
        return (x - F.lit(self.shift[column])) / F.lit(spread if spread else 1.0)

    def apply(self, df: DataFrame) -> DataFrame:
        return df.select(
            *[
                self.expression(c).alias(c) if c in self.shift else F.col(f"`{c}`")
                for c in df.columns
            ]
        )


def minmax_pair(
    train: DataFrame, test: DataFrame, columns: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    scaler = Scaler.minmax(train, columns)
    return scaler.apply(train), scaler.apply(test)


def standardise_pair(
    train: DataFrame, test: DataFrame, columns: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    scaler = Scaler.standard(train, columns)
    return scaler.apply(train), scaler.apply(test)


def correlations(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Pearson correlation of each feature with the label: one pass, one row per feature.

    Pairs with a missing side are left out. A constant column has no correlation (null).
    """
    y = F.col(label).cast("double")
    terms = []
    for i, c in enumerate(features):
        x = F.col(f"`{c}`").cast("double")
        both = x.isNotNull() & y.isNotNull()
        terms += [
            F.covar_pop(x, y).alias(f"xy_{i}"),
            F.stddev_pop(F.when(both, x)).alias(f"x_{i}"),
            F.stddev_pop(F.when(both, y)).alias(f"y_{i}"),
        ]
    moments = df.agg(*terms)
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                F.try_divide(F.col(f"xy_{i}"), F.col(f"x_{i}") * F.col(f"y_{i}")).alias("corr"),
            )
            for i, c in enumerate(features)
        ]
    )
    return moments.select(F.explode(rows).alias("r")).select("r.feature", "r.corr")


def select_features(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    threshold: float = fixed.CORRELATION_THRESHOLD,
) -> DataFrame:
    """Features whose absolute correlation with the label exceeds the threshold."""
    return correlations(df, features, label).filter(F.abs("corr") > threshold)


def project_selected(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    threshold: float = fixed.CORRELATION_THRESHOLD,
    keep: Sequence[str] = (),
) -> DataFrame:
    """The table with only the selected features and the label."""
    chosen = {r["feature"] for r in select_features(df, features, label, threshold).collect()}
    return df.select(*keep, *[c for c in features if c in chosen], label)


def image(df: DataFrame, source: str, target: str = "image") -> DataFrame:
    """A row of d features as its d x d Gramian angular field."""
    return df.withColumn(target, vectors.angular_field(vectors.doubles(F.col(source))))


def assemble(df: DataFrame, columns: Sequence[str], target: str = "features") -> DataFrame:
    """Features as 32-bit floats, the precision models are fed with, in one vector."""
    floats = F.array(*[F.col(f"`{c}`").cast(T.FloatType()).cast("double") for c in columns])
    return df.withColumn(target, array_to_vector(floats))
