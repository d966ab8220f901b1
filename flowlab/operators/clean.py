"""Row and column cleaning, label mapping and column routing."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlab import fixed
from flowlab.functions import cells, vectors


def string_columns(df: DataFrame) -> list[str]:
    return [name for name, dtype in df.dtypes if dtype == "string"]


def blanks_to_null(df: DataFrame) -> DataFrame:
    return df.withColumns({c: cells.blank_to_null(F.col(c)) for c in string_columns(df)})


def drop_incomplete(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with a missing value (null or NaN) anywhere, or in ``subset``.

    One condition per column instead of ``dropna``: these reach the Parquet reader, and
    the optimizer handles them one by one, where a single condition over dozens of
    computed columns makes its constraint inference explode.
    """
    types = dict(df.dtypes)
    for c in subset or df.columns:
        df = df.filter(~cells.is_missing(F.col(f"`{c}`"), types[c]))
    return df


def is_incomplete(df: DataFrame) -> Column:
    """Whether any cell is missing (null or NaN)."""
    return reduce(lambda a, b: a | b, [cells.is_missing(F.col(f"`{c}`"), t) for c, t in df.dtypes])


def map_labels(
    df: DataFrame,
    source: str,
    target: str = "new_label",
    codes: Mapping[str, int] = fixed.ATTACK_CODES,
) -> DataFrame:
    """Trim a label, code it, and drop rows whose label has no code."""
    coded = df.withColumn(target, cells.label_code(cells.strip(F.col(source)), codes))
    return drop_incomplete(coded, [target]).drop(source)


def remove_classes(df: DataFrame, label: str, classes: Iterable[int]) -> DataFrame:
    return df.filter(~F.col(label).isin(*classes))


def keep_classes(df: DataFrame, label: str, classes: Iterable[int]) -> DataFrame:
    return df.filter(F.col(label).isin(*classes))


def feature_label(df: DataFrame, label: str, keep: Sequence[str] = ()) -> DataFrame:
    """Gather every numeric feature in one vector ``x`` beside the label."""
    features = [c for c in df.columns if c != label and c not in keep]
    return df.select(*keep, vector(features).alias("x"), F.col(label).alias("label"))


def vector(columns: Sequence[str]):
    return F.array(*[F.col(f"`{c}`").cast("double") for c in columns])


def semantic_groups(
    columns: Sequence[str],
    static: Sequence[str] = tuple(fixed.STATIC_FRAGMENTS),
    dynamic: Sequence[str] = tuple(fixed.DYNAMIC_FRAGMENTS),
) -> tuple[list[str], list[str]]:
    """Split names in two by the fragments they hold; a static fragment has precedence."""
    def holds(name: str, fragments: Sequence[str]) -> bool:
        return any(f in name for f in fragments)

    moving = [c for c in columns if holds(c, dynamic) and not holds(c, static)]
    return [c for c in columns if c not in moving], moving


def listed_groups(
    columns: Sequence[str],
    static: Sequence[str] = tuple(fixed.LISTED_STATIC),
    dynamic: Sequence[str] = tuple(fixed.LISTED_DYNAMIC),
) -> tuple[list[str], list[str]]:
    """Groups by explicit lists; unlisted columns follow the static ones."""
    rest = [c for c in columns if c not in static and c not in dynamic]
    return [*static, *rest], list(dynamic)


def group_columns(
    df: DataFrame, groups: tuple[Sequence[str], Sequence[str]], keep: Sequence[str] = ()
) -> DataFrame:
    static, dynamic = groups
    return df.select(
        *keep, vector(static).alias("x_static"), vector(dynamic).alias("x_dynamic")
    )


def concat_groups(df: DataFrame, target: str = "x") -> DataFrame:
    return df.withColumn(target, F.concat("x_static", "x_dynamic"))


def reorder_columns(
    df: DataFrame,
    label: str = "new_label",
    blocks: Sequence[Sequence[str]] = tuple(map(tuple, fixed.ORDER_BLOCKS)),
) -> DataFrame:
    """Bring related columns together: one block per fragment list, the rest, the label."""
    def block_of(name: str) -> int:
        return next(
            (i for i, block in enumerate(blocks) if any(f in name for f in block)), len(blocks)
        )

    features = sorted((c for c in df.columns if c != label), key=block_of)
    return df.select(*[F.col(f"`{c}`") for c in [*features, label]])


def reshape(df: DataFrame, source: str, rows: int, target: str = "x") -> DataFrame:
    """A vector as ``rows`` rows of equal width: a sequence, or a square image."""
    return df.withColumn(target, vectors.rows_of(F.col(source), rows))
