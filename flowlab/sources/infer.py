"""Column types of text tables, found from every cell.

Each cell has a kind, and a column the set of its cells' kinds, kept as bits. Such sets merge by
union, so they are one aggregation over the table with partial results per task, and what a
column becomes depends on the set alone: not on the order of rows or files, nor on a sample.

    missing < boolean                 < text
    missing < long < double           < text
    missing < timestamp               < text
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlab import fixed
from flowlab.functions.cells import blank_to_null

BOOLEAN, LONG, DOUBLE, TIMESTAMP, TEXT = 1, 2, 4, 8, 16

#: Whole numbers of more digits are not all doubles of their own.
EXACT_DIGITS = 15

_LONG = r"^[+-]?[0-9]{1,19}$"
_DOUBLE = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?([iI]nf|[iI]nfinity)$"
_TIMESTAMP = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,6})?)?)?$"

REPORT_SCHEMA = "column string, type string, width int, missing long"


def known(c: Column, na_tokens: Sequence[str]) -> Column:
    """A cell without the tokens for missing values; blank cells are missing too."""
    return blank_to_null(F.when(~c.isin(*na_tokens), c))


def kind(c: Column) -> Column:
    """The kind of a known cell, null for a missing one."""
    plain = F.trim(c)
    return (
        F.when(c.isNull(), F.lit(None))
        .when(F.lower(plain).isin("true", "false"), BOOLEAN)
        .when(plain.rlike(_LONG) & plain.try_cast("long").isNotNull(), LONG)
        # A whole number too long to be one stays as it is written.
        .when(plain.rlike(r"^[+-]?[0-9]+$"), TEXT)
        .when(plain.rlike(_DOUBLE), DOUBLE)
        .when(plain.rlike(_TIMESTAMP) & F.try_to_timestamp(plain).isNotNull(), TIMESTAMP)
        .otherwise(TEXT)
    )


def type_of(kinds: int | None, digits: int | None) -> T.DataType:
    """The least type that holds all of a column's kinds; a column of missing cells is text."""
    kinds = kinds or 0
    if kinds == BOOLEAN:
        return T.BooleanType()
    if kinds == LONG:
        return T.LongType()
    if kinds == DOUBLE or (kinds == LONG | DOUBLE and (digits or 0) <= EXACT_DIGITS):
        return T.DoubleType()
    if kinds == TIMESTAMP:
        return T.TimestampType()
    return T.StringType()


def infer_types(cells: DataFrame, na_tokens: Sequence[str] = tuple(fixed.NA_TOKENS)) -> list[tuple[str, T.DataType, int, int]]:
    """(column, type, width, missing) of each column of a table of text, from one pass over it.

    ``width`` is the longest known cell's number of characters, ``missing`` the number of
    missing cells. Only these few numbers per column reach the driver.
    """
    terms = []
    for i, name in enumerate(cells.columns):
        cell = known(F.col(f"`{name}`"), na_tokens)
        what = kind(cell)
        digits = F.when(what == LONG, F.length(F.regexp_replace(F.trim(cell), r"^[+-]?0*", "")))
        terms += [
            F.bit_or(what).alias(f"kinds_{i}"),
            F.max(digits).alias(f"digits_{i}"),
            F.max(F.length(cell)).alias(f"width_{i}"),
            F.count_if(cell.isNull()).alias(f"missing_{i}"),
        ]
    if not terms:
        return []
    row = cells.agg(*terms).first()
    return [
        (name, type_of(row[f"kinds_{i}"], row[f"digits_{i}"]), row[f"width_{i}"] or 0, row[f"missing_{i}"])
        for i, name in enumerate(cells.columns)
    ]


def schema_of(types: Sequence[tuple[str, T.DataType, int, int]]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype, _, _ in types])


def report(df: DataFrame, types: Sequence[tuple[str, T.DataType, int, int]]) -> DataFrame:
    """The columns' types, widths and missing cells as a table, in the order of columns."""
    rows = [(name, dtype.simpleString(), width, missing) for name, dtype, width, missing in types]
    return df.sparkSession.createDataFrame(rows, REPORT_SCHEMA)
