"""CSV and Parquet input and output of flow tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlab import fixed
from flowlab.sources import infer

_TYPES = {"string": T.StringType(), "double": T.DoubleType(), "long": T.LongType(), "int": T.IntegerType()}

PREPARED_SCHEMA = T.StructType(
    [T.StructField(c, _TYPES[t]) for c, t in fixed.FEATURE_TYPES.items()]
    + [T.StructField("new_label", T.IntegerType())]
)
RAW_SCHEMA = T.StructType(
    [T.StructField("id", T.IntegerType()), *PREPARED_SCHEMA.fields[:-1],
     T.StructField("attack_cat", T.StringType()), T.StructField("label", T.IntegerType())]
)

# File stem per mode.
MODE_FILES = {"multi": "processed", "binary": "binary"}


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    na_tokens: Sequence[str] = tuple(fixed.NA_TOKENS),
    multi_line: bool = False,
    escaped_breaks: bool = True,
) -> DataFrame:
    """A CSV file with header. Cells holding a missing-value token become null.

    Without a schema the types are those that all cells of all files allow (`infer.infer_types`,
    one more pass), and blank cells are missing; the files' headers must agree.
    Columns are read as text and then cast by the schema, so a token never
    fails a numeric column, while other malformed numbers do. A line with a field too many
    or too few is an error. Text columns have the line breaks that `write_csv` escapes;
    ``escaped_breaks=False`` takes backslashes as they are. ``multi_line`` admits
    unescaped line breaks within quotes, at the price of one task per file.
    """
    inferred = schema is None
    if inferred:
        names = spark.read.options(header=True, escape='"', multiLine=multi_line).csv(path).columns
        raw = _text_table(spark, path, names, multi_line)
        schema = infer.schema_of(infer.infer_types(raw, na_tokens))
    else:
        raw = _text_table(spark, path, [f.name for f in schema], multi_line)

    def cell(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        known = infer.known(c, na_tokens) if inferred else F.when(~c.isin(*na_tokens), c)
        if inferred and f.dataType != T.StringType():
            known = F.trim(known)
        return _unescaped(known) if escaped_breaks and f.dataType == T.StringType() else known.cast(f.dataType)

    return raw.select(*[cell(f).alias(f.name) for f in schema])


def _text_table(spark: SparkSession, path: str, names: Sequence[str], multi_line: bool) -> DataFrame:
    """All cells as text. A header of other names, or a line of another width, is an error."""
    text = T.StructType([T.StructField(name, T.StringType()) for name in names])
    options = {"header": True, "enforceSchema": False, "escape": '"', "multiLine": multi_line, "mode": "FAILFAST", "columnPruning": False}
    return spark.read.schema(text).options(**options).csv(path)


def csv_types(spark: SparkSession, path: str, na_tokens: Sequence[str] = tuple(fixed.NA_TOKENS)) -> DataFrame:
    """(column, type, width, missing) of a CSV file with header, as `read_csv` without a schema finds them."""
    names = spark.read.options(header=True, escape='"').csv(path).columns
    raw = _text_table(spark, path, names, False)
    return infer.report(raw, infer.infer_types(raw, na_tokens))


def _escaped(c: Column) -> Column:
    """Backslashes doubled, line breaks as backslash and letter."""
    for plain, written in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r")):
        c = F.replace(c, F.lit(plain), F.lit(written))
    return c


def _unescaped(c: Column) -> Column:
    """Between doubled backslashes, a backslash begins a line break."""
    breaks = lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r"))
    return F.array_join(F.transform(F.split(c, r"\\\\"), breaks), "\\")


def mode_path(folder: str, split: str, mode: str) -> str:
    return f"{folder}/{split}_{MODE_FILES[fixed.check_mode(mode)]}.csv"


def read_mode(
    spark: SparkSession, folder: str, split: str, mode: str, schema: T.StructType = PREPARED_SCHEMA
) -> DataFrame:
    """The prepared train or test set of a mode."""
    return read_csv(spark, mode_path(folder, split, mode), schema)


def described_schema(
    description: DataFrame,
    name: str = "Name",
    kind: str = "Type",
    number: str = "No.",
    types: Mapping[str, str] | None = None,
) -> T.StructType:
    """A schema from a feature-description table of at most a few hundred rows.

    Columns follow the description's numbering, if it has one.
    """
    types = types or {
        "nominal": "string", "integer": "long", "float": "double", "timestamp": "long", "binary": "int",
    }
    if number in description.columns:
        description = description.orderBy(F.col(f"`{number}`").cast("int"))
    rows = description.select(F.trim(name).alias("n"), F.lower(F.trim(kind)).alias("k")).collect()
    return T.StructType(
        [T.StructField(r["n"].lower(), _TYPES[types.get(r["k"], "string")]) for r in rows]
    )


def read_described(spark: SparkSession, data: str, description: str) -> tuple[DataFrame, DataFrame]:
    """A data file typed by its feature-description file, and that description."""
    features = spark.read.option("header", True).csv(description)
    return read_csv(spark, data, described_schema(features)), features


def write_csv(df: DataFrame, path: str) -> None:
    """Header, no index, quotes doubled, white space kept, line breaks escaped so that files stay splittable."""
    texts = {f.name: _escaped(F.col(f"`{f.name}`")) for f in df.schema if f.dataType == T.StringType()}
    df.withColumns(texts).write.mode("overwrite").options(
        header=True, emptyValue="", escape='"',
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    ).csv(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def source_status(spark: SparkSession, path: str, reader=None) -> DataFrame:
    """One row saying whether a source can be read, instead of a failure."""
    reader = reader or (lambda p: spark.read.parquet(p))
    try:
        reader(path)
        status = "found"
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        status = "missing"
    return spark.createDataFrame([(path, status)], "path string, status string")
