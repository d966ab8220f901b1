"""Parquet tables by name, as batch and as stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


FILES_PER_TRIGGER = 64


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether ``path``, on any store Spark reads, is a folder; a missing path is an error."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(place):
        raise FileNotFoundError(path)
    return store.getFileStatus(place).isDirectory()


def table_stream(
    spark: SparkSession, folder: str, name: str, files_per_trigger: int = FILES_PER_TRIGGER
) -> DataFrame:
    """The same table as a stream; the schema is the stored one, so nothing is inferred.

    A table is one file or a folder of part files. The files taken per trigger bound what
    one micro-batch can hold; no query's answer depends on them.
    """
    path = f"{folder}/{name}.parquet"
    reader = spark.readStream.schema(table(spark, folder, name).schema).option("maxFilesPerTrigger", files_per_trigger)
    if is_folder(spark, path):
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
