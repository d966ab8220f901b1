"""A class-balanced replay buffer over a stream."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from flowlab import fixed
from flowlab.operators.sample import replay_first
from flowlab.streaming.drift import AVAILABLE, drop_step, step_path

SHARDS = 16


def admit(
    rows: DataFrame,
    label: str,
    order: list[str],
    per_class: int = fixed.REPLAY_PER_CLASS,
    shards: int = SHARDS,
) -> DataFrame:
    """Rows of a stream that may belong to the buffer by order of arrival.

    Each class is dealt over ``shards`` keys by a hash of ``order``, so a dominant class
    is not one task's. A shard admits its first ``per_class`` rows and then nothing; its
    state is one count. A row among the first of its class is among the first of its
    shard, so `buffer` over what was admitted is exact.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField("arrived", T.TimestampType())])
    names = rows.columns

    def update(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count = state.get[0] if state.exists else 0
        room = per_class - count
        best = None
        for chunk in chunks:
            if room <= 0:
                continue
            best = chunk if best is None else pd.concat([best, chunk])
            best = best.sort_values(order).head(room)
        if best is not None and len(best):
            state.update((count + len(best),))
            yield best[[*names, "arrived"]]

    return (
        rows.withColumn("arrived", F.current_timestamp())
        .withColumn("_class", F.col(label).cast("string"))
        .withColumn("_shard", F.pmod(F.xxhash64(*order), F.lit(shards)).cast("int"))
        .groupBy("_class", "_shard")
        .applyInPandasWithState(
            update, schema, "taken long", "append", GroupStateTimeout.NoTimeout
        )
    )


def keep_first(
    rows: DataFrame,
    label: str,
    order: list[str],
    out: str,
    checkpoint: str,
    per_class: int = fixed.REPLAY_PER_CLASS,
    trigger: Mapping[str, object] = AVAILABLE,
) -> StreamingQuery:
    """Start a query that keeps the first rows of each class by ``order``, whenever they arrive.

    Every micro-batch merges its own first rows with the buffer of the batches before it, and
    writes the new buffer under its number; `latest` reads the last one. A batch reads the one
    buffer before it, also when it runs again; older ones are removed.
    """
    spark = rows.sparkSession
    spark.createDataFrame([], rows.schema).write.mode("overwrite").parquet(f"{out}/buffer/batch=-1")

    def act(batch: DataFrame, number: int) -> None:
        before = spark.read.schema(rows.schema).parquet(step_path(out, "buffer", number - 1))
        first = replay_first(batch.select(*rows.columns), label, order, per_class)
        merged = before.select(*rows.columns).union(first.select(*rows.columns))
        replay_first(merged, label, order, per_class).write.mode("overwrite").parquet(step_path(out, "buffer", number))
        drop_step(spark, out, "buffer", number - 2)

    return rows.writeStream.foreachBatch(act).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def latest(spark: SparkSession, out: str, schema: T.StructType) -> DataFrame:
    """The buffer after the last batch written at ``out``."""
    every = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{out}/buffer")
    last = every.agg(F.max("batch")).first()[0]
    return every.filter(F.col("batch") == last).drop("batch") if last is not None else every.drop("batch")


def buffer(
    admitted: DataFrame, label: str, order: list[str], per_class: int = fixed.REPLAY_PER_CLASS
) -> DataFrame:
    """The first rows of each class to arrive; a micro-batch arrives in ``order``."""
    return replay_first(admitted, label, ["arrived", *order], per_class).drop("arrived")
