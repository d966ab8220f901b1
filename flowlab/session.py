"""Session set-up, shared working folder and size-checked small tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SMALL_ROWS = 100_000
SMALL_BYTES = 32 << 20


def build_session(master: str | None = None, app: str = "flowlab", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written tables.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session, whose
    executors share the driver's disk, gets a folder of its own.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = context.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="flowlab-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named.rstrip("/")


_SCOPES: list[str] = []


@contextmanager
def working_tables(spark: SparkSession) -> Iterator[None]:
    """Drop at the end what operators write to the shared folder meanwhile.

    Results must be written elsewhere before: a DataFrame that reads a dropped table fails.
    """
    path = f"{work_dir(spark)}/flowlab/scope-{uuid.uuid4().hex}"
    _SCOPES.append(path)
    try:
        yield
    finally:
        _SCOPES.remove(path)
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def fresh_path(spark: SparkSession, name: str) -> str:
    folder = _SCOPES[-1] if _SCOPES else f"{work_dir(spark)}/flowlab"
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage and, unlike a checkpoint, leaves a columnar table, so that later
    passes over a few columns read only those.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _is_small(df: DataFrame, limit: int) -> tuple[DataFrame, bool]:
    """``df`` written, and whether it has at most ``limit`` rows and SMALL_BYTES.

    Its size is asked of Spark before any row passes the driver.
    """
    written = materialise(df, "settled")
    size = F.coalesce(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))), F.lit(0))
    rows, size = written.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return written, rows <= limit and size <= SMALL_BYTES


def small_or_none(df: DataFrame, limit: int = SMALL_ROWS) -> list | None:
    """The rows of ``df`` if there are at most ``limit`` and SMALL_BYTES of them, else None."""
    written, small = _is_small(df, limit)
    return written.collect() if small else None


def settle(df: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """Evaluate a table that is expected to be small and mark it for broadcast.

    Beyond ``limit`` rows or SMALL_BYTES it is joined by whatever strategy its size calls for.
    """
    written, small = _is_small(df, limit)
    if not small:
        return written
    return F.broadcast(df.sparkSession.createDataFrame(written.toArrow(), df.schema))
