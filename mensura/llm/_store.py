"""Shared-folder helpers: lineage is cut only in spark.checkpoint.dir."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = 8 << 20


def bounded(df: DataFrame) -> DataFrame:
    """``df``, with the session's Arrow batches held to a few MB, which bounds what a Python worker and its JVM keep."""
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, "64m").lower().rstrip("b")
    size = int(now[:-1]) << {"k": 10, "m": 20, "g": 30}[now[-1]] if now[-1] in "kmg" else int(now)
    if not 0 < size <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    return df


def frugal(run):
    """An Arrow batch function that gives free memory back to the system when its task ends.

    Workers are reused by later stages, and what they keep counts against their executor.
    """

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # only where the C library can
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as named in spark.checkpoint.dir.

    Only where the setting is absent and the master is local a folder of the
    local machine is used; elsewhere the setting is required.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="mensura-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, so a lost executor costs no recomputation.

    It is read back from Parquet, not from an RDD checkpoint: a checkpoint hands on
    the constraints of the plan it replaces, and in loops these multiply.
    """
    return table(df, "cut")


def table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again; for wide or large intermediates."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


BROADCAST_ROWS = 1_000_000
SALTS = 32


def meet(
    rows: DataFrame, other: DataFrame, key: list[str], spread: str | list[str], how: str = "inner", most: int = BROADCAST_ROWS, stored: bool = False, *, bound: int | None = None
) -> DataFrame:
    """``rows`` joined with ``other``, which holds a row or few a key, so that a key with very many rows isn't one task's.

    ``other`` is sent to all tasks where it holds up to ``most`` rows, which a
    ``bound`` from a count of what it is made of can prove; else it is computed,
    unless it is ``stored``, and counted. Beyond that, rows of a key are dealt by
    the columns ``spread`` over SALTS parts, to each of which ``other`` is copied.
    """
    if bound is None or bound > most:
        other = other if stored else cut(other)
        bound = other.count()
    if bound <= most:
        return rows.join(F.broadcast(other), key, how)
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(*([spread] if isinstance(spread, str) else spread)), F.lit(SALTS)))
    copies = other.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(copies, [*key, "__salt"], how).drop("__salt")
