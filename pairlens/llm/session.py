"""Shared-folder checkpoints and sizes for the operators of this subpackage."""

from __future__ import annotations

import ctypes
import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import _powers

#: Bytes of an Arrow batch between the JVM and a Python worker.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Only a local session without the setting gets a temporary one."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None:
        if sc.master.startswith("local[") or sc.master == "local":
            named = tempfile.mkdtemp(prefix="pairlens-")
        else:
            named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and go on from there, so that lost executors cost no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bound_batches(spark: SparkSession) -> None:
    """Cap Arrow batches at BATCH_BYTES for this session, if it allows more: both ends of the pipe hold whole batches, and a text column may be long."""
    now = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    if not now.rstrip("bB").isdigit() or not 0 < int(now.rstrip("bB")) <= BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def text_bytes(df: DataFrame, text_col: str) -> tuple[int, int]:
    """(rows, UTF-8 bytes of the texts)."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.col(text_col))).alias("b")).first()
    return row["n"], row["b"] or 0


def release() -> None:
    """Give freed memory and kept tables back to the system: Python workers live on to serve other tasks, beside a JVM that keeps its heap."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run):
    """A mapInArrow function that releases when it ends."""

    def wrapped(batches):
        yield from run(batches)
        release()

    return wrapped


def tidy_group(run):
    """A function of (key, rows) for applyInArrow that releases after each group."""

    def wrapped(key, rows):
        out = run(key, rows)
        release()
        return out

    return wrapped


def tidy_cogroup(run):
    """A function of (key, left, right) for applyInArrow on a cogroup that releases after each group."""

    def wrapped(key, left, right):
        out = run(key, left, right)
        release()
        return out

    return wrapped
