"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: rows of a table that may be sent to every executor
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole input table; only Spark opens the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder in ``spark.checkpoint.dir``; a temporary one only where none is set and Spark runs in one process."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = sc.getConf().get("spark.checkpoint.dir", None)
    if shared is None:
        if not (sc.master or "").startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="spark-")
    sc.setCheckpointDir(shared)


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: computed once, kept in the shared folder, safe when executors are lost."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def few(df: DataFrame) -> DataFrame:
    """A hint to send a table to the executors, given only if it has few rows (it is counted)."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def freed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which a task's memory goes back to the system: Spark keeps its Python workers for later stages."""

    @wraps(run)
    def then_free(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return then_free


def give_back() -> None:
    """Memory that this process doesn't use goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order; null text has none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def parts_of(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about ``most`` bytes of a text or binary column, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = (np.cumsum(sizes) - sizes) // most
    starts = np.flatnonzero(np.diff(group, prepend=-1)) if len(group) else np.zeros(0, np.int64)
    for a, b in zip(starts, np.append(starts[1:], len(sizes)), strict=False):
        yield batch.slice(int(a), int(b - a))
