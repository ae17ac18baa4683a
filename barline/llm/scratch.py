"""Lineage cuts: tables written to the shared checkpoint folder, and read again; and memory that tasks give back.

A table that is written survives the loss of any executor, which a local checkpoint does not.
"""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; where that is unset, in a local session only, one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file://" + _own.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="barline-"))


def fresh(spark: SparkSession, what: str) -> str:
    """A path below the shared folder that nothing uses yet."""
    return f"{folder(spark)}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame, what: str = "cut") -> DataFrame:
    """df, computed once and read from the shared folder from now on."""
    path = fresh(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets the driver forget the shuffles of jobs that are over, so that their files go before the next ones come."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Places of the bit map of among().
PLACES = 1 << 23


def among(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """The rows of df whose column may be in the first column of keys: all that are, and few others as long as the keys are
    far fewer than PLACES. The bit map that is broadcast has at most PLACES / 64 rows whatever the input."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(PLACES))
    bit = lambda c: F.expr(f"shiftleft(1L, cast({c} % 64 AS int))")
    words = keys.select(place(F.col(keys.columns[0])).alias("_at")).groupBy(F.expr("_at DIV 64").alias("_word")).agg(F.bit_or(bit("_at")).alias("_bits"))
    placed = df.withColumn("_at", place(F.col(column))).join(F.broadcast(cut(words, "bits")), F.expr("_at DIV 64") == F.col("_word"))
    return placed.where(F.col("_bits").bitwiseAND(bit("_at")) != 0).select(*df.columns)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, which gives the memory that it freed back to the system at its end: Spark keeps its worker for other tasks."""

    def tidied(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
            if trim:
                trim(0)

    return tidied
