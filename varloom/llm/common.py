"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import re
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII letters, the only ones that "lower-case A-Z" touches.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share.

    Only where the session names none and runs on one machine (tests) is a temporary folder set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="varloom-shared-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """df written once as Parquet (with the writer's options) in the shared folder and read back: lineage ends there, any executor can reread it."""
    path = f"{shared_dir(df.sparkSession)}/varloom-{name}-{uuid.uuid4().hex}"
    df.write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of a small table (labels, factors, counts)."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def release() -> None:
    """Gives memory that is free in this Python worker back to the system. Workers live on from stage to stage, and what a batch of
    long texts has taken would else stay with them while the next stage's JVM and tables grow."""
    pa.default_memory_pool().release_unused()
    if sys.platform.startswith("linux"):
        with contextlib.suppress(OSError, AttributeError):  # another C library
            ctypes.CDLL("libc.so.6").malloc_trim(0)


def releasing(fn: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over batches that gives its memory back after each batch and at its end."""

    def run(batches: Iterator) -> Iterator:
        try:
            for out in fn(batches):
                yield out
                del out
                release()
        finally:
            release()

    return run


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo `by`; NULL for a NULL id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(by)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone; NULL counts as the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def shingle_hashes(words: Column, size: int) -> Column:
    """The hash of the `size` words from each place on, from those of its words; the last size - 1 places hold no shingle."""
    each = lambda v: F.transform(v, lambda x, i: F.xxhash64(x, *[F.get(v, i + j) for j in range(1, size)]))
    # An array of one, so that the words are hashed once however the expression is moved.
    return F.get(F.transform(F.array(F.transform(words, lambda x: F.xxhash64(x))), each), 0)


def first_by_hash(df: DataFrame, key: str, id_col: str, n: int) -> DataFrame:
    """At most n rows per value of column key, those with the smallest xxhash64 of their id: a bounded sample that does not
    depend on the partitioning. ids must be distinct within a key.

    Counts first give each key a hash below which a little over n of its rows lie; only those hashes are gathered, so a key
    that holds most rows is never ranked whole, and no key's list is longer than about 1.25 n.
    """
    rows = df.withColumn("__h", F.xxhash64(F.col(id_col)))
    share = F.least(F.lit(1.0), F.lit(1.25 * n + 100) / F.count("*"))
    counts = rows.groupBy(F.col(key).alias("__key")).agg((share * F.lit(2.0**64) - F.lit(2.0**63)).alias("__most"))
    few = rows.join(counts, F.col(key) == F.col("__key")).where(F.col("__h") <= F.col("__most")).drop("__key", "__most")
    last = few.groupBy(F.col(key).alias("__key")).agg(F.get(F.sort_array(F.collect_list("__h")), F.lit(n - 1)).alias("__last"))
    return few.join(last, F.col(key) == F.col("__key")).where("__last IS NULL OR __h <= __last").drop("__key", "__last", "__h")
