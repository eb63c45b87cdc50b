"""Ordered numbering and prefix sums that no single task has to do alone."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_LOCAL = (1 << 33) - 1


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir (a temporary folder only where the session names none on one machine), which all executors reach."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="varloom-"))
    return f"{sc.getCheckpointDir()}/varloom-{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    shared_path(df.sparkSession, "checkpoint")
    return df.checkpoint()


def numbered(df: DataFrame, order: list[Column], name: str = "n") -> DataFrame:
    """df with a global 0-based position in the given order, which must be total for a defined result.

    Rows are range-partitioned and sorted; each partition's count gives the next one's offset. Only one small row a
    partition meets in one place, so a table of any size can be numbered without a one-task window.
    """
    at = F.monotonically_increasing_id()
    rows = settled(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", at))
    sizes = rows.groupBy(F.shiftright("__at", 33).alias("__p")).agg(F.count("*").alias("__c"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__p", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__o"))
    joined = rows.withColumn("__p", F.shiftright("__at", 33)).join(F.broadcast(offsets), "__p")
    return joined.withColumn(name, F.col("__o") + F.col("__at").bitwiseAND(F.lit(_LOCAL))).drop("__p", "__o", "__at")


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """df with running sums (new name to column) along a total order: inside range partitions, plus their offsets."""
    rows = settled(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()))
    totals = rows.groupBy("__p").agg(*[F.sum(c).alias(f"__t_{n}") for n, c in sums.items()])
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__p", *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__o_{n}") for n in sums])
    inside = Window.partitionBy("__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.join(F.broadcast(offsets), "__p")
    out = joined.withColumns({n: F.sum(c).over(inside) + F.col(f"__o_{n}") for n, c in sums.items()})
    return out.drop("__p", *[f"__o_{n}" for n in sums])


def grouped_positions(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys..., value, n, upto, total): each distinct value of a group with its rows, those up to it, and all of the group's.

    Running sums over all groups in one order, less where each group begins: a group of any size is never sorted in one task
    or held in memory."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    sums = running_sums(counts, [F.col(k) for k in [*keys, value]], {"__upto": "n"})
    groups = sums.groupBy(*keys).agg(F.min(F.col("__upto") - F.col("n")).alias("__start"), F.sum("n").alias("total"))
    return sums.join(groups, keys).select(*keys, value, "n", (F.col("__upto") - F.col("__start")).alias("upto"), "total")


def draw(key: Column, seed: str) -> Column:
    """A uniform number in [0, 1) from the md5 of key and seed; the same on every engine and partitioning."""
    text = F.concat(key.cast("string"), F.lit(":" + seed))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
