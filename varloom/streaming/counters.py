"""Incremental confusion counters: the same query over a table and over a stream of its files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.functions import metrics as M
from varloom.operators.base import shared_path

CUT = 0.1


def _counters(events: DataFrame, every: str) -> DataFrame:
    rows = events.select(F.col("ts"), F.when(F.col("value") / 500.0 >= CUT, 1).otherwise(0).alias("pred"), F.when(F.col("event_type") == "error", 1).otherwise(0).alias("label"))
    grouped = rows.groupBy(F.window("ts", every).alias("w")).agg(*M.confusion(F.col("pred"), F.col("label")))
    return grouped.select(F.date_format("w.start", "yyyy-MM-dd").alias("epoch"), "tp", "tn", "fp", "fn")


def batch_counters(events: DataFrame, every: str = "1 day") -> DataFrame:
    """(epoch, tp, tn, fp, fn) for each tumbling window."""
    return _counters(events, every)


def stream_counters(spark: SparkSession, path: str, schema, every: str = "1 day", lateness: str = "2 days") -> DataFrame:
    """The same counters over a stream of event files: late events within `lateness` still count, a new window starts at
    nought, and the watermark bounds what is kept."""
    events = spark.readStream.schema(schema).parquet(path).withWatermark("ts", lateness)
    return _counters(events, every)


def drained_counters(spark: SparkSession, path: str, every: str = "1 day", lateness: str = "400 days", files: int = 4) -> DataFrame:
    """The counters of all events that are there now, by the stream: a few files a micro-batch, a checkpoint in the shared folder, each update
    of a window written by its batch, and the last one of each window read back.

    A window is updated while the watermark keeps it; later events would be dropped, so `lateness` spans what the files may hold in
    any order. State is one row a window.
    """
    schema = spark.read.parquet(path).schema
    sink, mark = shared_path(spark, "counters"), shared_path(spark, "counters-checkpoint")
    one = f"{path[:-1]}[{path[-1]}]"  # as a pattern, the source also takes a table that is a single file
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(one).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)

    def keep(batch: DataFrame, n: int) -> None:
        batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{sink}/run={n}")

    _counters(events, every).writeStream.outputMode("update").option("checkpointLocation", mark).trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    rows = spark.read.schema("epoch string, tp long, tn long, fp long, fn long, batch int").parquet(f"{sink}/run=*")
    last = F.max(F.struct("batch", "tp", "tn", "fp", "fn")).alias("last")
    return rows.groupBy("epoch").agg(last).select("epoch", *[F.col("last")[c].alias(c) for c in ("tp", "tn", "fp", "fn")])
