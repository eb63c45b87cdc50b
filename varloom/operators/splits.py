"""Folds, splits, weights and resampling, all by reproducible draws."""

from __future__ import annotations

from math import ceil, floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.operators.base import draw, numbered


def folds(df: DataFrame, order: list[Column], size: int | None = None, share: float = 0.1) -> DataFrame:
    """df with fold: tumbling folds by position; a tail shorter than a fold is dropped. Fold size 0 is an error."""
    n = df.count()
    size = size if size is not None else max(1, floor(share * n))
    if size <= 0:
        raise ValueError("fold size must be positive")
    size = min(size, max(1, n))
    return numbered(df, order, "__n").withColumn("fold", F.floor(F.col("__n") / F.lit(size))).where(F.col("fold") < n // size).drop("__n")


def chunks(df: DataFrame, order: list[Column], size: int) -> DataFrame:
    return numbered(df, order, "__n").withColumn("chunk", F.floor(F.col("__n") / F.lit(size))).drop("__n")


def split(df: DataFrame, key: str, ratio: float, seed: str = "split", rounding=ceil) -> DataFrame:
    """df with dataset train or test, test being exactly rounding(ratio x n) rows, those with the smallest draws."""
    size = rounding(ratio * df.count())
    rows = numbered(df.withColumn("__u", draw(F.col(key), seed)), [F.col("__u"), F.col(key)], "__n")
    return rows.withColumn("dataset", F.when(F.col("__n") < size, "test").otherwise("train")).drop("__u", "__n")


def split_by_source(df: DataFrame, key: str, origin: str, ratio: float, seed: str = "source") -> DataFrame:
    """Rows of TRAIN and TEST origin are pinned; rows of BOTH fill test up to ceil(ratio x n), then train."""
    if ratio > 0.5:
        raise ValueError("test ratio above one half")
    got = df.agg(F.count("*").alias("n"), F.count_if(F.col(origin) == "TEST").alias("t")).first()
    room = max(0, ceil(ratio * got["n"]) - got["t"])
    both = numbered(df.where(F.col(origin) == "BOTH").withColumn("__u", draw(F.col(key), seed)), [F.col("__u"), F.col(key)], "__n")
    both = both.withColumn("dataset", F.when(F.col("__n") < room, "test").otherwise("train")).drop("__u", "__n")
    return df.where(F.col(origin) != "BOTH").withColumn("dataset", F.lower(origin)).unionByName(both)


def class_balance(df: DataFrame, label: Column) -> DataFrame:
    """One row: counts, bias ln(n+ / n-) and balanced weights; a class without rows is an error."""
    got = df.agg(F.count_if(label == 1).alias("n_pos"), F.count_if(label == 0).alias("n_neg"))
    none = (F.col("n_pos") == 0) | (F.col("n_neg") == 0)
    checked = lambda x: F.when(none, F.raise_error(F.lit("a class has no rows")).cast("double")).otherwise(x)
    n = F.col("n_pos") + F.col("n_neg")
    return got.withColumns({"n": n, "bias": checked(F.ln(F.col("n_pos") / F.col("n_neg"))), "w_pos": checked(n / (2 * F.col("n_pos"))), "w_neg": checked(n / (2 * F.col("n_neg")))})


def dropout(df: DataFrame, key: str, label: str, features: dict[str, object], p: float, value: int = 1) -> DataFrame:
    """Features of rows of one label replaced by their fill value with probability p, each feature with a seed of its own."""
    return df.withColumns({f: F.when((F.col(label) == value) & (draw(F.col(key), f"drop-{f}") < p), F.lit(fill)).otherwise(F.col(f)) for f, fill in features.items()})


def resample(df: DataFrame, key: str, label: str, positive_share: float, seed: str = "resample") -> DataFrame:
    """Rows kept so that the two classes stand in the asked ratio; the class in short supply is kept whole."""
    n = df.agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n")).first()
    want = {1: positive_share / max(1, n["p"]), 0: (1 - positive_share) / max(1, n["n"])}
    most = max(want.values())
    keep = F.when(F.col(label) == 1, F.lit(want[1] / most)).otherwise(F.lit(want[0] / most))
    return df.where(draw(F.col(key), seed) < keep)


def interleave(df: DataFrame, key: str, label: str, share: float, seed: str = "interleave", repeats: int | None = None) -> DataFrame:
    """(t, key, label, copy): one stream of two class streams. Draw t takes the next row of class 1 with probability share, else of class 0; the first
    draw that meets an exhausted class ends the stream.

    Each class stream is shuffled; that of class 1 is repeated max(1, (n - p) // p) times, or `repeats` times, shuffled anew each time. Draws
    are md5 numbers of t. A draw's place in its class is the number of draws of that class before it, by numbering in range
    partitions, so that streams of any length are merged by one equi-join. A class without rows ends the stream at its first draw; NULL labels are left out.
    """
    rows = df.where(F.col(label).isin(0, 1)).select(F.col(key).alias("__id"), F.col(label).cast("int").alias("__y"))
    n = rows.agg(F.count_if(F.col("__y") == 1).alias("p"), F.count_if(F.col("__y") == 0).alias("n")).first()
    times = repeats if repeats is not None else max(1, (n["n"] - n["p"]) // max(1, n["p"]))
    copies = F.when(F.col("__y") == 1, F.sequence(F.lit(0), F.lit(times - 1))).otherwise(F.array(F.lit(0)))
    stream = rows.select("__id", "__y", F.explode(copies).alias("copy")).withColumn("__u", draw(F.concat_ws("-", F.col("__id").cast("string"), F.col("copy").cast("string")), seed))
    order = [F.col("copy"), F.col("__u"), F.col("__id")]
    size = {1: times * n["p"], 0: n["n"]}
    draws = df.sparkSession.range(size[0] + size[1] + 1).select(F.col("id").alias("t"), (draw(F.col("id"), f"{seed}-class") < share).cast("int").alias("__y"))
    placed, asked = None, None
    for y in (0, 1):
        mine, wanted = numbered(stream.where(F.col("__y") == y), order, "__place"), numbered(draws.where(F.col("__y") == y), [F.col("t")], "__place")
        placed, asked = (mine, wanted) if placed is None else (placed.unionByName(mine), asked.unionByName(wanted))
    end = asked.where(F.col("__place") >= F.when(F.col("__y") == 1, size[1]).otherwise(size[0])).agg(F.min("t").alias("__end"))
    live = asked.crossJoin(F.broadcast(end)).where("__end IS NULL OR t < __end")  # one row
    return live.join(placed, ["__y", "__place"]).select("t", F.col("__id").alias(key), F.col("__y").alias(label), "copy")


def variant_weight(label: Column, frequencies: list[Column], rare: float = 800.0, common: float = 1600.0, limit: float = 1 / 2000) -> Column:
    """800 for rare causative rows (mean frequency at most the limit), 1600 for common benign ones, else 1."""
    mean = sum((F.coalesce(f, F.lit(0.0)) for f in frequencies[1:]), F.coalesce(frequencies[0], F.lit(0.0))) / len(frequencies)
    first = F.when((label == 1) & (mean <= limit), F.lit(rare)).otherwise(F.lit(1.0))
    return first * F.when((label == 0) & (F.coalesce(frequencies[0], F.lit(0.0)) >= limit), F.lit(common)).otherwise(F.lit(1.0))
