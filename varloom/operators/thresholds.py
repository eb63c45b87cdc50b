"""Threshold sweeps, ROC curves and operating points, each in one pass over the scores."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varloom.functions import metrics as M
from varloom.operators.base import running_sums

CELLS = ("tp", "tn", "fp", "fn")


def sweep(df: DataFrame, score: Column, label: Column, thresholds: list[float] | Column, by: list[str] | None = None) -> DataFrame:
    """(by..., i, threshold, tp, tn, fp, fn) with a row for every threshold; a row is positive if score >= threshold.

    Each score is counted once, in the bucket of how many thresholds it reaches; sums from the top down over the few
    buckets give every threshold's matrix. NULL scores and labels are left out.
    """
    by = by or []
    steps = F.array(*[F.lit(float(t)) for t in thresholds]) if isinstance(thresholds, list) else thresholds
    rows = df.select(*by, score.alias("s"), label.alias("y"), steps.alias("steps")).where("s IS NOT NULL AND y IS NOT NULL")
    reached = F.size(F.filter("steps", lambda t: t <= F.col("s")))
    counts = rows.groupBy(*by, "steps", reached.alias("b")).agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") == 0).alias("n"))
    one = counts.groupBy(*by, "steps").agg(F.collect_list(F.struct("b", "p", "n")).alias("k"))  # a bucket a threshold
    grid = one.select(*by, "k", F.posexplode("steps").alias("i", "threshold"))
    total = lambda f, keep: F.aggregate(F.filter("k", keep), F.lit(0).cast("long"), lambda a, x: a + x[f])
    above, below = lambda x: x["b"] > F.col("i"), lambda x: x["b"] <= F.col("i")
    return grid.select(*by, "i", "threshold", total("p", above).alias("tp"), total("n", below).alias("tn"), total("n", above).alias("fp"), total("p", below).alias("fn"))


def with_metrics(matrix: DataFrame) -> DataFrame:
    tp, tn, fp, fn = (F.col(c) for c in CELLS)
    return matrix.withColumns({"f1": M.f_beta(tp, fp, fn), "mcc": M.mcc(tp, tn, fp, fn), "mcc_score": M.mcc_normalised(tp, tn, fp, fn), **M.rates(tp, tn, fp, fn), **M.roc_point(tp, tn, fp, fn)})


def linspace(low: float, high: float, n: int) -> list[float]:
    return [low + (high - low) * i / (n - 1) for i in range(n)]


def data_grid(df: DataFrame, score: Column, n: int = 100) -> DataFrame:
    """One row: the thresholds from min - 0.1 m to 1.1 max + 0.1 m, where m = 1.1 max - min."""
    ends = df.agg(F.min(score).alias("lo"), F.max(score).alias("hi"))
    m = 1.1 * F.col("hi") - F.col("lo")
    low, high = F.col("lo") - 0.1 * m, 1.1 * F.col("hi") + 0.1 * m
    return ends.select(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: low + (high - low) * i / F.lit(float(n - 1))).alias("steps"))


def optimum(points: DataFrame, metric: str) -> DataFrame:
    """All thresholds that reach the best value of the metric, with their mean."""
    if metric not in ("mcc_score", "f1"):
        raise ValueError(f"unknown metric {metric}")
    best = points.agg(F.max(metric).alias("best"))
    tied = points.join(F.broadcast(best), points[metric] == best["best"])
    return tied.groupBy("best").agg(F.array_sort(F.collect_list("threshold")).alias("thresholds"), F.avg("threshold").alias("mean_threshold"))


def trapezoid(points: DataFrame, x: str, y: str, order: str, by: list[str] | None = None) -> DataFrame:
    """Area under y over x by the trapezoid rule along a curve of few points."""
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(order)
    part = (F.col(x) - F.lag(x).over(w)) * (F.col(y) + F.lag(y).over(w)) / 2
    return points.withColumn("__a", part).groupBy(*(by or [])).agg(F.abs(F.sum("__a")).alias("auc"))


def stratified(df: DataFrame, strata: dict[str, Column], predicted: Column, label: Column) -> DataFrame:
    """(term, size, tp, tn, fp, fn, f1): the matrix and F1 of the rows of each stratum, a name and a predicate; any number of them
    in one aggregation. A row may lie in several strata or none."""
    cells = [F.struct(F.lit(n).alias("term"), *[F.count_if(inside & (predicted == p) & (label == y)).alias(c) for c, p, y in (("tp", 1, 1), ("tn", 0, 0), ("fp", 1, 0), ("fn", 0, 1))]) for n, inside in strata.items()]
    rows = df.agg(F.array(*cells).alias("s")).select(F.inline("s"))
    return rows.withColumns({"size": F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"), "f1": M.f_beta(F.col("tp"), F.col("fp"), F.col("fn"))})


class MetricSpec(NamedTuple):
    """A metric of the rows of a stratum: its name, the stratum's predicate (None: all rows), and a function of the four cells."""

    name: str
    stratum: Column | None
    metric: Callable[[Column, Column, Column, Column], Column]


#: Metrics by name for specs; a spec may hold any other function of (tp, tn, fp, fn).
METRICS: dict[str, Callable[[Column, Column, Column, Column], Column]] = {
    "f1": lambda tp, tn, fp, fn: M.f_beta(tp, fp, fn),
    "mcc": M.mcc,
    "recall": lambda tp, tn, fp, fn: M.rates(tp, tn, fp, fn)["recall"],
    "precision": lambda tp, tn, fp, fn: M.rates(tp, tn, fp, fn)["precision"],
}


def metric_specs(df: DataFrame, specs: list[MetricSpec], predicted: Column, label: Column, by: list[str] | None = None) -> DataFrame:
    """(by..., name, size, value): all specs in one aggregation of one pass, however many; rows with a NULL prediction, label or stratum count nowhere.
    A name given twice is an error."""
    if len({s.name for s in specs}) < len(specs):
        raise ValueError("two metrics have one name")
    pairs = (("tp", 1, 1), ("tn", 0, 0), ("fp", 1, 0), ("fn", 0, 1))
    cells = [F.struct(F.lit(i).alias("i"), *[F.count_if((F.lit(True) if s.stratum is None else s.stratum) & (predicted == p) & (label == y)).alias(c) for c, p, y in pairs]) for i, s in enumerate(specs)]
    rows = df.groupBy(*(by or [])).agg(F.array(*cells).alias("s")).select(*(by or []), F.inline("s"))
    value = F.coalesce(*[F.when(F.col("i") == i, s.metric(*[F.col(c) for c, _, _ in pairs]).cast("double")) for i, s in enumerate(specs)])
    name = F.get(F.array(*[F.lit(s.name) for s in specs]), F.col("i"))
    return rows.select(*(by or []), name.alias("name"), sum((F.col(c) for c, _, _ in pairs[1:]), F.col("tp")).alias("size"), value.alias("value"))


def gate_grid(df: DataFrame, score: str, gate: str, label: str, slopes: list[float], offsets: list[float], cut: float) -> DataFrame:
    """(w, b, tp, tn, fp, fn) of the gated score for each slope and offset."""
    return gate_points(df, score, gate, label, [(w, b) for w in slopes for b in offsets], cut).drop("i")


def gate_points(df: DataFrame, score: str, gate: str, label: str, points: list[tuple[float, float]], cut: float) -> DataFrame:
    """(i, w, b, tp, tn, fp, fn) of the gated score at each (slope, offset); all points in one pass, a matrix a point and task leaves it."""
    grid = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(w)).alias("w"), F.lit(float(b)).alias("b")) for i, (w, b) in enumerate(points)])
    rows = df.select(score, gate, label, F.inline(grid))
    gated = F.col(score) * F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("w") * F.col(gate) + F.col("b")))
    return rows.withColumn("__p", F.when(gated >= cut, 1).otherwise(0)).groupBy("i", "w", "b").agg(*M.confusion(F.col("__p"), F.col(label)))


def roc_auc_by(df: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    """(by..., auc): exact areas of all groups from running sums in one order; NULL where a group has one class alone."""
    rows = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    points = rows.groupBy(*by, score).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    sums = running_sums(points, [F.col(c) for c in [*by, score]], {"upto": "n"})
    # What stands before the group counts for each of its positives alike.
    area = F.sum(F.col("p") * (F.col("upto") - F.col("n") / 2.0)) - F.sum("p") * F.min(F.col("upto") - F.col("n"))
    return sums.groupBy(*by).agg((area / F.nullif(F.sum("p") * F.sum("n"), F.lit(0))).alias("auc"))


def roc_curve(df: DataFrame, score: Column, label: Column) -> DataFrame:
    """(score, cum_tp, cum_fp): one point a distinct score, from the highest down, summed in range partitions."""
    points = df.where(score.isNotNull() & label.isNotNull()).groupBy(score.alias("score")).agg(F.count_if(label == 1).alias("p"), F.count_if(label == 0).alias("n"))
    return running_sums(points, [F.desc("score")], {"cum_tp": "p", "cum_fp": "n"})


def roc_auc(df: DataFrame, score: Column, label: Column) -> DataFrame:
    """Exact area: each distinct score adds its negatives times the positives above it and half of those beside it."""
    curve = roc_curve(df, score, label)
    area = F.sum(F.col("n") * (F.col("cum_tp") - F.col("p") / 2.0))
    return curve.agg((area / F.nullif(F.sum("p") * F.sum("n"), F.lit(0))).alias("auc"), F.sum("p").alias("positives"), F.sum("n").alias("negatives"))
