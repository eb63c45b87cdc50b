"""Profiles of data sets: missing values, words, correlation, quantiles, histograms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varloom.operators.base import grouped_positions


def long_form(df: DataFrame, keys: list[str], columns) -> DataFrame:
    """(keys..., feature, x): numeric columns stacked, in one scan."""
    return df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(keys, list(columns), "feature", "x")


def missing_ratio(df: DataFrame, columns, group: str, label: str) -> DataFrame:
    """(group, label or NULL for all, feature, ratio): share of NULL or empty values, both grouping sets in one pass."""
    stacked = df.select(group, label, *[(F.col(c).isNull() | (F.col(c).cast("string") == "")).cast("int").alias(c) for c in columns]).unpivot([group, label], list(columns), "feature", "gone")
    return stacked.groupingSets([[group, "feature"], [group, label, "feature"]], group, label, "feature").agg(F.avg("gone").alias("ratio"))


def promote(df: DataFrame, columns) -> DataFrame:
    """(column, type): DOUBLE if every non-empty value is a number, else STRING; one aggregation for all columns."""
    checks = [F.coalesce(F.bool_and(F.col(c).isNull() | (F.col(c) == "") | F.col(c).try_cast("double").isNotNull()), F.lit(True)).alias(c) for c in columns]
    return df.agg(*checks).unpivot([], list(columns), "column", "numeric").select("column", F.when(F.col("numeric"), "DOUBLE").otherwise("STRING").alias("type"))


def correlations(df: DataFrame, columns) -> DataFrame:
    """(a, b, r): Pearson correlation of each pair over the rows where both are given."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[:i]]
    one = df.agg(*[F.corr(F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))).alias(f"{a}|{b}") for a, b in pairs])
    rows = one.unpivot([], [f"{a}|{b}" for a, b in pairs], "pair", "r")
    return rows.select(F.split_part("pair", F.lit("|"), F.lit(1)).alias("a"), F.split_part("pair", F.lit("|"), F.lit(2)).alias("b"), "r")


def box_summary(df: DataFrame, keys: list[str], columns) -> DataFrame:
    """Minimum, quartiles, maximum and the 1.5 x IQR fences of each feature and group, exact: the values that stand at the two
    positions around each quartile, interpolated."""
    placed = grouped_positions(long_form(df, keys, columns).where("x IS NOT NULL"), [*keys, "feature"], "x")

    def at(q: float) -> Column:
        where = q * (F.col("total") - 1)
        value = lambda k: F.max(F.when((k < F.col("upto")) & (k >= F.col("upto") - F.col("n")), F.col("x")))
        low, high = value(F.floor(where)), value(F.ceil(where))
        return low + (high - low) * F.max(where - F.floor(where))

    q = placed.groupBy(*keys, "feature").agg(F.min("x").alias("low"), at(0.25).alias("q1"), at(0.5).alias("median"), at(0.75).alias("q3"), F.max("x").alias("high"))
    iqr = F.col("q3") - F.col("q1")
    return q.withColumns({"fence_low": F.col("q1") - 1.5 * iqr, "fence_high": F.col("q3") + 1.5 * iqr})


def ecdf(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys..., value, share): share of the group's rows at or below each distinct value."""
    return grouped_positions(df, keys, value).select(*keys, value, (F.col("upto") / F.col("total")).alias("share"))


def data_histogram(df: DataFrame, x: Column, bins: int, by: list[str] | None = None) -> DataFrame:
    """(by..., bin, n): equal-width bins between the smallest and the largest value of the data, the last one closed."""
    rows = df.select(*(by or []), x.cast("double").alias("__x")).where("__x IS NOT NULL")
    ends = rows.agg(F.min("__x").alias("__lo"), F.max("__x").alias("__hi"))
    width = (F.col("__hi") - F.col("__lo")) / bins
    bin_ = F.coalesce(F.least(F.lit(bins - 1), F.floor(F.try_divide(F.col("__x") - F.col("__lo"), width)).cast("int")), F.lit(0))
    return rows.crossJoin(F.broadcast(ends)).groupBy(*(by or []), bin_.alias("bin")).agg(F.count("*").alias("n"))  # one row


def dataset_profile(df: DataFrame, by: list[str]) -> DataFrame:
    """(by..., column, type, rows, given, bytes): one aggregation for all columns. bytes: of the values as text."""
    columns = [c for c in df.columns if c not in by]
    sizes = [F.struct(F.lit(c).alias("column"), F.lit(dict(df.dtypes)[c]).alias("type"), F.count("*").alias("rows"), F.count(c).alias("given"), F.coalesce(F.sum(F.octet_length(F.col(c).cast("string"))), F.lit(0)).alias("bytes")) for c in columns]
    rows = df.groupBy(*by).agg(F.array(*sizes).alias("p")) if by else df.agg(F.array(*sizes).alias("p"))
    return rows.select(*by, F.inline("p"))


def numeric_columns(df: DataFrame) -> list[str]:
    """The columns that hold numbers; all others count as text."""
    from pyspark.sql.types import NumericType

    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def chosen_columns(df: DataFrame, allow: list[str] | None = None, ignore: list[str] = ()) -> DataFrame:
    """The allowed columns (all if None) without the ignored ones; a name that df does not have is an error."""
    unknown = [c for c in [*(allow or []), *ignore] if c not in df.columns]
    if unknown:
        raise ValueError(f"unknown columns: {', '.join(unknown)}")
    return df.select(*[c for c in (allow or df.columns) if c not in ignore])


def histogram(df: DataFrame, x: Column, bins: int, low: float, high: float, by: list[str] | None = None) -> DataFrame:
    """(by..., bin, n): equal-width bins of [low, high], the last one closed."""
    bin_ = F.least(F.lit(bins - 1), F.floor((x - low) / ((high - low) / bins)).cast("int"))
    return df.where(x.isNotNull() & (x >= low) & (x <= high)).groupBy(*(by or []), bin_.alias("bin")).agg(F.count("*").alias("n"))


def fit_columns(df: DataFrame, columns) -> DataFrame:
    """Count, mean, population variance, sample deviation, minimum and maximum of each column, in one aggregation."""
    return long_form(df.withColumn("__k", F.lit(0)), ["__k"], columns).groupBy("feature").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.var_pop("x").alias("var"), F.stddev_samp("x").alias("std"), F.min("x").alias("low"), F.max("x").alias("high"))


def vocabulary(df: DataFrame, tokens: Column, size: int) -> DataFrame:
    """(token, n, slot): the `size` most frequent tokens; slot 0 is kept for unknown words."""
    counts = df.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(size)
    return counts.withColumn("slot", F.row_number().over(Window.orderBy(F.desc("n"), "token")))  # at most `size` rows


def word_occurrence(df: DataFrame, text: str, label: str, most: int = 500) -> DataFrame:
    """(value, label, n): for each distinct value the rows whose text contains it as a substring.

    Values and texts meet as distinct texts with counts; the column is left out (no rows) if it has over `most` values.
    """
    texts = df.where(F.col(text).isNotNull()).groupBy(F.col(text).alias("t"), F.col(label).alias("label")).agg(F.count("*").alias("c"))
    values = texts.select(F.col("t").alias("value")).distinct()
    checked = values.limit(most + 1)
    few = checked.agg((F.count("*") <= most).alias("few"), F.collect_list("value").alias("values")).where("few")  # bounded by `most`
    return texts.crossJoin(F.broadcast(few)).select("t", "label", "c", F.explode("values").alias("value")).where(F.col("t").contains(F.col("value"))).groupBy("value", "label").agg(F.sum("c").alias("n"))


def presence(df: DataFrame, key: str, columns) -> DataFrame:
    """Rows of each case in which a column is given, and their total."""
    counts = df.groupBy(key).agg(*[F.count(c).alias(c) for c in columns])
    return counts.withColumn("total", reduce(lambda a, b: a + b, [F.col(c) for c in columns]))


def magnitude(df: DataFrame, key: str, columns) -> DataFrame:
    """Presence of each column over its largest presence, summed."""
    counts = presence(df, key, columns).drop("total")
    most = counts.agg(*[F.max(c).alias(f"m_{c}") for c in columns])
    share = [F.coalesce(F.try_divide(F.col(c), F.col(f"m_{c}")), F.lit(0.0)) for c in columns]
    return counts.crossJoin(F.broadcast(most)).select(key, reduce(lambda a, b: a + b, share).alias("magnitude"))  # one row


def density(df: DataFrame, x: Column, low: float, high: float, points: int = 50, bins: int = 1000, adjust: float = 0.75) -> DataFrame:
    """(at, density): gaussian kernel density on a grid, from a histogram of bin centres; Scott's bandwidth x adjust."""
    step = (high - low) / bins
    n = df.where(x.isNotNull()).agg(F.count("*").alias("n"), F.stddev_samp(x).alias("s")).select("n", (F.col("s") * F.pow("n", F.lit(-0.2)) * adjust).alias("h"))
    bars = histogram(df, x, bins, low, high).select((F.lit(low) + (F.col("bin") + 0.5) * step).alias("c"), F.col("n").alias("w"))
    grid = F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i")
    met = bars.crossJoin(F.broadcast(n)).select("c", "w", "n", "h", grid)
    at = F.lit(low) + F.col("i") * ((high - low) / (points - 1))
    z = (at - F.col("c")) / F.col("h")
    return met.groupBy("i").agg(F.sum(F.col("w") * F.exp(-z * z / 2) / (F.col("n") * F.col("h") * 2.5066282746310002)).alias("density"))
