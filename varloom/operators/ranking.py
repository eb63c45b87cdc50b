"""Ranks of causative variants per case, and how competing scores compare."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FREQUENCIES = ("frq", "frq2", "frq3")
#: Population-frequency limits of the comparison; None keeps everything.
LIMITS = (None, 1 / 2000, 10 / 2000, 100 / 2000)


def rare(limit: float | None, columns=FREQUENCIES) -> Column:
    """The largest of the frequencies, NULL counting as 0, is at most `limit`."""
    if limit is None:
        return F.lit(True)
    return F.greatest(F.lit(0.0), F.lit(0.0), *[F.coalesce(F.col(c), F.lit(0.0)) for c in columns]) <= F.lit(limit)


def compare(scored: DataFrame, causative: DataFrame, scores: list[str], limits=LIMITS) -> DataFrame:
    """(case_id, rank_<score>..., max_frq) for every case and frequency limit (NULL: none): the 0-based rank of the best-ranked
    causative variant among the rows within the limit, NULL if none is left.

    Ties go to the smaller id. A rank is the count of better rows, so no case, however large, is sorted in one task; all limits
    share one grouping for the causative rows and one for the counts.
    """
    frequency = [c for c in FREQUENCIES if c in scored.columns]
    inside = [rare(x, frequency) for x in limits]
    rows = scored.select("case_id", "id", *scores, *[ok.alias(f"in_{i}") for i, ok in enumerate(inside)])
    marked = rows.join(causative.select("case_id", "id").distinct(), ["case_id", "id"], "left_semi")
    best = [F.max(F.when(F.col(f"in_{i}"), F.struct(F.col(s).alias("s"), (-F.col("id")).alias("i")))).alias(f"b_{i}_{s}") for i in range(len(limits)) for s in scores]
    met = rows.join(marked.groupBy("case_id").agg(*best), "case_id", "left")

    def rank(i: int, s: str) -> Column:
        b = F.col(f"b_{i}_{s}")
        ahead = F.col(f"in_{i}") & ((F.col(s) > b["s"]) | ((F.col(s) == b["s"]) & (-F.col("id") > b["i"])))
        return F.when(F.count(b) > 0, F.count_if(ahead)).alias(f"r_{i}_{s}")

    counts = met.groupBy("case_id").agg(*[rank(i, s) for i in range(len(limits)) for s in scores])
    each = [F.struct(*[F.col(f"r_{i}_{s}").alias(f"rank_{s}") for s in scores], F.lit(x).cast("double").alias("max_frq")) for i, x in enumerate(limits)]
    return counts.select("case_id", F.inline(F.array(*each)))


def causative_ranks(scored: DataFrame, causative: DataFrame, scores: list[str], limit: float | None = None) -> DataFrame:
    """(case_id, rank_<score>...) under one frequency limit (None: none)."""
    return compare(scored, causative, scores, (limit,)).drop("max_frq")


def points(ranks: DataFrame, a: str, b: str) -> DataFrame:
    """Wins of a, losses of a, ties, and cases that only one, or none, of the two ranks (NULL or -1 counts as not ranked)."""
    ra, rb = (F.when(F.col(c) >= 0, F.col(c)) for c in (a, b))
    return ranks.agg(
        F.count_if(ra < rb).alias("wins"), F.count_if(ra > rb).alias("losses"), F.count_if(ra == rb).alias("ties"),
        F.count_if(ra.isNull() & rb.isNull()).alias("neither"), F.count_if(ra.isNull() & rb.isNotNull()).alias("only_b"), F.count_if(ra.isNotNull() & rb.isNull()).alias("only_a"),
    )


def top_per_case(scored: DataFrame, score: str, n: int) -> DataFrame:
    """The n best rows of each case with their 0-based rank; Spark keeps n rows a task before it shuffles."""
    w = Window.partitionBy("case_id").orderBy(F.desc(score), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).withColumn("rank", F.col("rank") - 1)
