"""Connected components by alternating large-star and small-star steps, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.llm.common import written


def _to_minimum(directed: DataFrame) -> DataFrame:
    """(u, v) with the smallest of u and all its v beside. The minimum is pre-aggregated, and the join back streams the
    rows of a hub, so adaptive execution can split it."""
    least = directed.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return directed.join(least, "u")


def _settled(pairs: DataFrame) -> bool:
    """Whether pairs (u, v), v < u, are stars: no u has two v, and no v is a u. Then v is the smallest node of its component, and a round would change nothing."""
    ends = pairs.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(pairs.select(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("in")))
    return ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("in").alias("in")).where("out > 1 OR (out = 1 AND `in` = 1)").isEmpty()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component): for every node of an edge, the smallest node that it reaches.

    Self-links and repeated links are fine; rows with a NULL end are ignored; an empty table gives an empty table. Each half of a
    round is written, so plans stay short, Spark knows the sizes of what it joins, and a lost executor costs half a round. The
    number of rounds grows with the logarithm of the longest path; a component that is not settled after max_rounds raises an error.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull()).where("u <> v").distinct()
    pairs = written(pairs, "component-pairs")
    rounds = 0
    while not _settled(pairs):
        if rounds == max_rounds:
            raise RuntimeError("components did not settle")
        rounds += 1
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_minimum(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _to_minimum(written(large, "component-pairs"))
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        pairs = written(small.where("u <> v").distinct(), "component-pairs")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
