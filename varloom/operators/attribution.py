"""Shapley values of any score: coalitions of features against a small background, scored by the same job as the rows themselves."""

from __future__ import annotations

import random
from collections import defaultdict
from collections.abc import Callable
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def coalitions(features: int, permutations: int | None = None, seed: int = 1) -> list[tuple[int, list[float]]]:
    """(members as bits, weight of the coalition's value in each feature's Shapley value): every coalition if permutations is None, else
    those met along so many random orders and their reverses. The weights of either sum to v(all) - v(none) over the features."""
    full = (1 << features) - 1
    if permutations is None:
        size = [bin(m).count("1") for m in range(full + 1)]
        weight = lambda n: factorial(n) * factorial(features - n - 1) / factorial(features)
        return [(m, [weight(size[m] - 1) if m >> j & 1 else -weight(size[m]) for j in range(features)]) for m in range(full + 1)]
    met: dict[int, list[float]] = defaultdict(lambda: [0.0] * features)
    rng = random.Random(seed)
    for _ in range(permutations):
        order = rng.sample(range(features), features)
        for way in (order, order[::-1]):
            mask = 0
            for j in way:
                met[mask][j] -= 0.5 / permutations
                mask |= 1 << j
                met[mask][j] += 0.5 / permutations
    return sorted(met.items())


def benign_background(df: DataFrame, key: str, features: list[str], benign: Column, most: int = 50, seed: str = "bg") -> DataFrame:
    """At most `most` rows of the benign class, those with the smallest md5 of key and seed: the same on every partitioning."""
    return df.where(benign).orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(":" + seed)).cast("binary")), key).limit(most).select(*features)


def shapley(rows: DataFrame, key: str, features: list[str], background: DataFrame, score: Callable[[DataFrame], DataFrame], permutations: int | None = None, seed: int = 1, most: int = 50) -> DataFrame:
    """(key, expected, score, phi_<feature>...): what each feature adds to a row's score over the background's mean score.

    score takes rows that hold the features and gives them back with a column __score, whatever computes it: an expression, a fitted pipeline, a
    pandas function. A coalition's value is its mean score over the background, where the row's own values stand for
    its members. The values of a row add up to score - expected. Coalitions explode row by row and are summed up per key before
    the shuffle, so only a row a key and task leaves it. The background is bounded by `most`; a larger one, or an empty one, is an error.
    """
    held = background.select(*features).limit(most + 1).collect()  # at most 51 rows
    if not 0 < len(held) <= most:
        raise ValueError(f"the background must have 1 to {most} rows")
    full = (1 << len(features)) - 1
    spark, names = rows.sparkSession, [f"__phi{j}" for j in range(len(features))]
    drawn = coalitions(len(features), permutations, seed)
    masks = spark.createDataFrame([(m, *w) for m, w in drawn], "__mask long, " + ", ".join(f"{n} double" for n in names))
    ground = spark.createDataFrame(held, background.select(*features).schema).select(*[F.col(f"`{c}`").alias(f"__b{j}") for j, c in enumerate(features)])
    # Both sides are bounded: background rows by coalitions of a fixed number of features.
    plan = F.broadcast(masks.crossJoin(ground))
    inside = lambda j: F.col("__mask").bitwiseAND(F.lit(1 << j)) != 0
    kind = dict(rows.dtypes)
    mixed = rows.crossJoin(plan).select(F.col(key).alias("__key"), "__mask", *names, *[F.when(inside(j), F.col(f"`{c}`")).otherwise(F.col(f"__b{j}")).cast(kind[c]).alias(c) for j, c in enumerate(features)])
    scored = score(mixed)
    mean = lambda x: F.sum(x) / F.lit(float(len(held)))
    out = scored.groupBy("__key").agg(
        mean(F.when(F.col("__mask") == 0, F.col("__score")).otherwise(0.0)).alias("expected"), mean(F.when(F.col("__mask") == full, F.col("__score")).otherwise(0.0)).alias("score"),
        *[mean(F.col("__score") * F.col(n)).alias(f"phi_{c}") for n, c in zip(names, features, strict=True)],
    )
    return out.withColumnRenamed("__key", key)
