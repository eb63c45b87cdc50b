"""What the two operators on integer vectors share: scaling, starting rows and exact grouped sums."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def whole(vector: Column) -> Column:
    """Not NULL, and no component NULL or non-finite."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))


def scaled(lists: pa.Array, dims: int, scale: int) -> np.ndarray:
    """floor(scale * x) of an Arrow column of vectors with `dims` components each, as long integers.

    Components whose squared distances might leave 64 bits are an error, as an overflow is anywhere in Spark.
    """
    x = np.floor(np.asarray(lists.flatten(), np.float64) * scale).reshape(len(lists), dims)
    if x.size and np.abs(x).max() > (limit := int((2.0**62 / max(1, dims)) ** 0.5) // 2):
        raise OverflowError(f"a component beyond {limit} after scaling: squared distances would not fit 64 bits")
    return x.astype(np.int64)


def first_vectors(vectors: DataFrame, order: list[Column], n: int, id_col: str, vec_col: str, dims: int, scale: int) -> np.ndarray:
    """The first n vectors in the given order as long integers; rows with a NULL id come last, ties go by their components."""
    x = F.transform(F.col(vec_col), lambda v: F.floor(v.cast("double") * scale))
    held = vectors.orderBy(F.col(id_col).isNull(), *order, x).limit(n).select(x.alias("x")).collect()
    return np.array([r["x"] for r in held], np.int64).reshape(len(held), dims)


def moved(sums: DataFrame, keys: list[str], dims: int) -> dict[tuple, tuple[int, list[int]]]:
    """Key to (rows, componentwise floor of the mean) over rows (keys..., n, s array of `dims`) that tasks have summed up; a key is one of
    a fixed number of entries, so this stays small."""
    held = sums.groupBy(*keys).agg(F.sum("n").alias("n"), *[F.sum(F.get("s", F.lit(i))).alias(f"s{i}") for i in range(dims)]).collect()
    return {tuple(r[k] for k in keys): (r["n"], [r[f"s{i}"] // r["n"] for i in range(dims)]) for r in held if r["n"]}
