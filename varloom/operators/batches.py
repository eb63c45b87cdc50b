"""User functions over batches of rows, model fitting and projection."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.operators.base import numbered


def map_batches(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """fn over every batch of every partition; a failing batch fails the job. Spark deals the batches out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from map(fn, batches)

    return df.mapInPandas(run, schema)


def map_shards(df: DataFrame, order: list[Column], fn: Callable[[pd.DataFrame, int, int], pd.DataFrame], schema: str, most: int = 100_000) -> DataFrame:
    """fn over shards of at most `most` rows by global position: it is handed a shard's rows in order, the shard's first position and the one after
    its last, and gives rows of `schema`.

    The result has shard, start, stop and place (the row's place in the shard's output) beside them and is sorted by (shard, place): the outputs joined in the order
    of the shards. A shard that fails ends the job. Shards are numbered without a one-task window and run in parallel, each in one task.
    """
    if most <= 0:
        raise ValueError("a shard must have room for a row")
    rows = numbered(df, order, "__n").withColumn("__shard", F.floor(F.col("__n") / F.lit(most)))

    def run(key: tuple[int], pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__n", kind="stable")
        start, stop = int(pdf["__n"].iloc[0]), int(pdf["__n"].iloc[-1]) + 1
        out = fn(pdf.drop(columns=["__n", "__shard"]).reset_index(drop=True), start, stop)
        return out.assign(shard=key[0], start=start, stop=stop, place=range(len(out)))

    return rows.groupBy("__shard").applyInPandas(run, f"{schema}, shard long, start long, stop long, place long").orderBy("shard", "place")


def fit_classifier(df: DataFrame, text_columns: dict[str, object], numbers: list[str], label: str, weight: str, vocabulary: int = 5000):
    """Weighted logistic regression over bags of words and standardised numbers; the fitted Spark ML pipeline."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizer, StandardScaler, VectorAssembler

    stages, made = [], []
    rows = df.withColumns({f"{c}_words": words for c, words in text_columns.items()})
    for c in text_columns:
        stages.append(CountVectorizer(inputCol=f"{c}_words", outputCol=f"{c}_bag", vocabSize=vocabulary))
        made.append(f"{c}_bag")
    stages += [VectorAssembler(inputCols=numbers, outputCol="numbers"), StandardScaler(inputCol="numbers", outputCol="scaled", withMean=True)]
    stages += [VectorAssembler(inputCols=[*made, "scaled"], outputCol="features"), LogisticRegression(labelCol=label, weightCol=weight, maxIter=20)]
    return Pipeline(stages=stages).fit(rows), rows


def fit_gate(df: DataFrame, score: str, label: str, weight: str):
    """Logistic regression of one score with slope >= 0 and intercept <= 0."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.linalg import Matrices, Vectors

    rows = VectorAssembler(inputCols=[score], outputCol="features").transform(df)
    model = LogisticRegression(labelCol=label, weightCol=weight, lowerBoundsOnCoefficients=Matrices.dense(1, 1, [0.0]), upperBoundsOnIntercepts=Vectors.dense([0.0]))
    return model.fit(rows), rows


def pca(df: DataFrame, key: str, vector: str, k: int = 2) -> DataFrame:
    """(key, pc1..pck): principal components of centred vectors."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = df.select(key, array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("v"))
    centred = StandardScaler(inputCol="v", outputCol="c", withMean=True, withStd=False).fit(rows).transform(rows)
    out = PCA(k=k, inputCol="c", outputCol="p").fit(centred).transform(centred).select(key, vector_to_array("p").alias("p"))
    return out.select(key, *[F.get("p", i).alias(f"pc{i + 1}") for i in range(k)])
