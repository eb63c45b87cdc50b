"""Every registered query with SQL gives the same rows as DuckDB on the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import pytest

from varloom.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return repr(round(float(value), 6) + 0.0)
    return str(value)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.execute(ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())


def test_only_fitted_models_have_no_sql():
    assert set(QUERIES) - set(ORACLE_SQL) == {"m04_fit_classifier", "m05_fit_gate", "m08_pca"}


def test_pca_equals_singular_values(spark):
    import numpy as np

    given = sorted(spark.read.parquet(f"{SF}/embeddings.parquet").collect(), key=lambda r: r["vec_id"])
    got = {r["vec_id"]: (r["pc1"], r["pc2"]) for r in QUERIES["m08_pca"](spark, SF).collect()}
    x = np.array([r["embedding"] for r in given], float)
    x -= x.mean(0)
    _, _, axes = np.linalg.svd(x, full_matrices=False)
    own, have = x @ axes[:2].T, np.array([got[r["vec_id"]] for r in given])
    assert np.allclose(np.abs(own), np.abs(have), atol=1e-6)


def test_gate_keeps_its_bounds_and_finds_the_scores_order(spark):
    from pyspark.sql import functions as F

    from varloom.operators.batches import fit_gate

    rows = spark.range(400).select((F.col("id") / 400).alias("s"), (F.col("id") > 250).cast("double").alias("y"), F.lit(1.0).alias("w"))
    model, made = fit_gate(rows, "s", "y", "w")
    assert model.coefficients[0] > 0 and model.intercept < 0
    right = model.transform(made).where("prediction = y").count()
    assert right >= 390
    turned, _ = fit_gate(rows.withColumn("y", 1 - F.col("y")), "s", "y", "w")
    assert turned.coefficients[0] >= 0 and turned.intercept <= 0, "a falling score gets no negative slope"
    got = QUERIES["m05_fit_gate"](spark, SF)
    assert got.columns == ["id", "class", "held_out"] and got.count() == spark.read.parquet(f"{SF}/events.parquet").count()


def test_classifier_on_rows_it_has_not_seen(spark):
    from pyspark.sql import functions as F

    from varloom.functions import parsing as P
    from varloom.operators.batches import fit_classifier

    word = lambda bad: F.when(bad, F.concat(F.lit("harmful stop "), (F.col("id") % 9).cast("string"))).otherwise(F.concat(F.lit("mild intron "), (F.col("id") % 9).cast("string")))
    rows = spark.range(600).withColumn("bad", F.col("id") % 4 == 0).select("id", word(F.col("bad")).alias("text"), (F.col("id") % 7).cast("double").alias("n"), F.col("bad").cast("double").alias("y"), F.lit(1.0).alias("w"))
    model, _ = fit_classifier(rows.where("id < 400"), {"text": P.tokens(F.col("text"))}, ["n"], "y", "w", 50)
    asked = rows.where("id >= 400").withColumn("text_words", P.tokens(F.col("text")))
    assert model.transform(asked).where("prediction = y").count() == 200
    assert QUERIES["m04_fit_classifier"](spark, SF).select("class").distinct().count() == 2


@pytest.mark.parametrize("name", ["b06_case_rank_compare", "a13_roc_exact", "w03_global_rank", "t01_split_ceil", "a08_sweep_grid"])
def test_partitions_do_not_matter(spark, tmp_path, name):
    """One and seven input partitions give the same rows."""
    results = []
    for n in (1, 7):
        folder = tmp_path / str(n)
        spark.read.parquet(f"{SF}/events.parquet").repartition(n).write.parquet(str(folder / "events.parquet"))
        results.append(sorted(map(str, QUERIES[name](spark, str(folder)).collect())))
    assert results[0] == results[1]
