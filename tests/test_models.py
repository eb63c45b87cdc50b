"""Attribution, search, shards, interleaved streams and metric specs on small tables."""

from __future__ import annotations

import itertools
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from varloom.operators import attribution as S
from varloom.operators import modelling as C
from varloom.operators import splits
from varloom.operators import thresholds as T
from varloom.operators.batches import map_shards
from varloom.streaming.counters import batch_counters, drained_counters


def brute_shapley(value, n):
    out = []
    for j in range(n):
        rest = [k for k in range(n) if k != j]
        out.append(sum(factorial(len(s)) * factorial(n - len(s) - 1) / factorial(n) * (value({*s, j}) - value(set(s))) for size in range(n) for s in itertools.combinations(rest, size)))
    return out


@pytest.fixture(scope="module")
def four(spark):
    rng = np.random.default_rng(3)
    x, b = rng.normal(size=(6, 4)), rng.normal(size=(5, 4))
    names = ["a", "b", "c", "d"]
    frame = lambda m, ids: spark.createDataFrame([(i, *map(float, r)) for i, r in zip(ids, m, strict=True)], "id long, a double, b double, c double, d double")
    return names, x, b, frame(x, range(6)), frame(b, range(100, 105))


def test_shapley_equals_brute_force_over_all_coalitions(four):
    names, x, b, rows, ground = four
    f = lambda m: m[:, 0] * m[:, 1] + np.maximum(m[:, 2], 0) - m[:, 3] * m[:, 0] ** 2
    score = lambda df: df.withColumn("__score", F.col("a") * F.col("b") + F.greatest("c", F.lit(0.0)) - F.col("d") * F.col("a") ** 2)
    got = {r["id"]: r for r in S.shapley(rows, "id", names, ground, score).collect()}
    for i, row in enumerate(x):
        value = lambda s: f(np.where([j in s for j in range(4)], row, b)).mean()  # noqa: B023, E731
        assert np.allclose([got[i][f"phi_{n}"] for n in names], brute_shapley(value, 4))
        assert np.isclose(got[i]["expected"] + sum(got[i][f"phi_{n}"] for n in names), got[i]["score"]) and np.isclose(got[i]["score"], f(row[None])[0])


def test_sampled_shapley_adds_up_and_is_exact_for_sums(four):
    """Of a sum every coalition tells the same, so samples equal the closed form; of anything else they still add up, and near the exact values."""
    names, x, b, rows, ground = four
    w = np.array([2.0, -1.0, 0.5, 3.0])
    got = {r["id"]: r for r in S.shapley(rows, "id", names, ground, lambda df: df.withColumn("__score", sum((F.col(n) * v for n, v in zip(names, w.tolist(), strict=True)), F.lit(1.0))), 2).collect()}
    assert all(np.allclose([got[i][f"phi_{n}"] for n in names], w * (row - b.mean(0))) for i, row in enumerate(x))

    def by_pandas(df):  # a scorer that is no expression
        return df.mapInPandas(lambda it: (p.assign(__score=p["a"] * p["b"] * p["c"]) for p in it), ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + ", __score double")

    exact, drawn = ({r["id"]: r for r in S.shapley(rows, "id", names, ground, by_pandas, n).collect()} for n in (None, 40))
    for i in exact:
        phi = [drawn[i][f"phi_{n}"] for n in names]
        assert np.isclose(sum(phi), drawn[i]["score"] - drawn[i]["expected"]) and np.allclose(phi, [exact[i][f"phi_{n}"] for n in names], atol=0.6)
    assert S.shapley(rows.limit(0), "id", names, ground, by_pandas).count() == 0
    with pytest.raises(ValueError, match="1 to 3 rows"):
        S.shapley(rows, "id", names, ground, by_pandas, most=3)
    with pytest.raises(ValueError, match="1 to 50 rows"):
        S.shapley(rows, "id", names, ground.limit(0), by_pandas)


def test_shards_are_ordinal_ordered_and_whole(spark):
    rows = spark.range(1003).select(F.col("id"), (F.col("id") * 7919 % 1003).alias("k")).repartition(7)
    seen = lambda pdf, start, stop: pdf[["k"]].assign(ok=len(pdf) == stop - start and pdf["k"].tolist() == list(range(start, stop)))
    got = map_shards(rows, [F.col("k")], seen, "k long, ok boolean", 100).collect()
    assert [r["k"] for r in got] == list(range(1003)) and all(r["ok"] for r in got)
    assert {(r["shard"], r["start"], r["stop"]) for r in got} == {(i, 100 * i, min(1003, 100 * i + 100)) for i in range(11)}

    def fails(pdf, start, stop):
        if start == 300:
            raise RuntimeError("shard of 300 failed")
        return pdf[["k"]]

    with pytest.raises(Exception, match="shard of 300 failed"):
        map_shards(rows, [F.col("k")], fails, "k long", 100).collect()
    assert map_shards(rows.limit(0), [F.col("k")], seen, "k long, ok boolean").count() == 0


def test_interleave_stops_with_the_first_empty_class(spark):
    rows = spark.range(500).select("id", (F.col("id") % 10 == 0).cast("int").alias("y"))
    got = splits.interleave(rows.repartition(5), "id", "y", 0.3).orderBy("t").collect()
    assert [r["t"] for r in got] == list(range(len(got)))
    n = {y: [r for r in got if r["y"] == y] for y in (0, 1)}
    assert len({r["id"] for r in n[0]}) == len(n[0]) and len({(r["id"], r["copy"]) for r in n[1]}) == len(n[1])
    assert len(n[0]) == 450 or len(n[1]) == 8 * 50, "a class has run out"
    assert abs(len(n[1]) / len(got) - 0.3) < 0.06
    for copy in range(max(r["copy"] for r in n[1])):  # each repeat is whole before the next begins
        assert sorted(r["id"] for r in n[1][50 * copy : 50 * copy + 50]) == list(range(0, 500, 10))
    assert splits.interleave(rows.where("y = 0"), "id", "y", 0.5).where("y = 1").count() == 0
    assert splits.interleave(rows.limit(0), "id", "y", 0.5).count() == 0


def test_search_finds_the_planted_optimum(spark):
    """The user's own fit and objective: of drawn slopes that nearest to the planted one wins; equal ones go to the first."""
    rows = spark.range(2000).select("id", (F.col("id") % 97 / 97).alias("g"), ((F.col("id") % 97 / 97) * 2.5 - 0.95 > 0.3).cast("int").alias("y"))
    train, validation = C.held_out(rows, "id")
    assert 300 < validation.count() < 500 and train.count() + validation.count() == 2000
    tried = C.drawn_parameters({"w": (0.0, 5.0), "kind": ["x"]}, 20)
    loss = lambda w, df: C.matthews_loss(df, F.when(w * F.col("g") - 0.95 > 0.3, 1).otherwise(0), F.col("y"))
    model, chosen, results = C.search(train, validation, lambda df, p: p["w"], loss, tried)
    assert model == chosen["w"] == min((p["w"] for p in tried), key=lambda w: abs(w - 2.5)) and len(results) == 20
    assert all(p["kind"] == "x" for p in tried) and tried == C.drawn_parameters({"w": (0.0, 5.0), "kind": ["x"]}, 20)
    with pytest.raises(ValueError, match="no parameters"):
        C.search(train, validation, lambda df, p: None, loss, [])


def test_search_over_fitted_pipelines(spark):
    rows = spark.range(400).select("id", F.when(F.col("id") % 4 == 0, "bad word").otherwise("good word").alias("t"), (F.col("id") % 13).cast("double").alias("n"), (F.col("id") % 4 == 0).cast("double").alias("label"))
    train, validation = C.held_out(rows, "id")
    fit = lambda df, p: C.fit_variant_classifier(df, ["t"], ["n"], **p)
    loss = lambda model, df: C.matthews_loss(C.probability(model, C.filled(df, ["t"], ["n"])), F.when(F.col("score") >= 0.5, 1).otherwise(0), F.col("label"))
    model, chosen, results = C.search(train, validation, fit, loss, [{"regParam": 100.0, "elasticNetParam": 1.0}, {"regParam": 0.001}], 2)
    assert chosen == {"regParam": 0.001} and results[1][1] == 0.0
    one = C.probability(model, C.filled(validation.limit(1), ["t"], ["n"])).first()
    assert one["score"] == C.probability(model, C.filled(validation, ["t"], ["n"])).where(F.col("id") == one["id"]).first()["score"], "a score doesn't depend on other rows"


def test_metric_specs_in_one_aggregation(spark):
    rows = spark.createDataFrame([(i % 2, int(i % 3 == 0), i % 5) for i in range(60)] + [(None, 1, 0), (1, None, 0)], "p int, y int, s int")
    mine = T.MetricSpec("share", F.col("s") == 1, lambda tp, tn, fp, fn: tp / (tp + tn + fp + fn))
    out = T.metric_specs(rows, [T.MetricSpec("f1", None, T.METRICS["f1"]), mine], F.col("p"), F.col("y"))
    got = {r["name"]: (r["size"], round(r["value"], 9)) for r in out.collect()}
    tp = sum(i % 2 and i % 3 == 0 for i in range(60))
    assert got["f1"] == (60, round(2 * tp / (30 + 20), 9)) and got["share"] == (12, round(sum(i % 2 and i % 3 == 0 and i % 5 == 1 for i in range(60)) / 12, 9))
    assert str(out._jdf.queryExecution().optimizedPlan()).count("Aggregate") == 1
    with pytest.raises(ValueError, match="one name"):
        T.metric_specs(rows, [mine, mine], F.col("p"), F.col("y"))


def test_stream_over_many_files_equals_the_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(7).write.parquet(path := str(tmp_path / "events.parquet"))
    assert sorted(drained_counters(spark, path, files=2).collect()) == sorted(batch_counters(events).collect())
