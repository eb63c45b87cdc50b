"""Queries over splits, weights and resampling."""

from __future__ import annotations

from math import floor

from pyspark.sql import functions as F

from varloom.operators import splits as S
from varloom.operators.base import draw, numbered
from varloom.plans.registry import query
from varloom.plans.vehicles import V_SCORED, scored

def _u(seed: str, key: str = "id") -> str:
    return f"(cast('0x' || substr(md5(concat({key}::VARCHAR, ':{seed}')), 1, 8) AS BIGINT) / 4294967296e0)"


@query("t01_split_ceil", f"WITH {V_SCORED}, r AS (SELECT id, row_number() OVER (ORDER BY {_u('split')}, id) AS k, count(*) OVER () AS n FROM v_scored) SELECT id, CASE WHEN k <= ceil(0.25*n) THEN 'test' ELSE 'train' END AS dataset FROM r")
def split_ceil(spark, d):
    return S.split(scored(spark, d).select("id"), "id", 0.25)


@query("t03_split_floor", f"WITH {V_SCORED}, r AS (SELECT id, row_number() OVER (ORDER BY {_u('split')}, id) AS k, count(*) OVER () AS n FROM v_scored) SELECT id, CASE WHEN k <= floor(0.33*n) THEN 'test' ELSE 'train' END AS dataset FROM r")
def split_floor(spark, d):
    return S.split(scored(spark, d).select("id"), "id", 0.33, rounding=floor)


_ORIGIN = "CASE id % 5 WHEN 0 THEN 'TEST' WHEN 1 THEN 'BOTH' ELSE 'TRAIN' END"


@query(
    "t02_split_source",
    f"""WITH {V_SCORED}, o AS (SELECT id, {_ORIGIN} AS origin FROM v_scored), c AS (SELECT ceil(0.25*count(*)) - count(CASE WHEN origin = 'TEST' THEN 1 END) AS room FROM o),
    r AS (SELECT id, row_number() OVER (ORDER BY {_u('source')}, id) AS k FROM o WHERE origin = 'BOTH')
    SELECT id, origin, lower(origin) AS dataset FROM o WHERE origin <> 'BOTH' UNION ALL SELECT id, 'BOTH', CASE WHEN k <= room THEN 'test' ELSE 'train' END FROM r, c""",
)
def split_source(spark, d):
    return S.split_by_source(scored(spark, d).selectExpr("id", f"{_ORIGIN} AS origin"), "id", "origin", 0.25)


@query("t04_fraction", f"WITH {V_SCORED}, r AS (SELECT id, row_number() OVER (ORDER BY {_u('part')}, id) AS k, count(*) OVER () AS n FROM v_scored) SELECT id FROM r WHERE k <= floor(0.1*n)")
def fraction(spark, d):
    rows = scored(spark, d).select("id")
    n = floor(0.1 * rows.count())
    return numbered(rows.withColumn("u", draw(F.col("id"), "part")), [F.col("u"), F.col("id")], "k").where(F.col("k") < n).select("id")


@query("t05_with_replacement", f"WITH {V_SCORED}, s AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k, count(*) OVER () AS n FROM v_scored), m AS (SELECT max(n) AS n FROM s), g AS (SELECT i, floor({_u('boot', 'i')} * n)::BIGINT AS k FROM range(1000) r(i), m) SELECT i AS draw, id FROM g JOIN s USING (k)")
def with_replacement(spark, d):
    rows = numbered(scored(spark, d).select("id"), [F.col("id")], "k")
    draws = spark.range(1000).select(F.col("id").alias("draw"), F.floor(draw(F.col("id"), "boot") * F.lit(rows.count())).alias("k"))
    return draws.join(rows, "k").select("draw", "id")


@query("t06_dropout", f"WITH {V_SCORED} SELECT id, CASE WHEN label = 1 AND {_u('drop-consequence')} < 0.5 THEN '' ELSE consequence END AS consequence, round(CASE WHEN label = 1 AND {_u('drop-frq')} < 0.5 THEN 0e0 ELSE frq END, 6) AS frq FROM v_scored")
def dropout(spark, d):
    return S.dropout(scored(spark, d), "id", "label", {"consequence": "", "frq": 0.0}, 0.5).select("id", "consequence", F.round("frq", 6).alias("frq"))


@query("t07_resample", f"WITH {V_SCORED}, c AS (SELECT 0.5/sum(label) AS wp, 0.5/sum(1-label) AS wn FROM v_scored) SELECT id, label FROM v_scored, c WHERE {_u('resample')} < CASE WHEN label = 1 THEN wp ELSE wn END / greatest(wp, wn)")
def resample(spark, d):
    return S.resample(scored(spark, d), "id", "label", 0.5).select("id", "label")


@query("t08_interleave", f"WITH {V_SCORED}, c AS (SELECT sum(label) AS p, sum(1-label) AS n FROM v_scored), k AS (SELECT greatest(1, ceil(n/p::DOUBLE))::BIGINT AS k FROM c) SELECT id, unnest(range(CASE WHEN label = 1 THEN k ELSE 1 END))::BIGINT AS copy FROM v_scored, k")
def interleave(spark, d):
    rows = scored(spark, d)
    n = rows.agg(F.sum(F.col("label")).alias("p"), F.sum(1 - F.col("label")).alias("n")).first()
    times = max(1, -(-n["n"] // max(1, n["p"])))
    return rows.select("id", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("label") == 1, F.lit(times - 1)).otherwise(F.lit(0)).cast("long"))).alias("copy"))


@query(
    "t08_weighted_interleave",
    f"""WITH {V_SCORED}, c AS (SELECT sum(label)::BIGINT AS p, sum(1-label)::BIGINT AS n, greatest(1, (n - p) // p)::BIGINT AS k FROM v_scored),
    s AS (SELECT id, 0 AS y, 0 AS copy FROM v_scored WHERE label = 0 UNION ALL SELECT id, 1, unnest(range(k))::INTEGER FROM v_scored, c WHERE label = 1),
    l AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY copy, {_u('interleave', "id::VARCHAR || '-' || copy")}, id) - 1 AS place FROM s),
    d AS (SELECT t, CASE WHEN {_u('interleave-class', 't')} < 0.5 THEN 1 ELSE 0 END AS y FROM (SELECT unnest(range(n + k * p + 1)) AS t FROM c)),
    a AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY t) - 1 AS place FROM d), e AS (SELECT min(t) AS e FROM a, c WHERE place >= CASE WHEN y = 1 THEN k * p ELSE n END)
    SELECT t, id, y::INTEGER AS label, copy::INTEGER AS copy FROM a JOIN l USING (y, place), e WHERE t < e""",
)
def weighted_interleave(spark, d):
    """The two classes as one stream, a draw picks the class, until one of them runs out."""
    return S.interleave(scored(spark, d), "id", "label", 0.5).select("t", "id", "label", "copy")


@query("t09_weights", f"WITH {V_SCORED} SELECT id, CASE WHEN label = 1 AND (coalesce(frq,0)+coalesce(frq2,0)+coalesce(frq3,0))/3 <= 5e-4 THEN 8e2 ELSE 1e0 END * CASE WHEN label = 0 AND coalesce(frq,0) >= 5e-4 THEN 16e2 ELSE 1e0 END AS weight FROM v_scored")
def weights(spark, d):
    return scored(spark, d).select("id", S.variant_weight(F.col("label"), [F.col("frq"), F.col("frq2"), F.col("frq3")]).alias("weight"))


@query("t11_balanced", f"WITH {V_SCORED}, c AS (SELECT count(*) AS n, sum(label) AS p FROM v_scored) SELECT id, round(n / (2e0 * CASE WHEN label = 1 THEN p ELSE n - p END), 6) AS weight FROM v_scored, c")
def balanced(spark, d):
    rows = scored(spark, d)
    w = S.class_balance(rows, F.col("label")).select("w_pos", "w_neg")
    return rows.crossJoin(F.broadcast(w)).select("id", F.round(F.when(F.col("label") == 1, F.col("w_pos")).otherwise(F.col("w_neg")), 6).alias("weight"))  # one row


@query("t12_fixed", f"WITH {V_SCORED}, c AS (SELECT avg(label) AS q FROM v_scored) SELECT id, round(CASE WHEN label = 1 THEN 100*0.5/q ELSE q/0.5 END, 6) AS weight FROM v_scored, c")
def fixed(spark, d):
    rows = scored(spark, d)
    q = F.col("q")
    return rows.crossJoin(F.broadcast(rows.agg(F.avg(F.col("label")).alias("q")))).select("id", F.round(F.when(F.col("label") == 1, 50.0 / q).otherwise(q / 0.5), 6).alias("weight"))


@query("t13_batches", f"WITH {V_SCORED} SELECT id, (row_number() OVER (ORDER BY {_u('shuffle')}, id) - 1) // 160 AS batch FROM v_scored")
def batches(spark, d):
    rows = scored(spark, d).select("id").withColumn("u", draw(F.col("id"), "shuffle"))
    return S.chunks(rows, [F.col("u"), F.col("id")], 160).select("id", F.col("chunk").alias("batch"))
