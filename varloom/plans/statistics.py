"""Queries over scores and labels: matrices, metrics, sweeps, curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from varloom.functions import metrics as M
from varloom.operators import thresholds as T
from varloom.plans.registry import ORACLE_SQL, query
from varloom.plans.records import TERMS
from varloom.plans.vehicles import V_CLNSIG, V_SCORED, choose, clnsig, from_array, scored, table

CUT = 0.1

_PRED = f"{V_SCORED}, p AS (SELECT *, CASE WHEN score_a >= 0.1 THEN 1 ELSE 0 END AS pred FROM v_scored)"
_CELLS = "sum(CASE WHEN pred = 1 AND label = 1 THEN 1 ELSE 0 END)::BIGINT AS tp, sum(CASE WHEN pred = 0 AND label = 0 THEN 1 ELSE 0 END)::BIGINT AS tn, sum(CASE WHEN pred = 1 AND label = 0 THEN 1 ELSE 0 END)::BIGINT AS fp, sum(CASE WHEN pred = 0 AND label = 1 THEN 1 ELSE 0 END)::BIGINT AS fn"
_BY = f"WITH {_PRED}, cm AS (SELECT consequence, dataset, {_CELLS} FROM p GROUP BY consequence, dataset)"
_MCC_ROOT = "sqrt((tp+fp)::DOUBLE*(tp+fn)*(tn+fp)*(tn+fn))"
MCC = f"CASE WHEN {_MCC_ROOT} = 0 THEN 0e0 ELSE (tp::DOUBLE*tn - fp::DOUBLE*fn) / {_MCC_ROOT} END"
F1 = "CASE WHEN 2*tp+fn+fp = 0 THEN 0e0 ELSE 2*tp/(2*tp+fn+fp)::DOUBLE END"


def _rep(c: str) -> str:
    return f"(CASE WHEN (tp+fp)*(tp+fn)*(tn+fp)*(tn+fn) = 0 AND {c} = 0 THEN 1e-6 ELSE {c}::DOUBLE END)"


_T, _N, _F, _M = map(_rep, ("tp", "tn", "fp", "fn"))
MCC_SCORE = f"(({_T}*{_N} - {_F}*{_M}) / sqrt(({_T}+{_F})*({_T}+{_M})*({_N}+{_F})*({_N}+{_M})) + 1) / 2"
PRECISION = "CASE WHEN tp+fp = 0 THEN 0e0 ELSE tp/(tp+fp)::DOUBLE END"
RECALL = "CASE WHEN tp+fn = 0 THEN 0e0 ELSE tp/(tp+fn)::DOUBLE END"


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


def _predicted(spark, d):
    return scored(spark, d).withColumn("pred", F.when(F.col("score_a") >= CUT, 1).otherwise(0))


def _matrix(spark, d):
    return _predicted(spark, d).groupBy("consequence", "dataset").agg(*M.confusion(F.col("pred"), F.col("label")))


@query("a01_confusion", f"{_BY} SELECT * FROM cm")
def confusion(spark, d):
    return _matrix(spark, d)


@query("a02_add_matrices", f"{_BY} SELECT dataset, sum(tp)::BIGINT AS tp, sum(tn)::BIGINT AS tn, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM cm GROUP BY dataset")
def add_matrices(spark, d):
    return _matrix(spark, d).groupBy("dataset").agg(*[F.sum(c).alias(c) for c in T.CELLS])


@query("a03_fbeta", f"{_BY} SELECT consequence, dataset, round({F1}, 6) AS f1, round(CASE WHEN 5*tp+4*fn+fp = 0 THEN 0e0 ELSE 5*tp/(5*tp+4*fn+fp)::DOUBLE END, 6) AS f2 FROM cm")
def fbeta(spark, d):
    return _matrix(spark, d).select("consequence", "dataset", F.round(M.f_beta(F.col("tp"), F.col("fp"), F.col("fn")), 6).alias("f1"), F.round(M.f_beta(F.col("tp"), F.col("fp"), F.col("fn"), 2.0), 6).alias("f2"))


@query("a04_mcc_norm", f"{_BY} SELECT consequence, dataset, round({MCC_SCORE}, 6) AS mcc_score FROM cm")
def mcc_norm(spark, d):
    return _matrix(spark, d).select("consequence", "dataset", F.round(M.mcc_normalised(F.col("tp"), F.col("tn"), F.col("fp"), F.col("fn")), 6).alias("mcc_score"))


@query("a05_mcc_f1", f"{_BY} SELECT consequence, dataset, round({MCC}, 6) AS mcc, round({F1}, 6) AS f1 FROM cm")
def mcc_f1(spark, d):
    return T.with_metrics(_matrix(spark, d)).select("consequence", "dataset", *r6("mcc", "f1"))


@query("a06_roc_point", f"{_BY} SELECT consequence, dataset, round(CASE WHEN fp+tn = 0 THEN 0e0 ELSE fp/(fp+tn)::DOUBLE END, 6) AS fpr, round({RECALL}, 6) AS tpr FROM cm")
def roc_point(spark, d):
    return T.with_metrics(_matrix(spark, d)).select("consequence", "dataset", *r6("fpr", "tpr"))


@query(
    "a07_rates",
    f"""{_BY} SELECT consequence, dataset, round({PRECISION}, 6) AS "precision", round({RECALL}, 6) AS recall, round(CASE WHEN tp+fn = 0 THEN NULL ELSE fn/(tp+fn)::DOUBLE END, 6) AS fnr,
    round((tp+tn)/(tp+tn+fp+fn)::DOUBLE, 6) AS accuracy,
    round(CASE WHEN tp+fn = 0 THEN tn/(tn+fp)::DOUBLE WHEN tn+fp = 0 THEN tp/(tp+fn)::DOUBLE ELSE (tp/(tp+fn)::DOUBLE + tn/(tn+fp)::DOUBLE)/2 END, 6) AS balanced_accuracy FROM cm""",
)
def rates(spark, d):
    return T.with_metrics(_matrix(spark, d)).select("consequence", "dataset", *r6("precision", "recall", "fnr", "accuracy", "balanced_accuracy"))


_GRID = "g AS (SELECT i::INTEGER AS i, i / 49e0 AS threshold FROM range(50) r(i))"
_SWEPT = f"""WITH {V_SCORED}, {_GRID}, p AS (SELECT i, threshold, label, CASE WHEN score_a >= threshold THEN 1 ELSE 0 END AS pred FROM v_scored CROSS JOIN g),
    cm AS (SELECT i, threshold, {_CELLS} FROM p GROUP BY i, threshold)"""


def _swept(spark, d):
    return T.sweep(scored(spark, d), F.col("score_a"), F.col("label"), [i / 49.0 for i in range(50)])


@query("a08_sweep_grid", f"""{_SWEPT} SELECT i, round(threshold, 6) AS threshold, tp, tn, fp, fn, round({F1}, 6) AS f1, round({PRECISION}, 6) AS "precision", round({RECALL}, 6) AS recall, round({MCC}, 6) AS mcc FROM cm""")
def sweep_grid(spark, d):
    return T.with_metrics(_swept(spark, d)).select("i", *r6("threshold"), *T.CELLS, *r6("f1", "precision", "recall", "mcc"))


_DATA_GRID = f"""WITH {V_SCORED}, e AS (SELECT min(score_b) AS lo, max(score_b) AS hi, 1.1e0*max(score_b) - min(score_b) AS m FROM v_scored),
    g AS (SELECT i::INTEGER AS i, (lo - 0.1e0*m) + ((1.1e0*hi + 0.1e0*m) - (lo - 0.1e0*m)) * i / 99e0 AS threshold FROM e, range(100) r(i)),
    p AS (SELECT i, threshold, label, CASE WHEN score_b >= threshold THEN 1 ELSE 0 END AS pred FROM v_scored CROSS JOIN g),
    cm AS (SELECT i, threshold, {_CELLS} FROM p GROUP BY i, threshold)"""


def _data_swept(spark, d):
    rows = scored(spark, d)
    return T.sweep(rows.crossJoin(F.broadcast(T.data_grid(rows, F.col("score_b")))), F.col("score_b"), F.col("label"), F.col("steps"))  # one row of 100 numbers


@query("a09_sweep_data", f"{_DATA_GRID} SELECT i, round(threshold, 6) AS threshold, tp, tn, fp, fn FROM cm")
def sweep_data(spark, d):
    return _data_swept(spark, d).select("i", *r6("threshold"), *T.CELLS)


@query(
    "a10_optimum",
    f"""{_DATA_GRID}, m AS (SELECT threshold, round({MCC_SCORE}, 6) AS mcc_score FROM cm), b AS (SELECT max(mcc_score) AS best FROM m)
    SELECT best, count(*) AS ties, round(avg(threshold), 6) AS mean_threshold FROM m JOIN b ON mcc_score = best GROUP BY best""",
)
def optimum(spark, d):
    points = T.with_metrics(_data_swept(spark, d)).withColumn("mcc_score", F.round("mcc_score", 6))
    return T.optimum(points, "mcc_score").select("best", F.size("thresholds").cast("long").alias("ties"), *r6("mean_threshold"))


@query(
    "a11_auc",
    f"""{_SWEPT}, q AS (SELECT i, fp/nullif(fp+tn,0)::DOUBLE AS fpr, tp/nullif(tp+fn,0)::DOUBLE AS tpr FROM cm),
    t AS (SELECT (fpr - lag(fpr) OVER (ORDER BY i)) * (tpr + lag(tpr) OVER (ORDER BY i)) / 2 AS a FROM q) SELECT round(abs(sum(a)), 6) AS auc FROM t""",
)
def auc(spark, d):
    return T.trapezoid(T.with_metrics(_swept(spark, d)), "fpr", "tpr", "i").select(*r6("auc"))


@query(
    "a12_fold_stats",
    f"""WITH {V_SCORED}, n AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS k FROM v_scored), c AS (SELECT count(*) AS n, greatest(1, count(*)//10) AS size FROM v_scored),
    f AS (SELECT n.*, k // size AS fold FROM n, c WHERE k // size < c.n // size), g AS (SELECT i::INTEGER AS i, i/20e0 AS threshold FROM range(20) r(i)),
    p AS (SELECT fold, i, label, CASE WHEN score_b >= threshold THEN 1 ELSE 0 END AS pred FROM f CROSS JOIN g), cm AS (SELECT fold, i, {_CELLS} FROM p GROUP BY fold, i),
    m AS (SELECT i, {MCC_SCORE} AS mcc_score, {F1} AS f1 FROM cm)
    SELECT i, round(avg(mcc_score), 6) AS mcc_mean, round(stddev_pop(mcc_score), 6) AS mcc_std, round(avg(f1), 6) AS f1_mean, round(stddev_pop(f1), 6) AS f1_std FROM m GROUP BY i""",
)
def fold_stats(spark, d):
    from varloom.operators.splits import folds

    per_fold = T.with_metrics(T.sweep(folds(scored(spark, d), [F.col("id")]), F.col("score_b"), F.col("label"), [i / 20.0 for i in range(20)], by=["fold"]))
    return per_fold.groupBy("i").agg(
        F.round(F.avg("mcc_score"), 6).alias("mcc_mean"), F.round(F.stddev_pop("mcc_score"), 6).alias("mcc_std"), F.round(F.avg("f1"), 6).alias("f1_mean"), F.round(F.stddev_pop("f1"), 6).alias("f1_std")
    )


_CURVE = f"""WITH {V_SCORED}, s AS (SELECT score_a AS score, sum(label)::BIGINT AS p, sum(1-label)::BIGINT AS n FROM v_scored GROUP BY 1),
    c AS (SELECT score, p, n, sum(p) OVER (ORDER BY score DESC)::BIGINT AS cum_tp, sum(n) OVER (ORDER BY score DESC)::BIGINT AS cum_fp FROM s)"""


@query("a13_roc_exact", f"{_CURVE} SELECT round(sum(n*(cum_tp - p/2e0))/(sum(p)*sum(n)), 6) AS auc, sum(p)::BIGINT AS positives, sum(n)::BIGINT AS negatives FROM c")
def roc_exact(spark, d):
    return T.roc_auc(scored(spark, d), F.col("score_a"), F.col("label")).select(*r6("auc"), "positives", "negatives")


@query("w04_cumulative", f"{_CURVE} SELECT round(score, 6) AS score, cum_tp, cum_fp FROM c")
def cumulative(spark, d):
    return T.roc_curve(scored(spark, d), F.col("score_a"), F.col("label")).select(*r6("score"), "cum_tp", "cum_fp")


@query("a14_toc", f"""{_SWEPT} SELECT i, tp AS hits, tp + fp AS flagged, least(tp+fn, tp+fp) AS upper_bound, greatest(0, tp+fp-(fp+tn)) AS lower_bound, round((tp+fp)*(tp+fn)/(tp+tn+fp+fn)::DOUBLE, 6) AS uniform_hits FROM cm""")
def toc(spark, d):
    n, pos = F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"), F.col("tp") + F.col("fn")
    return _swept(spark, d).select("i", F.col("tp").alias("hits"), (F.col("tp") + F.col("fp")).alias("flagged"), F.least(pos, F.col("tp") + F.col("fp")).alias("upper_bound"), F.greatest(F.lit(0).cast("long"), F.col("tp") + F.col("fp") - (F.col("fp") + F.col("tn"))).alias("lower_bound"), F.round((F.col("tp") + F.col("fp")) * pos / n, 6).alias("uniform_hits"))


@query("a15_recall_constrained", f"""{_SWEPT} SELECT max(threshold) AS best_threshold, round(max({MCC}), 6) AS best_mcc, round(max({PRECISION}), 6) AS best_precision FROM cm WHERE {RECALL} >= 0.5""")
def recall_constrained(spark, d):
    return T.with_metrics(_swept(spark, d)).where("recall >= 0.5").agg(F.max("threshold").alias("best_threshold"), F.round(F.max("mcc"), 6).alias("best_mcc"), F.round(F.max("precision"), 6).alias("best_precision"))


@query("a16_label_ratio", f"WITH {V_SCORED} SELECT dataset, label, count(*) AS n, round(count(*)/sum(count(*)) OVER (PARTITION BY dataset), 6) AS ratio FROM v_scored GROUP BY dataset, label")
def label_ratio(spark, d):
    from pyspark.sql import Window

    counts = scored(spark, d).groupBy("dataset", "label").agg(F.count("*").alias("n"))  # a row a set and label
    return counts.withColumn("ratio", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("dataset")), 6))


@query("a25_class_balance", f"WITH {V_SCORED}, c AS (SELECT sum(label)::DOUBLE AS p, sum(1-label)::DOUBLE AS n FROM v_scored) SELECT p::BIGINT AS n_pos, n::BIGINT AS n_neg, round(ln(p/n), 6) AS bias, round((p+n)/(2*p), 6) AS w_pos, round((p+n)/(2*n), 6) AS w_neg FROM c")
def class_balance(spark, d):
    from varloom.operators.splits import class_balance as balance

    return balance(scored(spark, d), F.col("label")).select("n_pos", "n_neg", *r6("bias", "w_pos", "w_neg"))


#: Consequence terms and clinical patterns by which scores are stratified.
STRATA = (
    "missense_variant", "downstream_gene_variant", "upstream_gene_variant", "intron_variant", "non_coding_transcript_exon_variant", "splice_donor_variant", "splice_donor_region_variant", "splice_region_variant",
    "5_prime_UTR_variant", "splice_polypyrimidine_tract_variant", "3_prime_UTR_variant", "synonymous_variant", "frameshift_variant", "stop_gained", "splice_acceptor_variant", "splice_donor_5th_base_variant",
    "stop_lost", "protein_altering_variant", "inframe_insertion", "inframe_deletion", "transcript_ablation", "start_lost", "stop_retained_variant", "coding_sequence_variant", "mature_miRNA_variant",
    "incomplete_terminal_codon_variant",
)
CLINICAL_STRATA = {"clinvar_pathogenic": "pathogenic|Pathogenic", "clinvar_benign": "benign|Benign"}


@query(
    "a30_strata_regex",
    "WITH "
    + V_CLNSIG
    + f", b AS (SELECT p_partkey AS id, {choose('p_partkey', TERMS)} AS consequence, CASE WHEN p_size >= 25 THEN 1 ELSE 0 END AS pred, CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS label FROM part), "
    + "t AS (SELECT unnest(["
    + ", ".join(f"'{t}'" for t in STRATA)
    + "]) AS term), p AS (SELECT term, pred, label FROM b JOIN t ON regexp_full_match(consequence, '.*(' || term || ').*') UNION ALL SELECT 'clinvar_pathogenic', pred, label FROM b JOIN v_clnsig USING (id) WHERE regexp_matches(clnsig, 'pathogenic|Pathogenic') "
    + f"UNION ALL SELECT 'clinvar_benign', pred, label FROM b JOIN v_clnsig USING (id) WHERE regexp_matches(clnsig, 'benign|Benign')), cm AS (SELECT term, {_CELLS} FROM p GROUP BY term) SELECT term, tp+tn+fp+fn AS size, round({F1}, 6) AS f1 FROM cm",
)
def strata_regex(spark, d):
    rows = table(spark, d, "part").selectExpr("p_partkey AS id", f"{from_array('p_partkey', TERMS)} AS consequence", "CASE WHEN p_size >= 25 THEN 1 ELSE 0 END AS pred", "CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS label")
    rows = rows.join(clnsig(spark, d).select("id", "clnsig"), "id")
    strata = {t: F.col("consequence").contains(t) for t in STRATA} | {n: F.col("clnsig").rlike(p) for n, p in CLINICAL_STRATA.items()}
    return T.stratified(rows, strata, F.col("pred"), F.col("label")).where("size > 0").select("term", "size", F.round("f1", 6).alias("f1"))


@query(
    "a31_strata_frequency",
    f"""WITH {_PRED}, q AS (SELECT *, CASE WHEN frq <= 5e-4 THEN 'rare' ELSE 'common' END AS stratum FROM p WHERE frq > 0), cm AS (SELECT stratum, {_CELLS} FROM q GROUP BY stratum)
    SELECT stratum, tp+tn+fp+fn AS size, round({F1}, 6) AS f1 FROM cm""",
)
def strata_frequency(spark, d):
    rows = _predicted(spark, d).where("frq > 0").withColumn("stratum", F.when(F.col("frq") <= 5e-4, "rare").otherwise("common"))
    return rows.groupBy("stratum").agg(*M.confusion(F.col("pred"), F.col("label"))).select("stratum", (F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")).alias("size"), F.round(M.f_beta(F.col("tp"), F.col("fp"), F.col("fn")), 6).alias("f1"))


@query(
    "a32_rare_unsupported",
    f"""WITH {_PRED}, q AS (SELECT * FROM p WHERE frq > 0 AND frq <= 5e-4 AND frq2 IS NULL), cm AS (SELECT {_CELLS} FROM q) SELECT tp+tn+fp+fn AS size, round({F1}, 6) AS f1 FROM cm""",
)
def rare_unsupported(spark, d):
    rows = _predicted(spark, d).where("frq > 0 AND frq <= 5e-4 AND frq2 IS NULL")
    return rows.agg(*M.confusion(F.col("pred"), F.col("label"))).select((F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")).alias("size"), F.round(M.f_beta(F.col("tp"), F.col("fp"), F.col("fn")), 6).alias("f1"))


@query("a33_baseline_panel", f"""WITH {_PRED}, cm AS (SELECT dataset, {_CELLS} FROM p GROUP BY dataset),
    s AS (SELECT dataset, score_a, sum(label)::DOUBLE AS p, sum(1-label)::DOUBLE AS n FROM v_scored GROUP BY 1, 2), c AS (SELECT *, sum(n) OVER (PARTITION BY dataset ORDER BY score_a) AS upto FROM s),
    u AS (SELECT dataset, round(sum(p*(upto - n/2))/(sum(p)*sum(n)), 6) AS auc FROM c GROUP BY dataset) SELECT dataset, auc, tp, tn, fp, fn, round({PRECISION}, 6) AS "precision", round({RECALL}, 6) AS recall, round({F1}, 6) AS f1, round({MCC}, 6) AS mcc FROM cm JOIN u USING (dataset)""")
def baseline_panel(spark, d):
    rows = _predicted(spark, d)
    cm = T.with_metrics(rows.groupBy("dataset").agg(*M.confusion(F.col("pred"), F.col("label"))))
    return cm.join(T.roc_auc_by(rows, "score_a", "label", ["dataset"]), "dataset").select("dataset", *r6("auc"), *T.CELLS, *r6("precision", "recall", "f1", "mcc"))


_CORNERS = "unnest([1e0, 1.5e0, 2e0, 2.5e0, 3e0])"


@query(
    "m06_grid_search",
    f"""WITH {V_SCORED}, g AS (SELECT w, b FROM (SELECT {_CORNERS} AS w), (SELECT unnest([-1.5e0, -0.95e0, -0.5e0, -0.1e0, 0e0]) AS b)),
    p AS (SELECT w, b, label, CASE WHEN score_a * least(1e0, greatest(0e0, w*score_b + b)) >= 0.05 THEN 1 ELSE 0 END AS pred FROM v_scored, g), cm AS (SELECT w, b, {_CELLS} FROM p GROUP BY w, b)
    SELECT w, b, tp, tn, fp, fn, round({MCC}, 6) AS mcc FROM cm""",
)
def grid_search(spark, d):
    """The gate's slope and offset over a grid, each point's Matthews correlation; one pass, partial sums of 25 matrices a task."""
    return T.with_metrics(T.gate_grid(scored(spark, d), "score_a", "score_b", "label", [1.0, 1.5, 2.0, 2.5, 3.0], [-1.5, -0.95, -0.5, -0.1, 0.0], 0.05)).select("w", "b", *T.CELLS, *r6("mcc"))


_DRAWS, _SEARCH = 40, {"w": (0.0, 4.0), "b": (-2.0, 0.0)}
_DRAWN = "(cast('0x' || substr(md5(concat(i::VARCHAR, ':search-{n}')), 1, 8) AS BIGINT) / 4294967296e0)"


@query(
    "m06_random_search",
    f"""WITH {V_SCORED}, g AS (SELECT i::INTEGER AS draw, 0e0 + {_DRAWN.format(n='w')} * 4e0 AS w, -2e0 + {_DRAWN.format(n='b')} * 2e0 AS b FROM range({_DRAWS}) r(i)),
    p AS (SELECT draw, w, b, label, CASE WHEN score_a * least(1e0, greatest(0e0, w*score_b + b)) >= 0.05 THEN 1 ELSE 0 END AS pred FROM v_scored, g WHERE dataset = 'test'),
    cm AS (SELECT draw, w, b, {_CELLS} FROM p GROUP BY draw, w, b), o AS (SELECT draw, w, b, 1 - {MCC} AS objective FROM cm)
    SELECT draw, round(w, 6) AS w, round(b, 6) AS b, round(objective, 6) AS objective, draw = (SELECT arg_min(draw, (objective, draw)) FROM o) AS best FROM o""",
)
def random_search(spark, d):
    """Slopes and offsets of the gate drawn at random, judged by 1 - MCC on the rows of the other set; the smallest objective wins, the first of equals."""
    from varloom.operators.modelling import drawn_parameters

    points = [(p["w"], p["b"]) for p in drawn_parameters(_SEARCH, _DRAWS)]
    tried = T.with_metrics(T.gate_points(scored(spark, d).where("dataset = 'test'"), "score_a", "score_b", "label", points, 0.05))
    tried = tried.select(F.col("i").alias("draw"), "w", "b", (1 - F.col("mcc")).alias("objective"))
    best = tried.agg(F.min(F.struct("objective", "draw")).alias("top"))
    return tried.crossJoin(F.broadcast(best)).select("draw", *r6("w", "b", "objective"), (F.col("draw") == F.col("top.draw")).alias("best"))  # one row


_SPECS = {"mcc_all": ("TRUE", MCC), "f1_all": ("TRUE", F1), "recall_rare": ("frq <= 5e-4", RECALL), "mcc_rare": ("frq <= 5e-4", MCC), "precision_unsupported": ("frq > 0 AND frq2 IS NULL", PRECISION), "recall_purchase": ("consequence LIKE 'purch%'", RECALL)}


@query(
    "x05_metric_specs",
    f"WITH {_PRED} " + " UNION ALL ".join(f"SELECT dataset, '{n}' AS name, tp+tn+fp+fn AS size, round(({m})::DOUBLE, 6) AS value FROM (SELECT dataset, {_CELLS} FROM (SELECT dataset, pred, CASE WHEN {w} THEN label END AS label FROM p) GROUP BY dataset)" for n, (w, m) in _SPECS.items()),
)
def metric_specs(spark, d):
    """Different metrics of different strata, for each set, in one pass."""
    specs = [T.MetricSpec(n, None if where == "TRUE" else F.expr(where), T.METRICS[n.split("_")[0]]) for n, (where, _) in _SPECS.items()]
    return T.metric_specs(_predicted(spark, d), specs, F.col("pred"), F.col("label"), ["dataset"]).select("dataset", "name", "size", *r6("value"))


@query("p21_low_cap", f"WITH {V_SCORED} SELECT id, score_a < 0.2 AND greatest(score_a, 0.2e0) = 0.2 AS capped FROM v_scored")
def low_cap(spark, d):
    from varloom.functions import parsing as P

    return scored(spark, d).select("id", P.capped_low(F.col("score_a"), F.greatest("score_a", F.lit(0.2)), F.lit(0.2)).alias("capped"))


@query("a42_log_loss", f"WITH {V_SCORED} SELECT dataset, round(-avg(label*ln(least(1-1e-7, greatest(1e-7, score_b))) + (1-label)*ln(1-least(1-1e-7, greatest(1e-7, score_b)))), 6) AS loss FROM v_scored GROUP BY dataset")
def log_loss(spark, d):
    return scored(spark, d).groupBy("dataset").agg(F.round(M.log_loss(F.col("score_b"), F.col("label")), 6).alias("loss"))


@query("p17_threshold_class", f"WITH {V_SCORED} SELECT id, CASE WHEN score_a >= 0.1 THEN 1e0 ELSE 0e0 END AS class FROM v_scored")
def threshold_class(spark, d):
    return scored(spark, d).select("id", F.when(F.col("score_a") >= 0.1, 1.0).otherwise(0.0).alias("class"))


@query("p18_outcome", f"WITH {_PRED} SELECT id, CASE WHEN pred=1 AND label=1 THEN 'TP' WHEN pred=0 AND label=0 THEN 'TN' WHEN pred=1 THEN 'FP' ELSE 'FN' END AS outcome FROM p")
def outcome(spark, d):
    return _predicted(spark, d).select("id", M.outcome(F.col("pred"), F.col("label")).alias("outcome"))


@query("p19_residual", f"WITH {V_SCORED} SELECT id, round(label - score_a, 6) AS residual, round(score_a - score_b, 6) AS score_gap FROM v_scored")
def residual(spark, d):
    return scored(spark, d).select("id", F.round(F.col("label") - F.col("score_a"), 6).alias("residual"), F.round(F.col("score_a") - F.col("score_b"), 6).alias("score_gap"))


@query("p20_minmax", f"WITH {V_SCORED}, e AS (SELECT min(score_a) AS lo, max(score_a) AS hi FROM v_scored) SELECT id, round((score_a-lo)/(hi-lo), 6) AS scaled FROM v_scored, e")
def minmax(spark, d):
    rows = scored(spark, d)
    ends = rows.agg(F.min(F.col("score_a")).alias("lo"), F.max(F.col("score_a")).alias("hi"))
    return rows.crossJoin(F.broadcast(ends)).select("id", F.round(F.try_divide(F.col("score_a") - F.col("lo"), F.col("hi") - F.col("lo")), 6).alias("scaled"))


@query("p36_gate", f"WITH {V_SCORED} SELECT id, round(score_a*least(1e0, greatest(0e0, 2e0*score_b-0.95e0)), 6) AS combined FROM v_scored")
def gate(spark, d):
    return scored(spark, d).select("id", F.round(M.gate(F.col("score_a"), F.col("score_b")), 6).alias("combined"))


@query("p37_harmonic", f"WITH {V_SCORED} SELECT id, round(coalesce(2*score_a*score_b/nullif(score_a+score_b, 0), 0), 6) AS mean_score FROM v_scored")
def harmonic(spark, d):
    return scored(spark, d).select("id", F.round(M.harmonic(F.col("score_a"), F.col("score_b")), 6).alias("mean_score"))


@query("p38_sigmoid", f"WITH {V_SCORED} SELECT id, round(1/(1+exp(-(4e0*score_b-2e0))), 6) AS calibrated FROM v_scored")
def sigmoid(spark, d):
    return scored(spark, d).select("id", F.round(M.sigmoid(F.col("score_b"), 4.0, -2.0), 6).alias("calibrated"))


@query("f02_frq_max", f"WITH {V_SCORED} SELECT id FROM v_scored WHERE greatest(coalesce(frq,0), coalesce(frq2,0), coalesce(frq3,0)) <= 5e-4")
def frq_max(spark, d):
    from varloom.operators.ranking import rare

    return scored(spark, d).where(rare(5e-4)).select("id")


@query("f03_frq_single", f"WITH {V_SCORED} SELECT id FROM v_scored WHERE coalesce(frq, 0) <= 5e-4")
def frq_single(spark, d):
    return scored(spark, d).where("coalesce(frq, 0) <= 5e-4").select("id")


@query("f07_rare_nosupport", f"WITH {V_SCORED} SELECT id FROM v_scored WHERE frq > 0 AND frq <= 5e-4 AND frq2 IS NULL")
def rare_nosupport(spark, d):
    return scored(spark, d).where("frq > 0 AND frq <= 5e-4 AND frq2 IS NULL").select("id")


@query("f10_drop_null", f"WITH {V_SCORED} SELECT count(*) AS rows_in, count(CASE WHEN frq IS NOT NULL AND frq2 IS NOT NULL AND frq3 IS NOT NULL THEN 1 END) AS kept FROM v_scored")
def drop_null(spark, d):
    full = F.col("frq").isNotNull() & F.col("frq2").isNotNull() & F.col("frq3").isNotNull()
    return scored(spark, d).agg(F.count("*").alias("rows_in"), F.count_if(full).alias("kept"))


@query("m09_stream_counters", f"WITH {_PRED}, e AS (SELECT p.*, time_bucket(INTERVAL 1 DAY, events.ts) AS epoch FROM p JOIN events ON event_id = id) SELECT strftime(epoch, '%Y-%m-%d') AS epoch, {_CELLS} FROM e GROUP BY 1")
def stream_counters(spark, d):
    from varloom.streaming.counters import batch_counters

    return batch_counters(spark.read.parquet(f"{d}/events.parquet"))


@query("m09_stream_updates", ORACLE_SQL["m09_stream_counters"])
def stream_updates(spark, d):
    """The same counters by the stream itself, run over all events that are there, its sink read back."""
    from varloom.streaming.counters import drained_counters

    return drained_counters(spark, f"{d}/events.parquet")
