"""Queries that profile data sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from varloom.functions import parsing as P
from varloom.operators import profiles as O
from varloom.plans.registry import query
from varloom.plans.vehicles import V_SCORED, V_WIDE, WIDE_COLUMNS, scored, table, wide

COLS = WIDE_COLUMNS
_LONG = f"WITH {V_WIDE}, u AS (SELECT * FROM (SELECT id, label, dataset, case_id, quantity::DOUBLE AS quantity, price::DOUBLE AS price, discount::DOUBLE AS discount, tax::DOUBLE AS tax FROM v_wide) UNPIVOT INCLUDE NULLS (x FOR feature IN (quantity, price, discount, tax)))"


def r(*names, n=6):
    return [F.round(c, n).alias(c) for c in names]


@query("a17_missing_ratio", f"{_LONG} SELECT dataset, label, feature, round(avg(CASE WHEN x IS NULL THEN 1 ELSE 0 END), 6) AS ratio FROM u GROUP BY GROUPING SETS ((dataset, feature), (dataset, label, feature))")
def missing_ratio(spark, d):
    return O.missing_ratio(wide(spark, d), COLS, "dataset", "label").select("dataset", "label", "feature", *r("ratio"))


@query("a18_shares", f"WITH {V_WIDE} SELECT round(avg(CASE WHEN quantity IS NULL THEN 0 ELSE 1 END), 6) AS kept, round(avg(CASE WHEN quantity IS NULL THEN 1 ELSE 0 END), 6) AS dropped FROM v_wide")
def shares(spark, d):
    given = F.col("quantity").isNotNull().cast("int")
    return wide(spark, d).agg(F.round(F.avg(given), 6).alias("kept"), F.round(F.avg(1 - given), 6).alias("dropped"))


@query("a19_word_occurrence", f"WITH {V_SCORED}, t AS (SELECT consequence AS t, label, count(*) AS c FROM v_scored GROUP BY ALL) SELECT v.t AS value, t.label, sum(c)::BIGINT AS n FROM t JOIN (SELECT DISTINCT t FROM t) v ON contains(t.t, v.t) GROUP BY ALL")
def word_occurrence(spark, d):
    return O.word_occurrence(scored(spark, d), "consequence", "label")


@query("a20_correlation", "WITH " + V_WIDE + ", " + ", ".join(f"c{i}{j} AS (SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM v_wide WHERE {a} IS NOT NULL AND {b} IS NOT NULL)" for i, a in enumerate(COLS) for j, b in enumerate(COLS[:i])) + ", al AS (" + " UNION ALL ".join(f"SELECT * FROM c{i}{j}" for i, a in enumerate(COLS) for j, b in enumerate(COLS[:i])) + ") SELECT a, b, round(r, 6) + 0 AS r FROM al")
def correlation(spark, d):
    return O.correlations(wide(spark, d), COLS).select("a", "b", (F.round("r", 6) + 0).alias("r"))


@query("a21_box_summary", f"{_LONG} SELECT dataset, feature, min(x) AS low, round(quantile_cont(x, 0.25), 6) AS q1, round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.75), 6) AS q3, max(x) AS high FROM u WHERE x IS NOT NULL GROUP BY dataset, feature")
def box_summary(spark, d):
    return O.box_summary(wide(spark, d), ["dataset"], COLS).select("dataset", "feature", "low", *r("q1", "median", "q3"), "high")


@query("a22_histogram", f"WITH {V_SCORED}, e AS (SELECT min(score_a) AS lo, max(score_a) AS hi FROM v_scored) SELECT label, least(999, floor((score_a - lo) / ((hi - lo) / 1000)))::INTEGER AS bin, count(*) AS n FROM v_scored, e WHERE score_a IS NOT NULL GROUP BY ALL")
def histogram(spark, d):
    return O.data_histogram(scored(spark, d), F.col("score_a"), 1000, ["label"])


@query(
    "s23_profile",
    f"WITH {V_SCORED}, s AS (SELECT dataset, id, consequence, label, frq FROM v_scored) SELECT dataset, 'id' AS \"column\", 'bigint' AS type, count(*) AS rows, count(id) AS given, coalesce(sum(strlen(id::VARCHAR)), 0)::BIGINT AS bytes FROM s GROUP BY dataset "
    "UNION ALL SELECT dataset, 'consequence', 'string', count(*), count(consequence), coalesce(sum(strlen(consequence)), 0)::BIGINT FROM s GROUP BY dataset UNION ALL SELECT dataset, 'label', 'int', count(*), count(label), coalesce(sum(strlen(label::VARCHAR)), 0)::BIGINT FROM s GROUP BY dataset",
)
def profile(spark, d):
    return O.dataset_profile(O.chosen_columns(scored(spark, d), ["dataset", "id", "consequence", "label"]), ["dataset"])


@query("f09_column_kinds", "SELECT column_name AS \"column\", CASE WHEN data_type IN ('VARCHAR') THEN 'text' ELSE 'number' END AS kind, (SELECT count(*) FROM orders) AS n FROM (DESCRIBE orders) t(column_name, data_type, a, b, c, e) WHERE data_type NOT LIKE 'TIMESTAMP%' AND data_type NOT LIKE 'DATE%'")
def column_kinds(spark, d):
    rows = table(spark, d, "orders")
    numbers = O.numeric_columns(rows)
    kinds = [F.struct(F.lit(c).alias("column"), F.lit("number" if c in numbers else "text").alias("kind")) for c, t in rows.dtypes if t not in ("timestamp", "timestamp_ntz", "date")]
    return rows.agg(F.count("*").alias("n")).select(F.inline(F.array(*kinds)), "n")


@query("a23_ecdf", f"WITH {V_SCORED} SELECT DISTINCT consequence, score_b, round(cume_dist() OVER (PARTITION BY consequence ORDER BY score_b), 6) AS share FROM v_scored")
def ecdf(spark, d):
    return O.ecdf(scored(spark, d), ["consequence"], "score_b").select("consequence", "score_b", *r("share"))


@query(
    "a24_kde",
    f"""WITH {V_SCORED}, h AS (SELECT least(999, floor(score_b / 0.001))::INTEGER AS bin, count(*) AS w FROM v_scored WHERE score_b BETWEEN 0 AND 1 GROUP BY 1), s AS (SELECT count(*) AS n, stddev_samp(score_b) * pow(count(*), -0.2) * 0.75 AS h FROM v_scored)
    SELECT i::INTEGER AS i, round(sum(w * exp(-pow((i/49e0 - (bin+0.5)*0.001)/s.h, 2)/2) / (n * s.h * 2.5066282746310002)), 5) AS density FROM h, s, range(50) g(i) GROUP BY i""",
)
def kde(spark, d):
    return O.density(scored(spark, d), F.col("score_b"), 0.0, 1.0).select("i", *r("density", n=5))


@query("a26_column_fit", f"{_LONG} SELECT feature, count(x) AS n, round(avg(x), 4) AS mean, round(var_pop(x), 2) AS var, round(stddev_samp(x), 4) AS std, min(x) AS low, max(x) AS high FROM u GROUP BY feature")
def column_fit(spark, d):
    return O.fit_columns(wide(spark, d), COLS).select("feature", "n", *r("mean", n=4), *r("var", n=2), *r("std", n=4), "low", "high")


@query("a34_missing_bias", f"WITH {V_SCORED}, u AS (SELECT 'frq' AS annotation, score_b FROM v_scored WHERE frq IS NULL UNION ALL SELECT 'frq2', score_b FROM v_scored WHERE frq2 IS NULL UNION ALL SELECT 'frq3', score_b FROM v_scored WHERE frq3 IS NULL) SELECT annotation, round(avg(score_b), 6) AS mean, round(stddev_samp(score_b), 6) AS std, count(*) AS n, abs(0.5 - avg(score_b)) >= 0.2 AS biased FROM u GROUP BY annotation")
def missing_bias(spark, d):
    gone = scored(spark, d).select("score_b", *[F.col(c).isNull().alias(c) for c in ("frq", "frq2", "frq3")]).unpivot(["score_b"], ["frq", "frq2", "frq3"], "annotation", "gone").where("gone")
    return gone.groupBy("annotation").agg(F.round(F.avg("score_b"), 6).alias("mean"), F.round(F.stddev_samp("score_b"), 6).alias("std"), F.count("*").alias("n"), (F.abs(0.5 - F.avg("score_b")) >= 0.2).alias("biased"))


@query("a35_presence", f"WITH {V_WIDE} SELECT case_id, count(quantity) AS quantity, count(price) AS price, count(discount) AS discount, count(tax) AS tax, count(quantity)+count(price)+count(discount)+count(tax) AS total FROM v_wide GROUP BY case_id")
def presence(spark, d):
    return O.presence(wide(spark, d), "case_id", COLS)


@query("a36_magnitude", f"WITH {V_WIDE}, c AS (SELECT case_id, count(quantity) AS q, count(price) AS p, count(discount) AS d, count(tax) AS t FROM v_wide GROUP BY case_id) SELECT case_id, round(q/max(q) OVER () + p/max(p) OVER () + d/max(d) OVER () + t/max(t) OVER (), 6) AS magnitude FROM c")
def magnitude(spark, d):
    return O.magnitude(wide(spark, d), "case_id", COLS).select("case_id", *r("magnitude"))


@query("a37_group_compare", f"WITH {V_SCORED} SELECT consequence, round(avg(score_a), 6) AS mean_a, round(avg(score_b), 6) AS mean_b, count(*) AS n FROM v_scored GROUP BY consequence")
def group_compare(spark, d):
    return scored(spark, d).groupBy("consequence").agg(F.round(F.avg("score_a"), 6).alias("mean_a"), F.round(F.avg("score_b"), 6).alias("mean_b"), F.count("*").alias("n")).orderBy("consequence")


_DRIFT = "CASE WHEN o_orderkey % 97 = 0 THEN o_totalprice + 1 ELSE o_totalprice END"


@query("a39_integrity", f"WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders), s AS (SELECT o_orderkey, (o_totalprice-lo)/(hi-lo) AS a, ({_DRIFT}-lo)/(hi-lo) AS b FROM orders, e) SELECT count(*) AS n, count(CASE WHEN b IS NULL THEN 1 END) AS n_null, count(CASE WHEN b < 0 OR b > 1 THEN 1 END) AS out_of_range, count(CASE WHEN abs(a-b) >= 1e-6 THEN 1 END) AS differing FROM s")
def integrity(spark, d):
    rows = table(spark, d, "orders").selectExpr("o_totalprice AS raw", f"{_DRIFT} AS stored")
    ends = rows.agg(F.min("raw").alias("lo"), F.max("raw").alias("hi"))
    unit = lambda c: (F.col(c) - F.col("lo")) / (F.col("hi") - F.col("lo"))
    s = rows.crossJoin(F.broadcast(ends)).select(unit("raw").alias("a"), unit("stored").alias("b"))  # one row
    return s.agg(F.count("*").alias("n"), F.count_if(F.col("b").isNull()).alias("n_null"), F.count_if((F.col("b") < 0) | (F.col("b") > 1)).alias("out_of_range"), F.count_if(F.abs(F.col("a") - F.col("b")) >= 1e-6).alias("differing"))


@query("a40_drift", f"SELECT o_orderkey, round({_DRIFT} - o_totalprice, 6) AS drift FROM orders WHERE abs({_DRIFT} - o_totalprice) >= 1e-6")
def drift(spark, d):
    ref = table(spark, d, "orders").selectExpr("o_orderkey", "o_totalprice AS ref")
    test = table(spark, d, "orders").selectExpr("o_orderkey", f"{_DRIFT} AS test")
    joined = ref.join(test, "o_orderkey", "full_outer").withColumn("drift", F.col("test") - F.col("ref"))
    return joined.where("drift IS NULL OR abs(drift) >= 1e-6").select("o_orderkey", *r("drift"))


@query("p09_promote", "SELECT * FROM (SELECT 'doc_id' AS \"column\", CASE WHEN bool_and(try_cast(doc_id::VARCHAR AS DOUBLE) IS NOT NULL) THEN 'DOUBLE' ELSE 'STRING' END AS type FROM documents UNION ALL SELECT 'lang', CASE WHEN bool_and(lang IS NULL OR lang = '' OR try_cast(lang AS DOUBLE) IS NOT NULL) THEN 'DOUBLE' ELSE 'STRING' END FROM documents UNION ALL SELECT 'n_chars', CASE WHEN bool_and(try_cast(n_chars::VARCHAR AS DOUBLE) IS NOT NULL) THEN 'DOUBLE' ELSE 'STRING' END FROM documents)")
def promote(spark, d):
    return O.promote(table(spark, d, "documents").selectExpr("cast(doc_id AS string) AS doc_id", "lang", "cast(n_chars AS string) AS n_chars"), ["doc_id", "lang", "n_chars"])


@query("u07_wide_long", f"{_LONG} SELECT id, feature, x FROM u WHERE x IS NOT NULL")
def wide_long(spark, d):
    return O.long_form(wide(spark, d), ["id"], COLS).where("x IS NOT NULL")


@query("u07_long_wide", f"WITH {V_SCORED} SELECT case_id, sum(CASE WHEN consequence = 'click' THEN 1 ELSE 0 END)::BIGINT AS click, sum(CASE WHEN consequence = 'view' THEN 1 ELSE 0 END)::BIGINT AS view FROM v_scored GROUP BY case_id")
def long_wide(spark, d):
    return scored(spark, d).groupBy("case_id").pivot("consequence", ["click", "view"]).count().na.fill(0)


_TOKENS = r"list_filter(string_split_regex(lower(text), '[\s_&/|:,\-0-9]'), lambda t: t <> '')"


@query("p40_embed_sum", f"WITH w AS (SELECT doc_id, unnest({_TOKENS}) AS token FROM documents), v AS (SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) AS slot FROM w GROUP BY token QUALIFY slot <= 500), s AS (SELECT doc_id, sum(sin(coalesce(slot, 0)::DOUBLE)) AS e0, sum(cos(coalesce(slot, 0)::DOUBLE)) AS e1 FROM w LEFT JOIN v USING (token) GROUP BY doc_id) SELECT d.doc_id, round(coalesce(e0, 0), 4) AS e0, round(coalesce(e1, 0), 4) AS e1 FROM documents d LEFT JOIN s USING (doc_id)")
def embed_sum(spark, d):
    docs = table(spark, d, "documents")
    vocab = O.vocabulary(docs, P.tokens(F.col("text")), 500)  # at most 500 rows
    words = docs.select("doc_id", F.explode(P.tokens(F.col("text"))).alias("token"))
    slot = F.coalesce("slot", F.lit(0)).cast("double")
    sums = words.join(F.broadcast(vocab.select("token", "slot")), "token", "left").groupBy("doc_id").agg(F.sum(F.sin(slot)).alias("e0"), F.sum(F.cos(slot)).alias("e1"))
    return docs.select("doc_id").join(sums, "doc_id", "left").select("doc_id", F.round(F.coalesce("e0", F.lit(0.0)), 4).alias("e0"), F.round(F.coalesce("e1", F.lit(0.0)), 4).alias("e1"))
