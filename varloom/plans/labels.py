"""Queries over label texts, tokens and row-wise parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from varloom.functions import metrics as M
from varloom.functions import parsing as P
from varloom.plans.registry import query
from varloom.plans.vehicles import V_CLNSIG, V_SCORED, V_SITES, clnsig, scored, site_a, table

_KEY = "list_transform(string_split_regex(lower(clnsig), '[|/,]'), lambda k: regexp_replace(k, '^_+|_+$', '', 'g'))"
_MASKED = "['.', 'uncertain_significance', 'not_provided', 'other', 'confers_sensitivity', 'association_not_found', 'uncertain_risk_allele', 'conflicting_interpretations_of_pathogenicity', 'low_penetrance']"
_USABLE = f"WITH {V_CLNSIG}, k AS (SELECT *, {_KEY} AS ks FROM v_clnsig), u AS (SELECT * FROM k WHERE NOT list_has_any(ks, {_MASKED}))"
_VALUE = "CASE WHEN k IN ('benign', 'likely_benign', 'affects', 'drug_response', 'protective') THEN 0e0 WHEN k IN ('pathogenic', 'likely_pathogenic', 'association', 'risk_factor', 'likely_risk_allele') THEN 1e0 END"
_LABEL = f"least(1e0, list_sum(list_transform(ks, lambda k: {_VALUE})))"
_PLAIN = "CASE {c} WHEN 'benign' THEN 0e0 WHEN 'pathogenic' THEN 1e0 END"


@query("p22_keywords", f"WITH {V_CLNSIG} SELECT id, array_to_string({_KEY}, ';') AS keywords FROM v_clnsig")
def keywords(spark, d):
    return clnsig(spark, d).select("id", F.concat_ws(";", P.keywords(F.col("clnsig"))).alias("keywords"))


@query("f01_label_mask", f"{_USABLE} SELECT id FROM u")
def label_mask(spark, d):
    return clnsig(spark, d).where(~P.masked(F.col("clnsig"))).select("id")


@query("p23_label", f"{_USABLE} SELECT id, {_LABEL} AS label FROM u WHERE clnsig <> ''")
def label(spark, d):
    return clnsig(spark, d).where(~P.masked(F.col("clnsig")) & (F.col("clnsig") != "")).select("id", P.clinical_label(F.col("clnsig")).alias("label"))


@query("p24_plain_labels", f"WITH {V_CLNSIG} SELECT id, {_PLAIN.format(c='giab')} AS giab, {_PLAIN.format(c='mutacc')} AS mutacc FROM v_clnsig")
def plain_labels(spark, d):
    return clnsig(spark, d).select("id", P.binary_label(F.col("giab")).alias("giab"), P.binary_label(F.col("mutacc")).alias("mutacc"))


@query("p25_coalesce_label", f"{_USABLE} SELECT id, CASE WHEN clnsig <> '' THEN {_LABEL} WHEN giab <> '' THEN {_PLAIN.format(c='giab')} ELSE {_PLAIN.format(c='mutacc')} END AS label FROM u")
def coalesce_label(spark, d):
    sources = {"clnsig": P.clinical_label(F.col("clnsig")), "giab": P.binary_label(F.col("giab")), "mutacc": P.binary_label(F.col("mutacc"))}
    return clnsig(spark, d).where(~P.masked(F.col("clnsig"))).select("id", P.only_label(sources).alias("label"))


@query("p26_origin", f"{_USABLE} SELECT id, CASE WHEN clnsig <> '' THEN 'TRAIN' WHEN giab <> '' THEN 'TEST' ELSE 'BOTH' END AS origin FROM u")
def origin(spark, d):
    names = {"clnsig": F.lit("TRAIN"), "giab": F.lit("TEST"), "mutacc": F.lit("BOTH")}
    return clnsig(spark, d).where(~P.masked(F.col("clnsig"))).select("id", P.only_label(names).alias("origin"))


@query("p27_blank_uncertain", f"WITH {V_CLNSIG} SELECT id, CASE WHEN regexp_matches(lower(clnsig), 'uncertain|conflicting') OR lower(clnsig) IN ('other', 'association') THEN '' ELSE clnsig END AS clnsig FROM v_clnsig")
def blank_uncertain(spark, d):
    low = F.lower(F.col("clnsig"))
    return clnsig(spark, d).select("id", F.when(low.rlike("uncertain|conflicting") | low.isin("other", "association"), "").otherwise(F.col("clnsig")).alias("clnsig"))


@query("p29_fill", f"WITH {V_SCORED} SELECT id, coalesce(frq, 0e0) AS frq, coalesce(nullif(consequence, 'view'), '') AS consequence FROM v_scored")
def fill(spark, d):
    return scored(spark, d).select("id", F.coalesce("frq", F.lit(0.0)).alias("frq"), F.coalesce(F.nullif("consequence", F.lit("view")), F.lit("")).alias("consequence"))


@query("p30_one_hot", f"WITH {V_SCORED} SELECT id, 1-label AS benign, label AS pathogenic FROM v_scored")
def one_hot(spark, d):
    return scored(spark, d).select("id", P.one_hot(F.col("label")).alias("h")).select("id", F.get("h", 0).alias("benign"), F.get("h", 1).alias("pathogenic"))


_TOKENS = r"list_filter(string_split_regex(lower(text), '[\s_&/|:,\-0-9]'), lambda t: t <> '')"


@query("p31_tokens", f"SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, {_TOKENS} AS t FROM documents)")
def tokens(spark, d):
    rows = table(spark, d, "documents").select("doc_id", P.tokens(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.concat_ws(" ", "t").cast("binary")).alias("tokens_md5"))


@query("p32_no_dna", f"SELECT doc_id, len(list_filter(t, lambda w: NOT regexp_full_match(w, '[CAGTNcagtn]+'))) AS n_tokens FROM (SELECT doc_id, {_TOKENS} AS t FROM documents)")
def no_dna(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(P.no_dna(P.tokens(F.col("text")))).cast("long").alias("n_tokens"))


@query("p34_explanation", f"WITH {V_SCORED} SELECT id, '[' || array_to_string(list_transform(list_sort(list_filter([{{'minus': -score_a * 0.9987e0, 'name': 'a'}}, {{'minus': -score_b, 'name': 'b'}}, {{'minus': -frq, 'name': 'frq'}}], lambda s: s.minus IS NOT NULL)), lambda s: s.name || printf('=%.2f,', -s.minus)), '') || ']' AS explanation, printf('%.5f', score_a) AS score FROM v_scored")
def explanation(spark, d):
    text = P.explanation({"a": F.col("score_a") * 0.9987, "b": F.col("score_b"), "frq": F.col("frq")})
    return scored(spark, d).select("id", text.alias("explanation"), F.format_string("%.5f", "score_a").alias("score"))


@query("p15_unique_id", f"WITH {V_SITES} SELECT concat_ws('-', pos::VARCHAR, chrom, 'ALT', alt, 'REF', ref) AS uid FROM v_a")
def unique_id(spark, d):
    return site_a(spark, d).select(P.variant_id(F.col("pos"), F.col("chrom"), F.col("ref"), F.col("alt")).alias("uid"))


@query("p16_repeated_ids", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def repeated_ids(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


@query("p43_above_mean", f"WITH {V_SCORED} SELECT id, score_a > avg(score_a) OVER () AS cluster FROM v_scored")
def above_mean(spark, d):
    rows = scored(spark, d)
    return rows.crossJoin(F.broadcast(rows.agg(F.avg("score_a").alias("m")))).select("id", (F.col("score_a") > F.col("m")).alias("cluster"))  # one row


@query("p41_standardise", f"WITH {V_SCORED} SELECT id, round((score_a - avg(score_a) OVER ()) / stddev_pop(score_a) OVER (), 6) AS z FROM v_scored")
def standardise(spark, d):
    rows = scored(spark, d)
    fit = rows.agg(F.avg("score_a").alias("m"), F.stddev_pop("score_a").alias("s"))
    return rows.crossJoin(F.broadcast(fit)).select("id", F.round((F.col("score_a") - F.col("m")) / F.col("s"), 6).alias("z"))  # one row


@query("p42_rank_bin", f"WITH {V_SCORED} SELECT id, CASE WHEN id % 300 < 5 THEN 'a' WHEN id % 300 > 5 AND id % 300 < 10 THEN 'b' WHEN id % 300 > 200 THEN 'c' END AS bin FROM v_scored")
def rank_bin(spark, d):
    x = F.col("id") % 300
    return scored(spark, d).select("id", F.when(x < 5, "a").when((x > 5) & (x < 10), "b").when(x > 200, "c").alias("bin"))


_DOCS = f"tk AS (SELECT d.doc_id, l.toxic AS label, {_TOKENS} AS t FROM documents d JOIN labels l USING (doc_id))"


@query("a27_vocabulary", f"WITH w AS (SELECT unnest({_TOKENS}) AS token FROM documents), c AS (SELECT token, count(*) AS n FROM w GROUP BY token ORDER BY n DESC, token LIMIT 1000) SELECT token, n, row_number() OVER (ORDER BY n DESC, token) AS slot FROM c")
def vocabulary(spark, d):
    from varloom.operators.profiles import vocabulary as build

    return build(table(spark, d, "documents"), P.tokens(F.col("text")), 1000).withColumn("slot", F.col("slot").cast("long"))


@query("p28_rename_keys", f"WITH {V_SCORED} SELECT id, score_b AS score_a FROM v_scored")
def rename_keys(spark, d):
    override = dict(pair.split(":") for pair in "score_a:score_b".split(","))
    return scored(spark, d).select("id", *[F.col(new).alias(old) for old, new in override.items()])


@query(
    "p39_surface",
    f"WITH {V_SCORED}, c AS (SELECT least(29, floor(score_a * 30))::INTEGER AS i, least(29, floor(score_b * 30))::INTEGER AS j, count(*) AS n, avg(label) AS share FROM v_scored WHERE score_a >= 0 AND score_b >= 0 GROUP BY ALL) "
    "SELECT i, j, n, round(share, 6) AS share, round((i+0.5)/30*least(1e0, greatest(0e0, 2*(j+0.5)/30-0.95e0)), 6) AS score, (i+0.5)/30*least(1e0, greatest(0e0, 2*(j+0.5)/30-0.95e0)) > 0.5 AS class FROM c",
)
def surface(spark, d):
    """The decision surface over a 30 x 30 grid, with the rows and the share of positives that lie in each cell."""
    cell = lambda c: F.least(F.lit(29), F.floor(F.col(c) * 30).cast("int"))
    rows = scored(spark, d).where("score_a >= 0 AND score_b >= 0")
    grid = rows.groupBy(cell("score_a").alias("i"), cell("score_b").alias("j")).agg(F.count("*").alias("n"), F.round(F.avg("label"), 6).alias("share"))
    score = M.gate((F.col("i") + 0.5) / 30, (F.col("j") + 0.5) / 30)
    return grid.select("i", "j", "n", "share", F.round(score, 6).alias("score"), (score > 0.5).alias("class"))


_TERMS3 = {"score_a": 3.0017, "score_b": 2.0, "frq": -41.0}
_POINT = "3.0017e0*score_a + 2*score_b - 41*coalesce(frq,0) - 1.5"


@query("m02_score_table", f"WITH {V_SCORED} SELECT dataset, id, label, round(1/(1+exp(-({_POINT}))), 6) AS score FROM v_scored")
def score_table(spark, d):
    """Score and ground truth side by side, for each set."""
    return scored(spark, d).select("dataset", "id", "label", F.round(_probability(), 6).alias("score"))


def _probability():
    return M.sigmoid(sum((w * F.coalesce(F.col(c), F.lit(0.0)) for c, w in _TERMS3.items()), F.lit(0.0)) - 1.5)


@query(
    "m03_score",
    f"WITH {V_SCORED}, s AS (SELECT id, score_a, score_b, frq, 1/(1+exp(-({_POINT}))) AS p FROM v_scored) SELECT id, printf('%.5f', p) AS score, CASE WHEN p >= 0.5 THEN '[' || array_to_string(list_transform(list_sort("
    "[{'minus': -3.0017e0*score_a, 'name': 'score_a'}, {'minus': -2*score_b, 'name': 'score_b'}, {'minus': 41*coalesce(frq, 0e0), 'name': 'frq'}]), lambda s: s.name || printf('=%.2f,', -s.minus)), '') || ']' END AS explanation FROM s",
)
def score(spark, d):
    """Missing features filled, every row scored, and the rows that reach the threshold explained by their contributions."""
    filled = scored(spark, d).withColumn("frq", F.coalesce("frq", F.lit(0.0))).withColumn("p", _probability())
    parts = P.explanation({c: w * F.col(c) for c, w in _TERMS3.items()})
    return filled.select("id", F.format_string("%.5f", "p").alias("score"), F.when(F.col("p") >= 0.5, parts).alias("explanation"))


@query("p35_parse_explanation", f"WITH {V_SCORED} SELECT id, printf('%.2f', score_a * 0.9987e0)::DOUBLE AS a, printf('%.2f', score_b)::DOUBLE AS b FROM v_scored")
def parse_explanation(spark, d):
    text = P.explanation({"a": F.col("score_a") * 0.9987, "b": F.col("score_b"), "frq": F.col("frq")})
    return scored(spark, d).select("id", P.parse_explanation(text).alias("m")).select("id", F.col("m")["a"].cast("double").alias("a"), F.col("m")["b"].cast("double").alias("b"))


@query("m07_shapley_linear", f"WITH {V_SCORED}, bg AS (SELECT * FROM v_scored WHERE label = 0 ORDER BY md5(concat(id::VARCHAR, ':bg')), id LIMIT 50), m AS (SELECT avg(score_a) AS a, avg(score_b) AS b FROM bg) SELECT id, round(3*(score_a - a), 6) AS phi_a, round(2*(score_b - b), 6) AS phi_b FROM v_scored, m")
def shapley_linear(spark, d):
    rows = scored(spark, d)
    ground = rows.where("label = 0").orderBy(F.md5(F.concat(F.col("id").cast("string"), F.lit(":bg"))), "id").limit(50)
    mean = ground.agg(F.avg("score_a").alias("a"), F.avg("score_b").alias("b"))
    return rows.crossJoin(F.broadcast(mean)).select("id", F.round(3 * (F.col("score_a") - F.col("a")), 6).alias("phi_a"), F.round(2 * (F.col("score_b") - F.col("b")), 6).alias("phi_b"))  # one row


_FILL = "SELECT id, label, score_a, score_b, coalesce(frq, 0e0) AS frq, label = 0 AS benign FROM v_scored"
_SURE = "{a} * least(1e0, greatest(0e0, 2e0 * {b} - 0.95e0)) * (1 - 100e0 * {f})"


def _weights(j: int) -> str:
    """A coalition's weight in the Shapley value of the feature j of three."""
    size = "((mask & 1) + ((mask >> 1) & 1) + ((mask >> 2) & 1))"
    return f"CASE WHEN (mask >> {j}) & 1 = 1 THEN CASE {size} WHEN 2 THEN 1e0/6 ELSE 1e0/3 END ELSE -CASE {size} WHEN 1 THEN 1e0/6 ELSE 1e0/3 END END"


@query(
    "m07_shapley",
    f"""WITH {V_SCORED}, r AS ({_FILL}), bg AS (SELECT score_a AS ba, score_b AS bb, frq AS bf FROM r WHERE benign ORDER BY md5(concat(id::VARCHAR, ':bg')), id LIMIT 50),
    x AS (SELECT * FROM r WHERE {_SURE.format(a='score_a', b='score_b', f='frq')} >= 0.05), m AS (SELECT unnest(range(8)) AS mask),
    v AS (SELECT id, mask, avg({_SURE.format(a='CASE WHEN mask & 1 = 1 THEN score_a ELSE ba END', b='CASE WHEN (mask >> 1) & 1 = 1 THEN score_b ELSE bb END', f='CASE WHEN (mask >> 2) & 1 = 1 THEN frq ELSE bf END')}) AS v FROM x, m, bg GROUP BY id, mask)
    SELECT id, round(max(CASE WHEN mask = 0 THEN v END), 6) AS expected, round(max(CASE WHEN mask = 7 THEN v END), 6) AS score, round(sum(v * {_weights(0)}), 6) AS phi_a, round(sum(v * {_weights(1)}), 6) AS phi_b, round(sum(v * {_weights(2)}), 6) AS phi_frq FROM v GROUP BY id""",
)
def shapley(spark, d):
    """Exact Shapley values of a score that is no sum of its features, over all coalitions, for the rows that reach the threshold."""
    from varloom.operators import attribution as S

    sure = lambda df: df.withColumn("__score", M.gate(F.col("score_a"), F.col("score_b")) * (1 - 100 * F.col("frq")))
    rows = scored(spark, d).withColumn("frq", F.coalesce("frq", F.lit(0.0)))
    features = ["score_a", "score_b", "frq"]
    found = S.shapley(sure(rows).where("__score >= 0.05").drop("__score"), "id", features, S.benign_background(rows, "id", features, F.col("label") == 0), sure)
    return found.select("id", *[F.round(c, 6).alias(n) for n, c in (("expected", "expected"), ("score", "score"), ("phi_a", "phi_score_a"), ("phi_b", "phi_score_b"), ("phi_frq", "phi_frq"))])


@query(
    "m01_map_shards",
    f"WITH {V_SCORED}, n AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS position, count(*) OVER () AS total FROM v_scored) SELECT id, position, position // 1000 AS shard, position // 1000 * 1000 AS start, least(total, position // 1000 * 1000 + 1000) AS stop, position % 1000 AS place, round(score_a - avg(score_a) OVER (PARTITION BY position // 1000), 6) AS above_mean FROM n",
)
def map_shards(spark, d):
    """A function of whole shards by ordinal: each row against the mean of its own thousand; outputs in the order of the shards."""
    from varloom.operators.batches import map_shards as over

    def fn(pdf, start, stop):
        assert len(pdf) == stop - start
        return pdf[["id"]].assign(position=range(start, stop), above_mean=(pdf["score_a"] - pdf["score_a"].mean()))

    out = over(scored(spark, d).select("id", "score_a"), [F.col("id")], fn, "id long, position long, above_mean double", 1000)
    return out.select("id", "position", "shard", "start", "stop", "place", F.round("above_mean", 6).alias("above_mean"))


@query("m01_map_batches", f"WITH {V_SCORED} SELECT id, round(score_a*least(1e0, greatest(0e0, 2e0*score_b-0.95e0)), 6) AS combined FROM v_scored")
def map_batches(spark, d):
    from varloom.operators.batches import map_batches as over

    def fn(pdf):
        gate = (2.0 * pdf["score_b"] - 0.95).clip(0.0, 1.0)
        return pdf[["id"]].assign(combined=pdf["score_a"] * gate)

    return over(scored(spark, d).select("id", "score_a", "score_b"), fn, "id long, combined double").select("id", F.round("combined", 6).alias("combined"))
