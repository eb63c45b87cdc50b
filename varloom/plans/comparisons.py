"""Queries over cases, ranks and joins of score tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from varloom.operators import joins as J
from varloom.operators import ranking as R
from varloom.operators.base import numbered
from varloom.operators.splits import chunks, folds
from varloom.plans.registry import query
from varloom.plans.vehicles import V_CAUSATIVE, V_LEGACY, V_SCORED, V_SITES, causative, legacy, scored, site_a, site_b, table

_LIMITS = "(SELECT unnest([NULL, 1/2000e0, 10/2000e0, 100/2000e0]) AS max_frq)"
_RANKED = f"""WITH {V_CAUSATIVE}, l AS {_LIMITS},
    k AS (SELECT s.*, max_frq FROM v_scored s JOIN l ON max_frq IS NULL OR greatest(coalesce(frq,0), coalesce(frq2,0), coalesce(frq3,0)) <= max_frq),
    r AS (SELECT case_id, id, max_frq, row_number() OVER (PARTITION BY case_id, max_frq ORDER BY score_a DESC, id) - 1 AS ra, row_number() OVER (PARTITION BY case_id, max_frq ORDER BY score_b DESC, id) - 1 AS rb FROM k),
    h AS (SELECT r.case_id, r.max_frq, min(ra) AS rank_score_a, min(rb) AS rank_score_b FROM r JOIN v_causative c ON c.case_id = r.case_id AND c.id = r.id GROUP BY ALL),
    cases AS (SELECT DISTINCT case_id, max_frq FROM v_scored, l),
    b AS (SELECT cases.case_id, cases.max_frq, rank_score_a, rank_score_b FROM cases LEFT JOIN h ON h.case_id = cases.case_id AND h.max_frq IS NOT DISTINCT FROM cases.max_frq)"""


@query("b06_case_rank_compare", f"{_RANKED} SELECT * FROM b")
def case_rank_compare(spark, d):
    return R.compare(scored(spark, d), causative(spark, d), ["score_a", "score_b"])


@query("w01_case_rank", f"{_RANKED} SELECT case_id, rank_score_a, rank_score_b FROM b WHERE max_frq IS NULL")
def case_rank(spark, d):
    return R.causative_ranks(scored(spark, d), causative(spark, d), ["score_a", "score_b"])


_POINTS = "count(CASE WHEN {a} < {b} THEN 1 END) AS wins, count(CASE WHEN {a} > {b} THEN 1 END) AS losses, count(CASE WHEN {a} = {b} THEN 1 END) AS ties, count(CASE WHEN {a} IS NULL AND {b} IS NULL THEN 1 END) AS neither, count(CASE WHEN {a} IS NULL AND {b} IS NOT NULL THEN 1 END) AS only_b, count(CASE WHEN {a} IS NOT NULL AND {b} IS NULL THEN 1 END) AS only_a".format(a="rank_score_a", b="rank_score_b")


@query("a28_points", f"{_RANKED} SELECT {_POINTS} FROM b WHERE max_frq IS NULL")
def points(spark, d):
    return R.points(case_rank(spark, d), "rank_score_a", "rank_score_b")


@query("a29_wins", f"{_RANKED} SELECT max_frq, count(CASE WHEN rank_score_a < rank_score_b THEN 1 END) AS wins_a, count(CASE WHEN rank_score_b < rank_score_a THEN 1 END) AS wins_b, count(CASE WHEN rank_score_a = rank_score_b THEN 1 END) AS ties FROM b WHERE rank_score_a IS NOT NULL GROUP BY max_frq")
def wins(spark, d):
    a, b = F.col("rank_score_a"), F.col("rank_score_b")
    ranks = case_rank_compare(spark, d).dropna(subset=["rank_score_a", "rank_score_b"])
    return ranks.groupBy("max_frq").agg(F.count_if(a < b).alias("wins_a"), F.count_if(b < a).alias("wins_b"), F.count_if(a == b).alias("ties"))


_BIN = "CASE WHEN {x} < 5 THEN '0-5' WHEN {x} < 10 THEN '5-10' WHEN {x} < 20 THEN '10-20' WHEN {x} < 200 THEN '20-200' ELSE '200+' END"


@query("a38_rank_bins", f"{_RANKED} SELECT {_BIN.format(x='rank_score_a')} AS bin, count(*) AS n, round(avg(rank_score_b), 6) AS mean_other FROM b WHERE max_frq IS NULL AND rank_score_a IS NOT NULL GROUP BY 1")
def rank_bins(spark, d):
    x = F.expr(_BIN.format(x="rank_score_a"))
    return case_rank(spark, d).where("rank_score_a IS NOT NULL").groupBy(x.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("rank_score_b"), 6).alias("mean_other"))


@query(
    "w02_dup_rank",
    f"""WITH {V_CAUSATIVE}, v_base AS (SELECT id, ((id * 37) % 1000) / 1e3 AS genmod FROM v_scored), v_legacy AS (SELECT * FROM v_base UNION ALL SELECT id, genmod / 2e0 FROM v_base WHERE id % 5 = 0),
    j AS (SELECT s.case_id, s.id, genmod FROM v_scored s JOIN v_legacy USING (id)), b AS (SELECT c.case_id, max(genmod) AS g, any_value(c.id) AS cid FROM v_causative c JOIN j ON j.id = c.id AND j.case_id = c.case_id GROUP BY c.case_id)
    SELECT j.case_id, count(CASE WHEN genmod > g OR (genmod = g AND j.id < cid) THEN 1 END) AS first_position FROM j JOIN b USING (case_id) GROUP BY j.case_id""",
)
def dup_rank(spark, d):
    rows = scored(spark, d).select("case_id", "id").join(legacy(spark, d), "id")
    ranks = R.causative_ranks(rows, causative(spark, d), ["genmod"])
    return ranks.where("rank_genmod IS NOT NULL").select("case_id", F.col("rank_genmod").alias("first_position"))


@query("w03_global_rank", f"WITH {V_SCORED} SELECT id, row_number() OVER (ORDER BY score_a DESC, id) - 1 AS global_rank FROM v_scored")
def global_rank(spark, d):
    return numbered(scored(spark, d).select("id", "score_a"), [F.desc("score_a"), F.col("id")], "global_rank").select("id", "global_rank")


@query("w06_folds", f"WITH {V_SCORED}, n AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM v_scored), c AS (SELECT count(*) AS n, greatest(1, count(*)//10) AS size FROM v_scored) SELECT id, k // size AS fold FROM n, c WHERE k // size < c.n // size")
def fold_numbers(spark, d):
    return folds(scored(spark, d).select("id"), [F.col("id")])


@query("w07_chunks", f"WITH {V_SCORED}, c AS (SELECT DISTINCT case_id FROM v_scored) SELECT case_id, (row_number() OVER (ORDER BY case_id) - 1) // 25 AS chunk FROM c")
def case_chunks(spark, d):
    return chunks(scored(spark, d).select("case_id").distinct(), [F.col("case_id")], 25)


@query("w08_by_max", f"WITH {V_SCORED} SELECT id, round(score_a / max(score_a) OVER (), 6) AS share FROM v_scored")
def by_max(spark, d):
    rows = scored(spark, d)
    return rows.crossJoin(F.broadcast(rows.agg(F.max("score_a").alias("m")))).select("id", F.round(F.col("score_a") / F.col("m"), 6).alias("share"))


@query("o01_topn", f"WITH {V_SCORED}, r AS (SELECT case_id, id, row_number() OVER (PARTITION BY case_id ORDER BY score_a DESC, id) - 1 AS rank FROM v_scored) SELECT * FROM r WHERE rank < 5")
def topn(spark, d):
    return R.top_per_case(scored(spark, d), "score_a", 5).select("case_id", "id", F.col("rank").cast("long").alias("rank"))


@query("o02_top_fp", f"WITH {V_SCORED} SELECT id, round(score_a, 6) AS score FROM v_scored WHERE label = 0 AND score_a >= 0.1 ORDER BY score_a DESC, id LIMIT 10000")
def top_fp(spark, d):
    """The highest-scoring false positives at the threshold."""
    return scored(spark, d).where("label = 0 AND score_a >= 0.1").orderBy(F.desc("score_a"), "id").limit(10_000).select("id", F.round("score_a", 6).alias("score"))


@query("o01_top500", f"WITH {V_SCORED}, r AS (SELECT id, row_number() OVER (ORDER BY score_a DESC, id) - 1 AS rank FROM v_scored) SELECT id, rank FROM r WHERE rank < 500")
def top500(spark, d):
    """The 500 best of all, ranked anew; each task sends its own 500 at most."""
    return numbered(scored(spark, d).select("id", "score_a").orderBy(F.desc("score_a"), "id").limit(500), [F.desc("score_a"), F.col("id")], "rank").select("id", "rank")


@query("o03_nulls_last", f"WITH {V_SCORED} SELECT row_number() OVER (ORDER BY frq ASC NULLS LAST, id) - 1 AS place, id FROM v_scored")
def nulls_last(spark, d):
    return numbered(scored(spark, d).select("id", "frq"), [F.asc_nulls_last("frq"), F.col("id")], "place").select("place", "id")


@query("o05_first_benign", f"WITH {V_SCORED} SELECT id FROM v_scored WHERE label = 0 ORDER BY md5(concat(id::VARCHAR, ':bg')), id LIMIT 50")
def first_benign(spark, d):
    return scored(spark, d).where("label = 0").orderBy(F.md5(F.concat(F.col("id").cast("string"), F.lit(":bg"))), "id").limit(50).select("id")


@query("o06_argmax", f"WITH {V_SCORED} SELECT consequence, max(score_a) AS top, min(CASE WHEN score_a = m THEN id END) AS top_id FROM (SELECT *, max(score_a) OVER (PARTITION BY consequence) AS m FROM v_scored) GROUP BY consequence")
def argmax(spark, d):
    return scored(spark, d).groupBy("consequence").agg(F.max(F.struct("score_a", (-F.col("id")).alias("i"))).alias("b")).select("consequence", F.col("b.score_a").alias("top"), (-F.col("b.i")).alias("top_id"))


_MARK = f"WITH {V_SITES}, t AS (SELECT DISTINCT chrom, pos, ref, alt FROM v_b)"


@query("j01_mark4", f"{_MARK} SELECT a.chrom, a.pos, a.ref, a.alt, CASE WHEN t.pos IS NULL THEN 0 ELSE 1 END AS label FROM v_a a LEFT JOIN t USING (chrom, pos, ref, alt)")
def mark4(spark, d):
    return J.mark(site_a(spark, d), site_b(spark, d), J.SITE)


@query("j01_mark_report", f"{_MARK} SELECT round((SELECT avg(CASE WHEN t.pos IS NULL THEN 0 ELSE 1 END) FROM v_a LEFT JOIN t USING (chrom, pos, ref, alt)), 6) AS found_share, round((SELECT avg(CASE WHEN a.pos IS NULL THEN 1 ELSE 0 END) FROM t LEFT JOIN (SELECT DISTINCT * FROM v_a) a USING (chrom, pos, ref, alt)), 6) AS missing_share")
def mark_report(spark, d):
    return J.mark_report(site_a(spark, d), site_b(spark, d), J.SITE).select(F.round("found_share", 6).alias("found_share"), F.round("missing_share", 6).alias("missing_share"))


@query("j02_mark_id", f"WITH {V_CAUSATIVE} SELECT s.id, CASE WHEN c.id IS NULL THEN 0 ELSE 1 END AS causative FROM v_scored s LEFT JOIN v_causative c USING (id)")
def mark_id(spark, d):
    return J.mark(scored(spark, d).select("id"), causative(spark, d), ["id"], "causative")


@query("j03_inner_many", f"WITH {V_LEGACY} SELECT id, round(score_a, 6) AS score_a, round(genmod, 6) AS genmod FROM v_scored JOIN v_legacy USING (id)")
def inner_many(spark, d):
    return scored(spark, d).select("id", F.round("score_a", 6).alias("score_a")).join(legacy(spark, d).select("id", F.round("genmod", 6).alias("genmod")), "id")


@query("j04_lookup_dups", f"WITH {V_LEGACY} SELECT l.id, round(genmod, 6) AS genmod FROM v_legacy l SEMI JOIN (SELECT id FROM v_scored WHERE id % 10 = 0) USING (id)")
def lookup_dups(spark, d):
    return J.lookup(scored(spark, d).where("id % 10 = 0").select("id"), legacy(spark, d), ["id"]).select("id", F.round("genmod", 6).alias("genmod"))


_UID = "concat_ws('-', cast(pos AS string), chrom, 'ALT', alt, 'REF', ref)"


@query("j05_full_align", f"WITH {V_SITES}, x AS (SELECT {_UID} AS uid FROM v_a), y AS (SELECT {_UID} AS uid FROM v_b) SELECT uid, CASE WHEN x.uid IS NULL THEN 'b' WHEN y.uid IS NULL THEN 'a' ELSE 'both' END AS side FROM x FULL JOIN y USING (uid)")
def full_align(spark, d):
    a, b = site_a(spark, d).selectExpr(f"{_UID} AS uid", "1 AS a"), site_b(spark, d).selectExpr(f"{_UID} AS uid", "1 AS b")
    return a.join(b, "uid", "full_outer").select("uid", F.when(F.col("a").isNull(), "b").when(F.col("b").isNull(), "a").otherwise("both").alias("side"))


@query("j06_semi", f"WITH {V_CAUSATIVE} SELECT s.id, s.case_id FROM v_scored s SEMI JOIN v_causative USING (id)")
def semi(spark, d):
    return J.semi_counted(scored(spark, d).select("id", "case_id"), causative(spark, d).select("id"), "id")


@query("j07_isec", f"WITH {V_SITES} SELECT * FROM v_a SEMI JOIN v_b USING (chrom, pos, ref, alt)")
def isec(spark, d):
    return site_a(spark, d).join(site_b(spark, d), J.SITE, "left_semi")


@query("j08_complement", f"WITH {V_SITES} SELECT * FROM v_a ANTI JOIN v_b USING (chrom, pos, ref, alt)")
def complement(spark, d):
    return site_a(spark, d).join(site_b(spark, d), J.SITE, "left_anti")


@query("j09_lookup", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def lookup(spark, d):
    return J.lookup(table(spark, d, "customer"), table(spark, d, "nation").withColumnRenamed("n_nationkey", "c_nationkey"), ["c_nationkey"]).select("c_custkey", "n_name")


@query("j10_loss_check", f"WITH {V_SITES}, x AS (SELECT DISTINCT chrom, pos FROM v_a), y AS (SELECT DISTINCT chrom, pos FROM v_b) SELECT chrom, pos, 'a' AS side FROM x ANTI JOIN y USING (chrom, pos) UNION ALL SELECT chrom, pos, 'b' FROM y ANTI JOIN x USING (chrom, pos)")
def loss_check(spark, d):
    return J.only_one_side(site_a(spark, d), site_b(spark, d), ["chrom", "pos"])


@query("j16_zip", f"WITH {V_SCORED}, x AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS n FROM v_scored), y AS (SELECT consequence, row_number() OVER (ORDER BY id) - 1 AS n FROM v_scored) SELECT n, id, consequence FROM x JOIN y USING (n)")
def zip_rows(spark, d):
    rows = scored(spark, d)
    left = numbered(rows.select("id"), [F.col("id")]).select("n", "id")
    return left.join(numbered(rows.select(F.col("id").alias("o"), "consequence"), [F.col("o")]).select("n", "consequence"), "n")


@query("j17_case_intersection", f"WITH {V_CAUSATIVE} SELECT s.case_id, count(*) AS common FROM (SELECT DISTINCT case_id, id FROM v_scored WHERE score_a > 0.05) s JOIN v_causative c ON c.case_id = s.case_id AND c.id = s.id GROUP BY s.case_id")
def case_intersection(spark, d):
    common = scored(spark, d).where("score_a > 0.05").select("case_id", "id").distinct().join(causative(spark, d), ["case_id", "id"]).groupBy("case_id").agg(F.count("*").alias("common"))
    return J.one_common(common, "common")


@query("u01_concat", f"WITH {V_SITES} SELECT *, 'a' AS file FROM v_a UNION ALL SELECT *, 'b' FROM v_b")
def concat(spark, d):
    both = site_a(spark, d).withColumn("file", F.lit("a")).unionByName(site_b(spark, d).withColumn("file", F.lit("b")))
    return both.repartitionByRange("chrom", "pos").sortWithinPartitions("chrom", "pos")


_CONTIGS = [*[f"chr{n}" for n in range(1, 23)], "chrX"]


@query("u01_contig_order", f"WITH {V_SITES}, u AS (SELECT *, 'a' AS file FROM v_a UNION ALL SELECT *, 'b' FROM v_b) SELECT *, row_number() OVER (ORDER BY substr(chrom, 4)::INTEGER, pos, file) - 1 AS position FROM u")
def contig_order(spark, d):
    """Where each row of the merged files stands: chr2 before chr10, as the header's contig lines say."""
    from varloom.sources import vcf

    head = table(spark, d, "region").where("r_regionkey = 0").select(F.posexplode(F.array(*[F.lit(f"##contig=<ID={c}>") for c in _CONTIGS])).alias("at", "value"))
    both = site_a(spark, d).withColumn("file", F.lit("a")).unionByName(site_b(spark, d).withColumn("file", F.lit("b")))
    ranked = vcf.in_contig_order(both, vcf.contigs(head), ["pos", "file"])
    return numbered(ranked, [F.col("contig_rank"), F.col("pos"), F.col("file")], "position").drop("contig_rank")


@query("u02_ragged_union", f"WITH {V_SITES} SELECT chrom, pos, ref, NULL AS alt FROM v_a UNION ALL SELECT chrom, pos, NULL, alt FROM v_b")
def ragged_union(spark, d):
    return site_a(spark, d).drop("alt").unionByName(site_b(spark, d).drop("ref"), allowMissingColumns=True)


@query("u03_intersect", f"WITH {V_SITES} SELECT pos FROM v_a INTERSECT SELECT pos FROM v_b")
def intersect(spark, d):
    return site_a(spark, d).select("pos").intersect(site_b(spark, d).select("pos"))


@query("u04_except", f"WITH {V_SITES} SELECT pos FROM v_a EXCEPT SELECT pos FROM v_b")
def subtract(spark, d):
    return site_a(spark, d).select("pos").subtract(site_b(spark, d).select("pos"))


@query("u05_group_key", f"WITH {V_SCORED} SELECT concat_ws('-', dataset, label::VARCHAR) AS k, count(*) AS n FROM v_scored GROUP BY 1")
def group_key(spark, d):
    return scored(spark, d).groupBy(F.concat_ws("-", "dataset", F.col("label").cast("string")).alias("k")).agg(F.count("*").alias("n"))


@query("u06_explode3", f"WITH {V_SCORED}, s AS (SELECT case_id, [min(id), max(id)] AS a, ['x', 'y'] AS b, [min(label)] AS c FROM v_scored GROUP BY case_id), e AS (SELECT case_id, unnest(a) AS a, b, c FROM s), f AS (SELECT case_id, a, unnest(b) AS b, c FROM e) SELECT case_id, a, b, unnest(c) AS c FROM f")
def explode3(spark, d):
    lists = scored(spark, d).groupBy("case_id").agg(F.array(F.min("id"), F.max("id")).alias("a"), F.array(F.lit("x"), F.lit("y")).alias("b"), F.array(F.min("label")).alias("c"))
    for c in "abc":
        lists = lists.withColumn(c, F.explode_outer(c))
    return lists


@query("w05_lag", f"WITH {V_SCORED}, c AS (SELECT consequence, dataset, count(*) AS n FROM v_scored GROUP BY ALL) SELECT *, lag(n) OVER (PARTITION BY dataset ORDER BY consequence) AS before FROM c")
def lagged(spark, d):
    counts = scored(spark, d).groupBy("consequence", "dataset").agg(F.count("*").alias("n"))
    return counts.withColumn("before", F.lag("n").over(Window.partitionBy("dataset").orderBy("consequence")))


@query("f05_constraint", f"{_RANKED} SELECT case_id FROM b WHERE max_frq IS NULL AND rank_score_a < 10 AND rank_score_b > 10")
def constraint(spark, d):
    return case_rank(spark, d).where("rank_score_a < 10 AND rank_score_b > 10").select("case_id")


@query("f04_class_filter", f"WITH {V_SCORED} SELECT id FROM v_scored WHERE label = 1")
def class_filter(spark, d):
    return scored(spark, d).where("label = 1").select("id")
