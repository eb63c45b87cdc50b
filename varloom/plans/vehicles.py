"""Views that give the driver's tables the roles of score tables, truth sets, call sets and label texts.

Each view is one select list for Spark and the same in SQL for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SCORED = [
    "event_id AS id", "user_id AS case_id", "value / 5e2 AS score_a", "cast({k} AS double) / 1e2 AS score_b",
    "CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label",
    "CASE WHEN event_id % 7 = 0 THEN NULL ELSE (event_id % 1000) / 2e5 END AS frq",
    "CASE WHEN event_id % 5 = 0 THEN NULL ELSE (event_id % 700) / 2e5 END AS frq2",
    "CASE WHEN event_id % 3 = 0 THEN NULL ELSE (event_id % 90) / 2e5 END AS frq3",
    "event_type AS consequence", "CASE WHEN event_id % 4 = 0 THEN 'test' ELSE 'train' END AS dataset",
]


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*[c.format(k="get_json_object(props, '$.k')") for c in _SCORED])


V_SCORED = "v_scored AS (SELECT " + ", ".join(c.format(k="json_extract_string(props, '$.k')") for c in _SCORED) + " FROM events)"


def causative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).where("label = 1 AND case_id % 11 <> 0").groupBy("case_id").agg({"id": "min"}).withColumnRenamed("min(id)", "id")


V_CAUSATIVE = V_SCORED + ", v_causative AS (SELECT case_id, min(id) AS id FROM v_scored WHERE label = 1 AND case_id % 11 <> 0 GROUP BY case_id)"


def legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = scored(spark, sf_dir).selectExpr("id", "((id * 37) % 1000) / 1e3 AS genmod")
    return base.unionAll(base.where("id % 5 = 0").selectExpr("id", "genmod / 2e0 AS genmod"))


V_LEGACY = V_SCORED + ", v_base AS (SELECT id, ((id * 37) % 1000) / 1e3 AS genmod FROM v_scored), v_legacy AS (SELECT * FROM v_base UNION ALL SELECT id, genmod / 2e0 FROM v_base WHERE id % 5 = 0)"

_SITE = ["concat('chr', cast(1 + p_partkey % 22 AS string)) AS chrom", "p_partkey AS pos", "substr('ACGT', cast(1 + p_partkey % 4 AS int), 1) AS ref", "substr('CGTA', cast(1 + (p_partkey + {shift}) % 4 AS int), 1) AS alt"]


def sites(spark: SparkSession, sf_dir: str, keep: str, shift: str = "0") -> DataFrame:
    return table(spark, sf_dir, "part").where(keep).selectExpr(*[c.format(shift=shift) for c in _SITE])


V_SITES = (
    "v_a AS (SELECT " + ", ".join(c.format(shift="0") for c in _SITE) + " FROM part WHERE p_partkey % 3 <> 0), "
    "v_b AS (SELECT " + ", ".join(c.format(shift="p_partkey % 2") for c in _SITE) + " FROM part WHERE p_partkey % 5 <> 0)"
)


def site_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sites(spark, sf_dir, "p_partkey % 3 <> 0")


def site_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sites(spark, sf_dir, "p_partkey % 5 <> 0", "p_partkey % 2")


_WIDE = [
    "concat_ws('-', cast(l_orderkey AS string), cast(l_linenumber AS string), cast(l_partkey AS string), cast(l_suppkey AS string)) AS id",
    "CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS quantity", "CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE l_extendedprice END AS price",
    "CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE l_discount END AS discount", "l_tax AS tax", "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label",
    "CASE WHEN l_linestatus = 'F' THEN 'train' ELSE 'test' END AS dataset", "l_orderkey AS case_id",
]
WIDE_COLUMNS = ("quantity", "price", "discount", "tax")


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*_WIDE)


V_WIDE = "v_wide AS (SELECT " + ", ".join(_WIDE) + " FROM lineitem)"



def choose(number: str, values) -> str:
    """A CASE over number modulo the number of values, which both engines read alike."""
    return f"CASE cast(floor({number}) AS int) % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


def from_array(number: str, values) -> str:
    """choose() for Spark alone: the value is read from an array. A CASE repeats the number for each value, and a method of that size is never compiled."""
    return "get(array(" + ", ".join(f"'{v}'" for v in values) + f"), cast(floor({number}) AS int) % {len(values)})"


#: Every keyword that a clinical label may hold: those with a label, then those without.
_LABELLED = choose("p_partkey", ("Benign", "likely_benign", "Affects", "drug_response", "protective", "Pathogenic", "likely_pathogenic", "association", "risk_factor", "Likely_risk_allele"))
_UNLABELLED = choose("p_partkey", (".", "Uncertain_significance", "not_provided", "other", "confers_sensitivity", "association_not_found", "Uncertain_risk_allele", "Conflicting_interpretations_of_pathogenicity", "low_penetrance"))
_CLNSIG = [
    "p_partkey AS id",
    f"CASE cast(floor(p_partkey / 7) AS int) % 6 WHEN 0 THEN concat('Pathogenic|', {_LABELLED}) WHEN 1 THEN concat('_', {_LABELLED}, '/Likely_benign_') WHEN 2 THEN {_UNLABELLED} WHEN 3 THEN concat({_LABELLED}, ',', {_UNLABELLED}) WHEN 4 THEN '' ELSE {_LABELLED} END AS clnsig",
    "CASE WHEN cast(floor(p_partkey / 7) AS int) % 6 = 4 AND p_partkey % 2 = 0 THEN CASE WHEN p_partkey % 3 = 0 THEN 'pathogenic' ELSE 'benign' END ELSE '' END AS giab", "CASE WHEN cast(floor(p_partkey / 7) AS int) % 6 = 4 AND p_partkey % 2 = 1 THEN CASE WHEN p_partkey % 3 = 0 THEN 'benign' ELSE 'pathogenic' END ELSE '' END AS mutacc",
    "p_size AS size",
]


def clnsig(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(*_CLNSIG)


V_CLNSIG = "v_clnsig AS (SELECT " + ", ".join(_CLNSIG) + " FROM part)"
