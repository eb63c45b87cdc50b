"""Queries over call files: lines rendered from tables, read back as records, checked against the values behind them."""

from __future__ import annotations

from pyspark.sql import functions as F

from varloom.functions import parsing as P
from varloom.plans.registry import query
from varloom.operators.base import shared_path
from varloom.plans.vehicles import V_SCORED, choose, from_array, scored, table
from varloom.sources import tables, vcf

FIELDS = ["Allele", "Consequence", "IMPACT"]

#: Every consequence term, for the lines below.
TERMS = (
    "transcript_ablation", "splice_acceptor_variant", "splice_donor_variant", "stop_gained", "frameshift_variant", "stop_lost", "start_lost", "transcript_amplification", "feature_elongation",
    "feature_truncation", "inframe_insertion", "inframe_deletion", "missense_variant", "protein_altering_variant", "splice_donor_5th_base_variant", "splice_region_variant",
    "splice_donor_region_variant", "splice_polypyrimidine_tract_variant", "incomplete_terminal_codon_variant", "start_retained_variant", "stop_retained_variant", "synonymous_variant",
    "coding_sequence_variant", "mature_miRNA_variant", "5_prime_UTR_variant", "3_prime_UTR_variant", "non_coding_transcript_exon_variant", "intron_variant", "NMD_transcript_variant",
    "non_coding_transcript_variant", "coding_transcript_variant", "upstream_gene_variant", "downstream_gene_variant", "TFBS_ablation", "TFBS_amplification", "TF_binding_site_variant",
    "regulatory_region_ablation", "regulatory_region_amplification", "regulatory_region_variant", "intergenic_variant", "sequence_variant",
)

#: A line and the values behind it; {s} is the engine's string type, {first} and {second} are terms.
_BASE = [
    "p_partkey AS n", "concat('chr', cast(1 + p_partkey % 22 AS {s})) AS chrom", "p_partkey + 1000 AS pos", "concat('v', cast(p_partkey AS {s})) AS id",
    "CASE p_partkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'AC' ELSE 'G' END AS ref", "CASE p_partkey % 4 WHEN 0 THEN 'T,C' ELSE 'T' END AS alt", "cast(p_size AS {s}) AS score", "p_size AS score_n",
    "concat({first}, CASE p_partkey % 6 WHEN 0 THEN '&splice_region_variant' WHEN 1 THEN '&NMD_transcript_variant' ELSE '' END) AS c1", "{second} AS c2",
]


def _filled(string: str, pick) -> list[str]:
    return [c.format(s=string, first=pick("p_partkey", TERMS), second=pick("p_partkey * 7 + p_partkey / 41", TERMS)) for c in _BASE]


def _base(spark, d):
    return table(spark, d, "part").selectExpr(*_filled("string", from_array))


#: FORMAT values: two alleles called where there are two, and some without depths.
_BASE += [
    "CASE WHEN p_partkey % 4 = 0 THEN '1/2' WHEN p_partkey % 4 = 1 THEN '0|1' ELSE '1/1' END AS gt",
    "CASE WHEN p_partkey % 8 = 0 THEN '.' WHEN p_partkey % 4 = 0 THEN '4,20,6' ELSE '4,26' END AS ad",
]
_SQL = "b AS (SELECT " + ", ".join(_filled("VARCHAR", choose)) + " FROM part)"
_INFO = "concat('RankScore=fam:', score, ';DB;CSQ=T|', c1, '|HIGH,T|', c2, '|LOW', CASE WHEN n % 10 = 0 THEN '' ELSE ';Frq=' || printf('%.4f', (n % 100)/1e4) END)"
_QUAL = "CASE WHEN n % 3 = 0 THEN '.' ELSE concat(score, '.50') END"
#: Fixed header lines, the two ends of the header of the files.
HEAD = ("##fileformat=VCFv4.2", '##INFO=<ID=RankScore,Number=.,Type=String,Description="Score">', '##INFO=<ID=CSQ,Number=.,Type=String,Description="Consequences. Format: Allele|Consequence|IMPACT">', '##INFO=<ID=Frq,Number=1,Type=Float,Description="Frequency">', '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">')
COLUMNS = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tSAMPLE"
_CUSTOMER = "concat('##INFO=<ID=C', cast(c_custkey AS {s}), ',Number=1,Type=String,Description=\"', c_name, ', ', c_mktsegment, '\">')"
_HEADER_SQL = (
    "hd AS (SELECT unnest([" + ", ".join(f"'{h}'" for h in HEAD) + "]) AS value FROM region WHERE r_regionkey = 0 UNION ALL SELECT " + _CUSTOMER.format(s="VARCHAR") + " FROM customer UNION ALL "
    "SELECT '" + COLUMNS.replace("\t", "' || chr(9) || '") + "' FROM region WHERE r_regionkey = 0)"
)


def lines(spark, d):
    """Text lines as a file would hold them, with their order: a header that has a line a customer, and a record a part."""
    info = F.concat(F.lit("RankScore=fam:"), "score", F.lit(";DB;CSQ=T|"), "c1", F.lit("|HIGH,T|"), "c2", F.lit("|LOW"), F.when(F.col("n") % 10 == 0, "").otherwise(F.concat(F.lit(";Frq="), (F.col("n") % 100 / 1e4).cast("decimal(10,4)").cast("string"))))
    qual = F.when(F.col("n") % 3 == 0, ".").otherwise(F.concat("score", F.lit(".50")))
    sample = F.concat_ws(":", "gt", F.lit("30"), "ad", F.lit("38"))
    body = _base(spark, d).select(F.concat_ws("\t", "chrom", F.col("pos").cast("string"), "id", "ref", "alt", qual, F.lit("PASS"), info, F.lit("GT:DP:AD:GQ"), sample).alias("value"), F.col("n").alias("at"))
    one = table(spark, d, "region").where("r_regionkey = 0")
    top = one.select(F.posexplode(F.array(*[F.lit(h) for h in HEAD])).alias("i", "value")).select("value", (F.col("i") - 4_000_000_000_000).alias("at"))
    defined = table(spark, d, "customer").select(F.expr(_CUSTOMER.format(s="string")).alias("value"), (F.col("c_custkey") - 3_000_000_000_000).alias("at"))
    return top.unionByName(defined).unionByName(one.select(F.lit(COLUMNS).alias("value"), F.lit(-1).cast("long").alias("at"))).unionByName(body)


@query("s01_vcf_records", f"WITH {_SQL} SELECT chrom, pos, id, ref, alt FROM b")
def vcf_records(spark, d):
    return vcf.records(lines(spark, d)).select("chrom", "pos", "id", "ref", F.concat_ws(",", "alt").alias("alt"))


@query(
    "s02_header",
    "SELECT * FROM (VALUES ('INFO', 'RankScore', '.', 'String', 'Score'), ('INFO', 'CSQ', '.', 'String', 'Consequences. Format: Allele|Consequence|IMPACT'), ('INFO', 'Frq', '1', 'Float', 'Frequency'), ('FORMAT', 'GT', '1', 'String', 'Genotype')) v(header_type, id, number, type, description) "
    "UNION ALL SELECT 'INFO', concat('C', c_custkey::VARCHAR), '1', 'String', concat(c_name, ', ', c_mktsegment) FROM customer",
)
def header(spark, d):
    return vcf.header(lines(spark, d)).drop("at")


@query("p12_csq_fields", "SELECT c_custkey AS file, unnest(['Allele', 'Consequence', c_mktsegment]) AS field, unnest([0, 1, 2]) AS place FROM customer")
def csq_fields(spark, d):
    text = F.concat(F.lit('Consequences. Format: Allele|Consequence|'), "c_mktsegment")
    return table(spark, d, "customer").select(F.col("c_custkey").alias("file"), F.posexplode(P.csq_names(text)).alias("place", "field"))


@query("s03_header_conflict", "SELECT n_name AS id, 'INFO' AS header_type, count(DISTINCT c_mktsegment) AS n_kinds FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 HAVING count(DISTINCT c_mktsegment) > 1")
def header_conflict(spark, d):
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return vcf.header_conflicts(rows.select(F.lit("INFO").alias("header_type"), F.col("n_name").alias("id"), F.lit("1").alias("number"), F.col("c_mktsegment").alias("type"), F.lit("").alias("description")))


@query("s04_count", "SELECT count(*) AS n_records FROM part")
def count(spark, d):
    return vcf.count_records(lines(spark, d))


@query("s05_id_list", f"WITH {_SQL} SELECT id FROM b")
def id_list(spark, d):
    return vcf.records(lines(spark, d)).select("id")


@query("s07_info_csv", "SELECT user_id AS case_id, concat('v', event_id::VARCHAR) AS id, CASE WHEN event_type = 'error' THEN 1e0 ELSE 0e0 END AS causative, value AS score_a, CASE WHEN event_id % 3 = 0 THEN NULL ELSE (event_id % 100)::DOUBLE END AS frq FROM events")
def info_csv(spark, d):
    rows = table(spark, d, "events").select(
        F.concat_ws(",", F.col("user_id").cast("string"), F.concat(F.lit("v"), F.col("event_id").cast("string")), F.when(F.col("event_type") == "error", "1.0").otherwise("0.0"), F.col("value").cast("string"), F.lit("x"),
                    F.concat(F.lit("DB;CSQ=a,b"), F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat(F.lit(";Frq="), (F.col("event_id") % 100).cast("string"))))).alias("value")
    )
    return vcf.info_csv(rows).select("case_id", "id", "causative", "score_a", "frq")


@query("s14_flatten", f"WITH {_SQL} SELECT chrom, pos, id, ref, alt, concat('T|', c1, '|HIGH,T|', c2, '|LOW') AS \"CSQ\", 'true' AS \"DB\", concat('fam:', score) AS \"RankScore\", CASE WHEN n % 10 = 0 THEN NULL ELSE round((n % 100)/1e4, 6) END AS \"Frq\" FROM b")
def flatten(spark, d):
    """The columns are those that occur; those that hold numbers alone become numbers."""
    return vcf.flatten(vcf.records(lines(spark, d)), cast=True).withColumn("Frq", F.round("Frq", 6))


_FIXED = "chrom, pos::VARCHAR, id, ref, alt"
_SAMPLE = "concat_ws(':', gt, '30', ad, '38')"


@query(
    "s16_render",
    f"WITH {_SQL}, {_HEADER_SQL} SELECT concat_ws(chr(9), {_FIXED}, {_QUAL}, 'PASS', {_INFO} || ';Score=' || printf('%.5f', score_n / 5e1), 'GT:DP:AD:GQ', {_SAMPLE}) AS value FROM b UNION ALL SELECT value FROM hd "
    "UNION ALL SELECT '##INFO=<ID=Score,Number=1,Type=Float,Description=\"A score\">' FROM region WHERE r_regionkey = 0",
)
def render(spark, d):
    """The whole file with one more key and its definition; all else as it was."""
    score = {"Score": F.format_string("%.5f", P.pair(F.col("info")["RankScore"])["number"] / 50)}
    return vcf.annotated(lines(spark, d), lambda rows: vcf.with_info(rows, score), [vcf.definition("Score", "Float", "A score", "1")]).select("value")


@query("s16_unchanged", f"WITH {_SQL}, {_HEADER_SQL} SELECT concat_ws(chr(9), {_FIXED}, {_QUAL}, 'PASS', {_INFO}, 'GT:DP:AD:GQ', {_SAMPLE}) AS value FROM b UNION ALL SELECT value FROM hd")
def unchanged(spark, d):
    return vcf.annotated(lines(spark, d), lambda rows: rows, []).select("value")


@query("s17_clinvar_labels", f"WITH {_SQL} SELECT concat_ws(chr(9), {_FIXED}, '.', '.', 'CLINVAR_GROUND_TRUTH=fam:' || score, 'GT:DP:AD:GQ', '1/1:30:4,26:38') AS value FROM b")
def clinvar_labels(spark, d):
    return vcf.render(vcf.labelled(vcf.records(lines(spark, d)), "CLINVAR_GROUND_TRUTH", F.col("info")["RankScore"])).select("value")


@query("s18_giab_labels", f"WITH {_SQL} SELECT concat_ws(chr(9), {_FIXED}, '.', '.', 'GIAB_GROUND_TRUTH=benign', 'GT:DP:AD:GQ', {_SAMPLE}) AS value FROM b")
def giab_labels(spark, d):
    return vcf.render(vcf.labelled(vcf.records(lines(spark, d)), "GIAB_GROUND_TRUTH", F.lit("benign"), genotype=None)).select("value")


@query("s19_mutacc_labels", f"WITH {_SQL} SELECT concat_ws(chr(9), {_FIXED}, {_QUAL}, 'PASS', 'MUTACC_GROUND_TRUTH=pathogenic', 'GT:DP:AD:GQ', '1/1:30:4,26:38') AS value FROM b")
def mutacc_labels(spark, d):
    return vcf.render(vcf.labelled(vcf.records(lines(spark, d)), "MUTACC_GROUND_TRUTH", F.lit("pathogenic"), keep_quality=True)).select("value")


@query(
    "s20_split_alleles",
    f"WITH {_SQL}, e AS (SELECT *, unnest(string_split(alt, ',')) AS one, generate_subscripts(string_split(alt, ','), 1) AS k FROM b) "
    "SELECT id, one AS alt, concat_ws(':', CASE WHEN n % 4 <> 0 THEN gt WHEN k = 1 THEN '1/0' ELSE '0/1' END, '30', CASE WHEN n % 4 <> 0 OR n % 8 = 0 THEN ad WHEN k = 1 THEN '4,20' ELSE '4,6' END, '38') AS sample FROM e",
)
def split_alleles(spark, d):
    return vcf.split_alleles(vcf.records(lines(spark, d))).select("id", F.get("alt", 0).alias("alt"), F.get("samples", 0).alias("sample"))


@query("s22_ranked_lines", f"WITH {_SQL}, r AS (SELECT *, row_number() OVER (ORDER BY score_n DESC, id) - 1 AS rank FROM b) SELECT rank, concat_ws(chr(9), {_FIXED}, {_QUAL}, 'PASS', {_INFO}, 'GT:DP:AD:GQ', {_SAMPLE}) AS value FROM r WHERE rank < 500")
def ranked_lines(spark, d):
    """The 500 best records as lines, for a file of their own."""
    from varloom.operators.base import numbered

    rows = vcf.records(lines(spark, d)).withColumn("score", P.pair(F.col("info")["RankScore"])["number"])
    best = rows.orderBy(F.desc("score"), "id").limit(500)
    return vcf.render(numbered(best, [F.desc("score"), F.col("id")], "rank").drop("score")).select("rank", "value")


@query("u08_ordered_lines", f"WITH {_SQL} SELECT row_number() OVER (ORDER BY n) - 1 AS line, id FROM b")
def ordered_lines(spark, d):
    """Shards of any order come back in the order of the file."""
    from varloom.operators.base import numbered

    return numbered(vcf.records(lines(spark, d).repartition(5)).select("at", "id"), [F.col("at")], "line").select("line", "id")


@query("s06_read_group", f"WITH {_SQL} SELECT id, [coalesce(CASE WHEN n % 10 = 0 THEN NULL ELSE round((n % 100)/1e4, 6) END, 0), score_n::DOUBLE] AS frq_score, n % 3 = 0 AS label FROM b WHERE n % 2 = 0")
def read_group(spark, d):
    rows = vcf.records(lines(spark, d)).select("id", F.round(P.number(F.try_element_at("info", F.lit("Frq"))), 6).alias("frq"), P.pair(F.col("info")["RankScore"])["number"].alias("score"), (F.col("at") % 3 == 0).alias("label"), F.when(F.col("at") % 2 == 0, "train").otherwise("test").alias("set"))
    return tables.select_group(rows, "set", "train", ["id", ["frq", "score"]], "label", fill=0.0)


@query("s09_columns_at", "SELECT concat('v', event_id::VARCHAR) AS id, value AS genmod FROM events")
def columns_at(spark, d):
    text = table(spark, d, "events").select(F.concat_ws(",", F.col("user_id").cast("string"), F.lit("x"), F.concat(F.lit("v"), F.col("event_id").cast("string")), F.lit("y"), F.lit("z"), F.col("value").cast("string")).alias("value"))
    return tables.columns_at(text, {2: "id", 5: "genmod"}).withColumn("genmod", F.col("genmod").cast("double"))


@query("s10_equal_counts", "SELECT (SELECT count(*) FROM orders) AS rows_a, (SELECT count(DISTINCT o_orderkey) FROM orders) AS rows_b")
def equal_counts(spark, d):
    """The orders as they were read, and as they come back from a columnar copy, a row a key."""
    rows, path = table(spark, d, "orders"), shared_path(spark, "orders")
    rows.dropDuplicates(["o_orderkey"]).select("o_orderkey", "o_custkey").write.parquet(path)
    return tables.equal_counts(rows.select("o_orderkey"), spark.read.parquet(path))


@query("s15_written_groups", "SELECT CASE WHEN event_id % 4 = 0 THEN 'test' ELSE 'train' END AS dataset, event_id::INTEGER AS id, round((value / 5e2)::FLOAT, 5) AS score, event_type AS consequence FROM events")
def written_groups(spark, d):
    """A columnar set written group by group with its type map, and read back."""
    rows, path = scored(spark, d).select("dataset", "id", F.col("score_a").alias("score"), "consequence"), shared_path(spark, "groups")
    for name in ("train", "test"):
        tables.write_groups(rows.where(F.col("dataset") == name), path, "dataset", {"score": "float32", "id": "int", "consequence": "utf-8"})
    return spark.read.parquet(path).select("dataset", "id", F.round("score", 5).alias("score"), "consequence")


@query("s21_dumped_rows", f"WITH {V_SCORED} SELECT dataset, id::VARCHAR AS id, label::VARCHAR AS label, CASE WHEN score_a >= 0.1 THEN CASE WHEN label = 1 THEN 'TP' ELSE 'FP' END WHEN label = 1 THEN 'FN' ELSE 'TN' END AS outcome FROM v_scored")
def dumped_rows(spark, d):
    """Classified rows as tab-separated text, a folder a set, read back as text."""
    from varloom.functions import metrics as M

    rows = scored(spark, d).select("dataset", "id", "label", M.outcome(F.when(F.col("score_a") >= 0.1, 1).otherwise(0), F.col("label")).alias("outcome"))
    tables.dump_groups(rows, path := shared_path(spark, "rows"), "dataset")
    return spark.read.option("sep", "\t").option("header", True).csv(path).select("dataset", "id", "label", "outcome")


@query("s25_export", f"WITH {V_SCORED} SELECT round(score_a::FLOAT, 5) AS first_score, round(score_b::FLOAT, 5) AS second_score, label::FLOAT AS causative FROM v_scored")
def export(spark, d):
    """The three columns of a training set as single-precision numbers, written and read back."""
    tables.export_columns(scored(spark, d), {"first_score": "score_a", "second_score": "score_b", "causative": "label"}, path := shared_path(spark, "export"))
    return spark.read.parquet(path).select(*[F.round(c, 5).alias(c) for c in ("first_score", "second_score")], "causative")


@query("f08_columns", "SELECT o_orderkey, o_totalprice FROM orders")
def chosen(spark, d):
    from varloom.operators.profiles import chosen_columns

    return chosen_columns(table(spark, d, "orders"), ["o_orderkey", "o_totalprice", "o_comment"] if "o_comment" in table(spark, d, "orders").columns else ["o_orderkey", "o_totalprice", "o_custkey"], [c for c in ("o_comment",) if c in table(spark, d, "orders").columns] or ["o_custkey"])


@query("s11_lookup_table", "SELECT c_custkey::VARCHAR AS \"Line_Number\", c_name AS \"Sample_ID\" FROM customer")
def lookup_table(spark, d):
    text = table(spark, d, "customer").select(F.concat_ws("\t", F.col("c_custkey").cast("string"), "c_name").alias("value"))
    top = table(spark, d, "region").where("r_regionkey = 0").select(F.lit("Line_Number\tSample_ID").alias("value"))
    return tables.lookup_table(top.unionByName(text), ["Line_Number", "Sample_ID"])


@query("s13_case_summaries", "SELECT user_id AS case_id, count(*) AS n, max(value) AS top FROM events GROUP BY user_id")
def case_summaries(spark, d):
    """Written as JSON, one row a case, and read back."""
    rows = table(spark, d, "events").groupBy(F.col("user_id").alias("case_id")).agg(F.count("*").alias("n"), F.max("value").alias("top"))
    return tables.from_summaries(tables.summaries(rows, "case_id"), "case_id", "n long, top double")


@query("p01_coerce", f"WITH {_SQL} SELECT id, CASE WHEN n % 10 = 0 THEN NULL ELSE round((n % 100)/1e4, 6) END AS number, concat('fam:', score) AS text FROM b")
def coerce(spark, d):
    rows = vcf.records(lines(spark, d), {"Frq": P.typed, "RankScore": P.typed})
    return rows.select("id", F.round("Frq.number", 6).alias("number"), F.col("RankScore.text").alias("text"))


@query("p11_field_types", f"WITH {_SQL} SELECT 'Frq' AS field, 'number' AS type, count(CASE WHEN n % 10 <> 0 THEN 1 END) AS n FROM b UNION ALL SELECT 'RankScore', 'text', count(*) FROM b")
def field_types(spark, d):
    rows = vcf.records(lines(spark, d), {"Frq": P.typed, "RankScore": P.typed}).select(F.col("Frq.kind").alias("Frq"), F.col("RankScore.kind").alias("RankScore"))
    return rows.unpivot([], ["Frq", "RankScore"], "field", "type").where("type IS NOT NULL").groupBy("field", "type").agg(F.count("*").alias("n"))


@query("p03_triples", f"WITH {_SQL} SELECT id, 'fam' AS family_id, score_n::DOUBLE AS low, score_n + 1e0 AS high FROM b")
def triples(spark, d):
    text = F.concat(F.lit("fam:"), "score", F.lit(":"), (F.col("score_n") + 1).cast("string"))
    return _base(spark, d).select("id", P.triple(text).alias("t")).select("id", "t.family_id", "t.low", "t.high")


@query("p04_two_parts", f"WITH {_SQL} SELECT id, 'fam' AS family_id, concat(c1, '>', c2) AS compounds FROM b")
def two_parts(spark, d):
    parts = P.two_parts(F.concat(F.lit("fam:"), "c1", F.lit(">"), "c2"))
    return _base(spark, d).select("id", parts.alias("p")).select("id", F.get("p", 0).alias("family_id"), F.get("p", 1).alias("compounds"))


@query("p05_rank_result", f"WITH {_SQL} SELECT id, concat(score, '|', c1) AS rank_result FROM b")
def rank_result(spark, d):
    return _base(spark, d).select("id", P.passed_on(F.concat("score", F.lit("|"), "c1")).alias("rank_result"))


@query("p06_unescape", f"WITH {_SQL} SELECT id, concat('p.', c1, ' ', score) AS text FROM b")
def unescape(spark, d):
    return _base(spark, d).select("id", P.unescape(F.concat(F.lit("p.%3D"), "c1", F.lit("%2C "), "score", F.lit("%3D"))).alias("text"))


@query("p07_alleles", f"WITH {_SQL} SELECT id, alt FROM b")
def alleles(spark, d):
    return _base(spark, d).select("id", P.allele(F.concat(F.lit("['"), "alt", F.lit("']"))).alias("alt"))


@query("p33_stand_ins", f"WITH {_SQL} SELECT id, CASE WHEN n % 5 = 0 THEN 'N/A' ELSE c1 END AS text, CASE WHEN n % 10 = 0 THEN 'N/A' ELSE 'numtype' END AS frq FROM b")
def stand_ins(spark, d):
    frq = P.stand_in(F.when(F.col("n") % 10 != 0, F.col("n") % 100 / 1e4), numeric=True)
    return _base(spark, d).select("id", P.stand_in(F.when(F.col("n") % 5 != 0, F.col("c1"))).alias("text"), frq.alias("frq"))


@query("p02_pairs", f"WITH {_SQL} SELECT id, 'fam' AS family_id, score_n::DOUBLE AS number FROM b")
def pairs(spark, d):
    return vcf.records(lines(spark, d)).select("id", P.pair(F.col("info")["RankScore"]).alias("p")).select("id", "p.family_id", "p.number")


@query("p10_typed_access", f"WITH {_SQL} SELECT id, CASE WHEN n % 10 = 0 THEN NULL ELSE round((n % 100)/1e4, 6) END AS frq FROM b")
def typed_access(spark, d):
    return vcf.records(lines(spark, d)).select("id", F.round(P.number(F.try_element_at("info", F.lit("Frq"))), 6).alias("frq"))


_SEVERITIES = """
    CASE {c} WHEN 'transcript_ablation' THEN 41 WHEN 'splice_acceptor_variant' THEN 40 WHEN 'splice_donor_variant' THEN 39 WHEN 'stop_gained' THEN 38 WHEN 'frameshift_variant' THEN 37
    WHEN 'stop_lost' THEN 36 WHEN 'start_lost' THEN 35 WHEN 'transcript_amplification' THEN 34 WHEN 'feature_elongation' THEN 33 WHEN 'feature_truncation' THEN 32 WHEN 'inframe_insertion' THEN 31
    WHEN 'inframe_deletion' THEN 30 WHEN 'missense_variant' THEN 29 WHEN 'protein_altering_variant' THEN 28 WHEN 'splice_donor_5th_base_variant' THEN 27 WHEN 'splice_region_variant' THEN 26
    WHEN 'splice_donor_region_variant' THEN 25 WHEN 'splice_polypyrimidine_tract_variant' THEN 24 WHEN 'incomplete_terminal_codon_variant' THEN 23 WHEN 'start_retained_variant' THEN 22
    WHEN 'stop_retained_variant' THEN 21 WHEN 'synonymous_variant' THEN 20 WHEN 'coding_sequence_variant' THEN 19 WHEN 'mature_miRNA_variant' THEN 18 WHEN '5_prime_UTR_variant' THEN 17
    WHEN '3_prime_UTR_variant' THEN 16 WHEN 'non_coding_transcript_exon_variant' THEN 15 WHEN 'intron_variant' THEN 14 WHEN 'NMD_transcript_variant' THEN 13 WHEN 'non_coding_transcript_variant' THEN 12
    WHEN 'coding_transcript_variant' THEN 11 WHEN 'upstream_gene_variant' THEN 10 WHEN 'downstream_gene_variant' THEN 9 WHEN 'TFBS_ablation' THEN 8 WHEN 'TFBS_amplification' THEN 7
    WHEN 'TF_binding_site_variant' THEN 6 WHEN 'regulatory_region_ablation' THEN 5 WHEN 'regulatory_region_amplification' THEN 4 WHEN 'regulatory_region_variant' THEN 3 WHEN 'intergenic_variant' THEN 2
    WHEN 'sequence_variant' THEN 1 END"""
_SEV = "list_sum(list_transform(string_split({c}, '&'), lambda k: " + _SEVERITIES.format(c="k") + "))"


@query("p13_severity", f"WITH {_SQL} SELECT id, {_SEV.format(c='c1')}::INTEGER AS severity FROM b")
def severity(spark, d):
    return _base(spark, d).select("id", P.severity(F.col("c1")).alias("severity"))


@query("p14_worst_consequence", f"WITH {_SQL} SELECT id, CASE WHEN {_SEV.format(c='c2')} > {_SEV.format(c='c1')} THEN c2 ELSE c1 END AS consequence, CASE WHEN {_SEV.format(c='c2')} > {_SEV.format(c='c1')} THEN 'LOW' ELSE 'HIGH' END AS impact FROM b")
def worst_consequence(spark, d):
    rows = vcf.records(lines(spark, d)).select("id", P.worst_transcript(F.col("info")["CSQ"], FIELDS).alias("w"))
    return rows.select("id", F.col("w.Consequence").alias("consequence"), F.col("w.IMPACT").alias("impact"))


@query("p44_row_range", f"WITH {_SQL}, r AS (SELECT id, row_number() OVER (ORDER BY chrom, pos) - 1 AS n FROM b) SELECT n, id FROM r WHERE n >= 10 AND n < 60")
def row_range(spark, d):
    from varloom.operators.base import numbered

    rows = numbered(vcf.records(lines(spark, d)).select("chrom", "pos", "id"), [F.col("chrom"), F.col("pos")], "n")
    return rows.where("n >= 10 AND n < 60").select("n", "id")
