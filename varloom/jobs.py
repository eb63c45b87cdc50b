"""The user-level jobs: whole runs from files to files, each a composition of the library's operators.

python -m varloom.jobs NAME ARGUMENT... runs one from the command line (spark-submit works alike).
"""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.functions import metrics as M
from varloom.functions import parsing as P
from varloom.operators import attribution as S
from varloom.operators import joins as J
from varloom.operators import modelling as C
from varloom.operators import profiles as O
from varloom.operators import ranking as R
from varloom.operators import thresholds as T
from varloom.operators.base import numbered, settled
from varloom.operators.splits import folds, split_by_source
from varloom.sources import tables, vcf


def concat_vcfs(spark: SparkSession, inputs: list[str], out: str) -> None:
    """Concatenation of files that may overlap, duplicates kept, in the order of the headers' contigs and of positions, under the header of the first.

    A missing input is an error, as are headers that define an id differently and records on a contig that no header names.
    """
    text = vcf.lines(spark, inputs)
    if conflicts := [r["id"] for r in vcf.header_conflicts(vcf.header(text)).limit(20).collect()]:
        raise ValueError(f"the inputs define differently: {', '.join(conflicts)}")
    parts = F.split("value", "\t")
    body = text.where(~F.col("value").startswith("#") & (F.col("value") != "")).select("value", F.get(parts, 0).alias("chrom"), F.get(parts, 1).cast("long").alias("pos"), "at")
    ranked = vcf.in_contig_order(body, vcf.contigs(text), ["pos", "at"])
    head = vcf.lines(spark, inputs[0]).where(F.col("value").startswith("#")).select("value", F.lit(None).cast("string").alias("chrom"), F.lit(-1).cast("long").alias("pos"), "at", F.lit(0).alias("contig_rank"))
    head.unionByName(ranked).orderBy("contig_rank", "pos", "at").select("value").write.mode("errorifexists").text(out)


def compile_vcf(spark: SparkSession, inputs: list[str], out: str, labels: dict[str, str], test_ratio: float = 0.25, ignore: tuple[str, ...] = (), clinical: str = "CLINVAR_GROUND_TRUTH") -> DataFrame:
    """Variant files to a labelled, split columnar data set (groups train and test) with its column types beside it; the written table.

    labels: INFO keys of label texts and their origin, TRAIN, TEST or BOTH. The key `clinical` holds significance keywords: rows with a masked one
    are dropped, the others are read by the keyword table. All other keys hold benign or pathogenic. Each row must have exactly one
    label, ids must be unique. Transcripts are expanded to a column for each field that the header's description of CSQ names, of the most
    severe one; columns whose every value is a number become numbers.
    """
    text = vcf.lines(spark, inputs)
    flat = vcf.with_transcripts(vcf.flatten(vcf.records(text), cast=False), vcf.transcript_fields(text))
    own = [c for c in labels if c in flat.columns]
    if not own:
        raise ValueError(f"no record has a label: {', '.join(labels)}")
    clean = flat
    if clinical in own:
        clean = flat.where(~F.coalesce(P.masked(F.nullif(F.col(clinical), F.lit(""))), F.lit(False)))
    read = {c: P.clinical_label(F.col(c)) if c == clinical else P.binary_label(F.col(c)) for c in own}
    clean = clean.withColumns(
        {"uid": P.variant_id(F.col("pos"), F.col("chrom"), F.col("ref"), F.col("alt")), "label": P.only_label(read), "origin": P.only_label({c: F.lit(labels[c]) for c in own})}
    ).drop(*own)
    if twice := [r["uid"] for r in clean.groupBy("uid").count().where("count > 1").limit(5).collect()]:
        raise ValueError(f"ids that are not unique: {', '.join(twice)}")
    texts = [c for c in clean.columns if c not in ("uid", "label", "origin", "chrom", "id", "ref", "alt", "pos")]
    plain = lambda c: F.col(f"`{c}`").isNull() | (F.col(f"`{c}`") == "") | P.number(F.col(f"`{c}`")).isNotNull()
    given = lambda c: F.count(F.nullif(F.col(f"`{c}`"), F.lit(""))) > 0
    numeric = clean.agg(*[(F.bool_and(plain(c)) & given(c)).alias(c) for c in texts]).first() if texts else {}  # a flag a column
    typed = clean.withColumns({c: P.number(F.col(f"`{c}`")) for c in texts if numeric[c]})
    split = split_by_source(O.chosen_columns(typed, ignore=list(ignore)), "uid", "origin", test_ratio)
    tables.write_groups(split.withColumnRenamed("dataset", "set"), out, "set", mode="errorifexists")
    tables.write_types(split.withColumnRenamed("dataset", "set"), out)
    return spark.read.parquet(out)


def train_on_set(spark: SparkSession, path: str, model: str, texts: list[str] = C.TEXTS, numbers: list[str] = C.NUMBERS, **settings) -> DataFrame:
    """A classifier fitted on the train group of a compiled set and saved to `model`, with its background beside it; (set, matrix and metrics) of
    both groups. Features that the set lacks count as missing."""
    rows = C.filled(C.without_uncertain(spark.read.parquet(path), texts=texts), texts, numbers)
    train = rows.where("set = 'train'")
    fitted = C.fit_variant_classifier(train, texts, numbers, path=f"{model}/classifier", **settings)
    S.benign_background(train, "uid", [*texts, *numbers], F.col("label") == 0).write.parquet(f"{model}/background")
    tables.write_types(train.select(*[F.col(f"`{c}`") for c in (*texts, *numbers)]), f"{model}/features")
    scored = C.probability(fitted, rows).withColumn("__p", F.when(F.col("score") >= 0.5, 1).otherwise(0))
    return T.with_metrics(scored.groupBy("set").agg(*M.confusion(F.col("__p"), F.col("label"))))


def predict_with_model(spark: SparkSession, path: str, out: str, model: str, name: str = "Score", threshold: float = 0.9, rename: str = "", ignore_uncertain: bool = True, permutations: int = 8) -> None:
    """One file scored by a saved classifier; all else of the file stays as it was.

    Every record gets <name>; those that reach the threshold also <name>Explanation, the Shapley values of their features against
    the benign background that was saved with the model. rename (FEATURE:KEY, comma-separated) reads a feature from
    another key and names it so in the explanation; clinical texts that are uncertain are blanked for scoring alone.
    """
    kinds = tables.read_types(spark, f"{model}/features")
    texts, numbers = [c for c, t in kinds.items() if t == "string"], [c for c, t in kinds.items() if t != "string"]
    keys = {c: c for c in (*texts, *numbers)} | dict(pair.split(":", 1) for pair in filter(None, rename.split(",")))
    if unknown := [c for c in keys if c not in kinds]:
        raise ValueError(f"not a feature of the model: {', '.join(unknown)}")
    fitted, text = C.load_classifier(f"{model}/classifier"), vcf.lines(spark, path)
    fields = vcf.transcript_fields(text)
    read = [c for c in {k for v in keys.values() for k in ([v] if not v.startswith("CSQ_") else ["CSQ"])}]
    rows = vcf.records(text)
    value = lambda k: F.try_element_at("info", F.lit(k))
    flat = vcf.with_transcripts(rows.select("at", *[value(k).alias(k) for k in read]), fields)
    if ignore_uncertain:
        flat = C.without_uncertain(flat, keys.get("CSQ_CLINVAR_CLNSIG", "CSQ_CLINVAR_CLNSIG"), [keys[c] for c in texts])
    have = set(flat.columns)
    named = flat.select("at", *[F.col(f"`{k}`").alias(c) for c, k in keys.items() if k in have])
    scored = settled(C.probability(fitted, C.filled(named, texts, numbers)))
    ground = spark.read.parquet(f"{model}/background")
    why = S.shapley(scored.where(F.col("score") >= threshold), "at", [*texts, *numbers], ground, lambda mixed: C.probability(fitted, mixed, "__score"), permutations)
    why = why.select(F.col("at").alias("__at"), P.explanation({keys[c]: F.col(f"`phi_{c}`") for c in (*texts, *numbers)}).alias("__why"))
    told = scored.select(F.col("at").alias("__at"), F.col("score").alias("__score")).join(why, "__at", "left")
    change = lambda records: vcf.with_info(records.join(told, F.col("at") == F.col("__at")), {name: F.format_string("%.5f", "__score"), f"{name}Explanation": F.col("__why")}).drop("__at", "__score", "__why")
    new = [vcf.definition(name, "Float", "Score of the variant", "1"), vcf.definition(f"{name}Explanation", "String", "Contributions to the score")]
    vcf.write(vcf.annotated(text, change, new), out)


def predict_on_vcf(spark: SparkSession, path: str, out: str, score: Column, contributions: dict[str, Column], name: str = "Score", threshold: float = 0.5, rename: str = "", blank_uncertain: str | None = None) -> None:
    """One file with a score, and an explanation for the rows that reach the threshold; all else of the file stays as it was.

    score and contributions are expressions over the map column info, whose keys may be renamed (NEW:OLD, comma-separated) and
    whose clinical text (the key blank_uncertain) is blanked where it is uncertain, for scoring alone.
    """

    def change(rows: DataFrame) -> DataFrame:
        seen = F.col("info")
        for pair in filter(None, rename.split(",")):
            new, old = pair.split(":")
            seen = F.map_concat(F.map_filter(seen, lambda k, v, new=new: k != new), F.create_map(F.lit(new), F.try_element_at(seen, F.lit(old))))  # noqa: B023
        if blank_uncertain:
            unsure = F.lower(F.coalesce(F.try_element_at(F.col("info"), F.lit(blank_uncertain)), F.lit(""))).rlike("uncertain|conflicting")
            seen = F.transform_values(seen, lambda k, v: F.when((k == blank_uncertain) & unsure, "").otherwise(v))
        held = rows.withColumns({"__info": F.col("info"), "info": seen})
        held = held.withColumns({"__score": score, "__why": P.explanation(contributions)}).withColumn("info", F.col("__info"))
        return vcf.with_info(held, {name: F.format_string("%.5f", "__score"), f"{name}Explanation": F.when(F.col("__score") >= threshold, F.col("__why"))}).drop("__info", "__score", "__why")

    new = [vcf.definition(name, "Float", "Score of the variant", "1"), vcf.definition(f"{name}Explanation", "String", "Contributions to the score")]
    vcf.write(vcf.annotated(vcf.lines(spark, path), change, new), out)


def explore_inference(df: DataFrame, score: str, label: str, group: str, out: str, cut: float = 0.5) -> dict[str, DataFrame]:
    """Matrices, a threshold sweep, exact areas and classified rows of a scored table, for each set; the rows also as text."""
    rows = df.withColumn("__p", F.when(F.col(score) >= cut, 1).otherwise(0))
    classified = df.withColumns({"residual": F.col(label) - F.col(score), "outcome": M.outcome(F.when(F.col(score) >= cut, 1).otherwise(0), F.col(label))})
    tables.dump_groups(classified, out, group)
    return {
        "matrix": T.with_metrics(rows.groupBy(group).agg(*M.confusion(F.col("__p"), F.col(label)))),
        "sweep": T.with_metrics(T.sweep(df, F.col(score), F.col(label), T.linspace(0.0, 1.0, 100), by=[group])),
        "auc": T.roc_auc_by(df, score, label, [group]),
    }


def view_ranked_vcf(spark: SparkSession, paths: list[str], causative: list[str], scores: list[str], out: str, most_frequent: float | None = None, frequency: str = "Frq", top: int = 500) -> DataFrame:
    """(case_name, id, rank_<score>...) of the causative variants of each file, by each score.

    Under out, for each score: the best rows as CSV, and as variant files, one ordered file a case under its own header; causative: one file a case
    of its causative records, in the file's order; summaries: the ranks as JSON. The case is what stands before the first underscore of
    a file's name. NULL frequencies count as 0.
    """
    text = vcf.file_key(vcf.lines(spark, paths))
    rows = vcf.records(text)
    value = lambda k: F.coalesce(P.number(F.try_element_at("info", F.lit(k))), P.pair(F.try_element_at("info", F.lit(k)))["number"])
    table = rows.select("case_name", "chrom", "pos", "id", "at", *[value(s).alias(s) for s in scores], F.coalesce(value(frequency), F.lit(0.0)).alias("__frq"))
    kept = table if most_frequent is None else table.where(F.col("__frq") <= most_frequent)
    asked = spark.createDataFrame([(i,) for i in causative], "id string")
    ranked = None
    for s in scores:
        placed = numbered(kept, [F.col("case_name"), F.desc(s), F.col("id")], "__n")
        first = placed.groupBy("case_name").agg(F.min("__n").alias("__first"))
        placed = placed.join(first, "case_name").withColumn("rank", F.col("__n") - F.col("__first"))
        best = placed.where(F.col("rank") < top)
        vcf.write_cases(rows.join(best.select("at", "rank"), "at"), text, "case_name", [F.col("rank")], f"{out}/{s}-vcf")
        best.select("case_name", "rank", "id", s).write.mode("errorifexists").partitionBy("case_name").option("header", True).csv(f"{out}/{s}")
        mine = placed.join(asked, "id", "left_semi").select("case_name", "id", F.col("rank").alias(f"rank_{s}"))
        ranked = mine if ranked is None else ranked.join(mine, ["case_name", "id"], "full_outer")
    vcf.write_cases(rows.join(asked, "id", "left_semi"), text, "case_name", [F.col("at")], f"{out}/causative")
    tables.summaries(ranked, "id").write.mode("errorifexists").parquet(f"{out}/summaries")
    return ranked


def rank_score_report(reference: DataFrame, test: DataFrame, key: str, raw: str, normalised: str, tolerance: float = 1e-6) -> dict[str, DataFrame]:
    """Integrity of normalised scores, and rows that drift from a reference set or are in one of the two alone."""
    s = test.agg(F.count("*").alias("n"), F.count_if(F.col(normalised).isNull()).alias("n_null"), F.count_if((F.col(normalised) < 0) | (F.col(normalised) > 1)).alias("out_of_range"))
    joined = reference.select(key, F.col(raw).alias("__ref")).join(test.select(key, F.col(raw).alias("__test")), key, "full_outer").withColumn("drift", F.col("__test") - F.col("__ref"))
    return {"integrity": s, "drift": joined.where(F.col("drift").isNull() | (F.abs("drift") >= tolerance)).select(key, "drift")}


def rank_score_statistics(df: DataFrame, key: str, score: str, label: str, steps: int = 100, bins: int = 1000) -> dict[str, DataFrame]:
    """How well a score tells the classes apart, by threshold over its own range.

    sweep: matrix and metrics at each threshold; folds: mean and deviation of MCC and F1 over ten folds in the order of the key;
    optimum: for both metrics the best value and all thresholds that reach it; auc: exact; histogram: by label.
    """
    x, y = F.col(score), F.col(label)
    rows = settled(df.select(key, score, label))
    grid = F.broadcast(T.data_grid(rows, x, steps))  # one row
    whole = T.with_metrics(T.sweep(rows.crossJoin(grid), x, y, F.col("steps")))
    parts = T.with_metrics(T.sweep(folds(rows, [F.col(key)]).crossJoin(grid), x, y, F.col("steps"), by=["fold"]))
    spread = [f(m).alias(f"{m}_{n}") for m in ("mcc_score", "f1") for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
    best = [T.optimum(whole, m).withColumn("metric", F.lit(m)) for m in ("mcc_score", "f1")]
    return {
        "sweep": whole,
        "folds": parts.groupBy("i", "threshold").agg(F.count("*").alias("folds"), *spread),
        "optimum": best[0].unionByName(best[1]),
        "auc": T.roc_auc(rows, x, y),
        "histogram": O.data_histogram(rows, x, bins, [label]),
    }


def data_report(df: DataFrame, group: str, label: str, allow: list[str] | None = None, ignore: list[str] = (), bins: int = 1000, shown: int = 20) -> dict[str, DataFrame]:
    """Label shares, missing values, correlations, quartiles, histograms, word counts, sizes and `shown` rows of a data set. The rows
    are those of the smallest digests, so the same ones each time."""
    rows = O.chosen_columns(df, allow, [c for c in ignore if c not in (group, label)])
    numbers = [c for c in O.numeric_columns(rows) if c not in (group, label)]
    texts = [c for c, t in rows.dtypes if t == "string" and c not in (group, label)]
    return {
        "labels": rows.groupBy(group, label).agg(F.count("*").alias("n")),
        "missing": O.missing_ratio(rows, [*numbers, *texts], group, label),
        **({"correlation": O.correlations(rows, numbers)} if len(numbers) > 1 else {}),
        "quartiles": O.box_summary(rows, [group], numbers),
        "profile": O.dataset_profile(rows, [group]),
        "sample": rows.orderBy(F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])))).limit(shown),
        **{f"histogram_{c}": O.data_histogram(rows, F.col(c), bins, [group]) for c in numbers},
        **{f"words_{c}": O.word_occurrence(rows, c, label) for c in texts},
    }


def gated_scores(spark: SparkSession, path: str, out: str, a: str, g: str, slope: float = 2.0, offset: float = -0.95, name: str = "GatedScore") -> None:
    """One file with the combined score of two INFO keys; rows that lack one get no score."""
    value = lambda k: F.coalesce(P.number(F.try_element_at("info", F.lit(k))), P.pair(F.try_element_at("info", F.lit(k)))["number"])
    combined = F.format_string("%.5f", M.gate(value(a), value(g), slope, offset))
    change = lambda rows: vcf.with_info(rows, {name: F.when(value(a).isNotNull() & value(g).isNotNull(), combined)})
    vcf.write(vcf.annotated(vcf.lines(spark, path), change, [vcf.definition(name, "Float", "Gated score", "1")]), out)


def label_vcf(spark: SparkSession, path: str, out: str, kind: str, label: str = "", confirmed: str | None = None) -> None:
    """A labelled file: kind clinvar (the label is each record's CLNSIG), giab (a given label, own genotypes, sites split by allele)
    or mutacc (a given label, own QUAL and FILTER). Records outside the confirmed file, if one is given, are left out."""
    rows = vcf.records(vcf.lines(spark, path))
    if confirmed:
        known = vcf.split_alleles(vcf.records(vcf.lines(spark, confirmed)))
        rows = vcf.split_alleles(rows).join(known.select(*J.SITE), J.SITE, "left_semi")
    made = {
        "clinvar": lambda: vcf.labelled(rows, "CLINVAR_GROUND_TRUTH", F.try_element_at("info", F.lit("CLNSIG"))),
        "giab": lambda: vcf.labelled(vcf.split_alleles(rows), "GIAB_GROUND_TRUTH", F.lit(label), genotype=None),
        "mutacc": lambda: vcf.labelled(rows, "MUTACC_GROUND_TRUTH", F.lit(label), keep_quality=True),
    }[kind]()
    names = {"clinvar": "CLINVAR_GROUND_TRUTH", "giab": "GIAB_GROUND_TRUTH", "mutacc": "MUTACC_GROUND_TRUTH"}
    formats = [f'##FORMAT=<ID={i},Number={n},Type={t},Description="{x}">' for i, n, t, x in (("GT", "1", "String", "Genotype"), ("DP", "1", "Integer", "Read depth"), ("AD", ".", "Integer", "Allelic depths"), ("GQ", "1", "Integer", "Genotype quality"))]
    head = vcf.lines(spark, path).where(F.col("value").startswith("##fileformat=") | F.col("value").startswith("##contig=")).select("value", "at", F.lit(0).alias("place"))
    fixed = [*formats, vcf.definition(names[kind], "String", "Label"), "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tNOTASAMPLE"]
    top = spark.createDataFrame([(v, -1, i) for i, v in enumerate(fixed)], "value string, at long, place int")
    head = head.withColumn("at", F.col("at") - F.lit(1 << 62))
    vcf.write(head.unionByName(top).unionByName(vcf.render(made).select("value", "at", F.lit(0).alias("place"))), out)


def confirm_calls(spark: SparkSession, path: str, confirmed: str, out: str) -> DataFrame:
    """One file split by allele and parted: out/kept holds the records whose site the confirmed file has, out/rest the others, both in
    order under the file's header. Returned: the sites that only one of the two files has (side a: this file, b: the confirmed one)."""
    text = vcf.lines(spark, path)
    known = settled(vcf.split_alleles(vcf.records(vcf.lines(spark, confirmed))).select(*J.SITE).distinct())
    for name, how in (("kept", "left_semi"), ("rest", "left_anti")):
        vcf.write(vcf.annotated(text, lambda rows, how=how: vcf.split_alleles(rows).join(known, J.SITE, how), []), f"{out}/{name}")
    return J.only_one_side(vcf.split_alleles(vcf.records(text)), known, J.SITE)


def label_with_negatives(spark: SparkSession, positives: str, negatives: str, out: str, kind: str = "mutacc") -> None:
    """Both files labelled, pathogenic and benign (out/positives, out/negatives), and their sorted concatenation (out/all)."""
    for path, name, label in ((positives, "positives", "pathogenic"), (negatives, "negatives", "benign")):
        label_vcf(spark, path, f"{out}/{name}", kind, label)
    concat_vcfs(spark, [f"{out}/positives", f"{out}/negatives"], f"{out}/all")


def vcf_to_csv(spark: SparkSession, paths: list[str], out: str) -> None:
    """All annotations that occur as columns, with a header; missing ones empty, number columns as numbers."""
    vcf.flatten(vcf.records(vcf.lines(spark, paths)), cast=True).write.mode("errorifexists").option("header", True).csv(out)


def case_rank_report(scored: DataFrame, causative: DataFrame, scores: list[str], names: DataFrame) -> dict[str, DataFrame]:
    """Ranks of causative variants under every frequency limit with the cases' names (a case without a name is an error), and
    wins and ties of the first score against the second."""
    ranks = J.lookup(R.compare(scored, causative, scores), names, ["case_id"])
    return {"ranks": ranks, "points": R.points(ranks.where("max_frq IS NULL"), f"rank_{scores[0]}", f"rank_{scores[1]}")}


#: Jobs that take nothing but paths and words, as the command line gives them.
COMMANDS: dict[str, Callable[..., object]] = {
    "concat-vcfs": lambda spark, out, *paths: concat_vcfs(spark, list(paths), out),
    "vcf2csv": lambda spark, out, *paths: vcf_to_csv(spark, list(paths), out),
    "label-vcf": lambda spark, path, out, kind, *more: label_vcf(spark, path, out, kind, *more),
    "confirm-calls": lambda spark, path, confirmed, out: confirm_calls(spark, path, confirmed, out).show(100, False),
    "label-with-negatives": lambda spark, positives, negatives, out: label_with_negatives(spark, positives, negatives, out),
    "gated-scores": lambda spark, path, out, a, g: gated_scores(spark, path, out, a, g),
    "compile-vcf": lambda spark, out, labels, *paths: compile_vcf(spark, list(paths), out, dict(x.split("=") for x in labels.split(","))),
    "train": lambda spark, path, model: train_on_set(spark, path, model).show(10, False),
    "predict-on-vcf": lambda spark, path, out, model, *more: predict_with_model(spark, path, out, model, rename=(more or ("",))[0]),
    "view-ranked-vcf": lambda spark, out, causative, scores, *paths: view_ranked_vcf(spark, list(paths), causative.split(","), scores.split(","), out).show(100, False),
}


def main(args: list[str]) -> int:
    if not args or args[0] not in COMMANDS:
        print(f"usage: python -m varloom.jobs {{{','.join(COMMANDS)}}} ARGUMENT...")
        return 2
    COMMANDS[args[0]](SparkSession.builder.appName(f"varloom-{args[0]}").getOrCreate(), *args[1:])
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
