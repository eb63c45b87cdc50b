"""Parsing of variant annotations as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Consequence terms of the Sequence Ontology with their severity.
CONSEQUENCES = {
    "transcript_ablation": 41, "splice_acceptor_variant": 40, "splice_donor_variant": 39, "stop_gained": 38, "frameshift_variant": 37, "stop_lost": 36, "start_lost": 35,
    "transcript_amplification": 34, "feature_elongation": 33, "feature_truncation": 32, "inframe_insertion": 31, "inframe_deletion": 30, "missense_variant": 29,
    "protein_altering_variant": 28, "splice_donor_5th_base_variant": 27, "splice_region_variant": 26, "splice_donor_region_variant": 25, "splice_polypyrimidine_tract_variant": 24,
    "incomplete_terminal_codon_variant": 23, "start_retained_variant": 22, "stop_retained_variant": 21, "synonymous_variant": 20, "coding_sequence_variant": 19,
    "mature_miRNA_variant": 18, "5_prime_UTR_variant": 17, "3_prime_UTR_variant": 16, "non_coding_transcript_exon_variant": 15, "intron_variant": 14, "NMD_transcript_variant": 13,
    "non_coding_transcript_variant": 12, "coding_transcript_variant": 11, "upstream_gene_variant": 10, "downstream_gene_variant": 9, "TFBS_ablation": 8, "TFBS_amplification": 7,
    "TF_binding_site_variant": 6, "regulatory_region_ablation": 5, "regulatory_region_amplification": 4, "regulatory_region_variant": 3, "intergenic_variant": 2, "sequence_variant": 1,
}

#: Clinical-significance keywords of a benign (0) and a pathogenic (1) variant.
CLINICAL = {
    "benign": 0.0, "likely_benign": 0.0, "affects": 0.0, "drug_response": 0.0, "protective": 0.0,
    "pathogenic": 1.0, "likely_pathogenic": 1.0, "association": 1.0, "risk_factor": 1.0, "likely_risk_allele": 1.0,
}

#: Keywords whose rows have no usable label.
MASKED = (
    ".", "uncertain_significance", "not_provided", "other", "confers_sensitivity", "association_not_found", "uncertain_risk_allele",
    "conflicting_interpretations_of_pathogenicity", "low_penetrance",
)


def number(text: Column) -> Column:
    """A decimal number, as Python's float() reads it apart from underscores; NULL for all else and for NaN."""
    plain = F.trim(text).rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$")
    return F.when(plain, F.trim(text).try_cast("double"))


def printable(text: Column) -> Column:
    return text.rlike(r"^\P{Cntrl}*$")


def pair(text: Column) -> Column:
    """family:value as a struct; the value also as a number."""
    parts = F.split(text, ":", 2)
    return F.struct(F.get(parts, 0).alias("family_id"), F.get(parts, 1).alias("value"), number(F.get(parts, 1)).alias("number"))


def triple(text: Column) -> Column:
    parts = F.split(text, ":")
    return F.struct(F.get(parts, 0).alias("family_id"), number(F.get(parts, 1)).alias("low"), number(F.get(parts, 2)).alias("high"))


def two_parts(text: Column) -> Column:
    """Strict family:list; anything but two parts is an error."""
    parts = F.split(text, ":")
    return F.when(F.size(parts) == 2, parts).otherwise(F.raise_error(F.concat(F.lit("expected two parts: "), text)))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("%3D"), F.lit("")), F.lit("%2C"), F.lit(""))


def allele(text: Column) -> Column:
    return F.translate(text, "[]'", "")


def severity(consequence: Column, strict: bool = True) -> Column:
    """Sum of the ranks of the &-separated terms; an unknown term is an error, or worth NULL if not strict."""
    ranks = F.create_map(*[F.lit(x) for kv in CONSEQUENCES.items() for x in kv])
    known = lambda t: F.coalesce(ranks[t], F.raise_error(F.concat(F.lit("unknown consequence "), t)).cast("int")) if strict else ranks[t]
    return F.aggregate(F.split(consequence, "&"), F.lit(0), lambda a, t: a + known(t))


def worst_transcript(csq: Column, fields: list[str], strict: bool = True) -> Column:
    """The transcript with the highest severity as a struct of its fields; the first of equals. No explode, no shuffle.

    An entry with another number of fields is an error.
    """
    at = fields.index("Consequence")

    def rated(entry: Column, i: Column) -> Column:
        parts = F.split(entry, r"\|")
        checked = F.when(F.size(parts) == len(fields), parts).otherwise(F.raise_error(F.concat(F.lit("wrong number of fields: "), entry)))
        return F.struct(severity(F.get(checked, at), strict).alias("severity"), (-i).alias("order"), checked.alias("parts"))

    best = F.array_max(F.transform(F.split(csq, ","), rated))
    return F.struct(best["severity"].alias("severity"), *[F.get(best["parts"], i).alias(f) for i, f in enumerate(fields)])


def csq_fields(description: str) -> list[str]:
    """Names in a header description after 'Format: '."""
    return [f.strip() for f in description.split("Format: ", 1)[1].strip('"').split("|")]


def csq_names(description: Column) -> Column:
    """csq_fields of a description column."""
    return F.transform(F.split(F.regexp_replace(F.regexp_replace(description, r"^.*?Format: ", ""), '"', ""), r"\|"), lambda f: F.trim(f))


def variant_id(pos: Column, identifier: Column, ref: Column, alt: Column) -> Column:
    return F.concat_ws("-", pos.cast("string"), identifier, F.lit("ALT"), alt, F.lit("REF"), ref)


def keywords(text: Column) -> Column:
    return F.transform(F.split(F.lower(text), r"[|/,]"), lambda k: F.regexp_replace(k, "^_+|_+$", ""))


def clinical_label(text: Column, strict: bool = True) -> Column:
    """0 or 1 from the keywords, summed and clipped; an unknown keyword is an error, or worth NULL if not strict."""
    table = F.create_map(*[F.lit(x) for kv in CLINICAL.items() for x in kv])
    value = lambda k: F.coalesce(table[k], F.raise_error(F.concat(F.lit("unknown keyword "), k)).cast("double")) if strict else table[k]
    total = F.aggregate(keywords(text), F.lit(0.0), lambda a, k: a + value(k))
    return F.when(total.isNotNull(), F.least(F.lit(1.0), total))


def masked(text: Column) -> Column:
    return F.arrays_overlap(keywords(text), F.array(*[F.lit(m) for m in MASKED]))


def only_label(columns: dict[str, Column]) -> Column:
    """The one label among sources of which exactly one is given ('' or NULL: not given); none or several is an error."""
    given = [F.coalesce(F.col(c), F.lit("")) != "" for c in columns]
    count = sum((g.cast("int") for g in given[1:]), given[0].cast("int"))
    value = F.coalesce(*[F.when(g, v) for g, v in zip(given, columns.values(), strict=True)])
    return F.when(count == 1, value).otherwise(F.raise_error(F.lit("exactly one label source must be given")))


def binary_label(text: Column) -> Column:
    """1 for pathogenic, 0 for benign, NULL where not given ('' or NULL); any other text is an error."""
    given = F.when(text == "pathogenic", 1.0).when(text == "benign", 0.0).when(F.coalesce(text, F.lit("")) == "", F.lit(None).cast("double"))
    return given.otherwise(F.raise_error(F.concat(F.lit("unknown label "), text)).cast("double"))


def typed(text: Column) -> Column:
    """A field's text as (number, text): a number where it reads as one, else the text without surrounding blanks if it is
    printable; anything else (control characters) is an error. NULL stays NULL."""
    x = number(text)
    plain = F.when(printable(text), F.trim(text)).otherwise(F.raise_error(F.concat(F.lit("value cannot be coerced: "), F.hex(text))))
    return F.when(text.isNotNull(), F.struct(x.alias("number"), F.when(x.isNull(), plain).alias("text"), F.when(x.isNull(), "text").otherwise("number").alias("kind")))


def passed_on(text: Column) -> Column:
    """A field that is taken as it stands."""
    return text


def stand_in(text: Column, numeric: bool = False) -> Column:
    """What stands for a value in word statistics: the text, N/A where it is missing or empty, numtype for any number."""
    if numeric:
        return F.when(text.isNull(), "N/A").otherwise("numtype")
    return F.when(F.coalesce(text, F.lit("")) == "", "N/A").otherwise(text)


def capped_low(raw: Column, normalised: Column, low: Column) -> Column:
    """Whether a raw score lies below the bound at which normalisation caps it, and its normalised score is that bound."""
    return (raw < low) & (normalised == low)


def tokens(text: Column) -> Column:
    """Lower-cased words between blanks, marks and digits."""
    return F.filter(F.split(F.lower(text), r"[\s_&/|:,\-0-9]"), lambda t: t != "")


def no_dna(words: Column) -> Column:
    return F.filter(words, lambda t: ~t.rlike("^[CAGTNcagtn]+$"))


def one_hot(label: Column) -> Column:
    return F.when((label >= 0) & (label <= 1), F.array(1 - label, label)).otherwise(F.raise_error(F.lit("label outside [0, 1]")))


def explanation(contributions: dict[str, Column]) -> Column:
    """[name=0.00,...] by falling contribution; NULL and NaN are left out."""
    items = F.filter(F.array(*[F.struct((-v).alias("minus"), F.lit(k).alias("name")) for k, v in contributions.items()]), lambda s: s["minus"].isNotNull() & ~F.isnan(s["minus"]))
    return F.concat(F.lit("["), F.concat_ws("", F.transform(F.array_sort(items), lambda s: F.format_string("%s=%.2f,", s["name"], -s["minus"]))), F.lit("]"))


def parse_explanation(text: Column) -> Column:
    return F.str_to_map(F.regexp_replace(text, r"^\[|,?\]$", ""), F.lit(","), F.lit("="))
