"""Variant call files as tables: records, headers, rendering."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from varloom.functions.parsing import csq_fields, number, worst_transcript

#: Contigs up to which their ranks are sent to every task.
MOST_CONTIGS = 100_000

STATIC = ("chrom", "pos", "id", "ref", "alt", "qual", "filter", "info", "format")


def lines(spark: SparkSession, path) -> DataFrame:
    """(value, file, at): all lines of one or many files, plain or gzip, read by Spark from any store; at: their order."""
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))


def file_key(text: DataFrame, pattern: str = r"([^/_]+)[^/]*$", name: str = "case_name") -> DataFrame:
    """text with a key from the file's path: by default what stands before the first underscore of the file name."""
    return text.withColumn(name, F.regexp_extract("file", pattern, 1))


def is_record() -> Column:
    """Whether a line (value) is a record: neither blank nor of the header; reads it once."""
    return ~F.substring("value", 1, 1).isin("", "#")


def records(text: DataFrame, parsers: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """Record lines to columns: INFO as a map in the order of the file (keys without a value map to NULL), ALT as an array, '.' as
    NULL; QUAL as a number and as it stood.

    A key that is given twice is an error. `parsers` adds a column for each named INFO field, parsed by the given function of
    its text; only those fields are looked up.
    """
    parts = F.col("__parts")
    part = lambda i: F.nullif(F.get(parts, F.lit(i)), F.lit("."))
    # Split once, and only the lines that are records: what makes the line may be long, and each mention of it would be made again.
    rows = text.where(is_record()).select(F.when(is_record(), F.split("value", "\t")).alias("__parts"), *[c for c in text.columns if c != "value"])
    out = rows.select(
        part(0).alias("chrom"), part(1).cast("long").alias("pos"), part(2).alias("id"), part(3).alias("ref"), F.split(part(4), ",").alias("alt"), part(5).try_cast("double").alias("qual"), part(6).alias("filter"),
        F.str_to_map(part(7), F.lit(";"), F.lit("=")).alias("info"), part(8).alias("format"), F.slice(parts, 10, F.greatest(F.lit(0), F.size(parts) - 9)).alias("samples"), part(5).alias("qual_text"),
        *[c for c in text.columns if c != "value"],
    )
    for field, parse in (parsers or {}).items():
        out = out.withColumn(field, parse(F.try_element_at("info", F.lit(field))))
    return out


def header(text: DataFrame) -> DataFrame:
    """(header_type, id, number, type, description) of the INFO and FORMAT lines."""
    meta = r'^##(INFO|FORMAT)=<ID=([^,]+),Number=([^,]+),Type=([^,]+),Description="(.*)"'
    rows = text.where(F.col("value").rlike(meta))
    names = ("header_type", "id", "number", "type", "description")
    return rows.select(*[F.regexp_extract("value", meta, i + 1).alias(n) for i, n in enumerate(names)], *[c for c in text.columns if c != "value"])


def header_conflicts(headers: DataFrame) -> DataFrame:
    """Ids that files describe differently."""
    kinds = headers.groupBy("header_type", "id").agg(F.collect_set(F.struct("number", "type", "description")).alias("kinds"))
    return kinds.where(F.size("kinds") > 1).select("header_type", "id", F.size("kinds").cast("long").alias("n_kinds"))


def count_records(text: DataFrame) -> DataFrame:
    return text.agg(F.count_if(~F.col("value").startswith("#") & (F.col("value") != "")).alias("n_records"))


def render(rows: DataFrame) -> DataFrame:
    """Records back to lines (value, and every column that is not of the record): INFO in its own order, flags without a
    value, QUAL as it stood, FORMAT and samples where there are any."""
    pairs = F.transform(F.map_entries("info"), lambda e: F.when(e["value"].isNull(), e["key"]).otherwise(F.concat(e["key"], F.lit("="), e["value"])))
    dot = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("."))
    qual = F.col("qual_text") if "qual_text" in rows.columns else F.col("qual").cast("string")
    fixed = [dot(F.col("chrom")), dot(F.col("pos").cast("string")), dot(F.col("id")), dot(F.col("ref")), dot(F.concat_ws(",", "alt")), dot(qual), dot(F.col("filter")), dot(F.concat_ws(";", pairs))]
    tail = F.when(F.col("format").isNotNull(), F.concat(F.lit("\t"), F.concat_ws("\t", "format", "samples"))).otherwise("") if "format" in rows.columns else F.lit("")
    rest = [c for c in rows.columns if c not in (*STATIC, "samples", "qual_text")]
    return rows.select(F.concat(F.concat_ws("\t", *fixed), tail).alias("value"), *rest)


def with_info(rows: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Records with further INFO keys after their own; a key whose value is NULL is not added. A key that a record has already
    is an error."""
    new = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k), v.cast("string")) for k, v in values.items()]), lambda e: e["col2"].isNotNull()))
    return rows.withColumn("info", F.map_concat(F.coalesce("info", F.create_map().cast("map<string,string>")), new))


def with_header(text: DataFrame, new: list[str]) -> DataFrame:
    """Header lines (value, at), the new ones before the column line. A file without a column line keeps its header alone."""
    head = text.where(F.col("value").startswith("#")).select("value", "at")
    added = F.when(F.col("value").startswith("#CHROM"), F.array(*[F.lit(n) for n in new], F.col("value"))).otherwise(F.array("value"))
    return head.select("at", F.posexplode(added).alias("place", "value")).select("value", "at", "place")


def contigs(text: DataFrame, inputs: list[str] | None = None) -> DataFrame:
    """(contig, rank): the order of the ##contig lines, over several files that of their first mention; where no header names one, the order
    in which records name them. A header has as many lines as an assembly has sequences, so this table is small."""
    named = text.where(F.col("value").startswith("##contig=")).select(F.regexp_extract("value", r"[<,]ID=([^,>]+)", 1).alias("contig"), "at")
    if not named.take(1):
        named = text.where(~F.col("value").startswith("#") & (F.col("value") != "")).select(F.get(F.split("value", "\t"), 0).alias("contig"), "at")
    first = named.groupBy("contig").agg(F.min("at").alias("__at"))
    return first.select("contig", F.row_number().over(Window.orderBy("__at", "contig")).alias("rank"))  # a row a contig


def in_contig_order(rows: DataFrame, order: DataFrame, then: list[str], chrom: str = "chrom", name: str = "contig_rank") -> DataFrame:
    """rows with the rank of their contig (contig, rank), range-partitioned and sorted by it and by `then`; a contig that has no rank is an error."""
    ranks = order.select(F.col("contig").alias("__contig"), F.col("rank").alias("__rank"))
    if order.count() <= MOST_CONTIGS:
        ranks = F.broadcast(ranks)
    ranked = rows.join(ranks, F.col(chrom) == F.col("__contig"), "left")
    known = F.coalesce(F.col("__rank"), F.raise_error(F.concat(F.lit("a contig that no header names: "), F.coalesce(F.col(chrom), F.lit("NULL")))).cast("int"))
    return ranked.withColumn(name, known).drop("__contig", "__rank").orderBy(name, *then)


def transcript_fields(text: DataFrame, key: str = "CSQ") -> list[str]:
    """The names of the transcript fields in the header's description of `key`; empty where no header describes it. Descriptions that differ are an error."""
    told = [r["description"] for r in header(text).where((F.col("header_type") == "INFO") & (F.col("id") == key)).select("description").distinct().limit(2).collect()]
    if len(told) > 1:
        raise ValueError(f"the headers describe {key} differently")
    return csq_fields(told[0]) if told and "Format: " in told[0] else []


def with_transcripts(flat: DataFrame, fields: list[str], key: str = "CSQ", strict: bool = True) -> DataFrame:
    """flat with the column `key` (transcripts, comma-separated) replaced by a column <key>_<field> of its most severe one for each field, as text; NULL
    where a record has no transcript. An unknown consequence (if strict) or another number of fields is an error."""
    if not fields or key not in flat.columns:
        return flat
    worst = F.when(F.coalesce(F.col(key), F.lit("")) != "", worst_transcript(F.col(key), fields, strict))
    held = flat.withColumn("__worst", worst)
    return held.select(*[F.col(f"`{c}`") for c in flat.columns if c != key], *[F.col("__worst").getField(f).alias(f"{key}_{f}") for f in fields])


def definition(name: str, kind: str, description: str, number: str = ".") -> str:
    return f'##INFO=<ID={name},Number={number},Type={kind},Description="{description}">'


def annotated(text: DataFrame, change: Callable[[DataFrame], DataFrame], new: list[str]) -> DataFrame:
    """(value, at, place): the lines of one file with its records changed and the new header lines; in the order of (at, place)."""
    body = render(change(records(text))).select("value", "at", F.lit(0).alias("place"))
    return with_header(text, new).unionByName(body)


def write_cases(rows: DataFrame, text: DataFrame, case: str, order: list[Column], path: str) -> None:
    """One ordered file for each case: rows (records with the case and what orders them) below the header of the case's own input, in text
    with the same case column.

    A case's rows meet in one task, sorted and streamed to its folder; they are what a report keeps of a case (its best or its causative
    records), not the case itself. Cases without a row get no file; an existing path is an error.
    """
    body = render(rows.withColumn("__order", F.struct(*order))).select(case, "value", F.lit(1).alias("__part"), "__order", F.lit(0).cast("long").alias("__at"))
    cases = rows.select(case).distinct()
    none = F.lit(None).cast(body.schema["__order"].dataType)
    head = text.where(F.col("value").startswith("#")).join(cases, case, "left_semi").select(case, "value", F.lit(0).alias("__part"), none.alias("__order"), F.col("at").alias("__at"))
    every = head.unionByName(body).repartition(case).sortWithinPartitions(case, "__part", "__at", "__order")
    every.select(case, "value").write.mode("errorifexists").partitionBy(case).text(path)


def write(ordered: DataFrame, path: str) -> None:
    """Lines to text files whose concatenation is the file, in the order of (at, place); an existing path is an error."""
    ordered.orderBy("at", "place").select("value").write.mode("errorifexists").text(path)


def labelled(rows: DataFrame, key: str, label: Column, genotype: str | None = "1/1:30:4,26:38", keep_quality: bool = False) -> DataFrame:
    """Records stripped to their five fields, the label as the only INFO key, and GT:DP:AD:GQ: a constant sample, or the record's
    own first one where genotype is None. QUAL and FILTER are dropped unless keep_quality."""
    keys = ("GT", "DP", "AD", "GQ")
    own = F.get("samples", 0)
    at = [F.array_position(F.split("format", ":"), k) for k in keys]
    kept = F.concat_ws(":", *[F.coalesce(F.get(F.split(own, ":"), F.when(p > 0, p - 1).cast("int")), F.lit(".")) for p in at])
    none = F.lit(None).cast("string")
    return rows.withColumns(
        {"info": F.create_map(F.lit(key), label), "format": F.lit(":".join(keys)), "samples": F.array(F.lit(genotype) if genotype else kept),
         "qual_text": F.col("qual_text") if keep_quality else none, "filter": F.col("filter") if keep_quality else none}
    )


def split_alleles(rows: DataFrame) -> DataFrame:
    """One row for each alternative allele. In the samples GT names the row's allele 1 and every other one 0, and AD keeps the
    depths of REF and of the row's allele (missing depths stay as they are); other fields are copied."""
    many = rows.select("*", F.size("alt").alias("__n"), F.explode(F.sequence(F.lit(1), F.size("alt"))).alias("__k"))

    def value(key: Column, v: Column) -> Column:
        calls = F.transform(F.split(v, "(?=[/|])|(?<=[/|])"), lambda t: F.when(t == F.col("__k").cast("string"), "1").when(t.rlike("^[0-9]+$"), "0").otherwise(t))
        depths = F.split(v, ",")
        return F.when(key == "GT", F.concat_ws("", calls)).when((key == "AD") & (F.size(depths) == F.col("__n") + 1), F.concat_ws(",", F.get(depths, 0), F.get(depths, F.col("__k")))).otherwise(v)

    own = F.transform("samples", lambda s: F.concat_ws(":", F.zip_with(F.split("format", ":"), F.split(s, ":"), lambda k, v: F.when(v.isNotNull(), value(k, v)))))
    parted = many.withColumns({"alt": F.slice("alt", F.col("__k"), 1), "samples": F.when((F.col("__n") > 1) & F.col("format").isNotNull(), own).otherwise(F.col("samples"))})
    return parted.drop("__k", "__alt", "__n")


def info_keys(rows: DataFrame) -> list[str]:
    """The INFO keys that occur, by name: as many as the header defines, a bounded list."""
    return [r["k"] for r in rows.select(F.explode(F.map_keys("info")).alias("k")).distinct().orderBy("k").collect()]


def flatten(rows: DataFrame, keys: list[str] | None = None, cast: bool = False) -> DataFrame:
    """Static columns and INFO keys as columns of text: the wanted keys, or all that occur. A flag reads as the text 'true'. With
    cast, columns whose every value is a number become numbers (missing: NULL), in one pass over all of them."""
    names = info_keys(rows) if keys is None else keys
    value = lambda k: F.when(F.array_contains(F.map_keys("info"), k), F.coalesce(F.try_element_at("info", F.lit(k)), F.lit("true")))
    out = rows.select("chrom", "pos", "id", "ref", F.concat_ws(",", "alt").alias("alt"), *[value(k).alias(k) for k in names])
    if not cast or not names:
        return out
    plain = [F.bool_and(F.col(f"`{k}`").isNull() | (F.col(f"`{k}`") == "") | number(F.col(f"`{k}`")).isNotNull()).alias(k) for k in names]
    numeric = out.agg(*plain).first()
    return out.withColumns({k: number(F.col(f"`{k}`")) for k in names if numeric[k]})


def info_csv(text: DataFrame) -> DataFrame:
    """Lines of five columns and INFO with commas of its own: (case_id, id, causative, score_a, score_b, gnomadaf, frq)."""
    parts = F.split("value", ",", 6)
    info = F.str_to_map(F.lower(F.get(parts, F.lit(5))), F.lit(";"), F.lit("="))
    num = lambda i: F.get(parts, F.lit(i)).try_cast("double")
    return text.select(F.get(parts, F.lit(0)).try_cast("long").alias("case_id"), F.get(parts, F.lit(1)).alias("id"), num(2).alias("causative"), num(3).alias("score_a"), num(4).alias("score_b"), F.try_element_at(info, F.lit("gnomadaf")).try_cast("double").alias("gnomadaf"), F.try_element_at(info, F.lit("frq")).try_cast("double").alias("frq"))
