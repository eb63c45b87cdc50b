"""Score tables, columnar data sets, summaries and checksums: what is read and written beside variant files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def columns_at(text: DataFrame, places: dict[int, str], sep: str = ",") -> DataFrame:
    """Lines (value) to the columns at the given places, by name; a line with fewer columns gives NULL."""
    parts = F.split("value", sep)
    return text.select(*[F.get(parts, F.lit(i)).alias(n) for i, n in places.items()])


def lookup_table(text: DataFrame, names: list[str], sep: str = "\\t") -> DataFrame:
    """A lookup table from lines whose first line is its header; the header line is told by its text, wherever it stands."""
    table = columns_at(text, dict(enumerate(names)), sep)
    return table.where(F.coalesce(F.col(names[0]), F.lit("")) != names[0])


def equal_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (rows_a, rows_b); different numbers of rows are an error."""
    both = a.agg(F.count("*").alias("rows_a")).crossJoin(F.broadcast(b.agg(F.count("*").alias("rows_b"))))  # one row each
    differ = F.concat(F.lit("inputs differ in rows: "), F.col("rows_a").cast("string"), F.lit(" and "), F.col("rows_b").cast("string"))
    return both.where(F.when(F.col("rows_a") == F.col("rows_b"), True).otherwise(F.raise_error(differ).cast("boolean")))


TYPES = {"float32": "float", "utf-8": "string", "int": "int"}


def write_groups(df: DataFrame, path: str, group: str, types: dict[str, str] | None = None, mode: str = "append") -> None:
    """A columnar data set with one folder a group; columns are cast by the names of TYPES. Appending adds a group or rows to one."""
    cast = {c: F.col(c).cast(TYPES[t]) for c, t in (types or {}).items()}
    df.withColumns(cast).write.mode(mode).partitionBy(group).parquet(path)


def write_types(df: DataFrame, path: str) -> None:
    """The column types of a data set beside its groups, as JSON lines that its readers skip."""
    df.sparkSession.createDataFrame(df.dtypes, "column string, type string").coalesce(1).write.mode("errorifexists").json(f"{path}/_types")


def read_types(spark: SparkSession, path: str) -> dict[str, str]:
    return {r["column"]: r["type"] for r in spark.read.schema("column string, type string").json(f"{path}/_types/*.json").collect()}


def export_columns(df: DataFrame, columns: dict[str, str], path: str, kind: str = "float") -> None:
    """The given columns under the names of a training set, as numbers of one kind; missing values stay missing, a text that is no number is an error."""
    df.select(*[F.col(f"`{c}`").cast(kind).alias(name) for name, c in columns.items()]).write.mode("errorifexists").parquet(path)


def read_group(spark: SparkSession, path: str, group: str, name: str, columns: list[str | list[str]], label: str | None = None, most: int | None = None, fill: float | None = None) -> DataFrame:
    """The rows of one group: columns, or nested lists of them as arrays, and the label; at most `most` rows; NULL and NaN numbers
    replaced by `fill`. Only the group's folder and the columns asked for are read; an unknown group or column is an error."""
    rows = spark.read.parquet(path)
    return select_group(rows, group, name, columns, label, most, fill)


def select_group(rows: DataFrame, group: str, name: str, columns: list[str | list[str]], label: str | None = None, most: int | None = None, fill: float | None = None) -> DataFrame:
    """read_group on a table at hand."""
    kinds = dict(rows.dtypes)
    asked = [c for x in columns for c in ([x] if isinstance(x, str) else x)] + ([label] if label else [])
    if unknown := [c for c in [group, *asked] if c not in kinds]:
        raise ValueError(f"unknown columns: {', '.join(unknown)}")

    def value(c: str) -> Column:
        return F.coalesce(F.nanvl(F.col(c), F.lit(None)), F.lit(fill)).cast(kinds[c]).alias(c) if fill is not None and kinds[c] in ("float", "double") else F.col(c)

    mine = rows.where(F.col(group) == name)
    mine = mine if most is None else mine.limit(most)
    return mine.select(*[value(c) if isinstance(c, str) else F.array(*[value(x) for x in c]).alias("_".join(c)) for c in columns], *([value(label)] if label else []))


def dump_groups(df: DataFrame, path: str, group: str) -> None:
    """Tab-separated text with a header, one folder a group."""
    df.write.mode("errorifexists").partitionBy(group).option("sep", "\t").option("header", True).csv(path)


def summaries(df: DataFrame, key: str) -> DataFrame:
    """(key, summary): each row's other columns as JSON; one table for all cases, not a file each."""
    return df.select(key, F.to_json(F.struct(*[c for c in df.columns if c != key])).alias("summary"))


def from_summaries(df: DataFrame, key: str, schema: str) -> DataFrame:
    """Summaries back to columns."""
    return df.select(key, F.from_json("summary", schema).alias("s")).select(key, "s.*")


def checked_files(spark: SparkSession, path, expected: dict[str, str | None] | None = None, bits: int | None = None) -> DataFrame:
    """(file, digest, ok): md5 (or the SHA-2 of so many bits) of whole files against what is expected of their names; ok is NULL
    where nothing is. A file goes through one task, as a digest must; a differing one is an error only to require_intact."""
    files = spark.read.format("binaryFile").load(path)
    digest = F.md5("content") if bits is None else F.sha2("content", bits)
    name = F.element_at(F.split("path", "/"), -1)
    known = F.create_map(*[F.lit(x) for kv in (expected or {}).items() for x in kv]) if expected else F.create_map().cast("map<string,string>")
    return files.select(name.alias("file"), digest.alias("digest")).withColumn("ok", F.col("digest") == F.try_element_at(known, F.col("file")))


def require_intact(checked: DataFrame) -> DataFrame:
    """checked, where a differing digest is an error."""
    return checked.where(F.when(F.coalesce("ok", F.lit(True)), True).otherwise(F.raise_error(F.concat(F.lit("checksum differs: "), F.col("file"))).cast("boolean")))
