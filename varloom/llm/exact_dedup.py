"""Exact dedup by skew-safe combining, with DataFrame functions alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.llm.common import ascii_lower, written


def quick_digest(content: Column) -> Column:
    """What deals texts to groups: 64 bits and the length. Equal digests alone never join two texts."""
    return F.struct(F.xxhash64(content).alias("h"), F.octet_length(content).alias("n"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16, digest: Callable[[Column], Column] = quick_digest) -> DataFrame:
    """(digest, content, keep_id, group_size): one row per distinct content, with the largest id and the number of rows.

    Three merges, each grouped by digest *and the full normalised content*: the partial aggregation inside every input task,
    the salted groups after the first shuffle, and the salt winners after the second. A group of copies that holds a third of
    all rows leaves each task as one row per salt.
    """
    rows = docs.select(F.col(id_col).alias("id"), ascii_lower(F.col(text_col)).alias("content"))
    rows = rows.withColumns({"digest": digest(F.col("content")), "salt": F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")})
    salted = rows.groupBy("digest", "content", "salt").agg(F.max("id").alias("top"), F.count("*").alias("n"))
    # Dealt by digest alone, so that what is asked of a digest next needs no further shuffle.
    return salted.repartition("digest").groupBy("digest", "content").agg(F.max("top").alias("keep_id"), F.sum("n").alias("group_size"))


def _matched(docs: DataFrame, id_col: str, text_col: str, salts: int, digest: Callable[[Column], Column]) -> DataFrame:
    """docs with __digest, and of the group of each row's text __keep, __size and __sha.

    The merges have compared all rows' contents in full. Where they found one content under a digest, every row of that digest
    has it, so the digest finds the group; where they found several, each row's own content is compared.
    """
    by_digest = exact_groups(docs, id_col, text_col, salts, digest).groupBy("digest").agg(
        F.count("*").alias("contents"), F.max("keep_id").alias("__keep"), F.max("group_size").alias("__size"), F.max(F.sha2(F.col("content").cast("binary"), 256)).alias("__sha")
    )
    groups = written(by_digest.withColumnRenamed("digest", "__digest"), "exact-groups")
    rows = docs.withColumn("__digest", digest(ascii_lower(F.col(text_col))))
    out = rows.join(groups.where("contents = 1").drop("contents"), "__digest")
    several = groups.where("contents > 1").select("__digest")
    if not several.take(1):
        return out
    shared = rows.join(several, "__digest", "left_semi")
    each = exact_groups(shared.select(*docs.columns), id_col, text_col, salts, digest)
    each = each.select(F.col("digest").alias("__digest"), F.col("content").alias("__content"), F.col("keep_id").alias("__keep"), F.col("group_size").alias("__size"), F.sha2(F.col("content").cast("binary"), 256).alias("__sha"))
    return out.unionByName(shared.withColumn("__content", ascii_lower(F.col(text_col))).join(each, ["__digest", "__content"]).drop("__content"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16, digest: Callable[[Column], Column] = quick_digest) -> DataFrame:
    """All columns of docs plus keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; NULL counts as the empty text. Of equal texts the row with the
    largest id stays. A NULL id loses to any other; where all ids of a group are NULL, keep_id is NULL and all its rows are
    marked kept. Rows that repeat an id with the same text are each marked kept (keep_one_copy leaves one of them). Very long
    texts are compared whole. Columns of docs that carry one of the new names are replaced. An empty table gives an empty
    table.
    """
    named = docs.drop("keep_id", "group_size", "kept", "text_sha256")
    return _matched(named, id_col, text_col, salts, digest).select(
        *named.columns, F.col("__keep").alias("keep_id"), F.col("__size").alias("group_size"), F.col(id_col).eqNullSafe(F.col("__keep")).alias("kept"), F.col("__sha").alias("text_sha256")
    )


def keep_one_copy(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16, digest: Callable[[Column], Column] = quick_digest) -> DataFrame:
    """docs without the copies: of equal texts one row, with the largest id (columns unchanged).

    Where rows repeat that id, or all ids are NULL, one of them stays too; which one is open, as other columns may differ.
    """
    kept = _matched(docs, id_col, text_col, salts, digest).where(F.col(id_col).eqNullSafe(F.col("__keep")))
    return kept.withColumn("__content", ascii_lower(F.col(text_col))).dropDuplicates(["__digest", "__content"]).select(*docs.columns)
