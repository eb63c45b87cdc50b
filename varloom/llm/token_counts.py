"""Token counts through a digest cache."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.llm.common import shared_dir

CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens long"


def tokenizer_version(path: str) -> str:
    """SHA-256 of the tokenizer file: another file, or another version of it, has entries of its own."""
    import hashlib

    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def open_cache(spark, path: str, version: str) -> DataFrame:
    """(digest, n_tokens): the stored counts of a tokenizer version, none where the cache does not exist yet; a digest that was
    appended twice, by a repeated run, counts once. A folder that is there but holds something else is an error."""
    from pyspark.errors import AnalysisException

    try:
        stored = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        stored = spark.createDataFrame([], CACHE_SCHEMA)
    if {f"{n} {t}" for n, t in stored.dtypes} != {"tokenizer string", "digest binary", "n_tokens bigint"}:
        raise ValueError(f"{path} is no token cache: {stored.dtypes}")
    return stored.where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))


def fill_cache(docs: DataFrame, tokenizer_path: str, cache_path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes one whole text of each digest that the cache does not hold under this tokenizer version, and appends the counts."""
    version = tokenizer_version(tokenizer_path)
    stored = open_cache(docs.sparkSession, cache_path, version).select("digest")
    misses = digests(docs, id_col, text_col).select("digest", "text").join(stored, "digest", "left_anti")
    distinct = misses.groupBy("digest").agg(F.first("text").alias("text"))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from varloom.llm.tokens import counts

        for pdf in batches:
            yield pd.DataFrame({"tokenizer": version, "digest": pdf["digest"], "n_tokens": counts(tokenizer_path, pdf["text"])})

    distinct.mapInPandas(encode, CACHE_SCHEMA).write.mode("append").parquet(cache_path)


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str | None = None, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' id with n_bytes, n_tokens and over_limit, for every row.

    The content is normalised (NULL is the empty text; nothing else may be folded, as case and blanks change the counts) and
    digested; stored counts of the same digest and tokenizer version are joined; one text of each digest that is missing is
    encoded whole, and the new counts are appended to the cache, a Parquet folder. Copies meet in the partial aggregation of
    their own task, so that one text in a third of all rows reaches the shuffle once a task. Texts are compared by SHA-256.
    Repeated rows and ids, NULL ids and other columns of docs, whatever their names, do no harm; an empty table gives no rows.
    """
    spark = docs.sparkSession
    cache_path = cache_path or f"{shared_dir(spark)}/varloom-token-cache"
    fill_cache(docs, tokenizer_path, cache_path, id_col, text_col)
    known = open_cache(spark, cache_path, tokenizer_version(tokenizer_path))
    return digests(docs, id_col, text_col).drop("text").join(known, "digest").select("id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
