"""The corpus pipeline: five stages over the documents, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.llm import exact_dedup, mixing, near_copies, packing, toxicity
from varloom.llm.common import read_table, written
from varloom.llm.queries import WORD_BPE, tokenizer_file


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose toxicity score reaches the threshold."""
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs.select(F.struct("*").alias("row"), "text"), model)
    return scored.where(F.col("tox_score") < toxicity.THRESHOLD).select("row.*")


def copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each exact text."""
    return exact_dedup.keep_one_copy(docs)


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts whose shingles of five words have a Jaccard similarity of 0.8 or more."""
    return near_copies.keep_one_of_similar(docs).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the calibrated draw keeps."""
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "text", "source", "lang")
    return mixing.mix(rows, carry=["row"]).where("mix_kept").select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document that is left."""
    # The stages before have grown the executors; a megabyte of text in step and fewer words at hand leave them room.
    return packing.pack_documents(docs, tokenizer_file(WORD_BPE), text_at_once=1 << 20, words=50_000)


STAGES = [
    ("toxicity", toxic_out),
    ("exact_dedup", copies_out),
    ("simhash_near_dedup", near_copies_out),
    ("mixing", mixed),
    ("best_fit_packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


#: Learned scores, fingerprints and tokenizers are beyond SQL; tests/llm compares run() with brute force instead.
ORACLE_SQL = None
