"""Best-fit packing of documents into sequences under several capacities."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.llm.common import releasing, written
from varloom.llm.tokens import MEMORY, word_ids

#: Bytes of text encoded together (a longer text alone), which bounds a task's memory.
TEXT_AT_ONCE = 8 << 20

#: What tokens, documents and attention cost weigh where a bin is rated.
WEIGHTS = np.array([1.0, 0.25, 0.25])

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, text_at_once: int = TEXT_AT_ONCE, words: int = MEMORY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the ids of every whole text and one end id, cut only where longer than
    capacity. A worker codes text_at_once bytes of texts in step and remembers some `words`: fewer take less memory and more time. The texts stay in the tasks that read them; what leaves is a few numbers a piece."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = word_ids(tokenizer_path, words)
        for batch in batches:
            sizes = np.nan_to_num(pc.binary_length(batch["text"]).to_numpy(zero_copy_only=False).astype(float))
            share = np.floor(np.cumsum(sizes) / text_at_once)
            for at, to in zip(np.r_[0, 1 + np.flatnonzero(np.diff(share))], np.r_[1 + np.flatnonzero(np.diff(share)), len(sizes)], strict=True):
                yield _pieces(batch["doc_id"][at:to], *table.encode_column(batch["text"][at:to]), capacity, end_id)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(releasing(encode), PIECES)


def _pieces(doc_ids: pa.Array, ids: np.ndarray, counts: np.ndarray, capacity: int, end_id: int) -> pa.RecordBatch:
    """The pieces of documents whose ids lie one after the other, `counts` each."""
    n = len(counts)
    flat = np.full(len(ids) + n, end_id, "<u4")
    flat[np.arange(len(ids)) + np.repeat(np.arange(n), counts)] = ids
    whole = counts + 1
    pieces = -(-whole // capacity)
    doc = np.repeat(np.arange(n), pieces)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = piece * capacity
    length = np.minimum(capacity, whole[doc] - start)
    begin = 4 * ((np.cumsum(whole) - whole)[doc] + start)
    raw = memoryview(flat).cast("B")
    crc = [zlib.crc32(raw[b:e]) for b, e in zip(begin.tolist(), (begin + 4 * length).tolist(), strict=True)]
    columns = [doc_ids.take(pa.array(doc)), piece.astype(np.int32), start, length, np.array(crc, np.int64)]
    return pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], ["doc_id", "piece", "start", "length", "ids_crc32"])


def best_fit(lengths: np.ndarray, capacity: int, max_docs: int, max_cost: float, rule: str = "dot") -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, longest first, under three capacities: tokens, documents and attention cost (the sum
    of squared lengths).

    Items of one length are the same vector, so all open bins are rated at once for each length: by the weighted dot product
    of item and residual (rule "dot": the largest wins, over the bins where the item fits, so that no capacity of a bin runs
    out long before the others) or by the norm of what is left after the item (rule "norm": the smallest wins). The items of that length go to the best bins that can hold them under every
    capacity; those that none can hold open new bins.
    """
    full = np.array([capacity, max_docs, max_cost], float)
    order = np.argsort(-lengths, kind="stable")
    bin_of, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    size = max(16, len(lengths))
    left = np.empty((size, 3))
    used = 0
    at = 0
    open_bins = np.empty(0, np.int64)
    values, first = np.unique(-lengths[order], return_index=True)
    groups = np.split(order, first[1:])
    smallest = float(lengths.min()) if len(lengths) else 0.0
    for length, items in zip((-values).tolist(), groups, strict=True):
        need = np.array([length, 1, float(length) * length])
        share = need / full
        waiting = items
        while len(waiting):
            if len(open_bins):
                room = left[open_bins]
                fits = np.flatnonzero((room >= need).all(1))
            else:
                fits = np.empty(0, np.int64)
            if not len(fits):
                # As many new bins as the items need: each takes what one bin can hold of this length.
                per = int(max(1, min(full[0] // need[0], full[1], full[2] // need[2])))
                n_new = -(-len(waiting) // per)
                new = np.arange(used, used + n_new)
                where = np.repeat(new, per)[: len(waiting)]
                step = np.tile(np.arange(per), n_new)[: len(waiting)]
                bin_of[waiting], offset[waiting] = where, step * length
                held = np.bincount(where - used, minlength=n_new)
                left[new] = full - held[:, None] * need
                open_bins = np.concatenate([open_bins, new])
                used += n_new
                break
            residual = room[fits] / full
            if rule == "dot":
                rating = -(residual * share * WEIGHTS).sum(1)
            else:
                rating = ((residual - share) ** 2 * WEIGHTS).sum(1)
            n = min(len(waiting), len(fits))
            best = fits[np.argsort(rating, kind="stable")[:n]]
            bins = open_bins[best]
            bin_of[waiting[:n]], offset[waiting[:n]] = bins, (capacity - left[bins, 0]).astype(np.int64)
            left[bins] -= need
            waiting = waiting[n:]
        at += 1
        if at % 16 == 0 and len(open_bins):
            room = left[open_bins]
            open_bins = open_bins[(room[:, 0] >= smallest) & (room[:, 1] >= 1) & (room[:, 2] >= smallest * smallest)]
    return bin_of, offset


def pack(
    pieces: DataFrame,
    capacity: int = 2048,
    max_docs: int | None = None,
    max_cost: float | None = None,
    per_shard: int = 60_000,
    rule: str = "dot",
) -> DataFrame:
    """pieces plus sequence_id and offset, gapless from 0 within each sequence.

    Pieces that fill a sequence are placed at once. The others are dealt evenly to shards of about per_shard pieces by the
    hash of document and piece, whatever their source, and each shard is packed by best_fit. A shard leaves at most a few
    sequences half empty, which is one in thousands. max_docs and max_cost default to what the token capacity allows, so that
    no sequence is spent on them; they still rate the bins. A piece with more cost than max_cost alone has a sequence of its
    own. Ties go by document and piece. Repeated rows are packed each for itself.
    """
    docs_limit = max_docs or capacity
    cost_limit = max_cost or float(capacity) ** 2
    held = written(pieces, "pieces")
    small = held.where(F.col("length") < capacity)
    shards = max(1, -(-small.count() // per_shard))
    small = small.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)))

    def place(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece", "ids_crc32"], kind="stable").reset_index(drop=True)
        lengths = pdf["length"].to_numpy(np.int64)
        alone = (lengths.astype(float) ** 2 > cost_limit) & (lengths > 0)
        bins, offset = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
        if (~alone).any():
            bins[~alone], offset[~alone] = best_fit(lengths[~alone], capacity, docs_limit, cost_limit, rule)
        top = int(bins[~alone].max()) + 1 if (~alone).any() else 0
        bins[alone] = top + np.arange(alone.sum())
        pdf["sequence_id"], pdf["offset"] = bins * shards + key[0], offset
        pdf["doc_id"] = pdf["doc_id"].astype("Int64")
        return pdf.drop(columns="shard")

    schema = f"{PIECES}, sequence_id long, offset long"
    packed = small.groupBy("shard").applyInPandas(place, schema)
    # Odd numbers for the full ones, even for the packed ones, so that neither needs to know the other's.
    packed = packed.withColumn("sequence_id", F.col("sequence_id") * 2)
    whole = held.where(F.col("length") >= capacity).withColumns({"sequence_id": F.monotonically_increasing_id() * 2 + 1, "offset": F.lit(0).cast("long")})
    return packed.unionByName(whole)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", text_at_once: int = TEXT_AT_ONCE, words: int = MEMORY, **limits) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every document.

    NULL and empty texts are the end id alone. NULL ids are packed like any other. Very long texts are cut to pieces of the
    capacity. An empty table gives no rows. Other columns of docs are ignored.
    """
    return pack(cut_pieces(docs, tokenizer_path, capacity, id_col, text_col, text_at_once=text_at_once, words=words), capacity, **limits)
