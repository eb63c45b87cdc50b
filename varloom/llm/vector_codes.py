"""Compression of vectors to codes: part codebooks over integers, distances by dictionaries of each dimension's values."""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.llm.common import written
from varloom.llm.int_vectors import first_vectors, moved, scaled, whole

#: Vectors that share their dictionaries of values. A code must fit 16 bits.
BLOCK = 32_768
#: Labels up to which their sums are sent to every task.
FEW_LABELS = 100_000


class Block:
    """Some vectors as codes: for each dimension the distinct integers that occur, and the place of each vector's among them."""

    def __init__(self, values: list[np.ndarray], codes: np.ndarray):
        self.values, self.codes = values, codes

    @classmethod
    def of(cls, x: np.ndarray) -> Block:
        values, codes = [], np.empty(x.shape[::-1], np.uint16)
        for d in range(x.shape[1]):
            distinct, places = np.unique(x[:, d], return_inverse=True)
            values.append(distinct)
            codes[d] = places
        return cls(values, codes)

    def dump(self) -> bytes:
        held = io.BytesIO()
        np.savez(held, codes=self.codes, values=np.concatenate([*self.values, np.empty(0, np.int64)]), sizes=np.array([len(v) for v in self.values], np.int64))
        return held.getvalue()

    @classmethod
    def load(cls, held: bytes) -> Block:
        with np.load(io.BytesIO(held)) as a:
            return cls(np.split(a["values"], np.cumsum(a["sizes"])[:-1]) if len(a["sizes"]) else [], a["codes"])

    def distances(self, dims: range, entries: np.ndarray) -> np.ndarray:
        """(entries, vectors): squared distances of the part `dims` to all entries. The squared differences of every distinct integer to all
        entries are tabulated once; a vector's are gathered by its codes and added."""
        total = np.zeros((len(entries), self.codes.shape[1]), np.int64)
        for at, d in enumerate(dims):
            table = (self.values[d][None, :] - entries[:, at : at + 1]) ** 2
            total += np.take(table, self.codes[d], axis=1)
        return total

    def sums(self, dims: range, best: np.ndarray, entries: int) -> np.ndarray:
        """(entries, dims): for each entry the sum of its vectors' components, from how often each distinct integer is among them."""
        out = np.zeros((entries, len(dims)), np.int64)
        for at, d in enumerate(dims):
            n = len(self.values[d])
            out[:, at] = np.bincount(best * n + self.codes[d], minlength=entries * n).reshape(entries, n) @ self.values[d]
        return out


def part_ranges(dims: int, parts: int) -> list[range]:
    return [range(p * dims // parts, (p + 1) * dims // parts) for p in range(parts)]


def blocks_of(vectors: DataFrame, id_col: str, vec_col: str, label_col: str, dims: int, scale: int) -> DataFrame:
    """(rows, block): up to BLOCK vectors a row, their ids and labels as an Arrow stream, and their Block."""

    def blocking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            x = np.concatenate([scaled(b["v"], dims, scale) for b in held])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, (names := table.select(["id", "label"])).schema) as stream:
                stream.write_table(names)
            return pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()]), pa.array([Block.of(x).dump()])], ["rows", "block"])

        for batch in batches:
            while batch.num_rows:
                some = batch.slice(0, BLOCK - sum(b.num_rows for b in held))
                batch = batch.slice(some.num_rows)
                held.append(some)
                if sum(b.num_rows for b in held) == BLOCK:
                    yield out()
                    held.clear()
        if held:
            yield out()

    return vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"), F.col(label_col).alias("label")).mapInArrow(blocking, "rows binary, block binary")


def _sums(blocks: DataFrame, books: np.ndarray, parts: list[range]) -> DataFrame:
    """(part, entry, n, s): what each task's parts sum up to in each entry of each codebook."""

    def summing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = np.zeros((len(parts), len(books)), np.int64), np.zeros((len(parts), len(books), max(map(len, parts))), np.int64)
        for batch in batches:
            for held in batch["block"]:
                block = Block.load(held.as_py())
                for p, dims in enumerate(parts):
                    best = block.distances(dims, books[:, dims]).argmin(0)
                    n[p] += np.bincount(best, minlength=len(books))
                    s[p] += block.sums(dims, best, len(books))
        p, k = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(k, pa.int32()), pa.array(n[p, k]), pa.array(s[p, k].tolist(), pa.list_(pa.int64()))], ["part", "entry", "n", "s"])

    return blocks.select("block").mapInArrow(summing, "part int, entry int, n long, s array<bigint>")


def _coded(blocks: DataFrame, books: np.ndarray, parts: list[range], kinds: str) -> DataFrame:
    """(id, label, code, error) of every vector."""
    hexes = np.array([f"{k:02x}" for k in range(len(books))])

    def coding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, held in zip(batch["rows"], batch["block"], strict=True):
                block = Block.load(held.as_py())
                error, code = np.zeros(block.codes.shape[1], np.int64), np.full(block.codes.shape[1], "", f"<U{2 * len(parts)}")
                for dims in parts:
                    distance = block.distances(dims, books[:, dims])
                    best = distance.argmin(0)
                    error += distance[best, np.arange(len(best))]
                    code = np.char.add(code, hexes[best])
                names = pa.ipc.open_stream(rows.as_py()).read_all().combine_chunks()
                whole_rows = pa.table({"id": names["id"], "label": names["label"], "code": pa.array(code.tolist(), pa.string()), "error": pa.array(error)})
                yield from whole_rows.to_batches(max_chunksize=10_000)

    return blocks.mapInArrow(coding, f"{kinds}, code string, error long")


def compress(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", scale: int = 4096, parts: int = 8, entries: int = 16, rounds: int = 6) -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) of every vector that is not NULL and holds no NULL or non-finite component.

    Components become floor(scale * x), vectors are cut into `parts` equal consecutive parts. Each part's codebook starts as that part of
    the `entries` smallest ids' vectors, in that order; each round assigns every part to the nearest entry (ties to the lower index) and
    moves each entry to the floor of its parts' mean, an unused one stays; a last assignment gives code and error. All numbers are exact.

    Distances are gathered from tables of squared differences, one for each dimension and block of at most BLOCK vectors: a dictionary
    of the distinct integers holds no more values than the block has vectors, whatever the data. Blocks are made and written once.

    Vectors of different length have codebooks of their own length, as in a table of their own; where the length is no multiple of `parts`
    (the empty vector is one with parts of no components), code, error and codebooks are NULL. Fewer vectors than `entries` make fewer entries; an empty
    table gives an empty one. Rows that repeat an id are vectors each for itself; where ids tie or are NULL the start goes by the components,
    NULL ids last. label_error sums the errors of equal labels over all lengths, NULL labels together. Components whose squared distances would leave 64
    bits are an error. Other columns are not read.
    """
    if not 1 <= entries <= 256:
        raise ValueError("two hex digits name at most 256 entries")
    kept = vectors.where(whole(F.col(vec_col)))
    kinds = ", ".join(f"{n} {vectors.schema[c].dataType.simpleString()}" for n, c in (("id", id_col), ("label", label_col)))
    lengths = sorted(r["n"] for r in kept.select(F.size(vec_col).alias("n")).distinct().collect())
    coded = []
    for dims in lengths:
        mine = kept.where(F.size(vec_col) == dims) if len(lengths) > 1 else kept
        if dims % parts:
            coded.append(mine.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"), F.lit(None).cast("string").alias("codebooks_sha256")))
            continue
        books = first_vectors(mine, [F.col(id_col)], entries, id_col, vec_col, dims, scale)
        blocks, cuts = written(blocks_of(mine, id_col, vec_col, label_col, dims, scale), "code-blocks"), part_ranges(dims, parts)
        for _ in range(rounds):
            for (p, k), (_, mean) in moved(_sums(blocks, books, cuts), ["part", "entry"], dims // parts).items():
                books[k, cuts[p]] = mean
        all_entries = ",".join(str(v) for dims_of in cuts for entry in books for v in entry[dims_of].tolist())
        coded.append(_coded(blocks, books, cuts, kinds).withColumn("codebooks_sha256", F.lit(hashlib.sha256(all_entries.encode()).hexdigest())))
    if not coded:
        return kept.select(F.col(id_col).alias("id"), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256")).limit(0)
    rows = coded[0]
    for more in coded[1:]:
        rows = rows.unionByName(more)
    rows = written(rows, "vector-codes")
    totals = written(rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "label-errors")
    if totals.count() <= FEW_LABELS:
        totals = F.broadcast(totals)
    return rows.join(totals, F.col("label").eqNullSafe(F.col("of"))).select("id", "code", "error", "label_error", "codebooks_sha256")
