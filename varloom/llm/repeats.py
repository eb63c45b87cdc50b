"""Removal of repeated 100-byte strings: Burrows-Wheeler transforms of shards, merged by iterative interleave refinement.

Four steps. (1) Every string of WINDOW bytes belongs to the smallest hash of a K-byte string inside it, so equal strings share that key wherever
they stand; the runs of starts that share a key are compared by 128-bit digest. Where a key's runs are all equal, all but the
earliest repeat it. (2) Only keys with differing runs need more: the bytes of one run of each digest are fetched, keys are dealt
to buckets, and each shard of a bucket makes the transform of its runs. (3) A bucket's transforms are merged by interleave refinement to a depth of
WINDOW bytes; what then shares an interval is one repeated string, and all but its earliest start go. (4) Each document loses the bytes
that its repeated starts cover.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.llm.common import written
from varloom.operators.base import numbered

#: Length of a repeated string, of the strings whose smallest hash is the key, and of the longest run of starts (in strings).
WINDOW, K, LONGEST = 100, 32, 256
#: Bytes of text that are hashed in step, bytes of runs in a bucket, shards of a bucket, and bytes of runs from which a key is split by whole strings.
STEP, BUCKET, SHARDS, HEAVY = 1 << 20, 1 << 18, 2, 1 << 21

_MIX = np.random.default_rng(11).integers(0, 2**63, K // 8 + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_RUN = "key long, d0 long, d1 long, doc long, start long, n int, again boolean"


# --- runs of equal keys -------------------------------------------------------------------------------------------------


def smallest_hashes(text: np.ndarray) -> np.ndarray:
    """For each string of WINDOW bytes the smallest hash of a K-byte string in it; the low 12 bits hold where that lies, so that ties go to the first."""
    n = len(text) - K + 1
    words = np.ndarray(len(text) - 7, "<u8", text, strides=(1,))
    h = np.zeros(n, np.uint64)
    for i in range(0, K, 8):
        h += words[i : i + n] * _MIX[i // 8]
        h ^= h >> np.uint64(31)
    h *= _MIX[-1]
    h ^= h >> np.uint64(29)
    h *= _MIX[0]
    at = np.arange(n, dtype=np.uint64) & np.uint64(4095)
    h = (h & ~np.uint64(4095)) | at
    width, wide = WINDOW - K + 1, 1
    while 2 * wide <= width:
        h = np.minimum(h[:-wide], h[wide:])
        wide *= 2
    return np.minimum(h[: len(h) - (width - wide)], h[width - wide :])


def runs_of(pieces: list[tuple[int, int, bytes]]) -> dict[str, np.ndarray]:
    """The runs of pieces (document, where the piece starts in it, bytes of WINDOW or more): for each its key, digest, document, first start,
    number of starts, and whether its key lies in it more than once, so that it may repeat itself."""
    sizes = np.array([len(b) for _, _, b in pieces])
    joined = b"".join(b for _, _, b in pieces)
    mins = smallest_hashes(np.frombuffer(joined, np.uint8))
    firsts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    owner = np.repeat(np.arange(len(pieces)), sizes)[: len(mins)]
    fits = np.arange(len(mins)) + WINDOW <= (firsts + sizes)[owner]
    keys = mins >> np.uint64(12)
    new = np.ones(len(mins), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    begin = np.flatnonzero(new & fits)
    stop = np.append(np.flatnonzero(new | ~fits), len(mins))
    length = stop[np.searchsorted(stop, begin, side="right")] - begin
    times = -(-length // LONGEST)
    if (times > 1).any():  # long runs of one key are cut; equal strings still share the key
        of = np.repeat(np.arange(len(begin)), times)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)
        begin, length = begin[of] + nth * LONGEST, np.minimum(LONGEST, length[of] - nth * LONGEST)
    moves = np.concatenate([[0], np.cumsum(mins[1:] != mins[:-1])])
    again = moves[begin + length - 1] != moves[begin]
    view, digest = memoryview(joined), xxhash.xxh3_128_digest
    marks = b"".join([digest(view[s : s + n]) for s, n in zip(begin.tolist(), (length + WINDOW - 1).tolist(), strict=True)])
    marks = np.frombuffer(marks, "<i8").reshape(-1, 2)
    doc, offset = np.array([p[0] for p in pieces], np.int64), np.array([p[1] for p in pieces], np.int64)
    mine = owner[begin]
    return {"key": keys[begin].astype(np.int64), "d0": marks[:, 0], "d1": marks[:, 1], "doc": doc[mine], "start": offset[mine] + begin - firsts[mine], "n": length, "again": again}


def earliest_here(runs: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The runs, those that repeat an earlier one of these with key 0 and digest 0: they are decided, and have no key to be dealt by."""
    order = np.lexsort([runs[c] for c in ("start", "doc", "n", "d1", "d0", "key")])
    runs = {c: v[order] for c, v in runs.items()}
    late = np.zeros(len(order), bool)
    late[1:] = np.all([runs[c][1:] == runs[c][:-1] for c in ("key", "d0", "d1", "n")], 0)
    return {c: np.where(late, 0, v) if c in ("d0", "d1") else v for c, v in runs.items()} | {"key": np.where(late, -1 - runs["doc"] % 65521, runs["key"])}


def document_runs(texts: DataFrame) -> DataFrame:
    """The runs of the documents (doc, bytes), equal ones of a step combined: of a group of copies each step sends one run on, the others with a negative key."""

    def cutting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for doc, text in zip(batch["doc"].to_pylist(), batch["bytes"], strict=True):
                text = text.as_buffer()
                for at in range(0, max(0, len(text) - WINDOW + 1), STEP):
                    held.append((doc, at, bytes(text[at : at + STEP + WINDOW - 1])))
                    size += len(held[-1][2])
                    if size >= STEP:
                        yield _as_batch(earliest_here(runs_of(held)))
                        held, size = [], 0
        if held:
            yield _as_batch(earliest_here(runs_of(held)))

    return texts.select("doc", "bytes").mapInArrow(cutting, _RUN)


def _as_batch(columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    kinds = {"n": pa.int32(), "again": pa.bool_()}
    return pa.RecordBatch.from_arrays([pa.array(v, kinds.get(c, pa.int64())) for c, v in columns.items()], list(columns))


def decided(runs: DataFrame) -> DataFrame:
    """(asks, key, doc, start, n): the runs that repeat an earlier equal one (asks is false), and of each digest the earliest where
    only its bytes can tell, as its key has other runs or lies in it twice.

    A key's runs come to one task, sorted, and stream past: no group is held, however large it is.
    """

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[str, np.ndarray] | None = None  # the last run of the batch before, and the earliest of its digest if it is still open
        for batch in batches:
            now = {c: batch[c].to_numpy(zero_copy_only=False) for c in ("key", "d0", "d1", "doc", "start", "n", "again")}
            if last is not None:
                now = {c: np.concatenate([last[c], v]) for c, v in now.items()}
            if not len(now["key"]):
                continue
            head = 0 if last is None else len(last["key"])
            key = now["key"]
            same_key = np.concatenate([[False], key[1:] == key[:-1]])
            same = same_key & np.concatenate([[False], np.all([now[c][1:] == now[c][:-1] for c in ("d0", "d1", "n")], 0)])
            local = key < 0
            out = (same & ~local) | local
            out[:head] = False
            firsts = np.flatnonzero(~same & ~local)
            # A key's first and second digest: both ask, and so does every further one.
            joined = np.concatenate([[False], key[firsts][1:] == key[firsts][:-1]])
            asks = joined | np.append(joined[1:], False) | now["again"][firsts]
            told = firsts < head
            done = np.zeros(len(firsts), bool)
            if head:
                done[told] = last["done"][firsts[told]]
            tail = firsts[-1] if len(firsts) else None
            yield _rows(now, np.flatnonzero(out), False)
            yield _rows(now, firsts[asks & ~done], True)
            # What the next batch needs: the earliest run of the last digest, which also stands for the last run's digest.
            last = None
            if tail is not None and not local[-1] and key[tail] == key[-1]:
                last = {c: v[[tail]] for c, v in now.items() if c != "done"} | {"done": np.array([bool(asks[-1] or done[-1])])}

    dealt = runs.repartition("key").sortWithinPartitions("key", "d0", "d1", "n", "doc", "start")
    return dealt.mapInArrow(passing, "asks boolean, key long, doc long, start long, n int")


def _rows(runs: dict[str, np.ndarray], which: np.ndarray, asks: bool) -> pa.RecordBatch:
    columns = {c: runs[c][which] for c in ("key", "doc", "start", "n")}
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(which), asks)), *[pa.array(v, pa.int32() if c == "n" else pa.int64()) for c, v in columns.items()]], ["asks", *columns])


# --- transforms and their merge -----------------------------------------------------------------------------------------


def transform(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(last column, rows of the texts' beginnings) of the Burrows-Wheeler transform of all texts, each ended by a mark of its own
    that sorts before every byte, and before those of later texts. Beginnings have 0 in the last column."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    ends = np.cumsum(sizes) - 1
    joined = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    symbol = joined.astype(np.int64) + len(texts)
    symbol[ends] = np.arange(len(texts))
    total, bits = len(joined), (len(texts) + 255).bit_length()
    rank, span = symbol.copy(), 62 // bits
    for n in range(1, span):  # as many symbols as fit are compared at once, then twice as many each time
        rank = rank << bits
        rank[: total - n] |= symbol[n:]
    order = np.argsort(rank)
    while True:
        ranked = rank[order]
        new = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
        rank = np.empty(total, np.int64)
        rank[order] = new
        if new[-1] == total - 1:
            break
        ahead = np.zeros(total, np.int64)
        ahead[: total - span] = rank[span:] + 1  # past an end mark nothing is compared any more, as marks differ
        rank = rank * (total + 1) + ahead
        order = np.argsort(rank)
        span *= 2
    begins = rank[np.concatenate([[0], ends[:-1] + 1])]
    last = joined[order - 1].copy()
    last[begins] = 0
    return last, begins


def steps_back(last: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """For each row the row of the string that starts one byte earlier; -1 for beginnings. The end marks have the first rows."""
    symbol = last.astype(np.uint16) + 1
    symbol[begins] = 0
    to = np.empty(len(last), np.int64)
    to[np.argsort(symbol, kind="stable")] = np.arange(len(last))
    to[begins] = -1
    return to


def places(back: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, offset) of each row, by walking back from all end marks at once."""
    text, offset = np.empty(len(back), np.int64), np.empty(len(back), np.int64)
    live, row = np.arange(len(lengths)), np.arange(len(lengths))
    at = lengths.astype(np.int64)
    while len(live):
        text[row], offset[row] = live, at[live]
        row = back[row]
        at[live] -= 1
        live, row = live[row >= 0], row[row >= 0]
    return text, offset


def merge(transforms: list[tuple[np.ndarray, np.ndarray]], depth: int, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, intervals, common) of the merged transforms; rows are numbered through all transforms, one after the other.

    The interleave begins with all rows, or with those of start, which then gives the rows `depth` bytes before them (and no common prefixes).

    The interleave starts as one transform after the other. Each refinement sorts it, stably, by the last column, which makes it right for one more
    leading byte: the rows of each transform keep their order, no suffix is compared or sorted again. Where neighbours differ, an interval
    ends; a row alone in its interval has its longest common prefix and is left out from then on, as all that starts before it
    is alone too. After `depth` refinements an interval holds the rows whose first `depth` bytes are equal. common has for each row its
    longest common prefix with any other row, up to `depth`.
    """
    bases = np.cumsum([0] + [len(last) for last, _ in transforms])
    back = np.concatenate([np.where((to := steps_back(*t)) >= 0, to + base, -1) for t, base in zip(transforms, bases[:-1], strict=True)]).astype(np.int32)
    symbol = np.concatenate([last for last, _ in transforms])
    common = np.zeros(bases[-1], np.int64)
    rows = np.arange(bases[-1], dtype=np.int32) if start is None else start.astype(np.int32)
    interval = np.zeros(len(rows), np.int32)
    for n in range(1, depth + 1):
        to = back[rows]
        if (to < 0).any():
            before = to >= 0
            rows, interval, to = rows[before], interval[before], to[before]
        byte = symbol[rows]
        by = np.argsort(byte, kind="stable")
        byte, interval, rows = byte[by], interval[by], to[by]
        ends = np.ones(len(rows) + 1, bool)
        ends[1:-1] = (byte[1:] != byte[:-1]) | (interval[1:] != interval[:-1])
        shared = ~(ends[:-1] & ends[1:])
        rows, interval = rows[shared], np.cumsum(ends[:-1], dtype=np.int32)[shared]
        common[rows] = n
        if not len(rows):
            break
    return rows, interval, common


def repeated_starts(shards: list[dict], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, start, n): the runs of starts in the shards' runs whose string of `window` bytes also starts earlier in one of them."""
    doc, start, inside = [], [], []
    for s in shards:
        text, offset = places(steps_back(s["last"], s["begins"]), s["lengths"])
        doc.append(s["doc"][text])
        start.append(s["start"][text] + offset)
        inside.append(offset >= window)  # from elsewhere no whole string lies before
    rows, interval, _ = merge([(s["last"], s["begins"]) for s in shards], window, np.flatnonzero(np.concatenate(inside)))
    doc, start = np.concatenate(doc)[rows], np.concatenate(start)[rows]
    if not len(rows):
        return doc, start, start
    order = np.lexsort([start, doc, interval])
    late = np.concatenate([[False], interval[order][1:] == interval[order][:-1]])
    # The same start may stand in two runs; it is no repeat of itself.
    doc, start, interval = doc[order], start[order], interval[order]
    lead = np.maximum.accumulate(np.where(late, 0, np.arange(len(late))))
    late &= (doc != doc[lead]) | (start != start[lead])
    doc, start = doc[late], start[late]
    order = np.lexsort([start, doc])
    doc, start = doc[order], start[order]
    first = np.ones(len(doc), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + 1)
    at = np.flatnonzero(first)
    upto = np.append(at[1:], len(doc))[: len(at)] - 1
    return doc[at], start[at], start[upto] - start[at] + 1


def shard_transforms(runs: DataFrame, buckets: int, shards: int) -> DataFrame:
    """(bucket, doc, start, lengths, last, begins): the transform of the runs (key, doc, start, bytes) of each bucket and shard, as packed arrays."""

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        texts = pdf["bytes"].tolist()
        last, begins = transform(texts)
        packed = [pdf["doc"].to_numpy(np.int64), pdf["start"].to_numpy(np.int64), np.array([len(t) for t in texts], np.int32), last, begins.astype(np.int32)]
        return pd.DataFrame([[key[0], *[a.tobytes() for a in packed]]], columns=["bucket", "doc", "start", "lengths", "last", "begins"])

    dealt = runs.select(F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"), F.pmod(F.xxhash64("doc"), F.lit(shards)).alias("shard"), "doc", "start", "bytes")
    return dealt.groupBy("bucket", "shard").applyInPandas(build, "bucket long, doc binary, start binary, lengths binary, last binary, begins binary")


def merged_repeats(transforms: DataFrame) -> DataFrame:
    """(doc, start, n): the repeated starts of each bucket, from its shards' transforms."""

    def merging(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        kinds = {"doc": np.int64, "start": np.int64, "lengths": np.int32, "last": np.uint8, "begins": np.int32}
        shards = [{c: np.frombuffer(r[c], kind) for c, kind in kinds.items()} for r in pdf.to_dict("records")]
        doc, start, n = repeated_starts(shards, WINDOW)
        return pd.DataFrame({"doc": doc, "start": start, "n": n.astype(np.int32)})

    return transforms.groupBy("bucket").applyInPandas(merging, "doc long, start long, n int")


# --- the operator -------------------------------------------------------------------------------------------------------


def fetched(asks: DataFrame, texts: DataFrame) -> DataFrame:
    """(key, doc, start, bytes): the bytes of the runs (key, doc, start, n), each document's list beside its text once."""
    lists = asks.groupBy("doc").agg(F.collect_list(F.struct("key", "start", "n")).alias("runs"))

    def slicing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, runs in zip(batch["doc"].to_pylist(), batch["bytes"], batch["runs"], strict=True):
                text, flat = text.as_buffer(), pa.StructArray.from_arrays(runs.values.flatten(), ["key", "start", "n"])
                key, start, n = (flat.field(c).to_numpy() for c in ("key", "start", "n"))
                cuts = [bytes(text[s : s + m + WINDOW - 1]) for s, m in zip(start.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.full(len(key), doc)), pa.array(start), pa.array(cuts, pa.binary())], ["key", "doc", "start", "bytes"])

    return texts.join(lists, "doc").mapInArrow(slicing, "key long, doc long, start long, bytes binary")


def each_string(runs: DataFrame) -> DataFrame:
    """Runs of one start each, keyed by the hash of the whole string: what is left of a key that too many differing runs share."""

    def cutting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, start, text in zip(batch["doc"].to_pylist(), batch["start"].to_pylist(), batch["bytes"].to_pylist(), strict=True):
                marks = np.frombuffer(b"".join(xxhash.xxh3_128_digest(text[i : i + WINDOW]) for i in range(len(text) - WINDOW + 1)), "<i8").reshape(-1, 2)
                n = len(marks)
                yield _as_batch(earliest_here({"key": marks[:, 0] & (2**62 - 1), "d0": marks[:, 0], "d1": marks[:, 1], "doc": np.full(n, doc), "start": start + np.arange(n), "n": np.ones(n, np.int32), "again": np.zeros(n, bool)}))

    return runs.mapInArrow(cutting, _RUN)


def repeated_runs(texts: DataFrame, heavy: int = HEAVY, bucket: int = BUCKET, shards: int = SHARDS) -> DataFrame:
    """(doc, start, n): runs of starts whose string of WINDOW bytes also starts earlier, for documents (doc, bytes) in the order of their distinct numbers."""
    told = written(decided(document_runs(texts)), "repeat-runs")
    asks = told.where("asks").drop("asks")
    weights = asks.groupBy("key").agg(F.sum(F.col("n") + WINDOW - 1).alias("size"))
    hot = written(weights.where(F.col("size") > heavy).select("key"), "repeat-hot")
    total = asks.agg(F.coalesce(F.sum(F.col("n") + WINDOW - 1), F.lit(0)).alias("size")).first()["size"]
    found = told.where("NOT asks")
    if hot.take(1):
        split = written(decided(each_string(fetched(asks.join(hot, "key", "left_semi"), texts))), "repeat-strings")
        found = found.unionByName(split.where("NOT asks"))
        asks = asks.join(hot, "key", "left_anti").unionByName(split.where("asks").drop("asks"))
    if total:
        found = found.select("doc", "start", "n").unionByName(merged_repeats(shard_transforms(fetched(asks, texts), int(-(-total // bucket)), shards)))
    return found.select("doc", "start", "n")


def covered(starts: np.ndarray, ns: np.ndarray) -> list[tuple[int, int]]:
    """The maximal runs of bytes [from, to) that the strings from these starts on cover."""
    order = np.argsort(starts, kind="stable")
    begin = starts[order].astype(np.int64)
    end = np.maximum.accumulate(begin + ns[order] + WINDOW - 1)
    first = np.concatenate([[True], begin[1:] > end[:-1]])
    at = np.flatnonzero(first)
    return list(zip(begin[at].tolist(), end[np.append(at[1:], len(begin)) - 1].tolist(), strict=True))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", heavy: int = HEAVY, bucket: int = BUCKET, shards: int = SHARDS) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept, kept_sha256) of every row: its text as UTF-8 bytes without those that a string of WINDOW bytes
    covers which also starts earlier, in a row of smaller id or before in the same text.

    Overlaps count, strings are judged on the input, and none crosses documents. NULL counts as the empty text; texts shorter than
    WINDOW lose nothing; very long texts are hashed in steps. kept holds the bytes that remain. Rows of one id are ordered by the SHA-256 of their
    text, NULL ids come last; rows that repeat id and text are one document and get the same result each. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("bytes"))
    kind = docs.schema[id_col].dataType.simpleString()
    plain = kind in ("bigint", "int", "smallint", "tinyint") and not rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1 OR id IS NULL").take(1)
    if plain:
        rows = rows.withColumn("doc", F.col("id").cast("long"))
    else:
        rows = rows.withColumn("sha", F.sha2("bytes", 256))
        order = [F.col("id").isNull(), F.col("id"), F.col("sha")]
        names = numbered(rows.select("id", "sha").distinct(), order, "doc")
        rows = rows.join(names.select(F.col("id").alias("__id"), F.col("sha").alias("__sha"), "doc"), F.col("id").eqNullSafe(F.col("__id")) & (F.col("sha") == F.col("__sha")))
        rows = written(rows.select("id", "doc", "bytes"), "repeat-rows")
    texts = rows.where(F.octet_length("bytes") >= WINDOW).select("doc", "bytes")
    if not plain:
        texts = texts.dropDuplicates(["doc"])
    found = repeated_runs(texts, heavy, bucket, shards)
    lists = found.groupBy("doc").agg(F.collect_list("start").alias("starts"), F.collect_list("n").alias("ns"))

    def cutting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, starts, ns in zip(batch["bytes"], batch["starts"], batch["ns"], strict=True):
                text = text.as_buffer()
                spans = covered(starts.values.to_numpy(), ns.values.to_numpy()) if starts.is_valid else []
                edges = [0, *[e for s in spans for e in s], len(text)]
                kept = b"".join(bytes(text[a:b]) for a, b in zip(edges[::2], edges[1::2], strict=True)) if spans else bytes(text)
                out.append((len(text), len(text) - len(kept), len(spans), kept, hashlib.sha256(kept).hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([batch["id"], *[pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)]], ["id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    return rows.join(lists, "doc", "left").select("id", "bytes", "starts", "ns").mapInArrow(cutting, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
