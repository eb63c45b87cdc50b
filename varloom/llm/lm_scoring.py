"""Language-model scoring by context-tree weighting over binary-decomposed bytes.

A text is its words, joined by one blank and closed by one end byte. Each byte is eight binary decisions; each decision mixes
the Krichevsky-Trofimov estimates of all context depths from 0 to DEPTH bytes, across word ends, by context-tree weighting. The
score is the log10 probability of all bytes under the frozen tree of the training documents; nothing else is mixed in.

Tables of contexts and words travel as packed arrays: a row a block of documents and bucket, not a row a context.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.llm.common import remainder, written

#: Bytes of context of the deepest tree nodes, and of those at which the tree is dealt to tasks.
DEPTH, SHARD_DEPTH = 5, 2
#: Joins the words; stands before a text; ends it. White space cannot be part of a word, so these bytes are free.
STOP, START, END = b" ", b"\t", b"\n"
LOG2 = np.log(2.0)
#: Bytes whose contexts are held at a time.
STRIDE = 1 << 20
#: Buckets of contexts or words at most, and (block, context) pairs that one task merges; more pairs are salted by block.
MOST_BUCKETS, PAIRS_A_TASK = 4096, 4_000_000


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes: like bytes of all numbers together, compressed."""
    parts = []
    for a in arrays:
        raw = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes()
        body = pa.compress(raw, "zstd", asbytes=True) if len(a) else b""
        parts += [struct.pack("<2sqq", a.dtype.str[1:].encode(), len(a), len(body)), body]
    return b"".join(parts)


def unpacked(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        kind, n, size = struct.unpack_from("<2sqq", data, at)
        at += struct.calcsize("<2sqq")
        dtype = np.dtype("<" + kind.decode())
        raw = pa.decompress(data[at : at + size], n * dtype.itemsize, "zstd", asbytes=True) if n else b""
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(dtype.itemsize, n).T).view(dtype).ravel())
        at += size
    return out


# ---- blocks of documents ------------------------------------------------------------------------------------------------


def words_of(text: str | None) -> list[bytes]:
    """The words, A-Z lower-cased; white space is tab to carriage return and the blank."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def positions(flat: np.ndarray, depth: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(where, which, keys), STRIDE bytes at a time: the context of `depth` bytes and the byte itself, packed, of every byte
    that is not START. Texts follow one another, each after `depth` START bytes."""
    for at in range(depth, len(flat), STRIDE):
        part = flat[at - depth : at + STRIDE]
        n = len(part) - depth
        key = np.zeros(n, np.int64)
        for d in range(depth, -1, -1):
            key = (key << 8) | part[depth - d : depth - d + n]
        which = np.flatnonzero(part[depth:] != START[0])
        yield at, which, key[which]


def spelled(words: list[bytes], depth: int) -> bytes:
    """The bytes of a text after `depth` START bytes."""
    return START * depth + STOP.join(words) + END


def counted(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    keys, n = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
    found, place = np.unique(keys, return_inverse=True)
    return found, np.bincount(place, weights=n, minlength=len(found)).astype(np.int64)


def context_bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Contexts that share their last SHARD_DEPTH bytes lie in one bucket."""
    last = (keys >> 8) & ((1 << (8 * SHARD_DEPTH)) - 1)
    return ((last * 0x9E3779B1 >> 7) & 0x7FFFFFFF) % buckets


def word_buckets(words: list[bytes], buckets: int) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % buckets


CODED = "block long, kind int, bucket int, n long, payload binary"
TEXTS, CONTEXTS, WORDS = 0, 1, 2


def _coded(block: int, ids: list, held: list[bool], texts: Iterable[str | None], buckets: int, depth: int) -> pa.RecordBatch:
    """One block of documents: its texts as word numbers, and its contexts and words with training counts, by bucket."""
    local: dict[bytes, int] = {}
    codes, raw = [], ([], [])
    for text, h in zip(texts, held, strict=True):
        words = words_of(text)
        codes.append(np.fromiter((local.setdefault(w, len(local)) for w in words), np.uint32, len(words)))
        raw[h].append(spelled(words, depth))
    lengths = np.array([len(c) for c in codes], np.int64)
    codes, held = np.concatenate(codes), np.array(held, bool)
    learned = np.r_[np.bincount(codes[np.repeat(~held, lengths)], minlength=len(local)), (~held).sum()].astype(np.int64)  # the last is the end
    names = [*local, b""]
    text = packed(np.array([0 if i is None else i for i in ids], np.int64), np.array([i is None for i in ids], bool), held, lengths, codes, _joined(names))
    rows = [(block, TEXTS, -1, len(ids), text)]
    parts = []
    for own, train in ((raw[False], 1), (raw[True], 0)):
        for _, _, keys in positions(np.frombuffer(b"".join(own), np.uint8), depth):
            found, n = np.unique(keys, return_counts=True)
            parts.append((found, n * train))
    keys, n = counted(parts)
    for kind, where, columns in ((CONTEXTS, context_bucket(keys, buckets), lambda i: (keys[i], n[i])), (WORDS, word_buckets(names, buckets), lambda i: (_joined([names[j] for j in i]), learned[i]))):
        by = np.argsort(where, kind="stable")
        for i in np.split(by, np.flatnonzero(np.diff(where[by])) + 1):
            rows.append((block, kind, int(where[i[0]]), len(i), packed(*columns(i))))
    types = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["block", "kind", "bucket", "n", "payload"])


def _joined(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(END.join(words), np.uint8)


def _parted(joined: np.ndarray) -> list[bytes]:
    return joined.tobytes().split(END)


def code_documents(docs: DataFrame, buckets: int, depth: int = DEPTH, block_bytes: int = 8 << 20) -> DataFrame:
    """Rows of three kinds for each block of documents (id, held, text): the texts, and the contexts and words of each bucket.

    A block closes at about block_bytes of text; a longer document is a block of its own. A frequent context or word leaves
    the task once a block.
    """

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        ids: list = []
        held: list[bool] = []
        texts: list = []
        size = 0
        for batch in batches:
            for i, h, t in zip(batch["id"].to_pylist(), batch["held"].to_pylist(), batch["text"], strict=True):
                ids.append(i)
                held.append(h)
                texts.append(t)  # still in the batch's own memory
                size += len(t.as_buffer()) if t.is_valid else 0
                if size >= block_bytes:
                    yield _coded(block, ids, held, (t.as_py() for t in texts), buckets, depth)
                    block, size = block + 1, 0
                    ids, held, texts = [], [], []
        if ids:
            yield _coded(block, ids, held, (t.as_py() for t in texts), buckets, depth)

    return docs.mapInArrow(code, CODED)


# ---- tables over all blocks ---------------------------------------------------------------------------------------------


def _merge_contexts(payloads: list[bytes]) -> tuple[np.ndarray, ...]:
    return counted([tuple(unpacked(p)) for p in payloads])


def _merge_words(payloads: list[bytes]) -> tuple[np.ndarray, ...]:
    parts = [unpacked(p) for p in payloads]
    coded = pa.array([w for joined, _ in parts for w in _parted(joined)], pa.binary()).dictionary_encode()
    n = np.bincount(coded.indices.to_numpy(), weights=np.concatenate([c for _, c in parts]), minlength=len(coded.dictionary))
    return _joined(coded.dictionary.to_pylist()), n.astype(np.int64)


MERGED = "bucket int, total long, kinds long, payload binary"


def merged(chunks: DataFrame, merge, salts: int) -> DataFrame:
    """(bucket, total, kinds, payload): the chunks of all blocks merged, a row a bucket. Chunks of many blocks are merged by
    salt first, so a bucket's task sees `salts` lists of distinct keys, however many blocks there are."""

    def together(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        keys, n = merge(list(pdf["payload"]))
        return pd.DataFrame({"bucket": [key[0]], "total": [int(n.sum())], "kinds": [int((n > 0).sum())], "payload": [packed(keys, n)]})

    if salts > 1:
        chunks = chunks.groupBy("bucket", F.pmod("block", F.lit(salts)).alias("salt")).applyInPandas(together, MERGED)
    return chunks.groupBy("bucket").applyInPandas(together, MERGED)


def answers(chunks: DataFrame, table: DataFrame, kind: int, find, salts: int) -> DataFrame:
    """(block, kind, bucket, n, payload): find(chunk, table) for the chunk of every block and bucket. The table of a bucket meets
    the chunks of one salt at a time."""

    def meet(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = find(left["payload"], right["payload"].iloc[0]) if len(left) else []
        return pd.DataFrame({"block": left["block"], "kind": kind, "bucket": left["bucket"], "n": left["n"], "payload": found})

    left = chunks.withColumn("salt", F.pmod("block", F.lit(salts)))
    right = table.select("bucket", "payload", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"))
    return left.groupBy("bucket", "salt").cogroup(right.groupBy("bucket", "salt")).applyInPandas(meet, CODED)


def _find_contexts(chunks: pd.Series, table: bytes) -> list[bytes]:
    known, value = unpacked(table)
    out = []
    for c in chunks:
        keys = unpacked(c)[0]
        out.append(packed(keys, value[np.searchsorted(known, keys)]))
    return out


def _find_words(chunks: pd.Series, table: bytes) -> list[bytes]:
    joined, n = unpacked(table)
    count = dict(zip(_parted(joined), n.tolist(), strict=True))
    return [packed(np.fromiter((count[w] for w in _parted(unpacked(c)[0])), np.int64)) for c in chunks]


# ---- the tree -----------------------------------------------------------------------------------------------------------


def _log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov block probability of a zeros and b ones."""
    return _ln_gamma(a + 0.5) + _ln_gamma(b + 0.5) - _ln_gamma(a + b + 1.0) - np.log(np.pi)


def _ln_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after eight steps of the recurrence (absolute error below 1e-10 for x >= 0.5)."""
    x = np.asarray(x, float)
    shift = np.ones_like(x)
    for i in range(8):
        shift = shift * (x + i)
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - np.log(shift)


def _bits(keys: np.ndarray, n: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct nodes ((context of `depth` bytes) x 256 + place in the byte's binary tree) with zeros and ones."""
    context = (keys >> 8) & ((1 << (8 * depth)) - 1)
    byte = keys & 255
    node = np.empty((8, len(keys)), np.int64)
    bit = np.empty((8, len(keys)), bool)
    for i in range(8):
        node[i] = (context << 8) | ((256 | byte) >> (8 - i))
        bit[i] = (byte >> (7 - i)) & 1
    nodes, place = np.unique(node.ravel(), return_inverse=True)
    weight = np.tile(n.astype(float), 8)
    ones = np.bincount(place, weights=weight * bit.ravel(), minlength=len(nodes))
    return nodes, np.bincount(place, weights=weight, minlength=len(nodes)) - ones, ones


def _weigh(keys: np.ndarray, n: np.ndarray, top: int, deepest: int) -> dict[int, tuple]:
    """Levels deepest..top of the tree: nodes, zeros, ones, weight of the node's own estimate, log weighted probability."""
    levels: dict[int, tuple] = {}
    below = None
    for depth in range(deepest, top - 1, -1):
        nodes, zeros, ones = _bits(keys, n, depth)
        own = _log_kt(zeros, ones)
        if below is None:
            levels[depth] = (nodes, zeros, ones, np.ones(len(nodes)), own)
        else:
            # A node one byte deeper is a child of the node whose context lacks its first byte.
            parent = (((below[0] >> 8) & ((1 << (8 * depth)) - 1)) << 8) | (below[0] & 255)
            split = np.bincount(np.searchsorted(nodes, parent), weights=below[4], minlength=len(nodes))
            mixed = np.logaddexp(own, split) - LOG2
            levels[depth] = (nodes, zeros, ones, np.exp(own - LOG2 - mixed), mixed)
        below = levels[depth]
    return levels


def _walk(levels: dict[int, tuple], keys: np.ndarray, start: np.ndarray | None, top: int, deepest: int) -> np.ndarray:
    """For each key and bit (8 x keys): probability of the bit, mixed over depths deepest..top; start: what lies below.

    A path ends at the deepest node that training reached (NaN: nothing below was reached); that node then stands alone.
    """
    byte = keys & 255
    p = start
    for depth in range(deepest, top - 1, -1):
        nodes, zeros, ones, weight, _ = levels[depth]
        context = (keys >> 8) & ((1 << (8 * depth)) - 1)
        now = np.empty((8, len(keys)))
        for i in range(8):
            at = np.searchsorted(nodes, (context << 8) | ((256 | byte) >> (8 - i)))
            bit = (byte >> (7 - i)) & 1
            seen = zeros[at] + ones[at]
            own = (np.where(bit, ones[at], zeros[at]) + 0.5) / (seen + 1.0)
            mixed = own if p is None else np.where(np.isnan(p[i]), own, weight[at] * own + (1 - weight[at]) * p[i])
            now[i] = np.where(seen > 0, mixed, np.nan) if depth else mixed
        p = now
    return p


def code_lengths(table: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(bucket, payload): for each bucket of the merged contexts the keys and the log10 probability of each byte in its context
    under the frozen tree; contexts that only held-out texts hold are there with count 0.

    Everything deeper than SHARD_DEPTH bytes is one bucket's own affair. The few levels above are summed up from one row a node
    of depth SHARD_DEPTH: 256 contexts times 255 places of level 1 are the most that reaches the driver, whatever the corpus.
    """

    def crown(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for payload in pdf["payload"]:
                nodes, zeros, ones, _, mixed = _weigh(*unpacked(payload), SHARD_DEPTH, depth)[SHARD_DEPTH]
                yield pd.DataFrame({"node": nodes, "zeros": zeros.astype(np.int64), "ones": ones.astype(np.int64), "mixed": mixed})

    @F.pandas_udf("mixed double, weight double")
    def mix(zeros: pd.Series, ones: pd.Series, split: pd.Series) -> pd.DataFrame:
        own = _log_kt(zeros.to_numpy(float), ones.to_numpy(float))
        mixed = np.logaddexp(own, split.to_numpy(float)) - LOG2
        return pd.DataFrame({"mixed": mixed, "weight": np.exp(own - LOG2 - mixed)})

    level = table.mapInPandas(crown, "node long, zeros long, ones long, mixed double")
    above: dict[int, tuple] = {}
    for d in range(SHARD_DEPTH - 1, -1, -1):
        parent = F.shiftright("node", 8).bitwiseAND(F.lit((1 << (8 * d)) - 1)) * 256 + F.col("node").bitwiseAND(F.lit(255))
        sums = level.groupBy(parent.alias("node")).agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("mixed").alias("split"))
        level = written(sums.withColumn("m", mix("zeros", "ones", "split")).select("node", "zeros", "ones", "m.mixed", "m.weight"), f"ctw-level{d}")
        t = level.toArrow().to_pandas().sort_values("node")
        above[d] = (t["node"].to_numpy(np.int64), t["zeros"].to_numpy(float), t["ones"].to_numpy(float), t["weight"].to_numpy(float), None)
    shared = table.sparkSession.sparkContext.broadcast(above)  # levels 0 and 1: 65,535 nodes at most

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for bucket, payload in zip(pdf["bucket"], pdf["payload"], strict=True):
                keys, n = unpacked(payload)
                p = _walk(_weigh(keys, n, SHARD_DEPTH, depth), keys, None, SHARD_DEPTH, depth)
                p = _walk(shared.value, keys, p, 0, SHARD_DEPTH - 1)
                yield pd.DataFrame({"bucket": [bucket], "payload": [packed(keys, np.log10(p).sum(0))]})

    return table.mapInPandas(score, "bucket int, payload binary")


# ---- scores -------------------------------------------------------------------------------------------------------------

SCORED = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold: int = 5, held: int = 1, depth: int = DEPTH, block_bytes: int = 8 << 20, pairs: int = PAIRS_A_TASK) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) for every row.

    Learns from the documents whose crc32(id as text) mod `fold` is not `held`. Tokens are the ASCII-blank-separated words,
    A-Z lower-cased, and one end. base_score is the smoothed unigram baseline; score the tree's log10 probability of the words
    joined by blanks and closed by the end byte; bits_per_byte its code length per such byte. A context that training never
    reached has no estimate: its longest reached suffix stands for it. NULL and empty texts are the end alone. A NULL id is
    neither held out nor learned from. Repeated rows count, and are scored, each for itself; equal texts of one fold score
    alike. Without training documents the counts are 0 and every bit costs one bit. Other columns of docs are ignored.
    """
    spark = docs.sparkSession
    out = F.coalesce(remainder(F.col(id_col), fold) == held, F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), (out | F.col(id_col).isNull()).alias("held"), F.col(text_col).alias("text"))
    buckets = min(MOST_BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    coded = written(code_documents(rows, buckets, depth, block_bytes), "lm-coded")
    contexts, words = coded.where(F.col("kind") == CONTEXTS), coded.where(F.col("kind") == WORDS)
    sizes = {r["kind"]: r["n"] for r in coded.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    salts = {k: max(1, -(-sizes.get(k, 0) // (buckets * pairs))) for k in (CONTEXTS, WORDS)}
    known = written(merged(words, _merge_words, salts[WORDS]), "lm-words")
    totals = known.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("n"), F.coalesce(F.sum("kinds"), F.lit(0)).alias("kinds")).first()
    n_all, kinds = int(totals["n"]), int(totals["kinds"])
    lengths = written(code_lengths(written(merged(contexts, _merge_contexts, salts[CONTEXTS]), "ctw-contexts"), depth), "ctw-lengths")
    back = answers(contexts, lengths, CONTEXTS, _find_contexts, salts[CONTEXTS]).unionByName(answers(words, known, WORDS, _find_words, salts[WORDS]))

    def add_up(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        kind = pdf["kind"].to_numpy()
        numbers, null, held, lengths, codes, joined = unpacked(pdf["payload"][kind == TEXTS].iloc[0])
        names = _parted(joined)
        told = pdf[kind == WORDS].sort_values("bucket")
        c = np.empty(len(names), np.int64)
        c[np.argsort(word_buckets(names, buckets), kind="stable")] = np.concatenate([unpacked(p)[0] for p in told["payload"]])
        base = np.log10((c + 0.5) / (n_all + 0.5 * (kinds + 1)))
        begin = np.cumsum(lengths) - lengths
        add = lambda x: np.add.reduceat(np.r_[x[codes], 0], begin) * (lengths > 0) + x[-1]  # noqa: E731  words, then the end
        parts = [spelled([names[i] for i in codes[b : b + n]], depth) for b, n in zip(begin.tolist(), lengths.tolist(), strict=True)]
        n_bytes = np.array([len(p) - depth for p in parts])
        flat, starts = np.frombuffer(b"".join(parts), np.uint8), np.cumsum(n_bytes + depth) - n_bytes - depth
        parts = [unpacked(p) for p in pdf["payload"][kind == CONTEXTS]]
        index, value = pd.Index(np.concatenate([k for k, _ in parts])), np.concatenate([v for _, v in parts])
        score = np.zeros(len(lengths))
        for at, which, keys in positions(flat, depth):
            score += np.bincount(np.searchsorted(starts, at + which, "right") - 1, weights=value[index.get_indexer(keys)], minlength=len(score))
        ids = pd.Series(numbers, dtype="Int64").mask(null)
        return pd.DataFrame(
            {"id": ids, "held_out": held & ~null, "n_tokens": lengths + 1, "n_known": add((c > 0).astype(np.int64)), "train_tokens": n_all, "base_score": add(base), "score": score, "bits_per_byte": -score / np.log10(2.0) / n_bytes}
        )

    return coded.where(F.col("kind") == TEXTS).unionByName(back).groupBy("block").applyInPandas(add_up, SCORED)
