"""SimHash near-dedup over a byte-position inverted index with count filtering."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.llm.common import cut
from varloom.llm.components import connected_components

#: Shingles hashed at a time, so that a very long text needs no more memory than a short one besides its words.
BLOCK = 16_384
SEED = 42
#: The byte positions that each of the six lists of a fingerprint leaves free: two of four blocks of two bytes.
FREE = np.array([[2 * x, 2 * x + 1, 2 * y, 2 * y + 1] for x, y in combinations(range(4), 2)])
#: Rows that a list of two blocks may hold before it passes on to longer keys. It changes which lists a pair meets in, not the links.
LONGEST = 256


def fingerprint(text: str | None, words: int = 3) -> int:
    """64 bits; bit i is set if it is set in over half of the XXH64 of the word shingles (repeats count)."""
    if not text:
        return 0
    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    n = max(1, len(tokens) - words + 1)
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, BLOCK):
        part = tokens[at : min(at + BLOCK, n) + words - 1]
        shingles = zip(*(part[i:] for i in range(words)), strict=False) if len(tokens) >= words else [tokens]
        hashes = np.fromiter((digest(b" ".join(s), SEED) for s in shingles), np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * ones > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, fp): the fingerprint of every whole text as a signed 64-bit number; texts without words have 0."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, words) for t in texts], dtype="int64")

    return docs.select(F.col(id_col).alias("id"), of(F.col(text_col)).alias("fp"))


def tally(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each pair of fingerprints the number of positional bytes that the two share."""
    return 8 - np.count_nonzero((a ^ b).view(np.uint8).reshape(-1, 8), axis=1)


def _candidates(residues: np.ndarray, radius: int) -> np.ndarray:
    """Pairs of positions (i < j) of residues (16-bit, distinct) that a change of at most `radius` bits takes into each other: for
    each residue its neighbours are looked up in a table of 65,536 places, never all pairs of the list."""
    place = np.full(65536, -1, np.int32)
    place[residues] = np.arange(len(residues), dtype=np.int32)
    masks = [1 << i for i in range(16)]
    if radius > 1:
        masks += [(1 << i) | (1 << j) for i, j in combinations(range(16), 2)]
    found = []
    for m in masks:
        other = place[residues ^ np.uint16(m)]
        i = np.flatnonzero(other > np.arange(len(residues)))
        if len(i):
            found.append(np.stack([i, other[i]], 1))
    return np.concatenate(found) if found else np.empty((0, 2), np.int64)


def checked(fps: np.ndarray, pairs: np.ndarray, radius: int) -> np.ndarray:
    """Those of the pairs whose tally of shared positional bytes reaches the guaranteed minimum, 8 - radius, and that differ in
    at most `radius` bits."""
    a, b = fps[pairs[:, 0]], fps[pairs[:, 1]]
    enough = tally(a, b) >= 8 - radius
    pairs, a, b = pairs[enough], a[enough], b[enough]
    return pairs[np.bitwise_count((a ^ b).view(np.uint64)) <= radius]


def _forest(pairs: np.ndarray, n: int) -> np.ndarray:
    """Those of the pairs that a spanning forest needs (fewer than n)."""
    if len(pairs) < 2:
        return pairs
    root = list(range(n))
    kept = []
    for i, j in pairs.tolist():
        a, b = i, j
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        while root[b] != b:
            root[b] = root[root[b]]
            b = root[b]
        if a != b:
            root[max(a, b)] = min(a, b)
            kept.append((i, j))
    return np.array(kept, np.int64).reshape(-1, 2)


def tallied(lists: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions (i < j) of one list that share a positional byte, and how many they share. lists: the list of each
    row, in order; entries: a row's bytes (n x k). The rows meet by (list, position, byte), as in an inverted index."""
    n, codes = len(lists), []
    for position in entries.T:
        posting = lists * 256 + position
        order = np.argsort(posting, kind="stable")
        posting = posting[order]
        at, apart = np.arange(n), 1
        while len(at := at[at + apart < n]) and len(at := at[posting[at] == posting[at + apart]]):
            codes.append(order[at] * n + order[at + apart])
            apart += 1
    if not codes:
        return np.empty((0, 2), np.int64), np.empty(0, np.int64)
    pair, shared = np.unique(np.concatenate(codes), return_counts=True)
    return np.stack([pair // n, pair % n], 1), shared


def counted(fps: np.ndarray, lists: np.ndarray, kinds: np.ndarray, radius: int) -> tuple[np.ndarray, int]:
    """Links among the rows of whole lists of one kind each (place in FREE), and how many of the pairs that met the count filter
    turned away: those sharing fewer than 8 - radius positional bytes, the four of the list's key included."""
    entries = fps.view(np.uint8).reshape(-1, 8)[np.arange(len(fps))[:, None], FREE[kinds]]
    pairs, shared = tallied(lists, entries)
    enough = shared + 4 >= 8 - radius
    pairs, low = pairs[enough], int((~enough).sum())
    apart = np.bitwise_count((fps[pairs[:, 0]] ^ fps[pairs[:, 1]]).view(np.uint64))
    return _forest(pairs[apart <= radius], len(fps)), low


def _keys(frees: list[tuple[int, ...]], codes: list[int]) -> Column:
    """An array of the postings of column fp: for each set of free byte positions its code and the fingerprint without them."""
    out = []
    for code, free in zip(codes, frees, strict=True):
        mask = ~sum(0xFF << (8 * p) for p in free) & 0xFFFFFFFFFFFFFFFF
        out.append(F.struct(F.lit(code).cast("byte").alias("free"), F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >= 1 << 63 else mask)).alias("shared")))
    return F.array(*out)


def _by_list(rows: DataFrame, keys: Column) -> DataFrame:
    """(free, shared, fp): the postings of the rows, each list in one partition and in order."""
    postings = rows.select("fp", F.explode(keys).alias("k")).select("k.free", "k.shared", "fp")
    return postings.repartition("free", "shared").sortWithinPartitions("free", "shared", "fp")


def near_links(distinct: DataFrame, radius: int = 2, longest: int = LONGEST) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) of at most `radius` (1 or 2) differing bits, enough to
    connect whatever the links of all pairs connect.

    Count filtering: radius differing bits spoil at most `radius` of the 8 bytes, so a true pair shares at least
    8 - radius (position, byte) entries. Lists of single entries would each hold 1/256 of all rows; but of four blocks of two
    bytes at least two stay whole, so postings carry two blocks, 32 bits, and every true pair meets in one of its six lists. Within a
    list the rows meet again by the entries of the four other bytes, each pair's shared entries are tallied, pairs
    below the minimum go, and the rest is verified bit by bit. Lists are streamed in order; one of over `longest` rows passes on
    to postings of 8 - radius bytes, whose lists hold at most 65,536 distinct fingerprints, in which each row looks its
    neighbours up. No list is cut, and each sends on a spanning forest of its verified pairs.
    """

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tail = (np.empty(0, np.int8), np.empty(0, np.int64), np.empty(0, np.int64))
        passed = None  # the list at the end of the last batch, if that has been found too long

        def settle(free: np.ndarray, shared: np.ndarray, fp: np.ndarray, starts: np.ndarray, known: bool) -> pd.DataFrame:
            """Links of whole lists, and the rows of those that are too long (known: the first is)."""
            sizes = np.diff(np.r_[starts, len(fp)])
            lists = np.repeat(np.arange(len(starts)), sizes)
            long = sizes > longest
            if known and len(long):
                long[0] = True
            short = ((sizes > 1) & ~long)[lists]
            pairs, _ = counted(fp[short], lists[short], free[short].astype(np.int64), radius)
            far = long[lists]
            mine = fp[short]
            return pd.DataFrame({"a": np.r_[mine[pairs[:, 0]], fp[far]], "b": np.r_[mine[pairs[:, 1]], fp[far]], "passed": np.r_[np.full(len(pairs), -1, np.int8), free[far]].astype(np.int8)})

        for pdf in batches:
            free, shared, fp = (np.r_[old, pdf[c].to_numpy()] for old, c in zip(tail, ("free", "shared", "fp"), strict=True))
            if not len(fp):
                continue
            starts = np.flatnonzero(np.r_[True, (free[1:] != free[:-1]) | (shared[1:] != shared[:-1])])
            known = passed == (free[0], shared[0])
            last = starts[-1]
            if len(fp) - last > longest or (known and last == 0):
                passed, tail = (free[-1], shared[-1]), (free[:0], shared[:0], fp[:0])
                yield settle(free, shared, fp, starts, known)
            else:
                passed, tail = None, (free[last:].copy(), shared[last:].copy(), fp[last:].copy())
                yield settle(free[:last], shared[:last], fp[:last], starts[:-1], known)
        yield settle(*tail, np.zeros(min(1, len(tail[2])), np.int64), False)

    first = cut(_by_list(distinct, _keys([tuple(f) for f in FREE.tolist()], list(range(len(FREE))))).mapInPandas(meet, "a long, b long, passed byte"))
    fine = list(combinations(range(8), radius))
    within = [[(n, f) for n, f in enumerate(fine) if set(f) <= set(wide)] for wide in FREE.tolist()]
    longer = F.get(F.array(*[_keys([f for _, f in w], [n for n, _ in w]) for w in within]), F.col("passed").cast("int"))
    finer = _by_list(first.where("passed >= 0").select(F.col("a").alias("fp"), "passed"), longer)
    return first.where("passed < 0").select("a", "b").unionByName(_near_in_long(finer, fine, radius))


def _near_in_long(postings: DataFrame, frees: list[tuple[int, ...]], radius: int) -> DataFrame:
    """(a, b): links of the fingerprints that meet in postings (free, shared, fp) of all bytes but `radius`, at most 65,536 distinct ones a list."""
    positions = [np.array(p) for p in frees]

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        last = None

        def flush() -> list[np.ndarray]:
            """The verified links of the held list."""
            fps = np.unique(np.concatenate(held))
            if len(fps) < 2:
                return []
            by_byte = fps.view(np.uint8).reshape(-1, 8)
            residue = np.zeros(len(fps), np.uint16)
            for i, p in enumerate(positions[last[0]]):
                residue |= by_byte[:, p].astype(np.uint16) << np.uint16(8 * i)
            pairs = _forest(checked(fps, _candidates(residue, radius), radius), len(fps))
            return [np.stack([fps[pairs[:, 0]], fps[pairs[:, 1]]], 1)] if len(pairs) else []

        for pdf in batches:
            free, shared, fp = (pdf[c].to_numpy() for c in ("free", "shared", "fp"))
            starts = np.flatnonzero(np.r_[True, (free[1:] != free[:-1]) | (shared[1:] != shared[:-1])])
            ends = np.r_[starts[1:], len(fp)]
            out: list[np.ndarray] = []
            first = (int(free[0]), int(shared[0])) if len(fp) else None
            if first is not None and last is not None and first != last:
                out += flush()
                held.clear()
            single = ends - starts == 1
            inner = np.zeros(len(starts), bool)
            inner[1:-1] = True
            for s, e in zip(starts[~(single & inner)], ends[~(single & inner)], strict=True):
                key = (int(free[s]), int(shared[s]))
                if last is not None and key != last and held:
                    out += flush()
                    held.clear()
                last = key
                held.append(fp[s:e])
            if out:
                links = np.concatenate(out)
                yield pd.DataFrame({"a": links[:, 0], "b": links[:, 1]})
        if held and (rest := flush()):
            yield pd.DataFrame({"a": rest[0][:, 0], "b": rest[0][:, 1]})

    return postings.mapInPandas(meet, "a long, b long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2) -> DataFrame:
    """(id, fp, component_id): the smallest id reachable over links of at most `radius` differing bits, itself included.

    NULL, empty and blank texts have fingerprint 0 and link like any other. A NULL id is a row like any other, though it is
    never the smallest id unless all ids of its group are NULL. Repeated rows stay repeated. No row, list or pair is capped.
    """
    rows = cut(fingerprints(docs, id_col, text_col, words))
    by_fp = cut(rows.groupBy("fp").agg(F.min("id").alias("least")))
    nodes = connected_components(near_links(by_fp.select("fp"), radius))
    labelled = by_fp.join(nodes, by_fp.fp == nodes.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("label"))
    least = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    lookup = labelled.join(least, "label").select("fp", "component_id")
    return rows.join(lookup, "fp").select("id", "fp", "component_id")


def hex_fingerprint(fp) -> object:
    """16 lowercase hex digits of a fingerprint column."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
