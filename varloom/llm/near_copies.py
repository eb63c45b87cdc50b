"""Near copies by Jaccard similarity of word shingles: candidates from bands of min-hashes, every link verified."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.llm.common import cut, releasing, written
from varloom.llm.components import connected_components
from varloom.llm.simhash import BLOCK, SEED, fingerprints, near_links

#: A pair of similarity s shares a band with probability 1 - (1 - s^ROWS)^BANDS: 0.99995 at 0.8.
BANDS, ROWS = 25, 5
#: Further heads that a list draws before its members meet by rare shingles.
STARS = 4
_draw = np.random.default_rng(SEED)
_FACTORS = _draw.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _draw.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """The distinct XXH64 (sorted) of the word shingles; a text of fewer words is one shingle, a blank one has none."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    parts = zip(*(tokens[i:] for i in range(words)), strict=False) if len(tokens) >= words else [tokens]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(b" ".join(s), SEED) for s in parts), np.uint64))


def min_hashes(hashes: np.ndarray) -> np.ndarray:
    """BANDS x ROWS min-hashes; those of a blank text are the largest number."""
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    step = max(1, BLOCK // 8)
    for at in range(0, len(hashes), step):
        least = np.minimum(least, (_FACTORS[:, None] * hashes[None, at : at + step] + _SHIFTS[:, None]).min(1))
    return least


def band_keys(least: np.ndarray) -> list[int]:
    """One key a band: the digest of its number and its ROWS min-hashes. Blank texts share all keys."""
    return [xxhash.xxh64_intdigest(row.tobytes(), n) - 2**63 for n, row in enumerate(least.reshape(BANDS, ROWS))]


def text_key(text: Column) -> Column:
    """The node of a text: 128 bits of its MD5; NULL counts as the empty text."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


_MARKS = [f"m{i}" for i in range(8)]
#: Places of a sketch that are always equal: 4 bits of each min-hash fill 8 x 16 places.
_SPARE = 16 * len(_MARKS) - BANDS * ROWS


def sketches_of(texts: DataFrame, words: int) -> DataFrame:
    """(node, n, keys, m0..m7): for each text the number of its shingles, its band keys, and 4 bits of each min-hash."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shifts = np.uint64(4) * np.arange(16, dtype=np.uint64)
        for batch in batches:
            n, keys, marks = [], [], []
            for text in batch["text"]:
                hashes = shingles(text.as_py(), words)
                least = min_hashes(hashes)
                n.append(len(hashes))
                keys.append(band_keys(least))
                bits = np.concatenate([least & np.uint64(15), np.zeros(_SPARE, np.uint64)]).reshape(len(_MARKS), 16)
                marks.append((bits << shifts).sum(1, dtype=np.uint64).view(np.int64))
            packed = np.array(marks, np.int64).reshape(len(n), len(_MARKS))
            columns = [batch["node"], pa.array(n, pa.int32()), pa.array(keys, pa.list_(pa.int64())), *[pa.array(packed[:, i]) for i in range(len(_MARKS))]]
            yield pa.RecordBatch.from_arrays(columns, ["node", "n", "keys", *_MARKS])

    return texts.select("node", "text").mapInArrow(releasing(sketch), "node binary, n int, keys array<bigint>, " + ", ".join(f"{m} bigint" for m in _MARKS))


def simhash_pairs(texts: DataFrame, words: int, radius: int = 2) -> DataFrame:
    """(a, b): pairs of the texts (node, text; a node may repeat), enough to connect all whose SimHash differs in at most `radius` bits: the inverted
    index and count filter of module simhash over distinct fingerprints, and the smallest node of each fingerprint against its others."""
    rows = written(fingerprints(texts, "node", "text", words).withColumnRenamed("id", "node").dropDuplicates(["node"]), "copy-fingerprints")
    heads = cut(rows.groupBy("fp").agg(F.min("node").alias("head")))
    same = rows.join(heads, "fp").where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    head = lambda x: heads.select(F.col("fp").alias(x), F.col("head").alias(f"h{x}"))
    near = near_links(heads.select("fp"), radius).join(head("a"), "a").join(head("b"), "b")
    return same.unionByName(near.select(F.least("ha", "hb").alias("a"), F.greatest("ha", "hb").alias("b"))).distinct()


def shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """(node, s): the distinct shingles of each text as sorted 64-bit hashes, packed."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["node"], pa.array([shingles(t.as_py(), words).tobytes() for t in batch["text"]], pa.binary())], ["node", "s"])

    return texts.select("node", "text").mapInArrow(releasing(pack), "node binary, s binary")


def alike(a: str, b: str, similar: float) -> Column:
    """Whether two sketches (columns of these suffixes) may be of texts of that similarity: sizes allow it, and enough places agree. A pair at `similar`
    agrees in fewer than its mean less 5.5 standard deviations with probability below 1e-7."""
    share = similar + (1 - similar) / 16
    places = BANDS * ROWS
    enough = share * places - 5.5 * (share * (1 - share) * places) ** 0.5 + _SPARE
    agree = F.lit(16 * len(_MARKS))
    for m in _MARKS:
        x = F.col(f"{m}{a}").bitwiseXOR(F.col(f"{m}{b}"))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(F.lit(0x1111111111111111))
        agree = agree - F.bit_count(x)
    return (F.least(f"n{a}", f"n{b}") >= F.lit(similar) * F.greatest(f"n{a}", f"n{b}") - 1e-6) & (agree >= F.lit(enough))


def _sided(rows: DataFrame, side: str, names: list[str]) -> DataFrame:
    return rows.select(*[F.col(c).alias(f"{c}{side}") if c in names else F.col(c) for c in rows.columns])


def verified(pairs: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """Those of the pairs (a, b) of nodes whose shingle sets (node, s) have a Jaccard similarity of `similar` or more."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch["sa"], batch["sb"], strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                shared = int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(x) else 0
                union = len(x) + len(y) - shared
                good.append(union == 0 or shared / union >= similar)
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    met = pairs.join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b").join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a")
    return met.select("a", "b", "sa", "sb").mapInArrow(releasing(compare), "a binary, b binary")


def rare_prefixes(apart: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """(h, left, node, lab, ...): for each node of apart (node, lab, n, ...) the rarest of its shingles, as many as two similar sets cannot both miss.

    Rare means in few labels. A shingle of one label alone links nothing and is not kept, but counts as one of the rarest, so a text with enough words of its own
    has no row at all, however much boilerplate it shares. Two sets of a similarity t share one of the n - ceil(t n) + 1 first of each, in any
    common order; so no similar pair is lost. left is the number of the text's shingles from h on, in the order of rarity.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(s.as_buffer()) // 8 for s in batch["s"]]
            hashes = np.frombuffer(b"".join(s.as_py() for s in batch["s"]), np.int64)
            for at in range(0, len(hashes), 1 << 16):
                row = np.repeat(np.arange(len(sizes)), sizes)[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(hashes[at : at + (1 << 16)]), batch["num"].take(pa.array(row)), batch["lab"].take(pa.array(row))], ["h", "num", "lab"])

    each = apart.join(sets, "node").select("num", "lab", "s").mapInArrow(releasing(spread), "h long, num long, lab long").repartition("h")
    few = each.groupBy("h", "lab").agg(F.count("*").alias("c")).groupBy("h").agg(F.count("*").alias("f")).where("f > 1")
    mixed = each.join(few, "h").groupBy("num").agg(F.array_sort(F.collect_list(F.struct("f", "h"))).alias("hs"))  # no longer than its text
    own = F.col("n") - F.size("hs")
    room = F.col("n") - F.ceil(F.lit(similar) * F.col("n") - 1e-9) + 1 - own
    first = apart.join(mixed, "num").withColumns({"__room": room.cast("int"), "own": own}).where("__room > 0")
    each = first.select("*", F.posexplode(F.slice("hs", 1, F.col("__room"))).alias("__pos", "__h"))
    return each.select(F.col("__h.h").alias("h"), (F.col("n") - F.col("own") - F.col("__pos")).alias("left"), *apart.columns)


def prefix_pairs(prefixes: DataFrame, similar: float) -> DataFrame:
    """(a, b): pairs of different labels that share a rare shingle and whose sketches allow the similarity. Labels meet first and then their nodes, so
    that the nodes of one label, a group of copies of any size, are never paired with each other. They meet by shingle and class of size: two sets of
    a similarity t differ in size by a factor of 1/t at most, so they lie in one class of that width or in neighbouring ones, and texts of
    other sizes that share a passage never meet. The first shingle that two sets share, in the order of rarity, has all others that they share
    behind it; where too few are left in either for the similarity, it is not the first or they are not similar, and they do not meet there. Labels
    are turned away by the fewest shingles and the most that are left of any of their nodes."""
    size = F.floor(F.log(F.col("n").cast("double")) / F.lit(max(-math.log(similar), 1e-6)) + F.lit(1e-9)).cast("int")
    sized = prefixes.withColumn("size", size)
    enough = lambda left_a, left_b, na, nb: F.least(left_a, left_b) >= F.lit(similar / (1 + similar)) * (F.col(na) + F.col(nb)) - 1e-6
    reach = lambda x: sized.groupBy("h", F.col("lab").alias(f"l{x}"), F.col("size").alias(f"size{x}")).agg(F.min("n").alias(f"lo{x}"), F.max("left").alias(f"most{x}"))
    near = reach("b").withColumn("sizea", F.explode(F.array(*[F.col("sizeb") + i for i in (-1, 0, 1)])))
    met = reach("a").join(near, ["h", "sizea"]).where((F.col("la") < F.col("lb")) & enough("mosta", "mostb", "loa", "lob"))
    met = met.select("h", "la", "sizea", "lb", "sizeb", "lob", "mostb")
    sides = {x: _sided(sized.select("h", F.col("lab").alias(f"l{x}"), F.col("node").alias(x), "size", "n", "left", *_MARKS), x, ["size", "n", "left", *_MARKS]) for x in "ab"}
    ones = met.join(sides["a"], ["h", "la", "sizea"]).where(enough("lefta", "mostb", "na", "lob")).drop("lob", "mostb")
    pairs = ones.join(sides["b"], ["h", "lb", "sizeb"]).where(enough("lefta", "leftb", "na", "nb") & alike("a", "b", similar))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def star_pairs(labelled: DataFrame, turns: int) -> DataFrame:
    """(a, b): in each list of labelled (key, node, label) that holds more than one label, the nodes that each turn's hash puts first against the nodes
    of other labels; never more pairs than rows a turn."""
    heads = F.array(*[F.min_by(F.struct("node", "label"), F.xxhash64("node", "key", F.lit(turn))) for turn in range(turns)])
    mixed = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), heads.alias("heads")).where("lo <> hi")
    met = labelled.join(mixed.select("key", F.explode(F.array_distinct("heads")).alias("head")), "key").where("label <> head.label")
    return met.select(F.least("head.node", "node").alias("a"), F.greatest("head.node", "node").alias("b")).distinct()


def joined_labels(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) as connected_components gives it, of the links of labels (node, component) and the links (a, b) together. Only the links
    between different components are followed, so that later links cost what they join and not what was joined before."""
    of = lambda x: labels.select(F.col("node").alias(x), F.col("component").alias(f"l{x}"))
    across = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    over = written(connected_components(across), "copy-joined")
    moved = labels.withColumnRenamed("component", "was").join(over.select(F.col("node").alias("was"), F.col("component").alias("now")), "was", "left")
    return written(moved.select("node", F.coalesce("now", "was").alias("component")).unionByName(over.join(labels, "node", "left_anti")), "copy-labels")


def similar_links(texts: DataFrame, words: int = 5, similar: float = 0.8) -> DataFrame:
    """(a, b): verified links between the texts (node, text; a node may repeat), enough to connect what the pairs that share a band connect."""
    _, *found = _joined(texts, words, similar)
    return found[0].unionByName(found[1]).unionByName(found[2])


def similar_groups(texts: DataFrame, words: int = 5, similar: float = 0.8) -> DataFrame:
    """(node, component): the connected components of similar_links, for every node that has a link."""
    labels, _, _, last = _joined(texts, words, similar)
    return joined_labels(labels, last)


def _joined(texts: DataFrame, words: int, similar: float) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The components of the first two tables of links, and three tables of links, the last of which is not followed yet.

    Pairs of near fingerprints come first (SimHash, simhash_pairs) and are verified like all others. A similarity of 0.8 leaves about ten of 64 bits
    apart, which no index of fingerprints reaches; the pairs that SimHash so misses are found by bands of min-hashes.
    Every member of a band's list is first compared with the list's smallest node: a large group of copies is connected by one comparison a
    member. Groups whose members are only just similar need more heads: each list draws up to STARS others, which the members of
    other components are compared with. That takes links early and changes no result.
    Lists whose members this leaves in different components are not compared pair by pair: their nodes meet only where they share
    one of their rarest shingles, which every similar pair does, so the work is bounded by what texts truly have in common, not
    by the length of the lists. Of the pairs that meet, those whose sizes and min-hashes allow the similarity are verified by their shingles.
    """
    sketches = written(sketches_of(texts, words).dropDuplicates(["node"]), "copy-sketches")
    postings = sketches.select("node", F.explode("keys").alias("key"))
    lists = postings.groupBy("key").agg(F.min("node").alias("head"), F.max("node").alias("last")).where("head <> last").select("key", "head")
    members = written(postings.join(lists, "key"), "copy-members")
    near = written(simhash_pairs(texts, words), "copy-simhash")
    asked = members.select("node").unionByName(near.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    marks = sketches.select("node", "n", *_MARKS).join(asked, "node", "left_semi")
    marks = written(marks, "copy-marks")
    sets = written(shingle_sets(texts.join(marks.select("node"), "node", "left_semi").dropDuplicates(["node"]), words), "copy-sets")
    sides = {x: _sided(marks.withColumnRenamed("node", x), x, ["n", *_MARKS]) for x in "ab"}
    allowed = lambda pairs: pairs.join(sides["b"], "b").join(sides["a"], "a").where(alike("a", "b", similar)).select("a", "b")
    stars = members.where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b")).unionByName(near).distinct()
    links = written(verified(allowed(stars), sets, similar), "copy-links")
    labels = written(connected_components(links), "copy-labels")
    label = lambda: written(members.join(labels, "node", "left").select("key", "node", F.coalesce("component", "node").alias("label")), "copy-labelled")
    labelled, more = label(), links.limit(0)
    if STARS:
        more = written(verified(allowed(star_pairs(labelled, STARS)), sets, similar), "copy-links")
        labels = joined_labels(labels, more)
        labelled = label()
    mixed = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
    apart = labelled.join(mixed, "key", "left_semi").select("node", "label").distinct().join(marks, "node")
    apart = written(apart.withColumn("num", F.monotonically_increasing_id()), "copy-apart")
    apart = written(apart.join(apart.groupBy("label").agg(F.min("num").alias("lab")), "label").drop("label"), "copy-apart")
    rest = written(prefix_pairs(rare_prefixes(apart, sets, similar), similar), "copy-rest")
    return labels, links, more, verified(rest, sets, similar)


def keep_one_of_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similar: float = 0.8) -> DataFrame:
    """docs with one document of each group of similar texts, the one with the smallest id, NULL last (columns unchanged).

    Groups are the connected components of the links of similar_links (SimHash retrieves, MinHash bands what it misses; all links are verified). A row is judged by its id and text together, so that other
    texts of the same id stay; rows equal in both stay repeated. Texts are told apart by 128 bits of their MD5.
    """
    rows = docs.withColumn("__node", text_key(F.col(text_col)))
    place = F.struct(F.col(id_col).isNull().alias("no"), F.col(id_col).alias("id"), F.col("__node").alias("node"))
    nodes = similar_groups(rows.select(F.col("__node").alias("node"), F.col(text_col).alias("text")), words, similar)
    by_node = rows.select("__node", place.alias("p")).groupBy("__node").agg(F.min("p").alias("lo"), F.max("p").alias("hi"))
    found = by_node.join(nodes, F.col("__node") == F.col("node"), "left").where("component IS NOT NULL OR lo <> hi")
    found = cut(found.select("__node", F.coalesce("component", "__node").alias("label"), "lo"))
    best = found.groupBy("label").agg(F.min("lo").alias("best"))
    verdict = found.join(best, "label").select(F.col("__node").alias("__judged"), "best")
    kept = rows.join(verdict, F.col("__node") == F.col("__judged"), "left").where(F.col("__judged").isNull() | (F.col("best") == place))
    return kept.select(*docs.columns)
