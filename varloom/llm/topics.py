"""Topics of documents that have none: clusters over hashed word counts, learned from every document."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.llm.common import release, releasing, written

#: Documents among which the first centroids are sought at most, slots of a word vector, rounds of a fit, and searches of which the best starts it.
SAMPLE, SLOTS, ROUNDS, STARTS = 4000, 256, 25, 8
#: Sums over documents are taken of whole numbers, this many to one, so that their order does not matter; centroids that move less than MOVED have settled.
UNIT, MOVED = 1 << 24, 1e-4
#: Vectors of one language that a row holds while centroids are sought.
BLOCK = 256


class _Slots(dict):
    """The slot of each word; those of the first short words that a process meets are remembered."""

    def __missing__(self, word: str) -> int:
        slot = zlib.crc32(word.encode("utf-8", "surrogatepass")) % SLOTS
        if len(word) <= 32 and len(self) < 1 << 16:
            self[word] = slot
        return slot


_slots = _Slots()


def word_vector(text: str | None) -> np.ndarray:
    """log(1 + count) of the words of a whole text by slot, as 32-bit numbers hold it; nought for NULL and blank texts."""
    counts = Counter((text or "").lower().split())
    at = np.fromiter(map(_slots.__getitem__, counts), np.int64, len(counts))
    return np.log1p(np.bincount(at, np.fromiter(counts.values(), np.float64, len(counts)), SLOTS)).astype("<f4")


def vector_column(text: Column) -> Column:
    """The packed word vector of each text, by Arrow batches."""

    @F.pandas_udf("binary")
    def vector(texts: pd.Series) -> pd.Series:
        packed = pd.Series([word_vector(t).tobytes() for t in texts.where(texts.notna(), None)], dtype=object)
        release()
        return packed

    return vector(text)


def _unpacked(vectors: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), "<f4").reshape(len(vectors), SLOTS).astype(np.float64)


def _spherical_means(unit: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """At most k unit centroids of unit vectors; the next seed is drawn by its distance from those before."""
    centroids = unit[rng.integers(0, len(unit), 1)]
    while len(centroids) < min(k, len(unit)):
        far = np.maximum(0, 1 - (unit @ centroids.T).max(1))
        if far.sum() < 1e-9:
            break
        centroids = np.vstack([centroids, unit[rng.choice(len(unit), p=far / far.sum())]])
    for _ in range(ROUNDS):
        best = (unit @ centroids.T).argmax(1)
        moved = np.stack([unit[best == j].sum(0) if (best == j).any() else c for j, c in enumerate(centroids)])
        moved = moved / np.maximum(1e-12, np.linalg.norm(moved, axis=1, keepdims=True))
        if np.allclose(moved, centroids):
            break
        centroids = moved
    return centroids


class TopicModel:
    """Slot weights, the mean vector of each language, and unit centroids: what a language has in common is no topic."""

    def __init__(self, weights: np.ndarray, means: dict[str | None, np.ndarray], centroids: np.ndarray):
        self.weights, self.means, self.centroids = weights, means, centroids

    def residuals(self, vectors: np.ndarray, langs: list[str]) -> np.ndarray:
        return self._unit(vectors, np.stack([self.means.get(name, self.means[None]) for name in langs])) if len(vectors) else np.zeros((0, SLOTS))

    def _unit(self, vectors: np.ndarray, mean: np.ndarray) -> np.ndarray:
        """The weighted vectors less their mean (one for all, or one each) at length 1; 0 for those without words."""
        out = vectors * self.weights
        out -= mean
        out[vectors.max(1) <= 0] = 0
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=np.zeros_like(out), where=norm > 1e-9)

    def nearest(self, vectors: np.ndarray, langs: list[str]) -> list[str]:
        """t0, t1, ...: the nearest centroid; none for texts without words, or where nothing was learned."""
        if not len(self.centroids):
            return ["none"] * len(vectors)
        unit = self.residuals(vectors, langs)
        best = (unit @ self.centroids.T).round(9).argmax(1)
        return [f"t{k}" if v else "none" for k, v in zip(best, unit.any(1), strict=True)]

    def of_language(self, vectors: np.ndarray, lang: str) -> np.ndarray:
        """The residuals of vectors of one language."""
        return self._unit(vectors, self.means.get(lang, self.means[None]))

    def names(self, texts: list[str | None], langs: list[str]) -> list[str]:
        out: list[str] = []
        for at in range(0, len(texts), 500):
            out += self.nearest(np.stack([word_vector(t) for t in texts[at : at + 500]]).astype(np.float64), langs[at : at + 500])
        return out

    def column(self, text: Column, lang: Column) -> Column:
        """The topic of each row, by Arrow batches."""
        return self.of_vectors(vector_column(text), lang)

    def of_vectors(self, vector: Column, lang: Column) -> Column:
        """The topic of each row from its packed word vector. Not deterministic to the planner, which would else copy it into the null check of a join on it: a second
        Python worker for each task."""

        @F.pandas_udf("string")
        def topic(vectors: pd.Series, langs: pd.Series) -> pd.Series:
            held, names, out = vectors.tolist(), langs.tolist(), []
            for at in range(0, len(held), 2000):
                out += self.nearest(_unpacked(held[at : at + 2000]), names[at : at + 2000])
            return pd.Series(out, dtype=object)

        return topic.asNondeterministic()(vector, lang)


def _blocks(rows: DataFrame) -> DataFrame:
    """(lang, vectors): the vectors of rows, up to BLOCK of one language packed side by side, so that a round over all of them moves few rows."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        n = 0

        def flush(names: list[str]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([b"".join(held.pop(name)) for name in names], pa.binary())], ["lang", "vectors"])

        for batch in batches:
            for name, vector in zip(batch["lang"].to_pylist(), batch["vector"].to_pylist(), strict=True):
                own = held.setdefault(name, [])
                own.append(vector)
                n += 1
                if len(own) == BLOCK:
                    n -= BLOCK
                    yield flush([name])
                elif n == 32 * BLOCK:  # of many languages
                    n = 0
                    yield flush(list(held))
        if held:
            yield flush(list(held))

    # Small row groups, so that a reader has few blocks in hand.
    return written(rows.select("lang", "vector").mapInArrow(releasing(pack), "lang string, vectors binary"), "topic-blocks", {"parquet.block.size": str(8 << 20)})


def _summed(blocks: DataFrame, add) -> dict[str, tuple[int, np.ndarray]]:
    """For each name the count and the sums of whole numbers that add(vectors, lang) gives as (name, n, numbers) for each block: summed inside tasks,
    then by Spark. A name is a language or a centroid, so what comes back is a few hundred numbers for each."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for batch in batches:
            for lang, packed in zip(batch["lang"], batch["vectors"], strict=True):
                vectors = np.frombuffer(packed.as_buffer(), "<f4").reshape(-1, SLOTS).astype(np.float64)
                for name, n, numbers in add(vectors, lang.as_py()):
                    if name in held:
                        held[name][0] += n
                        held[name][1] += numbers
                    else:
                        held[name] = [n, numbers.astype(np.int64)]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array([n for n, _ in held.values()], pa.int64()), pa.array([x.tolist() for _, x in held.values()], pa.list_(pa.int64()))], ["name", "n", "sums"])

    each = blocks.mapInArrow(releasing(partial), "name string, n long, sums array<long>").select("name", "n", F.posexplode("sums").alias("at", "x"))
    found: dict[str, dict[int, int]] = {}
    counts: dict[str, int] = {}
    for name, at, n, x in each.groupBy("name", "at").agg(F.sum("n"), F.sum("x")).collect():
        found.setdefault(name, {})[at] = x
        counts[name] = n
    return {name: (counts[name], np.array([x for _, x in sorted(xs.items())], np.int64)) for name, xs in found.items()}


def fit_vectors(rows: DataFrame, topics: int = 8, sample: int = SAMPLE) -> TopicModel:
    """A model of `topics` clusters from all rows (place, lang, vector), which must be written; their vectors are packed into blocks, which are read once a round.

    Slot weights, the mean of each language and the centroids are counts and means over every row. Only where the search begins is taken
    from `sample` rows, those with the smallest place: spherical means of them, the best of STARTS, are the first centroids, and then every
    round assigns all rows and moves the centroids to the means of theirs, until they have settled. Sums are of whole numbers, so the model is
    the same on every partitioning. To the driver come SLOTS numbers a language and centroid, and the sample's vectors.
    """

    def spread(vectors: np.ndarray, lang: str) -> list:
        return [(lang, len(vectors), np.r_[np.rint(vectors * UNIT).astype(np.int64).sum(0), (vectors > 0).sum(0)])]

    rows = rows.select("place", "lang", "vector")
    blocks = _blocks(rows)
    found = _summed(blocks, spread)
    n = sum(c for c, _ in found.values())
    if not n:
        return TopicModel(np.ones(SLOTS), {None: np.zeros(SLOTS)}, np.zeros((0, SLOTS)))
    total = sum(x for _, x in found.values())
    weights = np.log((1 + n) / (1 + total[SLOTS:])) + 1
    means: dict[str | None, np.ndarray] = {name: x[:SLOTS] / UNIT / c * weights for name, (c, x) in found.items()}
    means[None] = total[:SLOTS] / UNIT / n * weights
    model = TopicModel(weights, means, np.zeros((0, SLOTS)))
    share = min(1.0, (1.25 * sample + 100) / n)
    few = rows.where(F.col("place") <= F.lit(share * 2.0**64 - 2.0**63)).orderBy("place", "lang", "vector").limit(sample).collect()
    unit = model.residuals(_unpacked([bytes(r["vector"]) for r in few]), [r["lang"] for r in few])
    unit = unit[unit.any(1)]
    rng = np.random.default_rng(3)
    fits = [_spherical_means(unit, topics, rng) for _ in range(STARTS if len(unit) else 0)]
    model.centroids = max(fits, key=lambda c: float((unit @ c.T).max(1).sum()), default=np.zeros((0, SLOTS)))
    for _ in range(ROUNDS if len(model.centroids) else 0):

        def assigned(vectors: np.ndarray, lang: str, model: TopicModel = model) -> list:
            unit = model.of_language(vectors, lang)
            best = (unit @ model.centroids.T).round(9).argmax(1)
            unit *= UNIT
            mine = best == np.arange(len(model.centroids))[:, None]
            # Whole numbers below 2^24, BLOCK of them to a sum: exact as products of floats. Rows without words are noughts.
            sums = (mine.astype(np.float64) @ np.rint(unit, out=unit)).astype(np.int64)
            return [(str(k), int(n), sums[k]) for k, n in enumerate(mine.sum(1)) if n]

        sums = _summed(blocks, assigned)
        moved = np.stack([sums[str(k)][1] / UNIT if str(k) in sums else c for k, c in enumerate(model.centroids)])
        norm = np.linalg.norm(moved, axis=1, keepdims=True)
        moved = np.where(norm > 1e-9, moved / np.maximum(1e-12, norm), model.centroids)
        settled = np.abs(moved - model.centroids).max() <= MOVED
        model = TopicModel(weights, means, moved)
        if settled:
            break
    return model


def place_column(id_col: str, text_col: str) -> Column:
    """The hash of id and length that orders documents the same on every partitioning."""
    return F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.octet_length(F.coalesce(F.col(text_col), F.lit(""))))


def fit_topics(docs: DataFrame, topics: int = 8, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> TopicModel:
    """fit_vectors of the word vectors of all documents. NULL languages are a language of their own; an empty table gives a model that names
    every text none."""
    lang = F.coalesce(F.col(lang_col), F.lit("")).alias("lang")
    return fit_vectors(written(docs.select(place_column(id_col, text_col).alias("place"), lang, vector_column(F.col(text_col)).alias("vector")), "topic-vectors"), topics, sample)
