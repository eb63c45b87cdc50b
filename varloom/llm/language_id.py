"""Language identification by prediction by partial matching."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.llm.common import first_by_hash, remainder, written

ORDER = 3
ASCII_LETTER = re.compile("[A-Za-z]")
#: What stands before a text, as context only.
LEAD = b" " * ORDER
#: Sampled ids that may be broadcast; more are joined.
BROADCAST_IDS = 1_000_000
#: Bytes taken at a time, so that a very long text needs bounded memory.
BLOCK = 1 << 20


def has_letter(text: str | None) -> bool:
    """Whether any character is a letter (Unicode category L)."""
    return bool(text) and (ASCII_LETTER.search(text) is not None or any(map(str.isalpha, text)))


def flat_bytes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes, A-Z lower-cased, each after LEAD; and where each text begins, the end last."""
    parts = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    starts = np.cumsum([0, *(len(p) + ORDER for p in parts)]) + ORDER
    return np.frombuffer(b"".join([LEAD + p for p in parts]), np.uint8), starts


def keys_of(flat: np.ndarray, at: int, to: int) -> np.ndarray:
    """The last ORDER bytes and the byte itself, packed, of the bytes from at to before to."""
    key = np.zeros(to - at, np.int64)
    for d in range(ORDER, -1, -1):
        key = (key << 8) | flat[at - d : to - d]
    return key


@dataclass
class Tree:
    """One language's frozen tree. For each depth the sorted contexts with their escape costs, and the sorted (context, byte)
    pairs that were seen with their code lengths, in bits. Nothing that was counted is left out."""

    contexts: list[np.ndarray]
    escape: list[np.ndarray]
    pairs: list[np.ndarray]
    bits: list[np.ndarray]

    @classmethod
    def of(cls, counts: pd.DataFrame) -> Tree:
        """From (depth, pair, n). Method C: a new byte is as likely as there were kinds of bytes, and the shorter context shares
        that out among the bytes not seen here; where all 256 were seen nothing is shared."""
        tree = cls([], [], [], [])
        for depth in range(ORDER + 1):
            own = counts[counts["depth"] == depth].sort_values("pair")
            pair, n = own["pair"].to_numpy(np.int64), own["n"].to_numpy(np.float64)
            contexts, place, kinds = np.unique(pair >> 8, return_inverse=True, return_counts=True)
            total = np.bincount(place, weights=n, minlength=len(contexts))
            if depth == 0:
                below = np.full(len(pair), 1 / 256)
            else:
                shorter = ((pair >> 8) & ((1 << (8 * (depth - 1))) - 1)) << 8 | (pair & 255)
                below = np.exp2(-tree.bits[-1][np.searchsorted(tree.pairs[-1], shorter)])
            left = np.maximum(1e-15, 1 - np.bincount(place, weights=below, minlength=len(contexts)))
            full = kinds == 256
            escape = np.where(full, 0.0, kinds / (total + kinds))
            tree.contexts.append(contexts)
            tree.escape.append(np.where(full, np.inf, -np.log2(np.where(full, 1.0, escape / left))))
            tree.pairs.append(pair)
            tree.bits.append(-np.log2(n / total[place] * (1 - escape[place])))
        return tree

    def code_lengths(self, keys: np.ndarray) -> np.ndarray:
        """Bits of each byte in its context, down from the longest context."""
        cost, todo = np.zeros(len(keys)), np.arange(len(keys))
        for depth in range(ORDER, -1, -1):
            if not len(self.pairs[depth]):
                continue
            pair = keys[todo] & ((1 << (8 * (depth + 1))) - 1)
            at = np.minimum(np.searchsorted(self.pairs[depth], pair), len(self.pairs[depth]) - 1)
            seen = self.pairs[depth][at] == pair
            cost[todo[seen]] += self.bits[depth][at[seen]]
            todo, context = todo[~seen], pair[~seen] >> 8
            at = np.minimum(np.searchsorted(self.contexts[depth], context), len(self.contexts[depth]) - 1)
            known = self.contexts[depth][at] == context
            cost[todo[known]] += self.escape[depth][at[known]]
        cost[todo] += 8.0
        return cost


@dataclass
class PpmModel:
    """Some languages' trees, and a table of the code lengths of every (context, byte) that any of them has seen."""

    languages: list[str]
    trees: list[Tree]

    def __post_init__(self):
        self.keys = np.unique(np.concatenate([t.pairs[ORDER] for t in self.trees]))
        self.table = self.lengths(self.keys)

    def lengths(self, keys: np.ndarray) -> np.ndarray:
        return np.stack([t.code_lengths(keys) for t in self.trees], 1)

    def totals(self, texts: list[str | None]) -> np.ndarray:
        """Bits that each language's tree needs for each whole text."""
        if not hasattr(self, "index"):
            self.index = pd.Index(self.keys)
        flat, starts = flat_bytes(texts)
        lead = np.zeros(len(flat) + ORDER, bool)
        for d in range(1, ORDER + 1):
            lead[starts - d] = True
        out = np.zeros((len(texts), len(self.trees)))
        for at in range(ORDER, len(flat), BLOCK):
            to = min(at + BLOCK, len(flat))
            keys = keys_of(flat, at, to)
            place = self.index.get_indexer(keys)
            cost = self.table[place]
            new = np.flatnonzero(place < 0)
            if len(new):
                distinct, back = np.unique(keys[new], return_inverse=True)
                cost[new] = self.lengths(distinct)[back]
            cost[lead[at:to]] = 0
            first, last = np.searchsorted(starts, at, "right") - 1, np.searchsorted(starts, to - 1, "right") - 1
            if last < len(texts):
                begins = np.maximum(0, starts[first : last + 1] - at)
                out[first : last + 1] += np.add.reduceat(cost, np.minimum(begins, to - at - 1)) * (begins < to - at)[:, None] if len(begins) > 1 else cost.sum(0)
        return out


def count_contexts(sample: DataFrame) -> DataFrame:
    """(lang, depth, pair, n) over the sample: how often each byte followed each context of 0 to ORDER bytes, the context and
    the byte packed in one number. Counted by block in the tasks and summed by Spark."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lang, texts in pdf.groupby("lang")["text"]:
                flat, starts = flat_bytes(list(texts))
                lead = np.zeros(len(flat) + ORDER, bool)
                for d in range(1, ORDER + 1):
                    lead[starts - d] = True
                for at in range(ORDER, len(flat), BLOCK):
                    to = min(at + BLOCK, len(flat))
                    keys = keys_of(flat, at, to)[~lead[at:to]]
                    for depth in range(ORDER + 1):
                        found, n = np.unique(keys & ((1 << (8 * (depth + 1))) - 1), return_counts=True)
                        yield pd.DataFrame({"lang": lang, "depth": depth, "pair": found, "n": n})

    counts = sample.select("lang", "text").mapInPandas(count, "lang string, depth int, pair long, n long")
    return counts.groupBy("lang", "depth", "pair").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, per_language: int = 300, table_mb: int = 64, id_col: str = "doc_id", text_col: str = "text") -> list[PpmModel]:
    """Learns one tree a language from at most per_language documents each (a documented bound, drawn by the hash of the id; rows
    that repeat an id count each); an empty list if no document names a language.

    Every language is learned, and of its sample every byte and every context. A model holds as many languages as a table of
    table_mb can serve, so many languages make several models, each of bounded size; predict() asks them all.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col(id_col).isNotNull() & (remainder(F.col(id_col), 5) != 0)).select(F.col(id_col).alias("id"), "lang")
    chosen = written(first_by_hash(labelled.distinct(), "lang", "id", per_language), "lang-chosen")
    # At most per_language ids a language; counted before they are sent to the scan of the texts.
    chosen = F.broadcast(chosen) if chosen.count() <= BROADCAST_IDS else chosen
    sample = written(docs.select(F.col(id_col).alias("id"), "lang", F.col(text_col).alias("text")).join(chosen, ["id", "lang"], "left_semi"), "lang-sample")
    counts = written(count_contexts(sample), "lang-contexts")
    sizes = {r["lang"]: r["n"] for r in counts.where(F.col("depth") == ORDER).groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    parts: list[list[str]] = []
    keys = 0
    for lang in sorted(sizes):
        if not parts or (keys + sizes[lang]) * 8 * (len(parts[-1]) + 1) > table_mb << 20:
            parts.append([])
            keys = 0
        parts[-1].append(lang)
        keys += sizes[lang]
    models = []
    for names in parts:
        rows = counts.where(F.col("lang").isin(names)).toArrow().to_pandas()
        models.append(PpmModel(names, [Tree.of(rows[rows["lang"] == lang]) for lang in names]))
    return models


def predict(docs: DataFrame, models: list[PpmModel], text_col: str = "text") -> DataFrame:
    """docs plus lang_pred and lang_score (the language's share if all were equally likely before) for every row.

    `und` with score 0 for NULL and empty texts, for texts without any letter (Unicode category L), and for all if no language
    was learned. Only the text is looked at. Ties go to the language that comes first by name. Rows with a NULL or repeated id
    are judged each for itself. Columns of docs with the new names are replaced.
    """
    named = docs.drop("lang_pred", "lang_score", *[f"__bits{i}" for i in range(len(models) + 1)])
    if not models:
        return named.withColumns({"lang_pred": F.lit("und"), "lang_score": F.lit(0.0)})
    judged = named
    for i, model in enumerate(models):
        judged = judged.withColumn(f"__bits{i}", _totals(docs, model)(F.col(text_col)))
        if i + 1 < len(models):
            judged = written(judged, "lang-bits")  # one model at a time in a worker's memory
    bits = F.concat(*[f"__bits{i}" for i in range(len(models))])
    least = F.array_min("__all")
    share = 1 / F.aggregate("__all", F.lit(0.0), lambda a, x: a + F.pow(F.lit(2.0), least - x))
    names = F.array(*[F.lit(n) for m in models for n in m.languages])
    judged = judged.withColumn("__all", bits).withColumns({"lang_pred": F.coalesce(F.get(names, F.array_position("__all", least).cast("int") - 1), F.lit("und")), "lang_score": F.coalesce(share, F.lit(0.0))})
    return judged.select(*named.columns, "lang_pred", "lang_score")


def _totals(docs: DataFrame, model: PpmModel):
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a table of at most table_mb and the trees behind it

    @F.pandas_udf("array<double>")
    def totals(texts: pd.Series) -> pd.Series:
        held = texts.tolist()
        out: list = [None] * len(held)
        asked = [i for i, t in enumerate(held) if has_letter(t)]
        if asked:
            for i, row in zip(asked, shared.value.totals([held[i] for i in asked]), strict=True):
                out[i] = row
        return pd.Series(out)

    return totals
