"""Mixing sources to target weights by iterative proportional fitting."""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.llm.common import written
from varloom.llm.topics import fit_vectors, place_column, vector_column

DIMENSIONS = ("source", "lang", "topic")

#: Up to so many cells are raked on the driver; more are raked as joins, in the same steps to the same rates.
DRIVER_CELLS = 500_000
#: Raking has settled when no marginal is further from its target than this share of all tokens. Targets that contradict each
#: other never settle: after so many sweeps a warning names the gap that is left.
TOLERANCE, SWEEPS = 1e-5, 2000


def n_words(text: Column) -> Column:
    """Blank-separated words of a text, the token measure of the mixture; 0 for NULL and blank texts."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^ \t\n\x0B\f\r]+")).cast("long")


def tempered(cells: DataFrame, dim: str, power: float) -> DataFrame:
    """Default target of a dimension: its token shares to the given power, scaled to the total of all tokens."""
    shares = cells.groupBy(dim).agg(F.sum("tokens").alias("t")).where("t > 0").withColumn("p", F.pow(F.col("t").cast("double"), F.lit(power)))
    total = shares.agg(F.sum("p").alias("sp"), F.sum("t").alias("st")).first()
    return shares.select(dim, (F.col("p") * F.lit(float(total["st"] or 0) / (total["sp"] or 1.0))).alias("target"))


def _unsettled(gap: float) -> None:
    warnings.warn(f"raking did not settle: a marginal is still {gap:.2g} of all tokens from its target; the targets contradict each other", stacklevel=3)


def rake(cells: DataFrame, targets: dict[str, DataFrame], sweeps: int | None = None, tolerance: float | None = None, start: float = 1.0, most: float = float("inf")) -> DataFrame:
    """cells (dimensions, tokens) with w: the factor that every token of the cell gets, from `start`, so that the sums of tokens x min(most, w)
    meet each dimension's targets (dimension, target): the steps of settle(), as joins.

    A sweep is a grouped sum and a join for each dimension over the cells alone, never over documents; its result is written
    to the shared folder. Sweeps go on until every marginal meets its target. Values without a target keep their weight, and cells
    of values without tokens too.
    """
    now = cells.withColumn("w", F.lit(float(start)))
    total = float(cells.agg(F.sum("tokens")).first()[0] or 1)
    gap = 0.0
    for _ in range(SWEEPS if sweeps is None else sweeps):
        gap = 0.0
        for dim, goal in targets.items():
            have = now.groupBy(dim).agg(F.sum(F.col("tokens") * F.least(F.col("w"), F.lit(float(most)))).alias("have"))
            factor = written(have.join(goal, dim).where("have > 0").select(dim, (F.col("target") / F.col("have")).alias("f"), F.abs(F.col("target") - F.col("have")).alias("off")), "mix-factor")
            gap = max(gap, float(factor.agg(F.max("off")).first()[0] or 0) / total)
            now = now.join(factor.drop("off"), dim, "left").withColumn("w", F.least(F.lit(1e12), F.greatest(F.lit(0.0), F.col("w") * F.coalesce("f", F.lit(1.0))))).drop("f")
        now = written(now, "mix-sweep")
        if gap <= (TOLERANCE if tolerance is None else tolerance):
            return now
    _unsettled(gap)
    return now


def reachable_targets(cells: DataFrame, dim: str, goal: DataFrame, budget: float) -> DataFrame:
    """reachable() as grouped sums: the targets of a dimension (dim, target) that `budget` of its goals can reach."""
    rows = written(cells.groupBy(dim).agg(F.sum("tokens").alias("have")).join(goal, dim).select(dim, F.col("target").alias("goal"), "have"), "mix-goals")
    sums = rows.agg(F.sum("goal").alias("g"), F.sum(F.when(F.col("goal") > 0, F.col("have"))).alias("h")).first()
    want, level, whole = min(budget * float(sums["g"] or 0), float(sums["h"] or 0)), 0.0, F.lit(False)
    while True:  # a level per round; each takes the values whole that have less than their share at the one before
        got = rows.agg(F.sum(F.when(whole, F.col("have"))).alias("taken"), F.sum(F.when(~whole, F.col("goal"))).alias("free")).first()
        level = max(0.0, want - float(got["taken"] or 0)) / float(got["free"]) if got["free"] else 0.0
        more = ~whole & (F.col("goal") * F.lit(level) > F.col("have"))
        if not rows.where(more).take(1):
            return rows.select(dim, F.when(whole, F.col("have").cast("double")).otherwise(F.col("goal") * F.lit(level)).alias("target"))
        whole = F.col("goal") * F.lit(level) > F.col("have")


def joined_rates(cells: DataFrame, targets: dict[str, DataFrame], budget: float) -> DataFrame:
    """bounded_rates() for any number of cells: every step a grouped sum or a join over them."""
    free = rake(cells, targets)
    bounded = rake(cells, {dim: written(reachable_targets(cells, dim, goal, budget), "mix-reach") for dim, goal in targets.items()}, start=budget, most=1.0)
    rates = keep_rates(bounded, budget).drop("w")
    return rates.join(free.drop("tokens"), list(DIMENSIONS)).select(*cells.columns, "w", "rate")


def keep_rates(cells: DataFrame, budget: float) -> DataFrame:
    """cells with rate: the probability of each document, min(1, s x w), where s is solved for so that the expected tokens
    are `budget` of all tokens. Cells that reach 1 leave the rest of the budget to the others, which takes another round, until
    no further cell reaches it."""
    at_most = 0.0  # the weight from which a cell is kept whole; its place among the weights is all that a round changes
    scale = 0.0
    while True:
        full = F.lit(bool(at_most)) & (F.col("w") >= F.lit(at_most))
        got = cells.agg(
            F.sum("tokens").alias("all"),
            F.sum(F.when(full, F.col("tokens")).otherwise(0)).alias("spent"),
            F.sum(F.when(full, 0.0).otherwise(F.col("tokens") * F.col("w"))).alias("weighted"),
            F.max(F.when(~full & (F.col("tokens") > 0), F.col("w"))).alias("most"),
        ).first()
        scale = max(0.0, (got["all"] or 0) * budget - (got["spent"] or 0)) / (got["weighted"] or 1.0)
        if not scale or got["most"] is None or scale * got["most"] <= 1:
            break
        at_most = 1.0 / scale
    full = F.lit(bool(at_most)) & (F.col("w") >= F.lit(at_most))
    return cells.withColumn("rate", F.when(full, 1.0).otherwise(F.least(F.lit(1.0), F.lit(scale) * F.col("w"))))


def reachable(goal: np.ndarray, have: np.ndarray, budget: float) -> np.ndarray:
    """Targets of a dimension that sum to `budget` of its goals where no value is asked for more tokens than it has: values that
    cannot reach their share are taken whole, and the others share the rest in proportion to their goals."""
    want = min(budget * goal.sum(), have[goal > 0].sum())
    whole = np.zeros(len(goal), bool)
    while True:
        free = goal[~whole].sum()
        level = max(0.0, want - have[whole].sum()) / free if free else 0.0
        more = ~whole & (goal * level > have)
        if not more.any():
            return np.where(whole, have, goal * level)
        whole |= more


def settle(tokens: np.ndarray, codes: list[np.ndarray], goals: list[np.ndarray], start: float, most: float) -> np.ndarray:
    """Factors w of the cells, from `start`, so that the sums of tokens x min(most, w) meet the goals (NaN: none) of each
    dimension. A factor beyond the bound counts as the bound, so the other cells of its value take what it cannot give."""
    w = np.full(len(tokens), start)
    off = 0.0
    for _ in range(SWEEPS):
        off = 0.0
        for code, goal in zip(codes, goals, strict=True):
            have = np.bincount(code, tokens * np.minimum(w, most), len(goal))
            known = ~np.isnan(goal) & (have > 0)
            off = max(off, np.abs(have - goal)[known].max(initial=0.0))
            factor = np.divide(goal, have, out=np.ones(len(goal)), where=known)
            w = np.clip(w * factor[code], 0.0, 1e12)
        if off <= TOLERANCE * tokens.sum():
            return w
    _unsettled(off / max(1.0, tokens.sum()))
    return w


def bounded_rates(cells: DataFrame, targets: dict[str, DataFrame], budget: float) -> DataFrame:
    """On the driver, for few cells: cells with w, the factor of each cell by raking without a bound, and rate, its probability: raked again under the bound
    rate <= 1 to the targets that the budget can reach, then scaled so that the expected tokens are `budget` of all tokens."""
    held = cells.toPandas()
    tokens = held["tokens"].to_numpy(np.float64)
    codes, goals, bounded = [], [], []
    for dim, table in targets.items():
        code, values = pd.factorize(held[dim], use_na_sentinel=False)
        by = dict(table.select(dim, "target").collect())
        goal = np.array([by.get(v, np.nan) for v in values], np.float64)
        have = np.bincount(code, tokens, len(values))
        codes.append(code)
        goals.append(goal)
        bounded.append(np.where(np.isnan(goal), np.nan, reachable(np.nan_to_num(goal), have, budget)))
    held["w"] = settle(tokens, codes, goals, 1.0, np.inf)
    w = settle(tokens, codes, bounded, budget, 1.0)
    low, high = 0.0, 1e15
    for _ in range(200):
        middle = (low * high) ** 0.5 if low else high / 1e3
        if (tokens * np.minimum(1.0, w * middle)).sum() < budget * tokens.sum():
            low = middle
        else:
            high = middle
        if high < 1e-15 or (low and high / low < 1 + 1e-12):
            break
    held["rate"] = np.minimum(1.0, w * high)
    schema = cells.select("*", F.lit(0.0).alias("w"), F.lit(0.0).alias("rate")).schema
    # As an Arrow table, which the JVM reads itself: rows of pandas would start Python workers of another kind, which stay beside the others.
    return cells.sparkSession.createDataFrame(pa.Table.from_pandas(held, preserve_index=False), schema)


def uniform(doc_id: Column, seed: str = "mix") -> Column:
    """A number in [0, 1) from the md5 of the id: the draw is the same in every run and on every executor."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), doc_id.cast("string")).cast("binary")), 1, 12), 16, 10).cast("double") / F.lit(float(16**12))


def scaled(cells: DataFrame, dim: str, goal: DataFrame) -> DataFrame:
    """Targets in any unit, scaled so that they sum to the tokens of the values that have one; a value twice is an error."""
    have = cells.groupBy(dim).agg(F.sum("tokens").alias("tokens")).join(goal.groupBy(dim).agg(F.sum("target").alias("target"), F.count("*").alias("n")), dim)
    sums = have.agg(F.sum("tokens").alias("t"), F.sum("target").alias("g"), F.max("n").alias("n")).first()
    if (sums["n"] or 1) > 1:
        raise ValueError(f"a value of {dim} has two targets")
    if absent := [r[dim] for r in goal.join(have, dim, "left_anti").where("target > 0").select(dim).limit(5).collect()]:
        warnings.warn(f"no document has these values of {dim}, their targets are left out: {absent}", stacklevel=3)
    return have.select(dim, (F.col("target") * F.lit(float(sums["t"] or 0) / (sums["g"] or 1.0))).alias("target"))


def mix(
    docs: DataFrame,
    budget: float = 0.8,
    power: float = 0.7,
    targets: dict[str, DataFrame] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    topic_col: str | None = None,
    topics: int = 8,
    carry: list[str] | None = None,
) -> DataFrame:
    """docs plus mix_topic, mix_tokens, mix_weight, mix_rate, mix_kept (the draw without repeats) and mix_copies (with repeats).

    Token weights are raked to the marginals of source, language and topic, given as `targets` (a table of value and target
    for each dimension, in any unit: they are scaled to one total) or, by default, as the token shares to the power `power` (the
    hot source shrinks, small languages grow); a target of a value that no document has is left out, with a warning. The topic is topic_col where docs has
    one, else one of `topics` clusters over hashed word counts, learned from all documents (module topics). Every
    document of a cell is kept with the cell's probability, which is raked under the bound of 1: values that have fewer tokens
    than their share of the budget are kept whole. mix_copies, how often a document is taken if it may be taken repeatedly,
    meets the targets and the budget at once.

    NULL source, lang or topic, or a table without that column, is a value of its own, ''; NULL and empty texts have no tokens and are kept with their cell's
    probability; a NULL id is drawn as the text "null". Repeated rows share one draw. Columns of docs with the new names are
    replaced; `carry` names the columns to return, all by default. An empty table gives no rows. Texts are measured once: the
    columns to return and the measures are written, and cells and rates work on those. Nothing is capped: a cell that holds a
    third of all rows is only one row of the small table that joins back.
    """
    new = ("mix_topic", "mix_tokens", "mix_weight", "mix_rate", "mix_kept", "mix_copies")
    if topic_col is None:
        held = {"__place": place_column(id_col, text_col), "__vector": vector_column(F.col(text_col))}
    else:
        held = {"__topic": F.coalesce(F.col(topic_col).cast("string"), F.lit(""))}
    names = [c for c in (docs.columns if carry is None else carry) if c not in new]
    ids = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    value = lambda c: F.coalesce(F.col(c), F.lit("")) if c in docs.columns else F.lit("")
    measures = {"__source": value("source"), "__lang": value("lang"), **held, "__tokens": n_words(F.col(text_col)), "__draw": uniform(ids)}
    rows = written(docs.select(*names, *[c.alias(n) for n, c in measures.items()]), "mix-rows")
    if topic_col is None:
        model = fit_vectors(rows.select(F.col("__place").alias("place"), F.col("__lang").alias("lang"), F.col("__vector").alias("vector")), topics)
        rows = rows.withColumn("__topic", model.of_vectors(F.col("__vector"), F.col("__lang"))).drop("__place", "__vector")
    cells = written(rows.groupBy(F.col("__source").alias("source"), F.col("__lang").alias("lang"), F.col("__topic").alias("topic")).agg(F.sum("__tokens").alias("tokens")), "mix-cells")
    goals = {d: written(tempered(cells, d, power) if targets is None else scaled(cells, d, targets[d]), f"mix-{d}") for d in (DIMENSIONS if targets is None else targets)}
    few = cells.limit(DRIVER_CELLS + 1).count() <= DRIVER_CELLS
    rates = written((bounded_rates if few else joined_rates)(cells, goals, budget), "mix-rates")
    sums = rates.agg(F.sum("tokens").alias("t"), F.sum(F.col("tokens") * F.col("w")).alias("tw")).first()
    taken = F.col("mix_weight") * F.lit(budget * float(sums["t"] or 0) / (sums["tw"] or 1.0))
    # One row per (source, language, topic) that occurs: spark.sql.autoBroadcastJoinThreshold checks its size, else it shuffles.
    rates = rates.select(F.col("source").alias("__source"), F.col("lang").alias("__lang"), F.col("topic").alias("__topic"), F.col("w").alias("mix_weight"), F.col("rate").alias("mix_rate"))
    draw = F.col("__draw")
    copies = (F.floor(taken) + (draw < taken - F.floor(taken)).cast("long")).alias("mix_copies")
    joined = rows.join(rates, ["__source", "__lang", "__topic"])
    return joined.select(*names, F.col("__topic").alias("mix_topic"), F.col("__tokens").alias("mix_tokens"), "mix_weight", "mix_rate", (draw < F.col("mix_rate")).alias("mix_kept"), copies)


def report(mixed: DataFrame, power: float = 0.7) -> DataFrame:
    """(dimension, value, natural, target, kept, copied) of the output of mix with default targets: the shares of tokens of
    each value in the input, by target, among the kept documents, and among the documents taken as often as mix_copies says."""
    t = F.col("mix_tokens")
    sums = [F.sum(x).alias(n) for n, x in (("tokens", t), ("k", F.when(F.col("mix_kept"), t).otherwise(0)), ("c", t * F.col("mix_copies")))]
    cells = written(mixed.groupBy(F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"), F.col("mix_topic").alias("topic")).agg(*sums), "mix-report")
    total = cells.agg(*[F.sum(c).alias(c) for c in ("tokens", "k", "c")]).first()
    share = lambda column, n: (F.col(column) / F.lit(float(total[n] or 1))).alias
    out = None
    for dim in DIMENSIONS:
        by = cells.groupBy(dim).agg(*[F.sum(c).alias(c) for c in ("tokens", "k", "c")]).join(tempered(cells, dim, power), dim)
        rows = by.select(F.lit(dim).alias("dimension"), F.col(dim).alias("value"), share("tokens", "tokens")("natural"), share("target", "tokens")("target"), share("k", "k")("kept"), share("c", "c")("copied"))
        out = rows if out is None else out.unionByName(rows)
    return out
