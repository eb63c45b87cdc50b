"""Toxicity by maximum-scoring segments over token log-odds."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.llm.common import cut, first_by_hash, release, remainder, written

WORD = re.compile(r"[^\W\d_]+")
#: Characters of a word's stem, whose statistics are the prior of the word's own.
STEM = 4


def all_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """Every maximal scoring segment (start, end, sum) in linear time, as Ruzzo and Tompa define them.

    Only positive tokens start work; what lies between them enters through the running sum.
    """
    at = np.flatnonzero(scores > 0)
    if not len(at):
        return []
    total = np.concatenate([[0.0], np.cumsum(scores)])
    left: list[float] = []  # running sum before each candidate
    right: list[float] = []  # running sum after it
    spans: list[tuple[int, int]] = []
    link: list[int] = []  # the nearest earlier candidate with a smaller left sum
    for i in at.tolist():
        lo, hi, start = float(total[i]), float(total[i + 1]), i
        while True:
            j = len(left) - 1
            while j >= 0 and left[j] >= lo:
                j = link[j]
            if j < 0 or right[j] >= hi:
                left.append(lo)
                right.append(hi)
                spans.append((start, i + 1))
                link.append(j)
                break
            lo, start = left[j], spans[j][0]
            del left[j:], right[j:], spans[j:], link[j:]
    return [(s, e, r - lo) for (s, e), lo, r in zip(spans, left, right, strict=True)]


@dataclass
class ToxicityModel:
    """word and stem: log-odds of toxic against clean use; drift: what every token loses, so that the mean score is negative;
    scale, ln_k: of the extreme-value law of the best segment of clean text; slope, bias: of the final calibration."""

    word: dict[str, float]
    stem: dict[str, float]
    drift: float
    scale: float = 1.0
    ln_k: float = 0.0
    slope: float = 1.0
    bias: float = 0.0

    def token_scores(self, text: str | None) -> tuple[list[str], np.ndarray]:
        tokens = WORD.findall(text.lower()) if text else []
        word, stem = self.word, self.stem
        odds = [word[t] if t in word else stem.get(t[:STEM], 0.0) for t in tokens]
        return tokens, np.array(odds, float) - self.drift

    def evidence(self, text: str | None) -> tuple[float, int, list[tuple[int, int, float]]]:
        """Normalised score of the significant segments, their number, and the segments (token span, E-value)."""
        tokens, scores = self.token_scores(text)
        m = max(1, len(tokens))
        ln_km = max(0.0, self.ln_k + math.log(m))  # short texts leave no room for the asymptotic law: a score is then taken as it is
        segments = sorted(((s, e, self.scale * x - ln_km) for s, e, x in all_segments(scores)), key=lambda x: -x[2])
        best = [x for x in segments if x[2] > 0]  # fewer than one such segment is expected in clean text of this length
        # Karlin and Altschul's sum statistic: each further segment adds its normalised score, less what the choice costs.
        total = segments[0][2] if segments else -ln_km
        for r, x in enumerate(best[1:], 2):
            total += max(0.0, x[2] - math.log(r))
        return total, len(best), [(s, e, math.exp(min(50.0, -x))) for s, e, x in best]

    def score(self, text: str | None) -> tuple[float, int]:
        total, n, _ = self.evidence(text)
        z = self.slope * max(-60.0, min(60.0, total)) + self.bias
        return 1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, z)))), n


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, y, text): at most per_class documents of each label; ids with contradicting labels count as toxic, ids with several
    texts are learned from the first of them in order, and repeated rows once.

    The sample is bounded (2 x per_class ids, a documented parameter), so its ids may be broadcast to the scan of docs.
    """
    marks = labels.where(F.col("toxic").isin(0, 1) & F.col(id_col).isNotNull() & (remainder(F.col(id_col), 4) != 2))
    marks = marks.groupBy(F.col(id_col).alias("id")).agg(F.max("toxic").cast("int").alias("y"))
    chosen = first_by_hash(marks, "y", "id", per_class)
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    return found.groupBy("id").agg(F.max("y").alias("y"), F.min("text").alias("text"))


def _odds(t, c, prior_t, prior_c, shift: float):
    """Log-odds of toxic against clean use under Dirichlet pseudo-counts, drawn in to the nearer end of its 97 % interval:
    a word seen a few times tells nothing yet, and of many words some differ by chance."""
    a, b = t + prior_t, c + prior_c
    odds = np.log(a / b) + shift
    return np.sign(odds) * np.maximum(0.0, np.abs(odds) - 2.2 * np.sqrt(1 / a + 1 / b))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 3000, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel | None:
    """Learns from a bounded sample; None where a class has no labelled document.

    A word counts once a document. Its Dirichlet prior is what its stem shows, and the stem's is even between the classes.
    Counting runs in Spark; the driver receives the words and stems of the sample, all of them, and the 2 x per_class numbers
    that the calibration needs: what the bounded sample holds, whatever the corpus.
    """
    sample = written(labelled_sample(docs, labels, per_class, id_col, text_col), "toxic-sample")

    @F.pandas_udf("array<string>")
    def words(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: list(dict.fromkeys(WORD.findall(t.lower()))) if t else [])

    tokens = sample.select("y", F.explode(words("text")).alias("w"))
    counts = cut(tokens.groupBy("w").agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("c")))
    stems = tokens_of_stems(sample, words)
    n = counts.agg(F.sum("t").alias("t"), F.sum("c").alias("c")).first()
    if not n["t"] or not n["c"]:
        return None
    top, top_stems = counts.toArrow().to_pandas().sort_values("w"), stems.toArrow().to_pandas().sort_values("w")
    shift = math.log(n["c"] / n["t"])  # by words, as toxic documents may be longer or shorter than others
    stem_t, stem_c = top_stems.t.to_numpy(float), top_stems.c.to_numpy(float)
    stem = dict(zip(top_stems.w, _odds(stem_t, stem_c, 0.5, 0.5, shift).tolist(), strict=True))
    share = dict(zip(top_stems.w, ((stem_t + 0.5) / (stem_t + stem_c + 1)).tolist(), strict=True))
    even = np.array([share.get(w[:STEM], 0.5) for w in top.w])
    prior = np.clip(even, 0.4, 0.6)
    odds = _odds(top.t.to_numpy(float), top.c.to_numpy(float), prior, 1 - prior, shift)
    # Where the word's own counts don't speak against it, it is worth at least what its stem is.
    odds = np.where(odds >= 0, np.maximum(odds, [stem.get(w[:STEM], 0.0) for w in top.w]), odds)
    model = ToxicityModel(dict(zip(top.w, np.maximum(odds, -1.0).tolist(), strict=True)), stem, drift=1.0)
    model.scale = _scale(np.maximum(odds, -1.0) - model.drift, top.c.to_numpy(float))
    return calibrate(model, sample)


def _scale(scores: np.ndarray, weight: np.ndarray, most: float = 2.0) -> float:
    """Karlin and Altschul's scale: the positive root of mean(exp(scale x score)) = 1 over clean tokens, by bisection."""
    p = weight / weight.sum()
    low, high = 0.0, most
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if float(p @ np.exp(mid * scores)) < 1 else (low, mid)
    return max(0.1, low)


def tokens_of_stems(sample: DataFrame, words) -> DataFrame:
    """(w, t, c): for each stem the toxic and clean documents of the sample that hold it."""
    stems = F.array_distinct(F.transform(words("text"), lambda w: F.substring(w, 1, STEM)))
    rows = sample.select("y", F.explode(stems).alias("w"))
    return rows.groupBy("w").agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("c"))


def calibrate(model: ToxicityModel, sample: DataFrame) -> ToxicityModel:
    """Fits the extreme-value law on the clean documents of the sample, then the map of evidence to a probability."""
    plain = model

    @F.pandas_udf("best double, tokens long")
    def best(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            tokens, scores = plain.token_scores(t)
            rows.append((max((x for _, _, x in all_segments(scores)), default=0.0), max(1, len(tokens))))
        return pd.DataFrame(rows, columns=["best", "tokens"])

    clean = sample.where("y = 0").select(best("text").alias("b")).select("b.*").toPandas()
    # Extreme-value law of the best segment, P(best < x) = exp(-k m exp(-scale x)): scale was solved for by fit(), k by likelihood.
    model.ln_k = math.log(max(1, len(clean)) / max(1e-300, float(np.sum(clean.tokens * np.exp(-model.scale * clean.best)))))
    judged = model

    @F.pandas_udf("double")
    def evidence(texts: pd.Series) -> pd.Series:
        return pd.Series([judged.evidence(t)[0] for t in texts], dtype=float)

    rows = sample.select("y", evidence("text").alias("x")).toPandas()
    x, y = np.clip(rows.x.to_numpy(float), -60, 60), rows.y.to_numpy(float)
    # Ridge logistic regression on one number by Newton steps; toxic documents weigh a tenth of all, whatever the sample holds.
    weight = np.where(y == 1, 0.1 / max(1.0, y.sum()), 0.9 / max(1.0, (1 - y).sum())) * len(y)
    w, b = 0.5, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(w * x + b, -500, 500)))
        g, h = weight * (p - y), weight * np.maximum(p * (1 - p), 1e-6)
        grad = np.array([(g * x).sum() + 0.1 * (w - 0.5), g.sum() + 0.1 * b])
        hess = np.array([[(h * x * x).sum() + 0.1, (h * x).sum()], [(h * x).sum(), h.sum() + 0.1]])
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 1.0 / max(1e-9, float(np.abs(step).max())))
        w, b = w - step[0], b - step[1]
    model.slope, model.bias = max(1e-3, float(w)), float(b)
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel | None, text_col: str = "text") -> DataFrame:
    """docs plus tox_score (0 to 1, higher: likelier toxic) and tox_segments (number of significant passages).

    NULL and empty texts have no segment and get the score of no evidence. Without a model (a class was never seen) every
    score is 0. Rows with a NULL or repeated id are scored each for itself; equal texts score alike; very long texts are
    scored whole. Columns of docs with the new names are replaced.
    """
    named = docs.drop("tox_score", "tox_segments")
    if model is None:
        return named.withColumns({"tox_score": F.lit(0.0), "tox_segments": F.lit(0)})

    shared = docs.sparkSession.sparkContext.broadcast(model)  # the words of the bounded sample

    @F.pandas_udf("score double, segments int")
    def judge(texts: pd.Series) -> pd.DataFrame:
        told = pd.DataFrame([shared.value.score(t) for t in texts], columns=["score", "segments"])
        release()
        return told

    judged = named.withColumn("__tox_judged", judge(F.col(text_col)))
    return judged.select(*named.columns, F.col("__tox_judged.score").alias("tox_score"), F.col("__tox_judged.segments").alias("tox_segments"))


def toxic_passages(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, first_token, end_token, e_value, passage): every significant passage of every text."""

    @F.pandas_udf("array<struct<first_token:int,end_token:int,e_value:double,passage:string>>")
    def find(texts: pd.Series) -> pd.Series:
        def of(t):
            if not t:
                return []
            where = [m.span() for m in WORD.finditer(t.lower())]
            whole = len(t.lower()) == len(t)
            return [
                {"first_token": s, "end_token": e, "e_value": v, "passage": (t if whole else t.lower())[where[s][0] : where[e - 1][1]]}
                for s, e, v in model.evidence(t)[2]
            ]

        return texts.map(of)

    return docs.select(F.col(id_col).alias("id"), F.inline(find(F.col(text_col))))


#: Documents with at least this score count as toxic.
THRESHOLD = 0.3
