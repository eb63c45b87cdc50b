"""Classification metrics as column expressions over the four counts of a confusion matrix."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def confusion(predicted: Column, label: Column) -> list[Column]:
    """tp, tn, fp, fn as aggregates: partial sums merge, so matrices of folds or shards add up."""
    cell = lambda p, y: F.coalesce(F.count_if((predicted == p) & (label == y)), F.lit(0))
    return [cell(1, 1).alias("tp"), cell(0, 0).alias("tn"), cell(1, 0).alias("fp"), cell(0, 1).alias("fn")]


def ratio(a: Column, b: Column, otherwise: float = 0.0) -> Column:
    return F.when(b == 0, F.lit(otherwise)).otherwise(a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0)))


def f_beta(tp: Column, fp: Column, fn: Column, beta: float = 1.0) -> Column:
    b2 = beta * beta
    return ratio((1 + b2) * tp, (1 + b2) * tp + b2 * fn + fp)


def mcc(tp: Column, tn: Column, fp: Column, fn: Column) -> Column:
    """Matthews correlation; 0 where undefined."""
    d = [c.cast("double") for c in (tp, tn, fp, fn)]
    t, n, f, m = d
    return ratio(t * n - f * m, F.sqrt((t + f) * (t + m) * (n + f) * (n + m)))


def mcc_normalised(tp: Column, tn: Column, fp: Column, fn: Column, repair: float = 1e-6) -> Column:
    """(mcc + 1) / 2; where the denominator is 0, empty cells count as `repair`."""
    cells = [c.cast("double") for c in (tp, tn, fp, fn)]
    whole = (cells[0] + cells[2]) * (cells[0] + cells[3]) * (cells[1] + cells[2]) * (cells[1] + cells[3])
    t, n, f, m = [F.when((whole == 0) & (c == 0), F.lit(repair)).otherwise(c) for c in cells]
    return ((t * n - f * m) / F.sqrt((t + f) * (t + m) * (n + f) * (n + m)) + 1) / 2


def rates(tp: Column, tn: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """Precision, recall, miss rate, accuracy, and balanced accuracy over the classes that occur."""
    pos, neg = tp + fn, tn + fp
    recall, specificity = ratio(tp, pos), ratio(tn, neg)
    balanced = F.when(pos == 0, specificity).when(neg == 0, recall).otherwise((recall + specificity) / 2)
    return {
        "precision": ratio(tp, tp + fp),
        "recall": recall,
        "fnr": F.when(pos == 0, F.lit(None)).otherwise(ratio(fn, pos)),
        "accuracy": ratio(tp + tn, pos + neg),
        "balanced_accuracy": balanced,
    }


def roc_point(tp: Column, tn: Column, fp: Column, fn: Column) -> dict[str, Column]:
    return {"fpr": ratio(fp, fp + tn), "tpr": ratio(tp, tp + fn)}


def log_loss(p: Column, label: Column, weight: Column | None = None) -> Column:
    """Binary cross-entropy as an aggregate, p clipped to [1e-7, 1 - 1e-7]."""
    w = F.lit(1.0) if weight is None else weight
    q = F.least(F.lit(1 - 1e-7), F.greatest(F.lit(1e-7), p))
    return -F.sum(w * (label * F.ln(q) + (1 - label) * F.ln(1 - q))) / F.sum(w)


def gate(a: Column, g: Column, w: float = 2.0, b: float = -0.95) -> Column:
    """Score a under a clipped linear gate of g."""
    return a * F.least(F.lit(1.0), F.greatest(F.lit(0.0), w * g + b))


def harmonic(a: Column, b: Column, s: float = 1.0) -> Column:
    """Biased harmonic mean; 0 where undefined."""
    return F.coalesce(F.try_divide((1 + s * s) * a * b, s * s * a + b), F.lit(0.0))


def sigmoid(x: Column, w: float = 1.0, b: float = 0.0) -> Column:
    return 1 / (1 + F.exp(-(w * x + b)))


def outcome(predicted: Column, label: Column) -> Column:
    """TP, TN, FP or FN as text; any other pair is an error."""
    out = F.when((predicted == 1) & (label == 1), "TP").when((predicted == 0) & (label == 0), "TN")
    out = out.when((predicted == 1) & (label == 0), "FP").when((predicted == 0) & (label == 1), "FN")
    return out.otherwise(F.raise_error(F.lit("prediction and label must be 0 or 1")))


def rounded(x: Column, digits: int) -> Column:
    """round(x, digits), value for value, without decimal arithmetic but for numbers that lie close to a tie or are large."""
    scale = 10.0**digits
    whole = F.rint(x * scale)
    plain = (F.abs(F.abs(x * scale - whole) - 0.5) > 1e-3) & (F.abs(x) < 1e6)
    return F.when(plain, whole / scale + 0.0).otherwise(F.round(x, digits))
