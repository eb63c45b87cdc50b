"""Fitted scores as artefacts: a classifier over texts and numbers that is saved, loaded and used to score, and the search for its parameters."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.functions import metrics as M
from varloom.operators.base import draw

#: The annotation columns that a variant classifier reads by default, texts and numbers.
TEXTS = ("CSQ_PolyPhen", "CSQ_SIFT", "CSQ_CLINVAR_CLNREVSTAT", "CSQ_CLINVAR_CLNSIG", "most_severe_consequence")
NUMBERS = (
    "CSQ_MaxEntScan_alt", "CSQ_MaxEntScan_diff", "CSQ_MES-SWA_acceptor_alt", "CSQ_MES-SWA_donor_alt", "CSQ_MES-SWA_donor_diff", "CSQ_SpliceAI_pred_DS_AL",
    "CSQ_SpliceAI_pred_DS_DG", "CSQ_SpliceAI_pred_DS_DL", "CSQ_REVEL_score", "CSQ_LoFtool", "CSQ_GERP++_RS", "CSQ_phastCons100way_vertebrate",
    "CSQ_phyloP100way_vertebrate", "CADD", "SWEGENAF", "GNOMADAF_popmax", "CSQ_SpliceAI_pred_DS_AG", "Frq",
)

_WORDS = r"filter(split(lower(coalesce(`{c}`, '')), '[ \\t\\n_&/|:,0-9-]'), t -> t <> '' AND NOT t RLIKE '^[cagtn]+$')"


def filled(df: DataFrame, texts: list[str], numbers: list[str]) -> DataFrame:
    """df with every feature column: texts that are absent or missing are '', numbers 0; a number column that holds text is read as numbers."""
    have = set(df.columns)
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) if c in have else F.lit("")
    num = lambda c: F.coalesce(F.col(f"`{c}`").try_cast("double"), F.lit(0.0)) if c in have else F.lit(0.0)
    return df.withColumns({c: text(c) for c in texts} | {c: num(c) for c in numbers})


def classifier(texts: list[str], numbers: list[str], label: str = "label", weight: str = "weight", vocabulary: int = 5000, **settings):
    """The unfitted pipeline: a vocabulary and bag of words for each text, standardised numbers, weighted logistic regression.

    Words are lower-cased and split at blanks, marks and digits, DNA letters are dropped, and a text without words has one that stands
    for it. Everything that a row goes through is a stage, so the saved pipeline scores rows of the feature columns alone.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizer, SQLTransformer, StandardScaler, VectorAssembler

    words = [f"{_WORDS.format(c=c)} AS __t{i}" for i, c in enumerate(texts)]
    stages = [SQLTransformer(statement="SELECT *, " + ", ".join([*words, *[f"coalesce(`{c}`, 0D) AS __n{i}" for i, c in enumerate(numbers)]]) + " FROM __THIS__")]
    stages.append(SQLTransformer(statement="SELECT *, " + ", ".join(f"if(size(__t{i}) = 0, array('missing'), __t{i}) AS __w{i}" for i in range(len(texts))) + " FROM __THIS__"))
    stages += [CountVectorizer(inputCol=f"__w{i}", outputCol=f"__bag{i}", vocabSize=vocabulary) for i in range(len(texts))]
    stages += [VectorAssembler(inputCols=[f"__n{i}" for i in range(len(numbers))], outputCol="__raw"), StandardScaler(inputCol="__raw", outputCol="__scaled", withMean=True)]
    stages += [VectorAssembler(inputCols=[*[f"__bag{i}" for i in range(len(texts))], "__scaled"], outputCol="__features")]
    regression = LogisticRegression(featuresCol="__features", labelCol=label, weightCol=weight, probabilityCol="__probability", rawPredictionCol="__margin", predictionCol="__class", **{"maxIter": 30, "regParam": 1e-4} | settings)
    return Pipeline(stages=[*stages, regression])


def fit_variant_classifier(train: DataFrame, texts: list[str] = TEXTS, numbers: list[str] = NUMBERS, label: str = "label", weight: str | None = None, path: str | None = None, **settings):
    """The pipeline fitted on train (balanced weights unless a weight column is given), written to path if one is given."""
    from varloom.operators.splits import class_balance

    rows = filled(train, texts, numbers)
    if weight is None:
        w = class_balance(rows, F.col(label)).first()
        rows, weight = rows.withColumn("__weight", F.when(F.col(label) == 1, w["w_pos"]).otherwise(w["w_neg"])), "__weight"
    model = classifier(texts, numbers, label, weight, **settings).fit(rows)
    if path:
        model.save(path)
    return model


def load_classifier(path: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)


def probability(model, df: DataFrame, name: str = "score") -> DataFrame:
    """df with the model's probability of class 1; the columns that the stages make are dropped. A row's score does not depend on other rows."""
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(df)
    return scored.select(*df.columns, F.get(vector_to_array("__probability"), 1).alias(name))


def without_uncertain(df: DataFrame, significance: str = "CSQ_CLINVAR_CLNSIG", texts: list[str] = TEXTS) -> DataFrame:
    """df with the clinical texts blanked where the significance is uncertain or conflicting, or nothing but other or association."""
    if significance not in df.columns:
        return df
    seen = F.lower(F.coalesce(F.col(f"`{significance}`"), F.lit("")))
    unsure = seen.contains("uncertain") | seen.contains("conflicting") | seen.isin("other", "association")
    # One pass, so that the significance itself is blanked last.
    return df.withColumns({c: F.when(unsure, "").otherwise(F.col(f"`{c}`")) for c in texts if "CLINVAR" in c and c in df.columns})


def matthews_loss(scored: DataFrame, predicted: Column, label: Column) -> float:
    """1 - MCC of a scored table: an objective that falls as the score improves."""
    cells = scored.agg(*M.confusion(predicted, label))
    return 1.0 - cells.select(M.mcc(*[F.col(c) for c in ("tp", "tn", "fp", "fn")]).alias("m")).first()["m"]


def drawn_parameters(space: dict[str, tuple[float, float] | list], draws: int, seed: str = "search") -> list[dict]:
    """Parameter sets: of a list one of its values, of a (low, high) a number between; by md5, so that any engine draws the same."""
    from hashlib import md5

    def one(i: int, name: str, values):
        u = int(md5(f"{i}:{seed}-{name}".encode()).hexdigest()[:8], 16) / 2**32
        return values[int(u * len(values))] if isinstance(values, list) else values[0] + u * (values[1] - values[0])

    return [{name: one(i, name, values) for name, values in space.items()} for i in range(draws)]


def held_out(df: DataFrame, key: str, ratio: float = 0.2, seed: str = "validation") -> tuple[DataFrame, DataFrame]:
    """(train, validation) by a draw of each row's key."""
    rows = df.withColumn("__u", draw(F.col(key), seed))
    return rows.where(F.col("__u") >= ratio).drop("__u"), rows.where(F.col("__u") < ratio).drop("__u")


def search(train: DataFrame, validation: DataFrame, fit: Callable[[DataFrame, dict], object], objective: Callable[[object, DataFrame], float], parameters: list[dict], parallel: int = 4):
    """(best model, its parameters, [(parameters, objective)...] in the order given): one fit for each parameter set, judged on rows it hasn't seen.

    fit and objective are the user's own; the smallest objective wins, the first of equals. Both tables are settled once, and fits run as `parallel` Spark jobs at a time.
    """
    from varloom.operators.base import settled

    if not parameters:
        raise ValueError("no parameters to try")
    seen, unseen = settled(train), settled(validation)

    def attempt(chosen: dict) -> tuple[object, float]:
        model = fit(seen, chosen)
        return model, float(objective(model, unseen))

    with ThreadPoolExecutor(parallel) as pool:
        tried = list(pool.map(attempt, parameters))
    best = min(range(len(tried)), key=lambda i: tried[i][1])
    return tried[best][0], parameters[best], [(p, v) for p, (_, v) in zip(parameters, tried, strict=True)]
