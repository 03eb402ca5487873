"""Candidates, cross-validation and successive-halving search on Spark ML.

Every fit and score is a distributed Spark ML job over a persisted feature
table; the driver only loops over a handful of (candidate, fold) trials and
keeps one row of scores per trial.  Crashes are isolated per trial.
"""

from __future__ import annotations

import json
import math
import random
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    LogisticRegressionModel,
    NaiveBayes,
    OneVsRest,
    OneVsRestModel,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsight.errors import InputError
from tabsight.functions.exprs import DEFAULT_SEED, key_string
from tabsight.operators import evaluate
from tabsight.operators.boosting import OneVsRestBoosting
from tabsight.operators.calibration import TOLERANCE, CalibratedLinearSVC
from tabsight.operators.perceptron import Perceptron
from tabsight.operators.ranking import index_within
from tabsight.operators.relu_net import ReluNetClassifier

# Search schedule.
STAGE_FIDELITIES = (0.1, 0.5, 1.0)
STAGE_TIME_FRACTIONS = (0.25, 0.35, 0.40)
CV_FOLDS = 3
PROMOTION_FRACTION = 0.5
#: No clock stops a search unless its caller gives a budget: every candidate is tried.
DEFAULT_TIME_BUDGET_SEC = None
FALLBACK_MAX_ITER = 500
#: Rows of a trial that one task holds.
TASK_ROWS = 20_000


@dataclass
class Candidate:
    """A named estimator factory ``(n_features, n_classes) -> Estimator``."""

    name: str
    factory: Callable[[int, int], Estimator]
    description: str = ""
    params: dict = field(default_factory=dict)
    #: Weight of 1/2·|w|² beside the summed loss; none leaves the factory's own.
    l2: float | None = None

    def build(self, n_features: int, n_classes: int, features_col: str = "features", label_col: str = "label",
              n_rows: int | None = None) -> Estimator:
        """The estimator for a fit on ``n_rows`` rows (they scale the penalty on Spark's mean loss)."""
        est = self.factory(n_features, n_classes)
        est = est.copy()
        for p, v in (("featuresCol", features_col), ("labelCol", label_col)):
            if est.hasParam(p):
                est._set(**{p: v})
        if self.l2 is not None and n_rows is not None:
            est._set(regParam=self.l2 / max(1, n_rows))
        return est


# ---- candidate lists (M1-M3) ---------------------------------------------------------

def _mlp(name: str, hidden: list[int], epochs: int, alpha: float) -> Candidate:
    params = {"layers": hidden, "maxIter": epochs, "alpha": alpha}
    shape = "-".join(map(str, hidden))
    return Candidate(name, lambda f, k: ReluNetClassifier(hidden, k, alpha, epochs), f"ReLU network {shape}, L2, early stopping", params)


def _gbt(n_features: int, n_classes: int) -> Estimator:
    # GBT is binary-only in Spark ML: one-vs-rest for more classes
    if n_classes > 2:
        return OneVsRestBoosting(n_classes, maxIter=100, max_depth=3, step=0.1)
    return GBTClassifier(maxIter=100, maxDepth=3, stepSize=0.1, seed=DEFAULT_SEED)


def tabular_candidates(n_rows: int) -> list[Candidate]:
    """ReLU networks 64 / 128-64 / 256-128-64, GBT(100, depth 3, lr 0.1), RF, LogReg(500, L2) (M1)."""
    trees = max(100, min(400, n_rows))
    return [
        _mlp("MLP-Small", [64], 150, 1e-3),
        _mlp("MLP-Medium", [128, 64], 200, 1e-3),
        _mlp("MLP-Large", [256, 128, 64], 250, 1e-4),
        Candidate("GradientBoosting", _gbt, "Gradient-boosted trees", {"maxIter": 100, "maxDepth": 3, "stepSize": 0.1}),
        Candidate(
            "RandomForest",
            lambda f, k: RandomForestClassifier(numTrees=trees, seed=DEFAULT_SEED),
            "Random forest",
            {"numTrees": trees},
        ),
        Candidate(
            "LogisticRegression",
            lambda f, k: LogisticRegression(maxIter=FALLBACK_MAX_ITER),
            "Multinomial logistic regression with L2",
            {"maxIter": FALLBACK_MAX_ITER},
            l2=1.0,
        ),
    ]


def text_candidates() -> list[Candidate]:
    """TF-IDF heads: calibrated linear SVM, logistic regression, complement NB (M2)."""
    return [
        Candidate(
            "LinearSVC",
            lambda f, k: CalibratedLinearSVC(k, num_folds=CV_FOLDS, maxIter=100),
            "One-vs-rest linear SVM with probabilities fitted out of fold",
            {"maxIter": 100, "calibration_folds": CV_FOLDS},
            l2=1.0,
        ),
        Candidate(
            "LogisticRegression",
            lambda f, k: LogisticRegression(maxIter=2 * FALLBACK_MAX_ITER),
            "Logistic regression with L2 on TF-IDF",
            {"maxIter": 2 * FALLBACK_MAX_ITER},
            l2=1.0,
        ),
        Candidate(
            "ComplementNB",
            lambda f, k: NaiveBayes(modelType="complement"),
            "Complement naive Bayes",
            {"modelType": "complement"},
        ),
    ]


def vector_candidates() -> list[Candidate]:
    """Logistic-regression head over pre-extracted embedding vectors (M3)."""
    return [_logistic("Logistic regression head on embedding features")]


def fallback_candidate() -> Candidate:
    """The baseline used when the search fails or names no winner (M7)."""
    return _logistic("Fallback baseline")


def _logistic(description: str) -> Candidate:
    return Candidate(
        "LogisticRegression",
        lambda f, k: LogisticRegression(maxIter=FALLBACK_MAX_ITER),
        description,
        {"maxIter": FALLBACK_MAX_ITER},
        l2=1.0,
    )


# ---- probabilities ---------------------------------------------------------------

def with_proba(model: Model, df: DataFrame, out_col: str = "proba", pred_col: str = "pred") -> DataFrame:
    """Score ``df`` and add ``proba`` (array<double>) and ``pred`` (int).

    One-vs-rest models have no probability column: their per-class raw
    scores pass a sigmoid and are normalised to sum to one.
    """
    scored = model.transform(df)
    if isinstance(model, OneVsRestModel) or "probability" not in scored.columns:
        raw = vector_to_array(F.col("rawPrediction"))
        scored = scored.withColumn("_sig", F.transform(raw, lambda m: F.lit(1.0) / (F.lit(1.0) + F.exp(-m))))
        scored = scored.withColumn("_tot", F.aggregate(F.col("_sig"), F.lit(0.0), lambda a, b: a + b))
        scored = scored.withColumn(out_col, F.transform("_sig", lambda s: s / F.col("_tot"))).drop("_sig", "_tot")
    else:
        scored = scored.withColumn(out_col, vector_to_array(F.col("probability")))
    return scored.withColumn(pred_col, evaluate.argmax(F.col(out_col)))


#: Coefficients up to which a logistic regression is scored by column expressions.
_MAX_EXPRESSION_COEFFICIENTS = 400


def with_proba_of_columns(model: Model, df: DataFrame, inputs: list[str], out_col: str = "proba", pred_col: str = "pred") -> DataFrame:
    """:func:`with_proba` for rows whose features are the double columns ``inputs``.

    A small logistic regression is computed from its coefficients by column
    expressions, which cost a fraction of a vector per row; any other model
    transforms assembled vectors.
    """
    if not isinstance(model, LogisticRegressionModel) or model.coefficientMatrix.numRows * len(inputs) > _MAX_EXPRESSION_COEFFICIENTS:
        vectors = VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep").transform(df)
        return with_proba(model, vectors, out_col, pred_col).drop("features")
    coefficients, intercepts = model.coefficientMatrix.toArray().tolist(), model.interceptVector.toArray().tolist()
    margins = [sum((F.col(c) * F.lit(w) for c, w in zip(inputs, row)), F.lit(b)) for row, b in zip(coefficients, intercepts)]
    if len(margins) == 1:  # two classes
        scored = df.withColumn("_p0", F.lit(1.0) / (F.lit(1.0) + F.exp(margins[0])))
        scored = scored.withColumn(out_col, F.array(F.col("_p0"), F.lit(1.0) - F.col("_p0"))).drop("_p0")
    else:
        ms, es = [f"_m{i}" for i in range(len(margins))], [f"_e{i}" for i in range(len(margins))]
        scored = df.withColumns(dict(zip(ms, margins))).withColumn("_top", F.greatest(*ms))
        scored = scored.withColumns({e: F.exp(F.col(m) - F.col("_top")) for e, m in zip(es, ms)}).withColumn("_sum", sum(map(F.col, es[1:]), F.col(es[0])))
        scored = scored.withColumn(out_col, F.array(*[F.col(e) / F.col("_sum") for e in es])).drop(*ms, *es, "_top", "_sum")
    return scored.withColumn(pred_col, evaluate.argmax(F.col(out_col)))


def linear_margins(model: LogisticRegressionModel) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (a row per class) and intercepts; of two classes the first has margin 0."""
    coefficients, intercepts = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    if len(coefficients) == 1:
        return np.vstack((np.zeros_like(coefficients), coefficients)), np.concatenate(([0.0], intercepts))
    return coefficients, intercepts


# ---- cross-validation (M4) ---------------------------------------------------------

def balanced_accuracy_value(pred: DataFrame, label_col: str = "label", pred_col: str = "pred") -> float:
    """Balanced accuracy as a float, from one small aggregate."""
    p = pred.select(F.col(label_col).cast("int").alias("y"), F.col(pred_col).cast("int").alias("p"))
    row = evaluate.balanced_accuracy(p, "y", "p").first()
    return float(row[0]) if row and row[0] is not None else 0.0


def score_predictions(pred: DataFrame, scoring="balanced_accuracy", label_col: str = "label", pred_col: str = "pred") -> float:
    """A metric name, or a function of the long confusion table ``true_class, pred_class, n``."""
    if scoring == "balanced_accuracy":
        return balanced_accuracy_value(pred, label_col, pred_col)
    p = pred.select(F.col(label_col).cast("int").alias("y"), F.col(pred_col).cast("int").alias("p"))
    if callable(scoring):
        return float(scoring(evaluate.confusion_long(p, "y", "p")))
    m = evaluate.core_metrics(p, "y", "p").first()
    names = {"accuracy": "accuracy", "precision_weighted": "precision", "recall_weighted": "recall", "f1_weighted": "f1"}
    if scoring not in names:
        raise InputError(f"Unknown scoring '{scoring}'; use {sorted(names) + ['balanced_accuracy']} or a function.")
    return float(m[names[scoring]] or 0.0)


def score_fold(cand: Candidate, data: DataFrame, fold: int, n_features: int, n_classes: int,
               label_col: str = "label", fold_col: str = "fold", scoring="balanced_accuracy", n_rows: int | None = None) -> float:
    train = data.where(F.col(fold_col) != fold)
    test = data.where(F.col(fold_col) == fold)
    if n_rows is None and cand.l2 is not None:
        n_rows = train.count()
    model = cand.build(n_features, n_classes, label_col=label_col, n_rows=n_rows).fit(train)
    return score_predictions(with_proba(model, test), scoring, label_col)


def cross_val_score(
    cand: Candidate,
    data: DataFrame,
    k: int,
    n_features: int,
    n_classes: int,
    label_col: str = "label",
    fold_col: str = "fold",
    parallelism: int = 2,
    scoring="balanced_accuracy",
    n_train: int | None = None,
) -> list[float]:
    """Score of each of ``k`` folds (the fold column is already assigned) (M4).

    ``n_train`` is the number of rows each fit sees, where the caller knows it.
    """
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        futures = [pool.submit(score_fold, cand, data, f, n_features, n_classes, label_col, fold_col, scoring, n_train)
                   for f in range(k)]
        return [fu.result() for fu in futures]


def stage_sizes(counts: dict, fraction: float, cv: int) -> tuple[dict, int]:
    """Rows per class of a stage, ⌈fraction·n_c⌉ but at least min(n_c, cv), and its number of folds."""
    sizes = {c: max(math.ceil(n * fraction), min(n, cv)) for c, n in counts.items()}
    return sizes, min(cv, max(2, min(sizes.values())))


def stratified_stage_sample(
    data: DataFrame, label_col: str, key_cols: list[str], fraction: float, seed: int, cv: int, k: int
) -> DataFrame:
    """Per-class sample of ⌈fraction·n_c⌉ rows (at least min(n_c, cv)), with ``k`` folds.

    One ranking per class by md5(seed|key), at every size: the first rows form
    the sample and the same rank deals the folds round-robin.  Only keys and
    labels are ranked; the rows join their rank.  Rows that repeat a key share one.
    """
    order = F.md5(key_string(key_cols, seed))
    keys = data.select(label_col, *key_cols).distinct().withColumn("_h", order)
    ranked = index_within(keys, [label_col], ["_h", *key_cols], "_i")
    sizes = ranked.groupBy(label_col).agg(F.count(F.lit(1)).alias("_n"))
    want = F.greatest(F.ceil(F.col("_n") * F.lit(float(fraction))), F.least(F.col("_n"), F.lit(cv)))
    # one row per class: Spark broadcasts it if it is small
    picked = ranked.join(sizes, label_col).where(F.col("_i") < want)
    picked = picked.select(label_col, *key_cols, F.pmod(F.col("_i"), F.lit(k)).cast("int").alias("fold"))
    return data.join(picked, [label_col, *key_cols])


def spread(data: DataFrame, n_rows: int) -> DataFrame:
    """``data`` dealt to a partition for every ``TASK_ROWS`` of its ``n_rows`` rows.

    Every step of a fit is a job over all partitions: no more of them than the
    rows need, and no fewer either, however few files or partitions the rows come in.
    """
    parts = max(1, -(-n_rows // TASK_ROWS))
    return data.repartition(parts) if parts > 1 else data.coalesce(1)


def successive_halving(
    candidates: list[Candidate],
    data: DataFrame,
    label_col: str,
    key_cols: list[str],
    n_features: int,
    time_budget_sec: float | None = DEFAULT_TIME_BUDGET_SEC,
    cv: int = CV_FOLDS,
    seed: int = DEFAULT_SEED,
    parallelism: int = CV_FOLDS,
    scoring="balanced_accuracy",
):
    """Three-stage successive halving with stratified CV (M5).

    Returns ``(best_name | None, best_score, results DataFrame)``.  Every
    candidate of a stage is tried; only a ``time_budget_sec`` given by the caller
    stops *new* trials (a stage's clock starts at its first trial, one trial is
    always run); crashed trials score 0.0 with ``fit_ok`` false;
    ``max(1, ⌊m/2⌋)`` of the m evaluated candidates are promoted; the winner
    is the best ``fit_ok`` trial of stage 3.  A caller's cache of ``data`` stays.
    """
    spark = data.sparkSession
    schema = (
        "name string, stage int, score double, std double, cv_scores array<double>, fit_ok boolean, "
        "error string, n_sub long, fidelity double, seconds double, description string, params string"
    )
    if not candidates:
        return None, -1.0, spark.createDataFrame([], schema)
    cached = data.storageLevel.useMemory or data.storageLevel.useDisk
    if not cached:
        data = data.persist()
    # one row per class
    counts = {r[0]: r["n"] for r in data.groupBy(label_col).agg(F.count(F.lit(1)).alias("n")).collect()}
    alive = list(range(len(candidates)))
    rows = []
    for stage, (fid, frac) in enumerate(zip(STAGE_FIDELITIES, STAGE_TIME_FRACTIONS), start=1):
        sizes, k = stage_sizes(counts, fid, cv)
        n_sub = sum(sizes.values())
        sample = stratified_stage_sample(data, label_col, key_cols, fid, seed + stage - 1, cv, k)
        sample = spread(sample, n_sub).persist()
        sample.count()  # drawn before the clock starts
        stage_start = time.time()
        trials = {}
        for idx in alive:
            if trials and time_budget_sec is not None and time.time() - stage_start > frac * time_budget_sec:
                break
            cand = candidates[idx]
            t0 = time.time()
            try:
                scores = cross_val_score(
                    cand, sample, k, n_features, len(counts), label_col, "fold", parallelism, scoring, n_sub - n_sub // k
                )
                mean = sum(scores) / len(scores)
                std = math.sqrt(sum((s - mean) ** 2 for s in scores) / len(scores))
                result = (round(mean, 4), round(std, 4), [round(s, 4) for s in scores], True, "")
            except Exception as exc:  # a crashed candidate scores 0.0
                result = (0.0, 0.0, [], False, str(exc)[:500])
            trials[idx] = result[0]
            spent = round(time.time() - t0, 3)
            rows.append((cand.name, stage, *result, n_sub, fid, spent, cand.description, json.dumps(cand.params, sort_keys=True)))
        sample.unpersist()
        # best first; list order breaks ties
        ranked = sorted(trials, key=trials.get, reverse=True)
        alive = ranked[: max(1, int(len(ranked) * PROMOTION_FRACTION))]
    if not cached:
        data.unpersist()
    results = spark.createDataFrame(rows, schema)
    final = [r for r in rows if r[1] == 3 and r[5]]
    if not final:
        return None, -1.0, results
    best = max(final, key=lambda r: r[2])  # the first of equals
    return best[0], best[2], results


def promotion_table(results: DataFrame) -> DataFrame:
    """Rank within each stage by score, list order on ties, and mark survivors."""
    from pyspark.sql import Window

    w = Window.partitionBy("stage").orderBy(F.col("score").desc(), F.col("ordinal"))
    n = F.count(F.lit(1)).over(Window.partitionBy("stage"))
    ranked = results.withColumn("rank", F.row_number().over(w))
    return ranked.withColumn("promoted", F.col("rank") <= F.greatest(F.lit(1), F.floor(n * PROMOTION_FRACTION)))


# ---- final fit, recommendation, random search (M6, M8, M9) -------------------------------------

# Fixed values: (data type, most rows, most features, baseline), the first rule that holds;
# None is no bound.
BASELINE_RULES = (
    ("tabular", 500, None, "MLP-Small"),
    ("tabular", None, 20, "MLP-Small"),
    ("tabular", None, 100, "MLP-Medium"),
    ("tabular", None, None, "MLP-Large"),
    ("image", None, None, "LogisticRegression"),
    ("text", 499, None, "LogisticRegression"),
    ("text", None, None, "LinearSVC"),
)


def baseline_expr(data_type: Column, n_features: Column, n_samples: Column) -> Column:
    """The baseline name by ``BASELINE_RULES`` (M8); null for an unknown data type."""
    out = F.lit(None).cast("string")
    for kind, rows, features, name in reversed(BASELINE_RULES):
        rule = data_type == kind
        if rows is not None:
            rule = rule & (F.coalesce(n_samples, F.lit(0)) <= rows)
        if features is not None:
            rule = rule & (n_features <= features)
        out = F.when(rule, F.lit(name)).otherwise(out)
    return out


def recommend_baseline(data_type: str, n_features: int, n_samples: int | None) -> str:
    """Scale-based baseline name (M8), the driver-side form of :func:`baseline_expr`."""
    for kind, rows, features, name in BASELINE_RULES:
        if kind == data_type and (rows is None or (n_samples or 0) <= rows) and (features is None or n_features <= features):
            return name
    raise InputError(f"No baseline for data type {data_type!r}.")


def select_candidate(candidates: list[Candidate], data_type: str, n_features: int, n_samples: int,
                     manual: str | None = None) -> Candidate:
    """Manual choice if it names a candidate, else the recommendation (M8)."""
    names = [c.name for c in candidates]
    if manual is not None and manual not in names:
        raise InputError(f"No candidate '{manual}'; there are {sorted(names)}.")
    want = manual or recommend_baseline(data_type, n_features, n_samples)
    for c in candidates:
        if c.name == want:
            return c
    return candidates[0]


PARAM_SPACES = {
    "LogisticRegression": {"regParam": [0.0, 0.001, 0.01, 0.1], "elasticNetParam": [0.0, 0.5, 1.0], "maxIter": [100, 500]},
    "RandomForest": {"numTrees": [50, 100, 200], "maxDepth": [3, 5, 8]},
    "MLP": {"hidden": [[32], [64], [128, 64]], "stepSize": [0.01, 0.03, 0.1], "maxIter": [100, 200]},
    "GradientBoosting": {"maxIter": [20, 50, 100], "maxDepth": [2, 3, 5], "stepSize": [0.05, 0.1, 0.2]},
    "LinearSVC": {"regParam": [0.0, 0.001, 0.01, 0.1], "maxIter": [50, 100]},
    "NaiveBayes": {"smoothing": [0.1, 0.5, 1.0, 2.0], "modelType": ["multinomial", "complement"]},
}


def _estimator_for(kind: str, params: dict, n_features: int, n_classes: int) -> Estimator:
    if kind == "LogisticRegression":
        return LogisticRegression(**params)
    if kind == "RandomForest":
        return RandomForestClassifier(seed=DEFAULT_SEED, **params)
    if kind == "MLP":
        p = dict(params)
        hidden = p.pop("hidden")
        return Perceptron([n_features, *hidden, n_classes], p["maxIter"], DEFAULT_SEED)  # L-BFGS has no use for stepSize
    if kind == "NaiveBayes":
        return NaiveBayes(**params)
    if kind == "GradientBoosting":
        if n_classes > 2:
            return OneVsRestBoosting(n_classes, params["maxIter"], params["maxDepth"], params["stepSize"])
        return GBTClassifier(seed=DEFAULT_SEED, **params)
    if kind == "LinearSVC":
        return OneVsRest(classifier=LinearSVC(tol=TOLERANCE, **params), parallelism=n_classes)
    raise InputError(f"No parameter space for '{kind}'.")


def random_search(
    kind: str,
    data: DataFrame,
    label_col: str,
    key_cols: list[str],
    n_features: int,
    n_classes: int,
    n_trials: int = 5,
    validation_split: float = 0.15,
    seed: int = DEFAULT_SEED,
    space: dict | None = None,
):
    """Seeded random search over a parameter space on one validation split.

    Returns ``(best_params, best_model_refit_on_all, results DataFrame)``.
    """
    space = space or PARAM_SPACES[kind]
    rng = random.Random(seed)
    trials = []
    seen = set()
    for _ in range(n_trials * 4):
        p = {k: rng.choice(v) for k, v in sorted(space.items())}
        key = repr(sorted(p.items()))
        if key not in seen:
            seen.add(key)
            trials.append(p)
        if len(trials) >= n_trials:
            break
    from tabsight.functions.exprs import hash_unit

    split = data.withColumn("_val", hash_unit(key_cols, seed) < F.lit(float(validation_split)))
    split = spread(split, data.count()).persist()
    train, val = split.where(~F.col("_val")), split.where(F.col("_val"))
    rows = []
    done: dict[str, tuple[float, bool, str]] = {}
    best = (None, -1.0)
    for i, p in enumerate(trials):
        t0 = time.time()
        # parameters that the optimiser does not read make no other fit
        read = repr(sorted((k, v) for k, v in p.items() if (kind, k) != ("MLP", "stepSize")))
        if read in done:
            score, ok, err = done[read]
        else:
            try:
                est = _estimator_for(kind, p, n_features, n_classes).setLabelCol(label_col)
                score = balanced_accuracy_value(with_proba(est.fit(train), val), label_col)
                ok, err = True, ""
            except Exception as exc:
                score, ok, err = 0.0, False, str(exc)[:500]
            done[read] = score, ok, err
        rows.append((i, repr(p), score, ok, err, round(time.time() - t0, 3)))
        if ok and score > best[1]:
            best = (p, score)
    spark = data.sparkSession
    results = spark.createDataFrame(rows, "trial int, params string, score double, fit_ok boolean, error string, seconds double")
    try:
        if best[0] is None:
            return None, None, results
        # on the same partitions: the input's may be few
        model = _estimator_for(kind, best[0], n_features, n_classes).setLabelCol(label_col).fit(split.drop("_val"))
    finally:
        split.unpersist()
    return best[0], model, results
