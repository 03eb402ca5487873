"""Train and score tabular classifiers end to end.

``train_tabular`` composes validation → quality summary → preprocessing →
search → final fit on a stratified hold-out → threshold → importance, and
``predict_batch`` is one lazy plan over the scoring table.  The driver only
holds the fitted spec (one number per feature, the class list) and small
result rows.
"""

from __future__ import annotations

import datetime as _dt
import json
from dataclasses import dataclass, field

from pyspark.ml import Model
from pyspark.ml import classification as C
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsight.errors import InputError
from tabsight.functions.exprs import DEFAULT_SEED, key_string
from tabsight.operators import evaluate, models, prep, quality, split, validate
from tabsight.operators.boosting import OneVsRestBoostingModel
from tabsight.operators.calibration import CalibratedSVCModel
from tabsight.operators.relu_net import ReluNetModel
from tabsight.operators.report import prediction_detail
from tabsight.sources.registry import register_run

FEATURES = "features"
LABEL = "label"
ROW_KEY = "_row_key"
DEFAULT_THRESHOLD = 0.5


@dataclass
class FittedRun:
    """Everything needed to score new rows, plus the run's result rows."""

    pre: prep.Preprocessor
    model: Model
    model_name: str
    threshold: float | None
    metrics: dict = field(default_factory=dict)
    search: DataFrame | None = None
    importance: DataFrame | None = None
    quality: dict | None = None
    dataset_type: str = "tabular"
    fallback: bool = False
    error: str | None = None

    @property
    def classes(self) -> list[str]:
        return self.pre.classes

    def meta(self) -> dict:
        return {
            "model_name": self.model_name,
            "model_class": type(self.model).__name__,
            "dataset_type": self.dataset_type,
            "class_names": self.classes,
            "binary_threshold": self.threshold,
            "metrics": self.metrics,
            "quality": self.quality,
            "fallback": self.fallback,
            "error": self.error,
            "tables": [n for n in ("search", "importance") if getattr(self, n) is not None],
            "seed": DEFAULT_SEED,
            "created_at": _dt.datetime.now(_dt.timezone.utc).isoformat(),
        }

    # ---- persistence (S14) ----------------------------------------------------------
    def save(self, path: str) -> None:
        self.pre.save(path + "/preprocessor")
        self.model.write().overwrite().save(path + "/model")
        _save_tables(path, search=self.search, importance=self.importance)
        _save_meta(path, self.meta())

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "FittedRun":
        try:
            meta = json.loads(spark.read.json(path + "/meta").first()["meta"])
            pre = prep.Preprocessor.load(spark, path + "/preprocessor")
            model = load_model(meta["model_class"], path + "/model")
        except Exception as exc:
            raise InputError(
                f"Model folder '{path}' is incomplete: model, preprocessor and metadata must all be present."
            ) from exc
        return cls(pre, model, meta["model_name"], meta.get("binary_threshold"), meta.get("metrics") or {},
                   _load_table(spark, path, meta, "search"), _load_table(spark, path, meta, "importance"), meta.get("quality"),
                   meta.get("dataset_type", "tabular"), meta.get("fallback", False), meta.get("error"))


def _save_tables(path: str, **tables: DataFrame | None) -> None:
    """The run's small result tables beside its model."""
    for name, df in tables.items():
        if df is not None:
            df.coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")


def _load_table(spark: SparkSession, path: str, meta: dict, name: str) -> DataFrame | None:
    return spark.read.parquet(f"{path}/{name}") if name in meta.get("tables", []) else None


def _save_meta(path: str, meta: dict) -> None:
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").json(path + "/meta")


def load_model(class_name: str, path: str) -> Model:
    """A saved Spark ML model, or one of this package's own."""
    own = {c.__name__: c for c in (CalibratedSVCModel, OneVsRestBoostingModel, ReluNetModel)}
    return own.get(class_name, getattr(C, class_name, None)).load(path)


def assemble(df: DataFrame, feature_columns: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=feature_columns, outputCol=FEATURES, handleInvalid="keep").transform(df)


def feature_table(pre: prep.Preprocessor, df: DataFrame, keep: list[str]) -> DataFrame:
    """Encoded, scaled, assembled rows with the target index as ``label``."""
    labelled = pre.encode_target(df, LABEL)
    scaled = pre.transform(labelled, keep=[*keep, LABEL])
    return assemble(scaled, pre.feature_columns)


def metrics_from_cells(cells: list[tuple[int, int, int]]) -> dict:
    """Accuracy, weighted precision/recall/F1 and balanced accuracy from confusion cells."""
    labels = sorted({t for t, _, _ in cells} | {p for _, p, _ in cells})
    n = sum(c for _, _, c in cells)
    tp = {k: 0 for k in labels}
    sup = {k: 0 for k in labels}
    prd = {k: 0 for k in labels}
    for t, p, c in cells:
        sup[t] += c
        prd[p] += c
        if t == p:
            tp[t] += c
    prec = {k: (tp[k] / prd[k] if prd[k] else 0.0) for k in labels}
    rec = {k: (tp[k] / sup[k] if sup[k] else 0.0) for k in labels}
    f1 = {k: (2 * prec[k] * rec[k] / (prec[k] + rec[k]) if prec[k] + rec[k] else 0.0) for k in labels}
    present = [k for k in labels if sup[k] > 0]
    full = {(t, p): 0 for t in labels for p in labels}
    for t, p, c in cells:
        full[(t, p)] = c
    return {
        "accuracy": sum(tp.values()) / n if n else None,
        "precision": sum(prec[k] * sup[k] for k in labels) / n if n else None,
        "recall": sum(rec[k] * sup[k] for k in labels) / n if n else None,
        "f1": sum(f1[k] * sup[k] for k in labels) / n if n else None,
        "balanced_accuracy": sum(rec[k] for k in present) / len(present) if present else None,
        "confusion": [(t, p, c) for (t, p), c in sorted(full.items())],  # K×K, K ≤ 50
    }


def holdout_metrics(pred: DataFrame) -> dict:
    """Hold-out metrics (A18-A21) from ONE aggregate: the ≤ K² confusion cells."""
    p = pred.select(F.col(LABEL).cast("int").alias("y"), F.col("pred").cast("int").alias("p"))
    cells = [(int(r["true_class"]), int(r["pred_class"]), int(r["n"])) for r in evaluate.confusion_long(p, "y", "p").collect()]
    return metrics_from_cells(cells)


def fit_winner(cand: models.Candidate, data: DataFrame, key_cols: list[str], n_classes: int,
               seed: int = DEFAULT_SEED, class_weights: bool = False):
    """Stratified 20 % hold-out, fit on the rest, score the hold-out (M6)."""
    flagged = split.stratified_holdout(data, LABEL, key_cols, seed=seed).persist()
    train = flagged.where(~F.col("is_test"))
    test = flagged.where(F.col("is_test"))
    est = cand.build(_n_features(data), n_classes, n_rows=train.count() if cand.l2 is not None else None)
    if class_weights:
        w = prep.class_weights(train, LABEL).select(F.col("class_name").alias("_c"), F.col("weight").alias("_w"))
        train = train.join(F.broadcast(w), train[LABEL].cast("string") == F.col("_c"), "left").drop("_c")
        if est.hasParam("weightCol"):
            est = est.setWeightCol("_w")
    model = est.fit(train)
    pred = models.with_proba(model, test)
    return model, pred, flagged


def _n_features(data: DataFrame) -> int:
    meta = data.schema[FEATURES].metadata
    attrs = meta.get("ml_attr", {}).get("num_attrs")
    if attrs:
        return int(attrs)
    return int(data.select(FEATURES).first()[0].size)


def train_tabular(
    df: DataFrame,
    target: str,
    key_cols: list[str],
    candidates: list[models.Candidate] | None = None,
    search: bool = True,
    time_budget_sec: float | None = models.DEFAULT_TIME_BUDGET_SEC,
    manual: str | None = None,
    threshold_strategy: str = "youden",
    threshold_on: str = "holdout",
    importance: bool = True,
    quality_check: bool = True,
    seed: int = DEFAULT_SEED,
    save_path: str | None = None,
    registry_path: str | None = None,
) -> FittedRun:
    """The training composition (M10); saved to ``save_path`` and entered in the
    runs table ``registry_path`` if given.  A failed search leaves its error in
    the result's ``error``; ``fallback`` tells that no search winner was fitted."""
    df = validate.dedupe_columns(df)
    validate.require_min_rows(df, validate.MIN_TRAIN_ROWS)
    n_classes = validate.validate_target(df, target)
    validate.reject_null_target(df, target)
    qual = None
    if quality_check:
        q = quality.summarize_quality(df, target).first()
        qual = {"passed": bool(q["passed"]), "n_issues": int(q["n_issues"]), "summary": q["summary"]}
    if not key_cols:
        raise InputError("key_cols must name a stable row key for reproducible splits.")
    pre = prep.fit_preprocess(df, target)
    # the row key travels as one extra column, whether or not its parts are features
    keyed = df.withColumn(ROW_KEY, key_string(key_cols, seed))
    keep = [ROW_KEY]
    data = feature_table(pre, keyed, keep).persist()
    n_rows = data.count()
    n_features = len(pre.feature_columns)
    cands = candidates or models.tabular_candidates(n_rows)
    winner = None
    results = None
    fallback, error = False, None
    if search:
        try:
            name, _score, results = models.successive_halving(
                cands, data, LABEL, keep, n_features, time_budget_sec=time_budget_sec, seed=seed
            )
            winner = next((c for c in cands if c.name == name), None)
            if winner is None and cands:
                winner, fallback = cands[0], True  # no stage-3 survivor: first candidate (M7)
        except Exception as exc:
            winner, fallback, error = models.fallback_candidate(), True, str(exc)  # search failed (M7)
    else:
        winner = models.select_candidate(cands, "tabular", n_features, n_rows, manual)
    model, pred, flagged = fit_winner(winner, data, keep, n_classes, seed)
    metrics = holdout_metrics(pred)
    threshold = None
    if n_classes == 2:
        scored = pred if threshold_on == "holdout" else models.with_proba(model, data)
        t, _m, auc = evaluate.optimize_threshold(
            scored.select(F.col(LABEL).cast("int").alias("y"), F.element_at("proba", 2).alias("s")), "y", "s",
            threshold_strategy,
        )
        threshold, metrics["auc"] = t, auc
    imp = None
    if importance:
        from tabsight.operators.explain import permutation_importance

        imp = permutation_importance(model, flagged.where(F.col("is_test")), pre.feature_columns, keep, seed=seed)
    flagged.unpersist()
    data.unpersist()
    run = FittedRun(pre, model, winner.name, threshold, metrics, results, imp, qual, fallback=fallback, error=error)
    if save_path is not None:
        run.save(save_path)
        if registry_path is not None:
            register_run(df.sparkSession, registry_path, save_path, run.meta())
    return run


def predict_batch(run: FittedRun, df: DataFrame, key_col: str | None = None, detail: bool = True) -> DataFrame:
    """Score a table lazily (M11): transform → model → threshold → class names.

    Extra columns are ignored; missing feature columns raise (Q3).
    """
    # the key travels under its own name, even when it is also a feature
    src = df.withColumn("_key", F.col(key_col)) if key_col else df.withColumn("_key", F.lit(None).cast("long"))
    scaled = run.pre.transform(src, keep=["_key"])
    scored = models.with_proba(run.model, assemble(scaled, run.pre.feature_columns))
    k = len(run.classes)
    if k == 2 and run.threshold is not None:
        scored = scored.withColumn("pred", evaluate.apply_threshold(F.col("proba"), run.threshold, 2))
    if detail:
        return prediction_detail(scored, "_key", "pred", "proba", run.classes)
    return scored.select(F.col("_key").alias("sample_index"), "pred", "proba",
                         run.pre.decode_target("pred", "predicted_class"))


# ---------------------------------------------------------------------------
# text (the text branch of M10 / M11)
# ---------------------------------------------------------------------------

@dataclass
class FittedTextRun:
    """TF-IDF vocabulary + classifier + class list for labelled text."""

    tfidf: object  # text.TfidfModel
    model: Model
    model_name: str
    classes: list[str]
    metrics: dict = field(default_factory=dict)
    search: DataFrame | None = None
    fallback: bool = False
    error: str | None = None

    def meta(self) -> dict:
        return {
            "model_name": self.model_name,
            "model_class": type(self.model).__name__,
            "dataset_type": "text",
            "class_names": self.classes,
            "metrics": self.metrics,
            "n_docs": self.tfidf.n_docs,
            "tables": ["search"] if self.search is not None else [],
            "fallback": self.fallback,
            "error": self.error,
            "seed": DEFAULT_SEED,
            "created_at": _dt.datetime.now(_dt.timezone.utc).isoformat(),
        }

    def save(self, path: str) -> None:
        self.tfidf.terms.write.mode("overwrite").parquet(path + "/tfidf_terms")
        self.model.write().overwrite().save(path + "/model")
        _save_tables(path, search=self.search)
        _save_meta(path, self.meta())

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "FittedTextRun":
        from tabsight.operators.text import TfidfModel

        try:
            meta = json.loads(spark.read.json(path + "/meta").first()["meta"])
            terms = spark.read.parquet(path + "/tfidf_terms")
            model = load_model(meta["model_class"], path + "/model")
        except Exception as exc:
            raise InputError(f"Model folder '{path}' is incomplete: model, vocabulary and metadata must all be present.") from exc
        return cls(TfidfModel(terms, int(meta["n_docs"])), model, meta["model_name"], meta["class_names"], meta.get("metrics") or {},
                   _load_table(spark, path, meta, "search"), meta.get("fallback", False), meta.get("error"))


def train_text(
    df: DataFrame,
    key_col: str,
    text_col: str,
    label_col: str,
    candidates: list[models.Candidate] | None = None,
    search: bool = True,
    time_budget_sec: float | None = models.DEFAULT_TIME_BUDGET_SEC,
    seed: int = DEFAULT_SEED,
    save_path: str | None = None,
    registry_path: str | None = None,
) -> FittedTextRun:
    """Labelled text → cleaned text → TF-IDF → search → hold-out fit and metrics;
    saved and entered in the runs table like a tabular run, with the same ``fallback`` and ``error``."""
    from tabsight.operators import text as T

    base = df.select(F.col(key_col), F.col(text_col).alias("_text"), F.col(label_col).cast("string").alias("_label"))
    validate.require_min_rows(base, 2, "text dataset")
    n_classes = validate.validate_target(base, "_label")
    validate.reject_null_target(base, "_label")
    cleaned = base.withColumn("_text", T.clean_text(F.col("_text")))
    T.require_some_text(cleaned, "_text")
    classes = sorted(r[0] for r in cleaned.select("_label").distinct().collect())  # ≤ 50, validated
    # texts folded and written once feed both the fit and the vectors
    tf = T.checkpointed_term_counts(cleaned, key_col, "_text")
    tfidf = T.fit_tfidf(cleaned, key_col, "_text", tf=tf)
    vec = tfidf.vectors(cleaned, key_col, "_text", tf=tf)
    lab = cleaned.select(key_col, (F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("_label")) - 1)
                         .cast("double").alias(LABEL))
    data = vec.join(lab, key_col).withColumn(ROW_KEY, F.col(key_col).cast("string")).persist()
    n_features = tfidf._size()
    cands = candidates or models.text_candidates()
    results, winner = None, cands[0]
    fallback, error = False, None
    if search:
        try:
            name, _s, results = models.successive_halving(cands, data, LABEL, [ROW_KEY], n_features,
                                                          time_budget_sec=time_budget_sec, seed=seed)
            fallback = name is None  # no stage-3 survivor: first candidate (M7)
            winner = next((c for c in cands if c.name == name), cands[0])
        except Exception as exc:
            winner, fallback, error = models.fallback_candidate(), True, str(exc)  # search failed (M7)
    model, pred, flagged = fit_winner(winner, data, [ROW_KEY], n_classes, seed)
    metrics = holdout_metrics(pred)
    flagged.unpersist()
    data.unpersist()
    run = FittedTextRun(tfidf, model, winner.name, classes, metrics, results, fallback, error)
    if save_path is not None:
        run.save(save_path)
        if registry_path is not None:
            register_run(df.sparkSession, registry_path, save_path, run.meta())
    return run


def predict_text(run: FittedTextRun, df: DataFrame, key_col: str, text_col: str) -> DataFrame:
    """Score texts with the fitted vocabulary and model (text branch of M11)."""
    from tabsight.operators import text as T

    cleaned = df.select(F.col(key_col), T.clean_text(F.col(text_col)).alias("_text"))
    vec = run.tfidf.vectors(cleaned, key_col, "_text")
    scored = models.with_proba(run.model, vec)
    names = F.array(*[F.lit(c) for c in run.classes])
    return scored.select(
        F.col(key_col).alias("sample_index"), "pred", F.element_at(names, F.col("pred") + 1).alias("predicted_class"),
        F.array_max("proba").alias("confidence"),
    )
