"""Training and scoring over vectors: embeddings, or features extracted from images.

The vectors are an array column. A run fits a head on them, is saved and loaded
like the other runs, and scores lazily. Image folders go through a feature
extractor once; the vectors are written, so neither folds nor the final fit
extract again.
"""

from __future__ import annotations

import datetime as _dt
import json
from dataclasses import dataclass, field

from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsight.errors import InputError
from tabsight.functions.exprs import DEFAULT_SEED, col
from tabsight.operators import evaluate, models, validate
from tabsight.operators.report import prediction_detail
from tabsight.plans.train import FEATURES, LABEL, ROW_KEY, _load_table, _save_meta, _save_tables, fit_winner, holdout_metrics, load_model
from tabsight.session import cut_lineage
from tabsight.sources.images import extract_features, image_class_gate, read_image_bytes, verify_images
from tabsight.sources.registry import register_run


@dataclass
class FittedVectorRun:
    """A classifier over vectors of one length, its classes and result rows."""

    model: Model
    model_name: str
    classes: list[str]
    dim: int
    threshold: float | None = None
    metrics: dict = field(default_factory=dict)
    search: DataFrame | None = None
    dataset_type: str = "vector"
    fallback: bool = False
    error: str | None = None

    def meta(self) -> dict:
        return {
            "model_name": self.model_name,
            "model_class": type(self.model).__name__,
            "dataset_type": self.dataset_type,
            "class_names": self.classes,
            "dim": self.dim,
            "binary_threshold": self.threshold,
            "metrics": self.metrics,
            "fallback": self.fallback,
            "error": self.error,
            "tables": ["search"] if self.search is not None else [],
            "seed": DEFAULT_SEED,
            "created_at": _dt.datetime.now(_dt.timezone.utc).isoformat(),
        }

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path + "/model")
        _save_tables(path, search=self.search)
        _save_meta(path, self.meta())

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "FittedVectorRun":
        try:
            meta = json.loads(spark.read.json(path + "/meta").first()["meta"])
            model = load_model(meta["model_class"], path + "/model")
        except Exception as exc:
            raise InputError(f"Model folder '{path}' is incomplete: model and metadata must both be present.") from exc
        return cls(model, meta["model_name"], meta["class_names"], meta["dim"], meta["binary_threshold"], meta["metrics"],
                   _load_table(spark, path, meta, "search"), meta["dataset_type"], meta["fallback"], meta["error"])


def _usable(vector: Column, dim: int) -> Column:
    """True for a vector of ``dim`` finite components; false for null."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == dim) & finite, F.lit(False))


def train_vectors(
    df: DataFrame,
    key_col: str,
    vector_col: str,
    label_col: str,
    candidates: list[models.Candidate] | None = None,
    search: bool = False,
    time_budget_sec: float | None = models.DEFAULT_TIME_BUDGET_SEC,
    seed: int = DEFAULT_SEED,
    save_path: str | None = None,
    registry_path: str | None = None,
    dataset_type: str = "vector",
) -> FittedVectorRun:
    """Fit a head on labelled vectors.

    Without ``search`` the first candidate is fitted. The usual length of the
    vectors is the run's; a row whose vector is null, of another length or holds
    null or non-finite components is an error, and so is a null label. A failed
    search leaves its error in ``error`` and the baseline is fitted.
    """
    validate.require_min_rows(df, validate.MIN_TRAIN_ROWS)
    n_classes = validate.validate_target(df, label_col)
    validate.reject_null_target(df, label_col)
    vector = col(vector_col).cast("array<double>")
    found = df.groupBy(F.size(vector).alias("n")).count().orderBy(F.col("count").desc(), F.col("n").desc()).first()
    dim = int(found["n"])
    bad = df.where(~_usable(vector, dim)).count()
    if bad or dim < 1:
        raise InputError(f"{bad} row(s) have no vector of {dim} finite numbers in '{vector_col}'.")
    classes = sorted(r[0] for r in df.select(col(label_col).cast("string")).distinct().collect())  # at most 50, validated
    names = F.array(*[F.lit(c) for c in classes])
    data = df.select(
        col(key_col).cast("string").alias(ROW_KEY), array_to_vector(vector).alias(FEATURES),
        (F.array_position(names, col(label_col).cast("string")) - 1).cast("double").alias(LABEL),
    ).persist()
    cands = candidates or models.vector_candidates()
    winner, results, fallback, error = cands[0], None, False, None
    if search:
        try:
            name, _score, results = models.successive_halving(
                cands, data, LABEL, [ROW_KEY], dim, time_budget_sec=time_budget_sec, seed=seed)
            winner = next((c for c in cands if c.name == name), None)
            if winner is None:
                winner, fallback = cands[0], True
        except Exception as exc:  # the baseline is fitted, and the error is kept
            winner, fallback, error = models.fallback_candidate(), True, str(exc)
    model, pred, flagged = fit_winner(winner, data, [ROW_KEY], n_classes, seed)
    metrics = holdout_metrics(pred)
    threshold = None
    if n_classes == 2:
        threshold, _m, metrics["auc"] = evaluate.optimize_threshold(
            pred.select(F.col(LABEL).cast("int").alias("y"), F.element_at("proba", 2).alias("s")), "y", "s", "youden")
    flagged.unpersist()
    data.unpersist()
    run = FittedVectorRun(model, winner.name, classes, dim, threshold, metrics, results, dataset_type, fallback, error)
    if save_path is not None:
        run.save(save_path)
        if registry_path is not None:
            register_run(df.sparkSession, registry_path, save_path, run.meta())
    return run


def predict_vectors(run: FittedVectorRun, df: DataFrame, key_col: str, vector_col: str) -> DataFrame:
    """Prediction rows of a table of vectors, lazily.

    A row without a usable vector of the run's length is left out; count the
    keys to find them.
    """
    vector = col(vector_col).cast("array<double>")
    rows = df.where(_usable(vector, run.dim)).select(col(key_col).alias("_key"), array_to_vector(vector).alias(FEATURES))
    scored = models.with_proba(run.model, rows)
    if len(run.classes) == 2 and run.threshold is not None:
        scored = scored.withColumn("pred", evaluate.apply_threshold(F.col("proba"), run.threshold, 2))
    return prediction_detail(scored, "_key", "pred", "proba", run.classes)


def _image_vectors(spark: SparkSession, root: str, fn, dim: int) -> DataFrame:
    """``path, embedding`` of every image that can be decoded."""
    plain = F.regexp_replace(F.col("path"), "^file:/*", "/")  # the two readers write local paths differently
    good = verify_images(spark, root).select(plain.alias("_plain"))
    images = read_image_bytes(spark, root).select("path", "content", plain.alias("_plain"))
    return extract_features(images.join(good, "_plain", "left_semi"), fn, dim)


def train_images(spark: SparkSession, root: str, fn, dim: int, **options) -> FittedVectorRun:
    """Train on a folder of image classes through the feature extractor ``fn``.

    ``fn`` is that of ``extract_features``. The class gate counts images that can be
    decoded; others are left out. ``options`` are those of :func:`train_vectors`.
    """
    labels = read_image_bytes(spark, root).select("path", "label")
    rows = cut_lineage(labels.join(_image_vectors(spark, root, fn, dim), "path"), "image-features")
    image_class_gate(rows)
    return train_vectors(rows, "path", "embedding", "label", dataset_type="image", **options)


def predict_images(run: FittedVectorRun, spark: SparkSession, root: str, fn) -> DataFrame:
    """Prediction rows of every image below ``root`` that can be decoded."""
    return predict_vectors(run, _image_vectors(spark, root, fn, run.dim), "path", "embedding")
