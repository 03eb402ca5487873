"""Evaluation: confusion matrix, metrics, ROC and decision thresholds
(A18-A21, E1-E3, F12-F14).

Every metric derives from the long confusion table (one row per
(true, predicted) pair that occurs), which is tiny after one aggregate.  ROC
work runs over distinct scores, and its cumulative counts come from
:func:`running_totals`, never from a single-task global window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsight.operators.ranking import running_totals

# Fixed values.
DEFAULT_THRESHOLD = 0.5


# ---- decoding -------------------------------------------------------------------

def argmax(proba: Column) -> Column:
    """Index of the largest probability, first on ties."""
    return (F.array_position(proba, F.array_max(proba)) - 1).cast("int")


def apply_threshold(proba: Column, threshold: float, num_classes: int) -> Column:
    """Binary: p[positive] > t (strict); more classes: argmax.

    A one-element array is read as the positive-class score.
    """
    if num_classes > 2:
        return argmax(proba)
    positive = F.when(F.size(proba) == 1, F.element_at(proba, 1)).otherwise(F.element_at(proba, 2))
    return F.when(positive > F.lit(float(threshold)), F.lit(1)).otherwise(F.lit(0))


def one_hot_proba(pred: Column, num_classes: int) -> Column:
    """Pseudo-probabilities for classifiers without scores."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(num_classes - 1)),
        lambda i: F.when(i == pred, F.lit(1.0)).otherwise(F.lit(0.0)),
    )


# ---- confusion-matrix family ---------------------------------------------------------

def confusion_long(df: DataFrame, y_true: str, y_pred: str) -> DataFrame:
    """Observed ``(true_class, pred_class, n)`` cells, one aggregate."""
    return df.groupBy(F.col(y_true).alias("true_class"), F.col(y_pred).alias("pred_class")).agg(
        F.count(F.lit(1)).alias("n")
    )


def confusion_matrix(df: DataFrame, y_true: str, y_pred: str) -> DataFrame:
    """Zero-filled confusion matrix over labels seen in y_true ∪ y_pred.

    The label set is bounded by the class limit, so the K×K grid is built
    from the collected label list and joined to the observed cells.
    """
    cells = confusion_long(df, y_true, y_pred)
    labels = sorted(
        {r[0] for r in cells.select("true_class").distinct().collect()}
        | {r[0] for r in cells.select("pred_class").distinct().collect()},
        key=lambda v: (v is None, v),
    )
    spark = df.sparkSession
    dtype = cells.schema["true_class"].dataType
    from pyspark.sql.types import StructField, StructType

    schema = StructType([StructField("true_class", dtype), StructField("pred_class", dtype)])
    grid = spark.createDataFrame([(a, b) for a in labels for b in labels], schema)
    return grid.join(cells, ["true_class", "pred_class"], "left").select(
        "true_class", "pred_class", F.coalesce(F.col("n"), F.lit(0)).alias("n")
    )


def per_class(cells: DataFrame) -> DataFrame:
    """``class_name, tp, support, predicted, precision, recall, f1`` from cells."""
    truth = cells.groupBy(F.col("true_class").alias("class_name")).agg(
        F.sum("n").alias("support"), F.sum(F.when(F.col("true_class") == F.col("pred_class"), F.col("n")).otherwise(0)).alias("tp")
    )
    pred = cells.groupBy(F.col("pred_class").alias("class_name")).agg(F.sum("n").alias("predicted"))
    both = truth.join(pred, "class_name", "full_outer").select(
        "class_name",
        F.coalesce("tp", F.lit(0)).alias("tp"),
        F.coalesce("support", F.lit(0)).alias("support"),
        F.coalesce("predicted", F.lit(0)).alias("predicted"),
    )
    precision = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(F.lit(0.0))
    recall = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    out = both.withColumn("precision", precision).withColumn("recall", recall)
    f1 = F.when(
        F.col("precision") + F.col("recall") > 0,
        F.lit(2.0) * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")),
    ).otherwise(F.lit(0.0))
    return out.withColumn("f1", f1)


def core_metrics(df: DataFrame, y_true: str, y_pred: str) -> DataFrame:
    """One row: accuracy and support-weighted precision/recall/F1."""
    pc = per_class(confusion_long(df, y_true, y_pred))
    return pc.agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("precision"),
        (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("recall"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1"),
    )


def classification_report(df: DataFrame, y_true: str, y_pred: str) -> DataFrame:
    """Per-class rows plus ``macro avg`` and ``weighted avg``."""
    pc = per_class(confusion_long(df, y_true, y_pred))
    rows = pc.select(
        F.col("class_name").cast("string").alias("class_name"), "precision", "recall", "f1", "support"
    )
    macro = pc.agg(
        F.lit("macro avg").alias("class_name"),
        F.avg("precision").alias("precision"),
        F.avg("recall").alias("recall"),
        F.avg("f1").alias("f1"),
        F.sum("support").alias("support"),
    )
    weighted = pc.agg(
        F.lit("weighted avg").alias("class_name"),
        (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("precision"),
        (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("recall"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1"),
        F.sum("support").alias("support"),
    )
    return rows.unionByName(macro).unionByName(weighted)


def balanced_accuracy(df: DataFrame, y_true: str, y_pred: str) -> DataFrame:
    """Mean recall over classes present in y_true."""
    pc = per_class(confusion_long(df, y_true, y_pred))
    return pc.where(F.col("support") > 0).agg(F.avg("recall").alias("balanced_accuracy"))


# ---- ROC and thresholds ---------------------------------------------------------------

def score_counts(df: DataFrame, y_true: str, score: str, round_digits: int | None = None) -> DataFrame:
    """``score, pos, neg`` per distinct score (optionally rounded)."""
    s = F.col(score).cast("double")
    if round_digits is not None:
        s = F.round(s, round_digits)
    y = F.col(y_true).cast("int")
    return df.where(F.col(score).isNotNull() & F.col(y_true).isNotNull()).groupBy(s.alias("score")).agg(
        F.sum(F.when(y == 1, 1).otherwise(0)).cast("long").alias("pos"),
        F.sum(F.when(y == 1, 0).otherwise(1)).cast("long").alias("neg"),
    )


def _cumulative(counts: DataFrame) -> DataFrame:
    """Counts at or above each distinct score, with class totals as literals."""
    tot = counts.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N")).first()  # two numbers
    cum = running_totals(counts, [F.col("score").desc()], ["pos", "neg"])
    return cum.withColumn("P", F.lit(int(tot["P"] or 0))).withColumn("N", F.lit(int(tot["N"] or 0)))


def roc_curve(df: DataFrame, y_true: str, score: str, round_digits: int | None = None) -> DataFrame:
    """ROC points ``threshold, tps, fps, tpr, fpr`` at every distinct score.

    Predict positive when score ≥ threshold.  The origin row has a null
    threshold (the infinite one).
    """
    cum = _cumulative(score_counts(df, y_true, score, round_digits))
    pts = cum.select(
        F.col("score").alias("threshold"),
        F.col("cum_pos").alias("tps"),
        F.col("cum_neg").alias("fps"),
        F.try_divide(F.col("cum_pos"), F.col("P")).alias("tpr"),
        F.try_divide(F.col("cum_neg"), F.col("N")).alias("fpr"),
    )
    origin = df.sparkSession.createDataFrame(
        [(None, 0, 0, 0.0, 0.0)], "threshold double, tps long, fps long, tpr double, fpr double"
    )
    return origin.unionByName(pts)


def threshold_summary(df: DataFrame, y_true: str, score: str, round_digits: int | None = None) -> DataFrame:
    """One row: ``auc, youden_threshold, youden_j, f1_threshold, f1, n_pos, n_neg``.

    AUC by trapezoids needs no lag: the previous point of a score is its own
    cumulative count minus its own count.  Youden keeps the highest score on
    ties (the origin counts as +inf and clips to 1); F1 sweeps {0, 1} ∪ scores
    and keeps the lowest threshold on ties, skipping one-sided predictions.
    Empty input or a single class gives (0.5, 0.0) and AUC 0.5.
    """
    counts = score_counts(df, y_true, score, round_digits)
    extra = df.sparkSession.createDataFrame([(0.0, 0, 0), (1.0, 0, 0)], "score double, pos long, neg long")
    grid = counts.unionByName(extra).groupBy("score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    cum = _cumulative(grid)
    P = F.col("P").cast("double")
    N = F.col("N").cast("double")
    tp, fp = F.col("cum_pos"), F.col("cum_neg")
    # try_divide: a single-class input has P or N = 0 (ANSI mode raises on /0)
    area = F.try_divide(F.col("neg"), N) * F.try_divide(F.lit(2.0) * tp - F.col("pos"), F.lit(2.0) * P)
    j = F.try_divide(tp, P) - F.try_divide(fp, N)
    # sweep candidates are the scores that occur, plus 0 and 1
    real = (F.col("pos") + F.col("neg")) > 0
    f1 = F.try_divide(F.lit(2.0) * tp, F.lit(2.0) * tp + fp + (P - tp))
    both_sides = ((tp + fp) > 0) & ((tp + fp) < (P + N))
    agg = cum.agg(
        F.first("P").alias("P"),
        F.first("N").alias("N"),
        F.sum(area).alias("auc"),
        F.max(F.when(real, F.struct(j.alias("j"), F.col("score").alias("s")))).alias("yj"),
        F.max(F.when(both_sides, F.struct(f1.alias("f1"), (-F.col("score")).alias("ns")))).alias("bf"),
    )
    valid = (F.col("P") > 0) & (F.col("N") > 0)
    yj_wins = F.col("yj.j") > 0  # the origin (J = 0, threshold +inf) wins ties at 0
    return agg.select(
        F.when(valid, F.col("auc")).otherwise(F.lit(0.5)).alias("auc"),
        F.when(valid & yj_wins, F.least(F.greatest(F.col("yj.s"), F.lit(0.0)), F.lit(1.0)))
        .when(valid, F.lit(1.0))
        .otherwise(F.lit(DEFAULT_THRESHOLD))
        .alias("youden_threshold"),
        F.when(valid & yj_wins, F.col("yj.j")).otherwise(F.lit(0.0)).alias("youden_j"),
        F.when(valid & F.col("bf").isNotNull(), F.least(F.greatest(-F.col("bf.ns"), F.lit(0.0)), F.lit(1.0)))
        .otherwise(F.lit(DEFAULT_THRESHOLD))
        .alias("f1_threshold"),
        F.when(valid, F.coalesce(F.col("bf.f1"), F.lit(-1.0))).otherwise(F.lit(0.0)).alias("f1"),
        F.coalesce(F.col("P"), F.lit(0)).alias("n_pos"),
        F.coalesce(F.col("N"), F.lit(0)).alias("n_neg"),
    )


def optimize_threshold(df: DataFrame, y_true: str, score: str, strategy: str = "youden") -> tuple[float, float, float]:
    """``(threshold, metric, auc)`` like the reference's contract."""
    row = threshold_summary(df, y_true, score).first()
    strategy = (strategy or "").lower().strip()
    if row is None or row["n_pos"] == 0 or row["n_neg"] == 0:
        return DEFAULT_THRESHOLD, 0.0, 0.5
    if strategy == "f1":
        return float(row["f1_threshold"]), float(row["f1"]), float(row["auc"])
    return float(row["youden_threshold"]), float(row["youden_j"]), float(row["auc"])
