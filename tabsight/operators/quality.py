"""Data-quality gates.

Plans, not loops: all categorical features share one unpivot and one
``groupBy(feature, value, target)`` shuffle; all numeric features share one
aggregate for their correlations; id/constant gates read the profile.
Warnings come back as a DataFrame
``gate, seq, column_name, class_name, issue, metric, value, detail``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabsight.errors import InputError
from tabsight.functions.exprs import col, is_id_like_type, is_numeric_type, nan_to_null
from tabsight.operators.profile import PROFILE_SCHEMA, profile_columns

# Gate thresholds.
PEARSON_THRESHOLD = 0.95
CRAMERS_V_THRESHOLD = 0.95
IMBALANCE_THRESHOLD = 0.05
MIN_PAIRS = 5
NUMERIC_TEXT = r"^\s*[+-]?((\d+(\.\d*)?)|(\.\d+))([eE][+-]?\d+)?\s*$|(?i)^\s*[+-]?(nan|inf|infinity)\s*$"
ISSUE_NAMES = {
    "feature_leakage": "Leakage",
    "id_column": "ID columns",
    "constant_column": "Constant columns",
    "class_imbalance": "Imbalanced classes",
}

WARNING_SCHEMA = (
    "gate int, seq int, column_name string, class_name string, issue string, "
    "metric string, value double, detail string"
)


def _check_target(df: DataFrame, target: str) -> None:
    if target not in df.columns:
        raise InputError(f"Target column '{target}' not found; available columns: {df.columns}")


def value_counts(df: DataFrame, target: str) -> DataFrame:
    """Class counts and shares over non-null target rows (A5).

    ``class_name, n, fraction``.
    """
    _check_target(df, target)
    y = col(target).cast("string")
    counts = df.where(col(target).isNotNull()).groupBy(y.alias("class_name")).agg(F.count(F.lit(1)).alias("n"))
    # one row: the sum of the same counts, whose exchange Spark reuses; no second scan, no global window
    total = counts.agg(F.sum("n").alias("_total"))
    return counts.join(F.broadcast(total)).select("class_name", "n", (F.col("n") / F.col("_total")).alias("fraction"))


def _categorical_features(df: DataFrame, target: str, features: list[str] | None) -> list[str]:
    names = features if features is not None else [c for c in df.columns if c != target]
    return [c for c in names if not is_numeric_type(df.schema[c].dataType)]


def _numeric_features(df: DataFrame, target: str, features: list[str] | None) -> list[str]:
    names = features if features is not None else [c for c in df.columns if c != target]
    return [c for c in names if is_numeric_type(df.schema[c].dataType)]


def contingency(df: DataFrame, target: str, features: list[str] | None = None) -> DataFrame:
    """Long-form crosstab of every categorical feature with the target.

    ``feature, f, t, n``: one unpivot, one shuffle for all features; pairs
    with a null on either side are dropped.  Never a wide pivot.
    """
    _check_target(df, target)
    feats = _categorical_features(df, target, features)
    if not feats:
        return df.sparkSession.createDataFrame([], "feature string, f string, t string, n long")
    pairs = F.explode(
        F.array(*[F.struct(F.lit(c).alias("feature"), col(c).cast("string").alias("f")) for c in feats])
    )
    long = df.select(col(target).cast("string").alias("__t"), pairs.alias("__p")).select(
        "__p.feature", "__p.f", F.col("__t").alias("t")
    )
    long = long.where(F.col("f").isNotNull() & F.col("t").isNotNull())
    return long.groupBy("feature", "f", "t").agg(F.count(F.lit(1)).alias("n"))


def cramers_v(cells: DataFrame) -> DataFrame:
    """Cramér's V per feature from long-form cells.

    χ² over all r×k cells = n·(Σ o²/(R·C) − 1) (absent cells add nothing to
    Σ o²/e).  For 2×2 tables the continuity correction applies: every cell has
    the same |o−e| = D, so χ² = max(D − ½, 0)²·n³/(R₁R₂C₁C₂).
    Returns ``feature, n, r, k, chi2, v``.
    """
    # Row margins by a window per (feature, value): each holds at most k cells.
    # Column margins come from a (feature, target-value) aggregate - at most
    # features × classes rows - joined back, so a high-cardinality feature
    # never puts all cells of one class into one task.  r and k count the
    # first cell of each row / column, keeping the per-feature aggregate
    # algebraic (it combines map-side).
    wr = Window.partitionBy("feature", "f")
    colm = cells.groupBy("feature", "t").agg(F.sum("n").alias("C"), F.min("f").alias("_fmin"))
    # colm is features × target values: small for a class target, so the
    # planner broadcasts it by its measured size (AQE); a huge one is shuffled
    marg = cells.join(colm, ["feature", "t"]).select(
        "feature", "f", "t", "n",
        F.sum("n").over(wr).alias("R"),
        "C",
        (F.col("t") == F.min("t").over(wr)).alias("row_head"),
        (F.col("f") == F.col("_fmin")).alias("col_head"),
    )
    per = marg.groupBy("feature").agg(
        F.sum("n").alias("n"),
        F.count(F.when(F.col("row_head"), F.lit(1))).alias("r"),
        F.count(F.when(F.col("col_head"), F.lit(1))).alias("k"),
        F.sum(F.col("n").cast("double") * F.col("n") / (F.col("R").cast("double") * F.col("C"))).alias("s"),
        (F.min("R").cast("double") * F.max("R") * F.min("C") * F.max("C")).alias("p"),
    )
    n = F.col("n").cast("double")
    plain = n * (F.col("s") - F.lit(1.0))
    d = F.sqrt(F.greatest(F.col("s") - F.lit(1.0), F.lit(0.0)) * F.col("p")) / n
    yates = F.pow(F.greatest(d - F.lit(0.5), F.lit(0.0)), 2) * n * n * n / F.col("p")
    chi2 = (
        F.when((F.col("r") == 2) & (F.col("k") == 2), yates)
        .when((F.col("r") < 2) | (F.col("k") < 2), F.lit(0.0))
        .otherwise(F.greatest(plain, F.lit(0.0)))
    )
    denom = n * (F.least(F.col("r"), F.col("k")) - F.lit(1))
    v = F.when(denom > 0, F.sqrt(chi2 / denom)).otherwise(F.lit(0.0))
    return per.select("feature", "n", "r", "k", chi2.alias("chi2"), v.alias("v"))


def pearson_with_target(df: DataFrame, target: str, features: list[str] | None = None) -> DataFrame:
    """Pearson r of every numeric feature with the numeric-cast target.

    One unpivot of (feature, x, y) pairs and one ``groupBy(feature)``: the
    aggregate buffers combine map-side and the generated code stays small
    however many features there are.  ``r`` is null when fewer than five
    pairs, fewer than two target values, a non-numeric target value, or a
    constant side (no DIVIDE_BY_ZERO under ANSI).  Returns ``feature, n_pairs, r``.
    """
    _check_target(df, target)
    feats = _numeric_features(df, target, features)
    spark = df.sparkSession
    if not feats:
        return spark.createDataFrame([], "feature string, n_pairs long, r double")
    clean = nan_to_null(df.select(*[col(c) for c in feats + [target]]))
    y_raw = col(target)
    if is_numeric_type(df.schema[target].dataType):
        y_num = y_raw.cast("double")
    else:
        # a failed cast is costly: only values that look numeric are cast
        y_num = F.when(
            y_raw.rlike(NUMERIC_TEXT), F.expr(f"try_cast({'`' + target.replace('`', '``') + '`'} AS DOUBLE)")
        )
    # internal names carry a double-underscore prefix so user columns never clash
    base = clean.select(
        y_raw.alias("__y_raw"), y_num.alias("__y"), *[col(c).cast("double").alias(f"__x{i}") for i, c in enumerate(feats)]
    )
    pairs = base.select(
        "__y_raw",
        "__y",
        F.explode(F.array(*[F.struct(F.lit(c).alias("__f"), F.col(f"__x{i}").alias("__x")) for i, c in enumerate(feats)])).alias("__p"),
    ).select("__p.__f", "__p.__x", "__y", "__y_raw")
    pairs = pairs.where(F.col("__x").isNotNull() & F.col("__y_raw").isNotNull())
    stats = pairs.groupBy(F.col("__f").alias("feature")).agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.count("__y").alias("ny"),
        F.covar_pop("__x", "__y").alias("cv"),
        F.stddev_pop("__x").alias("sx"),
        F.stddev_pop("__y").alias("sy"),
        F.min("__y_raw").alias("ylo"),
        F.max("__y_raw").alias("yhi"),
    )
    valid = (
        (F.col("n_pairs") >= MIN_PAIRS)
        & (F.col("ylo") != F.col("yhi"))
        & (F.col("ny") == F.col("n_pairs"))
        & (F.col("sx") > 0)
        & (F.col("sy") > 0)
    )
    r = F.when(valid, F.try_divide(F.col("cv"), F.col("sx") * F.col("sy")))
    found = stats.select("feature", "n_pairs", r.alias("r"))
    # features without a single complete pair still get a row
    every = spark.createDataFrame([(c,) for c in feats], "feature string")
    return every.join(found, "feature", "left").select(
        "feature", F.coalesce(F.col("n_pairs"), F.lit(0)).cast("long").alias("n_pairs"), "r"
    )


def leakage_scores(df: DataFrame, target: str, features: list[str] | None = None) -> DataFrame:
    """``feature, metric, value`` for every feature that has a score."""
    num = pearson_with_target(df, target, features).where(F.col("r").isNotNull()).select(
        "feature", F.lit("pearson").alias("metric"), F.col("r").alias("value")
    )
    cells = contingency(df, target, features)
    cat = cramers_v(cells).where(F.col("n") >= MIN_PAIRS).select(
        "feature", F.lit("cramers_v").alias("metric"), F.col("v").alias("value")
    )
    return num.unionByName(cat)


def _ordinal_map(names: list[str]):
    return F.create_map(*[x for i, c in enumerate(names) for x in (F.lit(c), F.lit(i))])


def detect_leakage(df: DataFrame, target: str) -> DataFrame:
    """Gate: |r| > 0.95 or V > 0.95 (A9), as warning rows."""
    feats = [c for c in df.columns if c != target]
    scores = leakage_scores(df, target, feats)
    flagged = scores.where(F.abs(F.col("value")) > F.when(F.col("metric") == "pearson", PEARSON_THRESHOLD).otherwise(CRAMERS_V_THRESHOLD))
    detail = F.when(
        F.col("metric") == "pearson",
        F.format_string(f"correlation %.4f with the target; limit {PEARSON_THRESHOLD}", F.col("value")),
    ).otherwise(F.format_string("association V %.4f with the target", F.col("value")))
    return flagged.select(
        F.lit(0).alias("gate"),
        F.element_at(_ordinal_map(feats), F.col("feature")).cast("int").alias("seq"),
        F.col("feature").alias("column_name"),
        F.lit(None).cast("string").alias("class_name"),
        F.lit("feature_leakage").alias("issue"),
        "metric",
        "value",
        detail.alias("detail"),
    )


def leakage_report(
    df: DataFrame,
    target: str,
    numeric_threshold: float = PEARSON_THRESHOLD,
    categorical_threshold: float = CRAMERS_V_THRESHOLD,
) -> DataFrame:
    """Thresholded leakage flags ``feature, metric, value, threshold`` (A10)."""
    feats = [c for c in df.columns if c != target]
    scores = leakage_scores(df, target, feats)
    thr = F.when(F.col("metric") == "pearson", F.lit(float(numeric_threshold))).otherwise(F.lit(float(categorical_threshold)))
    return scores.where(F.abs(F.col("value")) > thr).select(
        "feature", "metric", F.round("value", 4).alias("value"), thr.alias("threshold")
    )


def detect_id_columns(df: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    """Integer/string columns with a distinct value per row, more than 8 rows."""
    prof = profile if profile is not None else profile_columns(df)
    idlike = [f.name for f in df.schema.fields if is_id_like_type(f.dataType)]
    flagged = prof.where(
        (F.col("n_unique") == F.col("n_rows")) & (F.col("n_rows") > 8) & F.col("column_name").isin(idlike)
    )
    return flagged.select(
        F.lit(2).alias("gate"),
        F.col("ordinal").alias("seq"),
        "column_name",
        F.lit(None).cast("string").alias("class_name"),
        F.lit("id_column").alias("issue"),
        F.lit("n_unique").alias("metric"),
        F.col("n_unique").cast("double").alias("value"),
        F.format_string("one %s value per row, as a row key has", F.col("dtype")).alias("detail"),
    )


def detect_constant_columns(df: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    """Columns with at most one distinct non-null value."""
    prof = profile if profile is not None else profile_columns(df)
    return prof.where(F.col("n_unique") <= 1).select(
        F.lit(3).alias("gate"),
        F.col("ordinal").alias("seq"),
        "column_name",
        F.lit(None).cast("string").alias("class_name"),
        F.lit("constant_column").alias("issue"),
        F.lit("n_unique").alias("metric"),
        F.col("n_unique").cast("double").alias("value"),
        F.lit("no two different values").alias("detail"),
    )


def detect_imbalance(df: DataFrame, target: str, threshold: float = IMBALANCE_THRESHOLD) -> DataFrame:
    """Classes below 5 % of the non-null target rows."""
    vc = value_counts(df, target)
    # one warning per class, so no ordering inside the gate is needed
    return vc.where(F.col("fraction") < threshold).select(
        F.lit(1).alias("gate"),
        F.lit(0).alias("seq"),
        F.lit(None).cast("string").alias("column_name"),
        "class_name",
        F.lit("class_imbalance").alias("issue"),
        F.lit("fraction").alias("metric"),
        F.col("fraction").alias("value"),
        F.format_string(
            "class %s: %d rows, %.1f%%; limit %d%%",
            F.col("class_name"), F.col("n"), F.col("fraction") * 100, F.lit(int(round(threshold * 100))),
        ).alias("detail"),
    )


def quality_warnings(df: DataFrame, target: str | None = None) -> DataFrame:
    """All gates, unioned (U1) and de-duplicated on (column or class, issue).

    The first warning in gate order (leakage, imbalance, id, constant) wins;
    ``row_number`` makes the survivor deterministic.
    """
    # one row per column (bounded by the schema): computed once, reused by two gates
    spark = df.sparkSession
    prof = spark.createDataFrame(profile_columns(df).collect(), PROFILE_SCHEMA)
    parts = []
    if target is not None and target in df.columns:
        parts += [detect_leakage(df, target), detect_imbalance(df, target)]
    parts += [detect_id_columns(df, prof), detect_constant_columns(df, prof)]
    allw = parts[0]
    for p in parts[1:]:
        allw = allw.unionByName(p)
    key = F.coalesce(F.col("column_name"), F.col("class_name"))
    w = Window.partitionBy(key, F.col("issue")).orderBy("gate", "seq")
    return allw.withColumn("_k", F.row_number().over(w)).where(F.col("_k") == 1).drop("_k")


def summarize_quality(df: DataFrame, target: str | None = None) -> DataFrame:
    """One row ``passed, n_issues, summary`` over the de-duplicated warnings."""
    warnings = quality_warnings(df, target)
    nice = F.create_map(*[x for k, v in ISSUE_NAMES.items() for x in (F.lit(k), F.lit(v))])
    agg = warnings.agg(
        F.count(F.lit(1)).alias("n_issues"),
        F.array_sort(F.collect_set(F.coalesce(F.element_at(nice, F.col("issue")), F.col("issue")))).alias("names"),
    )
    return agg.select(
        (F.col("n_issues") == 0).alias("passed"),
        "n_issues",
        F.when(F.col("n_issues") == 0, F.lit("no findings"))
        .otherwise(F.format_string("%d findings: %s", F.col("n_issues"), F.array_join("names", ", ")))
        .alias("summary"),
    )
