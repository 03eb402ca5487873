"""Kernel Shapley values against a clustered background.

The background is a weighted k-means summary. Shapley values are the solution of
a weighted least-squares problem over coalitions of features whose sum is held
to f(x) - f(background). All rows share the coalitions, hence the normal
equations: they are solved once, and a row's values are fixed linear
combinations of its coalition scores. Spark scores the hybrids of (row,
coalition, background centre) in one transform and sums them per row; a row's
hybrids are made in one task, so the sums combine before the shuffle.
"""

from __future__ import annotations

import json
from itertools import combinations
from math import comb

import numpy as np
from pyspark.ml import Model
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsight.errors import InputError
from tabsight.functions.exprs import DEFAULT_SEED, col
from tabsight.operators.models import with_proba_of_columns

BACKGROUND_CENTRES = 10
EXTRA_COALITIONS = 2048


def background_summary(
    rows: DataFrame, feature_columns: list[str], k: int = BACKGROUND_CENTRES, seed: int = DEFAULT_SEED
) -> list[tuple[float, list[float]]]:
    """At most ``k`` ``(weight, values)``: k-means centres of all rows, weights adding up to 1.

    Each value of a centre is moved to the nearest one the feature has, so
    category codes stay codes. Rows with a null or NaN feature are left out.
    """
    parts = rows.select(*[col(c).cast("double").alias(f"x{j}") for j, c in enumerate(feature_columns)])
    names = parts.columns
    data = VectorAssembler(inputCols=names, outputCol="features", handleInvalid="skip").transform(parts).persist()
    try:
        if data.isEmpty():
            raise InputError("The background has no row without missing features.")
        model = KMeans(k=k, seed=seed, maxIter=20).fit(data) if k > 1 else None
        centres = [c.tolist() for c in model.clusterCenters()] if model else [
            [data.agg(F.avg(n)).first()[0] for n in names]
        ]
        assigned = model.transform(data) if model else data.withColumn("prediction", F.lit(0))
        sizes = dict(assigned.groupBy("prediction").count().collect())  # at most k rows
        nearest = data.agg(*[
            F.min_by(n, F.struct(F.abs(F.col(n) - F.lit(v)), F.col(n))).alias(f"c{i}_{j}")
            for i, centre in enumerate(centres) for j, (n, v) in enumerate(zip(names, centre))
        ]).first()  # one row of k x features values
    finally:
        data.unpersist()
    total = sum(sizes.values())
    return [
        (sizes[i] / total, [nearest[f"c{i}_{j}"] for j in range(len(names))])
        for i in range(len(centres)) if sizes.get(i)
    ]


def coalitions(n_features: int, limit: int, seed: int = DEFAULT_SEED) -> tuple[np.ndarray, np.ndarray]:
    """Masks of proper coalitions and their kernel weights, each mask with its complement.

    Sizes are taken whole from the outside (1 and n-1, then 2 and n-2, ...) while
    they fit in ``limit``; what is left of it is drawn from the other sizes by
    their share of the weight, which the drawn masks divide.
    """
    if n_features < 2:
        return np.zeros((0, n_features)), np.zeros(0)
    if limit < 2 * n_features:
        raise InputError(f"{limit} coalitions; {n_features} features need {2 * n_features} at least.")
    found: dict[tuple[int, ...], float] = {}
    half = n_features // 2
    share = [(n_features - 1) / (s * (n_features - s)) * (1 if 2 * s == n_features else 2) for s in range(1, half + 1)]
    size = 1
    while size <= half and len(found) + comb(n_features, size) * (1 if 2 * size == n_features else 2) <= limit:
        each = (n_features - 1) / (size * (n_features - size) * comb(n_features, size))
        for members in combinations(range(n_features), size):
            mask = tuple(int(j in members) for j in range(n_features))
            found[mask] = each
            found[tuple(1 - m for m in mask)] = each
        size += 1
    draws = (limit - len(found)) // 2
    if size <= half and draws:
        rest = np.array(share[size - 1:])
        each = rest.sum() / (2 * draws)
        rng = np.random.default_rng(seed)
        for s in rng.choice(np.arange(size, half + 1), draws, p=rest / rest.sum()):
            mask = np.zeros(n_features, int)
            mask[rng.permutation(n_features)[:s]] = 1
            for m in (tuple(mask.tolist()), tuple((1 - mask).tolist())):
                found[m] = found.get(m, 0.0) + each
    return np.array(list(found), float), np.array(list(found.values()))


def score_coefficients(masks: np.ndarray, weights: np.ndarray, n_features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(per mask, full, empty)``: the values are these combinations of the coalitions' scores.

    With y = v(S) - v(empty), A = Z'WZ and D = v(full) - v(empty), least squares
    under sum(phi) = D gives phi = P Z'W y + A^-1 1 D / (1'A^-1 1), where
    P = A^-1 - A^-1 11' A^-1 / (1'A^-1 1).
    """
    if n_features == 1:
        return np.zeros((0, 1)), np.ones(1), -np.ones(1)
    inv = np.linalg.pinv((masks * weights[:, None]).T @ masks)
    ones = inv.sum(axis=1)
    per_mask = (masks * weights[:, None]) @ (inv - np.outer(ones, ones) / ones.sum())
    full = ones / ones.sum()
    return per_mask, full, -per_mask.sum(axis=0) - full


def kernel_shapley(
    model: Model,
    rows: DataFrame,
    background: list[tuple[float, list[float]]],
    feature_columns: list[str],
    key_cols: list[str],
    n_coalitions: int | None = None,
    seed: int = DEFAULT_SEED,
) -> DataFrame:
    """``*key_cols, phi, f_x, f_bg`` for every row: the values of the features in order.

    The score is the probability of the class predicted for the row; ``phi`` adds
    up to ``f_x - f_bg``. Up to ``n_coalitions`` (2 x features + 2,048) all
    coalitions are used and the values are exact for the background. Rows of one
    key are averaged.
    """
    nf = len(feature_columns)
    masks, weights = coalitions(nf, n_coalitions or 2 * nf + EXTRA_COALITIONS, seed)
    per_mask, full, empty = score_coefficients(masks, weights, nf)
    table = [{"z": [1] * nf, "c": full.tolist(), "e": 1}, {"z": [0] * nf, "c": empty.tolist(), "e": 0}]
    table += [{"z": [int(v) for v in m], "c": c.tolist(), "e": -1} for m, c in zip(masks, per_mask)]
    centres = [{"w": w, "x": x} for w, x in background]
    base = rows.select(*[col(k).alias(f"_k{i}") for i, k in enumerate(key_cols)],
                       *[col(c).cast("double").alias(f"_x{j}") for j, c in enumerate(feature_columns)])
    inputs = [f"_x{j}" for j in range(nf)]
    target = with_proba_of_columns(model, base, inputs)
    hybrids = target.select(
        *base.columns, F.col("pred").alias("_cls"),
        F.explode(F.from_json(F.lit(json.dumps(table)), "array<struct<z:array<int>,c:array<double>,e:int>>")).alias("_s"),
    ).select("*", F.explode(F.from_json(F.lit(json.dumps(centres)), "array<struct<w:double,x:array<double>>>")).alias("_b"))
    hybrids = hybrids.select(
        *[c for c in base.columns if c.startswith("_k")], "_cls", F.col("_s.c").alias("_c"), F.col("_s.e").alias("_e"), F.col("_b.w").alias("_w"),
        *[F.when(F.col("_s.z")[j] == 1, F.col(x)).otherwise(F.col("_b.x")[j]).alias(x) for j, x in enumerate(inputs)],
    )
    scored = with_proba_of_columns(model, hybrids, inputs)
    v = F.col("_w") * F.element_at("proba", F.col("_cls") + 1)
    copies = F.sum(F.when(F.col("_e") == 1, F.col("_w")))  # 1 for each row of the key
    keys = [c for c in base.columns if c.startswith("_k")]
    sums = scored.groupBy(*keys).agg(
        F.array(*[F.sum(F.col("_c")[j] * v) / copies for j in range(nf)]).alias("phi"),
        (F.sum(F.when(F.col("_e") == 1, v)) / copies).alias("f_x"),
        (F.sum(F.when(F.col("_e") == 0, v)) / copies).alias("f_bg"),
    )
    return sums.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(key_cols)], "phi", "f_x", "f_bg")


def shapley_importance(values: DataFrame, feature_columns: list[str], max_display: int | None = None) -> DataFrame:
    """``feature, mean_abs_shap`` of :func:`kernel_shapley` rows, largest first (the top ``max_display``, if given)."""
    names = F.array(*[F.lit(c) for c in feature_columns])
    long = values.select(F.posexplode("phi").alias("_j", "_v"))
    out = long.groupBy(F.element_at(names, F.col("_j") + 1).alias("feature")).agg(F.avg(F.abs("_v")).alias("mean_abs_shap"))
    out = out.orderBy(F.col("mean_abs_shap").desc(), "feature")
    return out if max_display is None else out.limit(max_display)
