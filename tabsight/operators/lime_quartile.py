"""Local explanations of table rows by quartile rules (E5).

Every feature is cut at its training quartiles. A perturbation draws a bin per
feature by its training frequency and a value from the bin's truncated normal;
the explaining variables say whether a perturbation stayed in the instance's
bin. Drawing and scoring are one Spark plan; because the variables are
binary, the samples of an instance with the same variables are counted and
summed as one, and Python only solves the small weighted ridge of each instance.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsight.errors import InputError
from tabsight.functions.exprs import DEFAULT_SEED, col
from tabsight.functions.hashing import hash_ints
from tabsight.operators.models import linear_margins, with_proba_of_columns
from tabsight.operators.quantiles import exact_quantiles

QUARTILES = [0.25, 0.5, 0.75]
NUM_SAMPLES = 5000
_BITS = 62  # variables per long
_POINTS = 64  # equally likely values that stand for a bin's truncated normal
#: Features up to which an instance's samples are counted by all patterns of its variables.
_MAX_PATTERN_FEATURES = 8
#: Samples that numpy draws and scores at once.
_BLOCK_SAMPLES = 8_192


@dataclass(frozen=True)
class FeatureBins:
    """A feature's distinct quartiles, the share of the rows in each bin and the values drawn there."""

    edges: list[float]
    shares: list[float]
    points: list[list[float]]

    def bin_of(self, value: Column) -> Column:
        """The number of edges below ``value`` (bins are closed above); 0 for null."""
        return sum((F.when(value > F.lit(e), 1).otherwise(0) for e in self.edges), F.lit(0))

    def rules(self, name: str) -> list[str]:
        """The text of each bin: ``x <= a``, ``a < x <= b``, ``x > b``."""
        e = [f"{v:.2f}" for v in self.edges]
        return [f"{name} <= {e[0]}", *[f"{a} < {name} <= {b}" for a, b in zip(e, e[1:])], f"{name} > {e[-1]}"]


def _truncated_normal(mean: float, std: float, low: float, high: float) -> list[float]:
    """The values at the middles of ``_POINTS`` equal shares of a normal cut to [low, high]."""
    inside = min(max(mean, low), high)
    if std <= 0 or low >= high:
        return [inside] * _POINTS
    normal = NormalDist(mean, std)
    a, b = normal.cdf(low), normal.cdf(high)
    out = []
    for i in range(_POINTS):
        p = a + (b - a) * (i + 0.5) / _POINTS
        out.append(min(max(normal.inv_cdf(p), low), high) if 0 < p < 1 else inside)
    return out


def fit_quartile_bins(train: DataFrame, feature_columns: list[str]) -> dict[str, FeatureBins]:
    """Bins of every feature from all training rows: exact quartiles, then one aggregate.

    Nulls and NaN are left out; a feature without any value is an error.
    """
    quartiles = exact_quantiles(train, feature_columns, QUARTILES)
    empty = [c for c, q in quartiles.items() if q[0] is None]
    if empty:
        raise InputError(f"Features without any value: {empty}")
    edges = {c: sorted(set(q)) for c, q in quartiles.items()}
    cells = F.array(*[
        F.struct(F.lit(j).alias("f"), FeatureBins(edges[c], [], []).bin_of(col(c).cast("double")).alias("b"),
                 F.when(~F.isnan(col(c).cast("double")), col(c).cast("double")).alias("x"))
        for j, c in enumerate(feature_columns)
    ])
    long = train.select(F.explode(cells).alias("v")).select("v.*").where("x IS NOT NULL")
    stats = {
        (r["f"], r["b"]): r
        for r in long.groupBy("f", "b").agg(
            F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"),
            F.min("x").alias("low"), F.max("x").alias("high"),
        ).collect()  # at most four rows per feature
    }
    out = {}
    for j, c in enumerate(feature_columns):
        mine = {b: r for (f, b), r in stats.items() if f == j}
        total = sum(r["n"] for r in mine.values())
        ends = [min(r["low"] for r in mine.values()), *edges[c], max(r["high"] for r in mine.values())]
        shares, points = [], []
        for b in range(len(edges[c]) + 1):
            r = mine.get(b)
            shares.append(r["n"] / total if r else 0.0)
            points.append(_truncated_normal(r["mean"], r["std"], ends[b], ends[b + 1]) if r else [ends[b]] * _POINTS)
        out[c] = FeatureBins(edges[c], shares, points)
    return out


def _draw(bins: FeatureBins, draw: Column) -> tuple[Column, Column]:
    """(bin, value) of one perturbed feature from 64 hashed bits."""
    unit = F.shiftrightunsigned(draw, 32) / F.lit(4294967296.0)
    last = max(b for b, s in enumerate(bins.shares) if s)
    chosen = F.lit(last)
    for b in reversed(range(last)):
        chosen = F.when(unit < F.lit(sum(bins.shares[: b + 1])), b).otherwise(chosen)
    values = F.from_json(F.lit(json.dumps(bins.points)), "array<array<double>>")
    point = F.pmod(draw, F.lit(_POINTS)).cast("int")
    return chosen, F.get(F.get(values, chosen), point)


def pattern_sums(x: np.ndarray, own: np.ndarray, cls: np.ndarray, hashes: np.ndarray, weights: np.ndarray, intercepts: np.ndarray,
                 shares: list[list[float]], points: list[np.ndarray], num_samples: int) -> tuple[np.ndarray, np.ndarray]:
    """By instance and pattern of variables (bit j: feature j stayed), the samples and the sum of their probabilities.

    A row of ``x`` is an instance with its bins ``own``, its class and the hash of
    (seed, key). The draws are those of :func:`_draw`: a feature's value is one of its
    bins' points, so its share of the margins is looked up.
    """
    n, nf = x.shape
    drawn = hash_ints(np.arange(num_samples)[None, :], hashes[:, None])
    pattern = np.zeros((n, num_samples), dtype=np.int64)
    margins = np.empty((len(intercepts), n, num_samples))  # by class first: all steps run along the samples
    margins[:] = intercepts[:, None, None]
    for j in range(nf):
        h = hash_ints(np.int64(j), drawn)
        last = max(b for b, s in enumerate(shares[j]) if s)
        unit = (h.view(np.uint64) >> np.uint64(32)) / 4294967296.0
        chosen = np.zeros((n, num_samples), dtype=np.int64)
        for b in range(last):
            chosen += unit >= sum(shares[j][: b + 1])
        pattern |= (chosen == own[:, j, None]).astype(np.int64) << j
        value = chosen * _POINTS + (h & (_POINTS - 1))
        for k, weight in enumerate(weights[:, j]):
            margins[k] += (points[j].ravel() * weight)[value]
    pattern[:, 0] = (1 << nf) - 1
    margins[:, :, 0] = weights @ x.T + intercepts[:, None]  # the instance itself
    with np.errstate(over="ignore"):
        p = 1.0 / np.exp(margins - margins[cls, np.arange(n)]).sum(axis=0)
    place = (pattern + (np.arange(n)[:, None] << nf)).ravel()
    counts = np.bincount(place, minlength=n << nf).reshape(n, -1)
    return counts, np.bincount(place, p.ravel(), n << nf).reshape(n, -1)


def _ridges(x: np.ndarray, y: np.ndarray, w: np.ndarray, penalty: float) -> np.ndarray:
    """Weighted ridges with free intercepts, one for each first index: ``x`` by variable and pattern."""
    total = w.sum(axis=1)
    xc = x - ((x @ w[:, :, None])[:, :, 0] / total[:, None])[:, :, None]
    yc = w * (y - ((w * y).sum(axis=1) / total)[:, None])
    products = (xc * w[:, None, :]) @ xc.transpose(0, 2, 1) + penalty * np.eye(x.shape[1])
    return np.linalg.solve(products, xc @ yc[:, :, None])[:, :, 0]


def strongest(counts: np.ndarray, sums: np.ndarray, nf: int, width: float, num_features: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and weights of every instance's strongest rules, the strongest first."""
    x = (np.arange(1 << nf)[None, :] >> np.arange(nf)[:, None] & 1).astype(float)
    y = sums / np.maximum(counts, 1)
    w = counts * np.sqrt(np.exp(-(nf - x.sum(axis=0)) / width**2))
    every = np.broadcast_to(x, (len(counts), *x.shape))
    used = np.sort(np.argsort(-np.abs(_ridges(every, y, w, 0.01)), axis=1, kind="stable")[:, :num_features], axis=1)
    coef = _ridges(x[used], y, w, 1.0)
    order = np.argsort(-np.abs(coef), axis=1, kind="stable")
    return np.take_along_axis(used, order, axis=1), np.take_along_axis(coef, order, axis=1)


def _explain_in_blocks(model: LogisticRegressionModel, target: DataFrame, bins: list[FeatureBins], names: list[str], rules: list[list[str]],
                       width: float, num_samples: int, num_features: int, seed: int) -> DataFrame:
    """``_k, feature, rule, weight`` from ``_k, _x0..., _cls, _bins``, dealt by ``_k``; rows that repeat a key share one explanation."""
    nf = len(names)
    weights, intercepts = linear_margins(model)
    shares, points = [b.shares for b in bins], [np.array(b.points) for b in bins]
    widest = max(map(len, rules))
    texts = pa.array([r for own in rules for r in own + [""] * (widest - len(own))])
    row = F.struct(F.array(*[f"_x{j}" for j in range(nf)]).alias("x"), F.col("_cls").alias("c"), F.col("_bins").alias("b"))
    keyed = target.groupBy("_k").agg(F.collect_list(row).alias("_r")).withColumn("_h", F.xxhash64(F.lit(seed), "_k"))
    block, some = max(1, _BLOCK_SAMPLES // num_samples), 128 * _BLOCK_SAMPLES // (nf << nf)

    def explain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = batch.column("_r")
            ends = np.asarray(found.offsets)[1:] - found.offsets[0].as_py()
            of = np.repeat(np.arange(batch.num_rows), np.diff(ends, prepend=0))  # the key of every row
            rows = found.flatten()
            x = rows.field("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, nf)
            own = rows.field("b").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, nf)
            cls = np.nan_to_num(rows.field("c").to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
            hashes = batch.column("_h").to_numpy()[of]
            counts, sums = np.zeros((batch.num_rows, 1 << nf)), np.zeros((batch.num_rows, 1 << nf))
            for at in range(0, len(of), block):
                part = slice(at, at + block)
                n, s = pattern_sums(x[part], own[part], cls[part], hashes[part], weights, intercepts, shares, points, num_samples)
                np.add.at(counts, of[part], n)
                np.add.at(sums, of[part], s)
            features, strengths = [], []
            for at in range(0, batch.num_rows, some):
                f, v = strongest(counts[at : at + some], sums[at : at + some], nf, width, num_features)
                features.append(f)
                strengths.append(v)
            chosen, strength = np.concatenate(features), np.concatenate(strengths)
            first = own[ends - np.diff(ends, prepend=0)]
            rule = chosen * widest + np.take_along_axis(first, chosen, axis=1)
            keys = batch.column("_k").take(pa.array(np.repeat(np.arange(batch.num_rows), chosen.shape[1])))
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array(names).take(pa.array(chosen.ravel())), texts.take(pa.array(rule.ravel())), pa.array(strength.ravel())],
                ["_k", "feature", "rule", "weight"])

    return keyed.select("_k", "_r", "_h").mapInArrow(
        explain, f"_k {target.schema['_k'].dataType.simpleString()}, feature string, rule string, weight double")


def lime_quartile(
    model: Model,
    instances: DataFrame,
    bins: dict[str, FeatureBins],
    feature_columns: list[str],
    key_col: str,
    num_samples: int = NUM_SAMPLES,
    num_features: int = 10,
    seed: int = DEFAULT_SEED,
) -> DataFrame:
    """``key, feature, rule, weight`` of the ``num_features`` strongest rules of each instance (E5).

    The instance itself and ``num_samples - 1`` perturbations are scored for the class
    predicted on the instance. A sample with d variables off weighs
    sqrt(exp(-d / w^2)), w = 0.75 sqrt(features). The strongest variables of a
    ridge with penalty 0.01 are fitted again with penalty 1. Keys are unique.
    An instance's samples stay in the task that holds it: only the instances are
    shuffled. A small logistic regression is drawn, scored and explained in blocks
    of instances by numpy, any other model by a plan over the samples.
    """
    spark = instances.sparkSession
    nf = len(feature_columns)
    inputs = [f"_x{j}" for j in range(nf)]
    base = instances.select(col(key_col).alias("_k"), *[col(c).cast("double").alias(x) for c, x in zip(feature_columns, inputs)])
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    # a stated number, which adaptive execution leaves: few bytes here become many samples
    base = base.repartition(parts, "_k")
    target = with_proba_of_columns(model, base, inputs).select("_k", *inputs, F.col("pred").alias("_cls"))
    own = [bins[c].bin_of(F.col(x)).cast("byte").alias(f"_b{j}") for j, (c, x) in enumerate(zip(feature_columns, inputs))]
    target = target.select("*", *own).withColumn("_bins", F.array(*[f"_b{j}" for j in range(nf)]))
    rules = [bins[c].rules(c) for c in feature_columns]
    width = 0.75 * math.sqrt(nf)
    if isinstance(model, LogisticRegressionModel) and nf <= _MAX_PATTERN_FEATURES:
        explained = _explain_in_blocks(model, target, [bins[c] for c in feature_columns], feature_columns, rules, width, num_samples, num_features, seed)
        return explained.withColumnRenamed("_k", key_col)
    samples = target.select("*", F.explode(F.sequence(F.lit(0), F.lit(num_samples - 1))).alias("_s"))
    itself = F.col("_s") == 0
    values, stays = [], []
    for j, (c, x) in enumerate(zip(feature_columns, inputs)):
        b, v = _draw(bins[c], F.xxhash64(F.lit(seed), F.col("_k"), F.col("_s"), F.lit(j)))
        values.append(F.when(itself, F.col(x)).otherwise(v).alias(x))
        stays.append(F.when(itself | (b == F.col(f"_b{j}")), F.lit(1 << j % _BITS)).otherwise(0).cast("long"))
    # the variables that stayed in their bins as bits: longs are cheap keys
    packed = [sum(stays[at + 1 : at + _BITS], stays[at]).alias(f"_z{at // _BITS}") for at in range(0, nf, _BITS)]
    keys = [f"_z{i}" for i in range(len(packed))]
    drawn = samples.select("_k", "_cls", "_bins", *packed, *values)
    scored = with_proba_of_columns(model, drawn, inputs)
    cells = scored.groupBy("_k", *keys).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.element_at("proba", F.col("_cls") + 1)).alias("_y"), F.first("_bins").alias("_bins"),
    )

    def ridge(X, y, w, penalty):
        xm, ym = w @ X / w.sum(), w @ y / w.sum()
        Xc = X - xm
        return np.linalg.solve((Xc * w[:, None]).T @ Xc + penalty * np.eye(X.shape[1]), (Xc * w[:, None]).T @ (y - ym))

    def explain(pdf: pd.DataFrame) -> pd.DataFrame:
        bits = pdf[keys].to_numpy()
        X = np.stack([bits[:, j // _BITS] >> (j % _BITS) & 1 for j in range(nf)], axis=1).astype(float)
        y = pdf["_y"].to_numpy() / pdf["_n"].to_numpy()
        w = pdf["_n"].to_numpy() * np.sqrt(np.exp(-(nf - X.sum(axis=1)) / width**2))
        used = np.sort(np.argsort(-np.abs(ridge(X, y, w, 0.01)), kind="stable")[:num_features])
        coef = ridge(X[:, used], y, w, 1.0)
        order = np.argsort(-np.abs(coef), kind="stable")
        return pd.DataFrame({
            "_k": [pdf["_k"].iloc[0]] * len(order), "feature": [feature_columns[used[i]] for i in order],
            "rule": [rules[used[i]][int(pdf["_bins"].iloc[0][used[i]])] for i in order], "weight": coef[order],
        })

    # one group per instance: at most num_samples rows, one for each pattern of variables
    out = cells.groupBy("_k").applyInPandas(
        explain, f"_k {base.schema['_k'].dataType.simpleString()}, feature string, rule string, weight double")
    return out.withColumnRenamed("_k", key_col)
