"""Tabular preprocessing.

Fit is two passes over the data plus one pass over distinct values:

1. one unpivot of all categorical columns → distinct (feature, value) ∪
   ``__UNKNOWN__`` → exact sorted index per feature (the category dictionary);
   one aggregate for all numeric medians;
2. one aggregate of mean and population std over the encoded, imputed columns.

Transform joins each categorical column with its dictionary, at every size by
the same plan: a dictionary is broadcast while the measured bytes of all
broadcast dictionaries stay under a limit, and shuffled beyond it; null values
are kept out of the joins.  Numerics are cast and filled, then scaled.
Driver-side state is bounded: one number per feature and the class list (≤ 50).
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabsight.errors import InputError
from tabsight.functions.exprs import UNKNOWN_TOKEN, col, is_numeric_type, nan_to_null
from tabsight.operators import validate
from tabsight.operators.quantiles import exact_quantiles
from tabsight.operators.ranking import index_within
from tabsight.session import cut_lineage

# Bytes of dictionary values (plus ROW_BYTES each) that one transform may broadcast in all.
BROADCAST_BYTES = 32 * 1024 * 1024
ROW_BYTES = 64
# Null values of a shuffled dictionary join are spread over this many keys.
NULL_KEYS = 1024


def category_values(df: DataFrame, features: list[str]) -> DataFrame:
    """Distinct ``(feature, value)`` with nulls as ``__UNKNOWN__`` plus the token itself (U4)."""
    pairs = F.explode(
        F.array(
            *[
                F.struct(F.lit(c).alias("feature"), F.coalesce(col(c).cast("string"), F.lit(UNKNOWN_TOKEN)).alias("value"))
                for c in features
            ]
        )
    )
    seen = df.select(pairs.alias("p")).select("p.feature", "p.value")
    token = df.sparkSession.createDataFrame([(c, UNKNOWN_TOKEN) for c in features], "feature string, value string")
    return seen.unionByName(token).distinct()


def fit_dictionary(df: DataFrame, features: list[str], checkpoint: bool = True) -> DataFrame:
    """Category dictionary ``feature, value, idx``.

    ``idx`` is the position of the value among the sorted distinct values of
    its feature (code-point order), ``__UNKNOWN__`` included at its sorted place.
    """
    if not features:
        return df.sparkSession.createDataFrame([], "feature string, value string, idx long")
    ranked = index_within(category_values(df, features), ["feature"], ["value"], checkpoint=checkpoint)
    return cut_lineage(ranked.select("feature", "value", "idx"), "dictionary")


def medians(df: DataFrame, numeric: list[str], exact: bool = True, accuracy: int = 1_000_000) -> dict[str, float | None]:
    """Median of each numeric column, one aggregate.

    Exact mode interpolates like pandas and never holds a column in one task
    (:func:`exact_quantiles`); ``exact=False`` uses the ``percentile_approx``
    sketch alone (one pass).
    """
    if not numeric:
        return {}
    clean = nan_to_null(df.select(*[col(c).cast("double").alias(c) for c in numeric]))
    if exact:
        q = exact_quantiles(clean, numeric, [0.5])
        return {c: q[c][0] for c in numeric}
    aggs = [F.percentile_approx(col(c), 0.5, accuracy).alias(f"m{i}") for i, c in enumerate(numeric)]
    row = clean.agg(*aggs).first()
    return {c: (None if row[f"m{i}"] is None else float(row[f"m{i}"])) for i, c in enumerate(numeric)}


def class_weights(df: DataFrame, label_col: str) -> DataFrame:
    """``class_name, n, weight`` with weight n/(k·n_c) (A17); one class → no rows."""
    counts = df.where(col(label_col).isNotNull()).groupBy(col(label_col).cast("string").alias("class_name")).agg(
        F.count(F.lit(1)).alias("n")
    )
    tot = counts.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("k")).first()  # two numbers
    total, k = int(tot["total"] or 0), int(tot["k"] or 0)
    if k <= 1:
        return counts.where(F.lit(False)).select("class_name", "n", F.lit(None).cast("double").alias("weight"))
    return counts.select("class_name", "n", (F.lit(float(total)) / (F.lit(k) * F.col("n"))).alias("weight"))


@dataclass
class Preprocessor:
    """Fitted preprocessing state.  ``dictionary`` stays a DataFrame."""

    target: str
    feature_columns: list[str]
    categorical: list[str]
    numeric: list[str]
    fill_values: dict[str, float]
    means: dict[str, float]
    scales: dict[str, float]
    classes: list[str]
    dictionary: DataFrame | None = None
    dict_sizes: dict[str, int] = field(default_factory=dict)
    unknown: dict[str, int] = field(default_factory=dict)
    dict_bytes: dict[str, int] = field(default_factory=dict)

    # ---- spec round trip (S14) -------------------------------------------
    def spec(self) -> dict:
        return {
            "target": self.target,
            "feature_columns": self.feature_columns,
            "categorical": self.categorical,
            "numeric": self.numeric,
            "fill_values": self.fill_values,
            "means": self.means,
            "scales": self.scales,
            "classes": self.classes,
            "dict_sizes": self.dict_sizes,
            "dict_bytes": self.dict_bytes,
            "unknown": self.unknown,
        }

    def save(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        spark.createDataFrame([(json.dumps(self.spec()),)], "spec string").coalesce(1).write.mode("overwrite").json(
            path + "/spec"
        )
        if self.dictionary is not None:
            self.dictionary.write.mode("overwrite").parquet(path + "/dictionary")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Preprocessor":
        spec = json.loads(spark.read.json(path + "/spec").first()["spec"])
        dictionary = spark.read.parquet(path + "/dictionary") if spec["categorical"] else None
        return cls(
            target=spec["target"],
            feature_columns=spec["feature_columns"],
            categorical=spec["categorical"],
            numeric=spec["numeric"],
            fill_values=spec["fill_values"],
            means=spec["means"],
            scales=spec["scales"],
            classes=spec["classes"],
            dictionary=dictionary,
            dict_sizes={k: int(v) for k, v in spec["dict_sizes"].items()},
            unknown={k: int(v) for k, v in spec["unknown"].items()},
            dict_bytes={k: int(v) for k, v in spec["dict_bytes"].items()},
        )

    def broadcast_features(self) -> set[str]:
        """The features whose dictionaries fit, smallest first, into the broadcast limit."""
        out, used = set(), 0
        for c in sorted(self.categorical, key=lambda c: (self.dict_bytes[c], c)):
            used += self.dict_bytes[c]
            if used > BROADCAST_BYTES:
                break
            out.add(c)
        return out

    # ---- transform -----------------------------------------------------------
    def unknown_index(self, feature: str) -> int | None:
        return self.unknown.get(feature)

    def encode(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """Categorical → index, numeric → cast and fill; unscaled doubles."""
        keep = keep or []
        base = validate.dedupe_columns(df)
        missing = sorted(set(self.feature_columns) - set(base.columns))
        if missing:
            raise InputError(f"Features absent from the data: {missing}")
        out = base
        small = self.broadcast_features()
        for i, c in enumerate(self.categorical):
            entries = self.dictionary.where(F.col("feature") == c)
            entries = entries.select(F.col("value").alias(f"_v{i}"), F.col("idx").alias(f"_i{i}"))
            value = col(c).cast("string")
            if c in small:
                entries = F.broadcast(entries)  # bytes measured at fit time
            else:
                # a null would meet all other nulls in one task: it gets a key of its own kind
                spread = F.pmod(F.xxhash64(*[col(x) for x in base.columns]), F.lit(NULL_KEYS))
                value = F.coalesce(value, F.concat(F.lit("\u0000"), spread.cast("string")))
            out = out.withColumn(f"_k{i}", value).join(entries, F.col(f"_k{i}") == F.col(f"_v{i}"), "left")
            known = F.when(col(c).isNotNull(), F.col(f"_i{i}"))
            out = out.withColumn(c, F.coalesce(known, F.lit(self.unknown[c])).cast("double"))
            out = out.drop(f"_k{i}", f"_v{i}", f"_i{i}")
        for c in self.numeric:
            x = F.expr(f"try_cast({'`' + c.replace('`', '``') + '`'} AS DOUBLE)")
            x = F.when(F.isnan(x), F.lit(None)).otherwise(x)
            out = out.withColumn(c, F.coalesce(x, F.lit(self.fill_values[c])))
        return out.select(*[col(k) for k in keep if k not in self.feature_columns], *[col(c) for c in self.feature_columns])

    def transform(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """Encoded, imputed and standardised features, in training order."""
        enc = self.encode(df, keep)
        exprs = []
        for c in self.feature_columns:
            exprs.append(((col(c) - F.lit(self.means[c])) / F.lit(self.scales[c])).alias(c))
        keep = [k for k in (keep or []) if k not in self.feature_columns]
        return enc.select(*[col(k) for k in keep], *exprs)

    def encode_target(self, df: DataFrame, out_col: str = "label") -> DataFrame:
        """Sorted class names → 0..K−1 (F5); unseen labels become null."""
        classes = F.array(*[F.lit(c) for c in self.classes])
        pos = F.array_position(classes, col(self.target).cast("string"))
        return df.withColumn(out_col, F.when(pos > 0, (pos - 1).cast("double")))

    def decode_target(self, index_col: str, out_col: str = "predicted_class") -> "F.Column":
        """Class index → name (J2), an ``element_at`` on the literal class list."""
        classes = F.array(*[F.lit(c) for c in self.classes])
        return F.element_at(classes, F.col(index_col).cast("int") + 1).alias(out_col)


def fit_preprocess(
    df: DataFrame,
    target: str | None = None,
    exact_median: bool = True,
    max_classes: int = validate.MAX_CLASSES,
    checkpoint: bool = True,
) -> Preprocessor:
    """Fit the tabular preprocessor (F6); default target is the last column."""
    base = validate.dedupe_columns(df)
    if len(base.columns) < 2:
        raise InputError(f"{len(base.columns)} column(s); a feature and a target are needed.")
    target = target or base.columns[-1]
    if target not in base.columns:
        raise InputError(f"No column '{target}'; there are {base.columns}.")
    # row count, null targets and class count in one aggregate
    st = base.agg(
        F.count(F.lit(1)).alias("n"), F.count(col(target)).alias("nn"), F.count_distinct(col(target)).alias("k")
    ).first()
    if st["n"] < 2:
        raise InputError(f"{st['n']} row(s); two are needed.")
    if st["nn"] < st["n"]:
        raise InputError(f"Some rows have no value of target '{target}'.")
    n_classes = st["k"]
    if n_classes < 2:
        raise InputError(f"Target '{target}' has {n_classes} distinct value(s); two or more are needed.")
    if n_classes > max_classes:
        raise InputError(f"Target '{target}' has {n_classes} distinct values; {max_classes} is the limit.")
    features = [c for c in base.columns if c != target]
    for c in features:
        dt = base.schema[c].dataType
        if dt.typeName() in ("struct", "map"):
            raise InputError(f"Feature column '{c}' is nested ({dt.simpleString()}); flatten or drop it.")
    categorical = [c for c in features if not is_numeric_type(base.schema[c].dataType)]
    numeric = [c for c in features if c not in categorical]
    # classes: bounded by max_classes, so a driver-side list is fine
    classes = sorted(
        r[0] for r in base.select(col(target).cast("string")).distinct().collect()
    )
    fills = medians(base, numeric, exact=exact_median)
    empty = [c for c, v in fills.items() if v is None]
    if empty:
        raise InputError(f"Feature '{empty[0]}' has no value in any row.")
    dictionary = fit_dictionary(base, categorical, checkpoint=checkpoint) if categorical else None
    sizes, unknown, width = {}, {}, {}
    if dictionary is not None:
        # one row per categorical feature: entries, bytes and the index of the unknown token
        for r in dictionary.groupBy("feature").agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.octet_length("value") + ROW_BYTES).alias("bytes"),
            F.max(F.when(F.col("value") == UNKNOWN_TOKEN, F.col("idx"))).alias("unk"),
        ).collect():
            sizes[r["feature"]], width[r["feature"]], unknown[r["feature"]] = int(r["n"]), int(r["bytes"]), int(r["unk"])
    pre = Preprocessor(
        target=target,
        feature_columns=features,
        categorical=categorical,
        numeric=numeric,
        fill_values=fills,
        means={},
        scales={},
        classes=classes,
        dictionary=dictionary,
        dict_sizes=sizes,
        unknown=unknown,
        dict_bytes=width,
    )
    enc = pre.encode(base)
    aggs = []
    for i, c in enumerate(features):
        aggs += [F.avg(col(c)).alias(f"a{i}"), F.stddev_pop(col(c)).alias(f"s{i}")]
    row = enc.agg(*aggs).first()  # one row: mean and std per feature (A16)
    for i, c in enumerate(features):
        pre.means[c] = float(row[f"a{i}"])
        s = float(row[f"s{i}"])
        pre.scales[c] = s if s != 0.0 else 1.0
    return pre


def mean_std(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column_name, mean, std, scale`` over encoded columns (A16); std is population std."""
    rows = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.avg(col(c)).alias("mean"),
            F.stddev_pop(col(c)).alias("std"),
        )
        for c in columns
    ]
    out = df.agg(F.array(*rows).alias("a")).select(F.explode("a").alias("x")).select("x.*")
    return out.withColumn("scale", F.when(F.col("std") == 0, F.lit(1.0)).otherwise(F.col("std")))
