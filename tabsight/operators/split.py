"""Samples, folds and hold-out splits.

Row identity comes from a stable key (``key_cols``), never from
``monotonically_increasing_id`` or ``rand``: the same rows land in the same
fold whatever the partitioning.  Two modes:

* ``hash`` (default of the folds) — row-local: a row's fold or side depends only on
  md5(seed|key).  No shuffle; per-class sizes are even up to sampling noise.
* ``exact`` (default of the hold-out) — per class, rows are ordered by md5(seed|key) and dealt out
  round-robin (folds) or cut at an exact count (hold-out, samples).  Uses
  :func:`index_within`, so a dominant class is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsight.errors import InputError
from tabsight.functions.exprs import DEFAULT_SEED, col, hash_unit, key_string
from tabsight.operators.ranking import index_within
from tabsight.operators.selection import first_k, hash_bin

# Fixed values.
DEFAULT_FOLDS = 3
TEST_SIZE = 0.2
MIN_SPLIT_ROWS = 10


def _order_key(key_cols: list[str], seed: int):
    if not key_cols:
        raise InputError("A stable row key is needed for reproducible splits; pass key_cols.")
    return F.md5(key_string(key_cols, seed))


def sample_n(df: DataFrame, n: int, key_cols: list[str], seed: int = DEFAULT_SEED) -> DataFrame:
    """Exactly ``n`` rows (all if fewer), chosen by md5(seed|key) order (K2)."""
    hashed = df.withColumn("_h", _order_key(key_cols, seed))
    return first_k(hashed, hash_bin(F.col("_h")), ["_h", *key_cols], n).drop("_h")


def sample_fraction(df: DataFrame, fraction: float, key_cols: list[str], seed: int = DEFAULT_SEED) -> DataFrame:
    """Row-local sample of about ``fraction`` of the rows (K2, at a fraction)."""
    return df.where(hash_unit(key_cols, seed) < F.lit(float(fraction)))


def class_counts(df: DataFrame, label_col: str) -> dict[str, int]:
    """Rows per class; the caller has bounded the number of classes."""
    return {
        r[0]: int(r[1])
        for r in df.groupBy(col(label_col).cast("string")).agg(F.count(F.lit(1))).collect()
    }


def n_folds_for(df: DataFrame, label_col: str, cv: int = DEFAULT_FOLDS) -> int:
    """k = min(cv, max(2, smallest class)) (K3)."""
    smallest = df.groupBy(col(label_col)).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n")).first()[0]
    return min(cv, max(2, int(smallest or 0)))


def assign_folds(
    df: DataFrame,
    label_col: str,
    key_cols: list[str],
    k: int = DEFAULT_FOLDS,
    seed: int = DEFAULT_SEED,
    mode: str = "hash",
    out_col: str = "fold",
) -> DataFrame:
    """Stratified k-fold assignment."""
    if mode == "hash":
        return df.withColumn(out_col, F.least(F.floor(hash_unit(key_cols, seed) * k), F.lit(k - 1)).cast("int"))
    if mode != "exact":
        raise InputError(f"Unknown split mode '{mode}'; use hash or exact.")
    ranked = index_within(df.withColumn("_h", _order_key(key_cols, seed)), [label_col], ["_h", *key_cols], "_i")
    return ranked.withColumn(out_col, F.pmod(F.col("_i"), F.lit(k)).cast("int")).drop("_h", "_i")


def stratified_holdout(
    df: DataFrame,
    label_col: str,
    key_cols: list[str],
    test_size: float = TEST_SIZE,
    seed: int = DEFAULT_SEED,
    mode: str = "exact",
    out_col: str = "is_test",
) -> DataFrame:
    """Hold-out flag (K4): stratified when every class has ≥ 2 rows, else plain.

    Exact mode (the default, at every size) takes the first ⌈test_size·n_c⌉ rows of each class in
    md5(seed|key) order (⌈test_size·n⌉ overall when not stratified).  Hash
    mode flags rows with md5(seed|key) < test_size: no shuffle, per-class
    shares within sampling noise.
    """
    stats = df.groupBy(col(label_col)).agg(F.count(F.lit(1)).alias("n")).agg(
        F.sum("n").alias("rows"), F.min("n").alias("smallest")
    ).first()
    rows = int(stats["rows"] or 0)
    if rows < MIN_SPLIT_ROWS:
        raise InputError(f"Need at least {MIN_SPLIT_ROWS} rows for a hold-out split; got {rows}.")
    stratify = (stats["smallest"] or 0) >= 2
    if mode == "hash":
        return df.withColumn(out_col, hash_unit(key_cols, seed) < F.lit(float(test_size)))
    if mode != "exact":
        raise InputError(f"Unknown split mode '{mode}'; use hash or exact.")
    groups = [label_col] if stratify else []
    base = df.withColumn("_h", _order_key(key_cols, seed))
    if not groups:
        base = base.withColumn("_g", F.lit(0))
        groups = ["_g"]
    ranked = index_within(base, groups, ["_h", *key_cols], "_i")
    sizes = ranked.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n"))
    # one row per class; Spark broadcasts it if it is small
    out = ranked.join(sizes, on=groups, how="inner")
    out = out.withColumn(out_col, F.col("_i") < F.ceil(F.col("_n") * F.lit(float(test_size))))
    return out.drop("_h", "_i", "_n", "_g")


def folder_split(df: DataFrame, label_col: str, path_col: str = "path", validation_split: float = 0.2,
                 seed: int = DEFAULT_SEED) -> DataFrame:
    """Per-class validation flag for image folders (K5), by md5 of the path."""
    return stratified_holdout(df, label_col, [path_col], validation_split, seed, mode="exact", out_col="is_validation")
