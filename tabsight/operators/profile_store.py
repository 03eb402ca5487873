"""A profile kept up to date batch by batch (A1), without rereading old batches.

A store is a folder with two parts per batch, both written from one pass over its
rows: the counted values of every column (128-bit keys, as in the exact profile)
and one state row per column with counts and a distinct-count sketch. Reading
merges the state rows; distinct counts that lie near a limit of a rule (or all,
in ``exact`` mode) are counted from the stored values of those columns alone.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsight.errors import InputError
from tabsight.operators.profile import column_meta, near_boundary, profile_of_cells, value_cells

#: Relative standard deviation of the sketches (2^12 registers).
SKETCH_RSD = 0.0163
_LOG2_REGISTERS = 12


class ProfileStore:
    """Profile states below ``path`` (shared storage on a cluster), one sub-folder per batch."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        self.path = path.rstrip("/")

    def _read(self, part: str) -> DataFrame:
        try:
            return self.spark.read.parquet(f"{self.path}/{part}")
        except AnalysisException as exc:
            raise InputError(f"No batch has been added to the profile store '{self.path}'.") from exc

    def columns(self) -> list[tuple[str, int, str]]:
        """``(name, ordinal, dtype)`` of the stored table."""
        meta = self._read("state").select("column_name", "ordinal", "dtype").distinct()
        return sorted((tuple(r) for r in meta.collect()), key=lambda r: r[1])  # one row per column

    def add(self, batch: str, df: DataFrame) -> None:
        """Add the rows of one batch; a batch added again replaces its earlier state.

        ``batch`` is made of letters, digits, ``_``, ``-`` and ``.``. Every batch has
        the same columns and types. A batch without rows counts as added. The state is
        written last, so a batch whose writing broke off does not count.
        """
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch):
            raise InputError(f"'{batch}' cannot name a batch.")
        if not df.columns:
            raise InputError("Cannot profile a table without columns.")
        meta = column_meta(df)
        mine = [(f.name, i, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
        try:
            known = self.columns()
        except InputError:
            known = mine
        if known != mine:
            raise InputError(f"Batch '{batch}' has the columns {mine}; the store has {known}.")
        place = f"{self.path}/values/batch={batch}"
        value_cells(df).write.mode("overwrite").partitionBy("ordinal").parquet(place)
        cells = self.spark.read.schema("v long, w long, cnt long, ordinal int").parquet(place)
        state = cells.groupBy("ordinal").agg(
            F.sum("cnt").alias("n_rows"),
            F.sum(F.when(F.col("v").isNotNull(), F.col("cnt")).otherwise(0)).alias("n_nonnull"),
            F.hll_sketch_agg(F.when(F.col("v").isNotNull(), F.xxhash64("v", "w")), F.lit(_LOG2_REGISTERS)).alias("sketch"),
        )
        # one row per column, also for a batch without rows
        rows = meta.join(state, "ordinal", "left").select(
            "column_name", "ordinal", "dtype", F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
            F.coalesce("n_nonnull", F.lit(0)).alias("n_nonnull"), "sketch",
        )
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/state/batch={batch}")

    def _values(self) -> DataFrame:
        """Stored values of the batches whose state is there, repeated once per batch."""
        done = self._read("state").select(F.col("batch").cast("string")).distinct()
        values = self.spark.read.schema("v long, w long, cnt long, batch string, ordinal int").parquet(f"{self.path}/values")
        # the smaller side has one row per batch
        return values.join(done, "batch", "left_semi").groupBy("ordinal", "v", "w").agg(F.sum("cnt").alias("cnt"))

    def profile(self, mode: str = "exact") -> DataFrame:
        """The profile of all batches, as ``profile_columns`` gives it for their union.

        ``auto`` takes distinct counts from the merged sketches, but counts a column
        exactly where the estimate lies near a limit of a rule; ``approx`` takes the
        sketches alone.
        """
        if mode not in ("exact", "approx", "auto"):
            raise InputError(f"Unknown profile mode '{mode}'; use exact, approx or auto.")
        merged = self._read("state").groupBy("column_name", "ordinal", "dtype").agg(
            F.sum("n_rows").alias("n_rows"), F.sum("n_nonnull").alias("n_nonnull"),
            F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("sketch")), F.lit(0)).cast("long").alias("n_unique"),
        )
        if mode == "approx":
            return merged
        if mode == "auto":
            rows = merged.collect()  # one row per column
            again = [r["ordinal"] for r in rows if near_boundary(r["n_rows"], r["n_unique"], SKETCH_RSD)]
        else:
            again = [i for _, i, _ in self.columns()]
        if not again:
            return merged
        meta = merged.select("column_name", "ordinal", "dtype")
        exact = profile_of_cells(meta, self._values().where(F.col("ordinal").isin(again))).select(
            "ordinal", F.col("n_unique").alias("_exact"))
        # one row per column on both sides; a recounted column without values has none
        counted = F.when(F.col("ordinal").isin(again), F.coalesce("_exact", F.lit(0))).otherwise(F.col("n_unique"))
        return merged.join(exact, "ordinal", "left").select(
            "column_name", "ordinal", "dtype", "n_rows", "n_nonnull", counted.cast("long").alias("n_unique"))
