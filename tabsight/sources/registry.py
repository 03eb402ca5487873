"""Append-only ``runs`` table.

Each registration appends one row; the current entry of a model folder is
its latest row.  Appends need no lock, and "latest per key" is an aggregate
(max over a struct) that combines map-side, so a key with many rows never
lands on one task.
"""

from __future__ import annotations

import datetime as _dt
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUNS_SCHEMA = "model_dir string, model_name string, dataset_type string, created_at timestamp, meta string"


def latest_per_key(df: DataFrame, key_cols: list[str], order_cols: list[str]) -> DataFrame:
    """The row with the greatest ``order_cols`` per key (W4), via ``max(struct)``."""
    payload = [c for c in df.columns if c not in key_cols]
    best = F.max(F.struct(*[F.col(c) for c in order_cols], *[F.col(c).alias(f"_p_{c}") for c in payload]))
    return df.groupBy(*key_cols).agg(best.alias("_b")).select(
        *key_cols, *[F.col(f"_b._p_{c}").alias(c) for c in payload]
    )


def register_run(spark: SparkSession, registry_path: str, model_dir: str, meta: dict) -> None:
    """Append one row for ``model_dir``."""
    row = (
        model_dir,
        meta.get("model_name"),
        meta.get("dataset_type"),
        _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None),
        json.dumps(meta, default=str),
    )
    spark.createDataFrame([row], RUNS_SCHEMA).write.mode("append").parquet(registry_path)


def list_runs(spark: SparkSession, registry_path: str) -> DataFrame:
    """Latest row per model folder."""
    runs = spark.read.schema(RUNS_SCHEMA).parquet(registry_path)
    return latest_per_key(runs, ["model_dir"], ["created_at"])


def get_run(spark: SparkSession, registry_path: str, model_dir: str) -> dict | None:
    row = list_runs(spark, registry_path).where(F.col("model_dir") == model_dir).first()
    return None if row is None else json.loads(row["meta"])
