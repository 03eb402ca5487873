"""Streaming scoring.

Every predict-side transform is row-local (map literals, broadcast
dictionary joins, a fitted model), so the batch plan runs unchanged on a
streaming DataFrame.  There is no state, hence no watermark.  The sink is a
Parquet folder with a checkpoint under the shared checkpoint directory, so a
restarted query resumes exactly where it stopped.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from tabsight.plans.train import FittedRun, predict_batch
from tabsight.session import scratch_path


def stream_source(spark: SparkSession, path: str, like: DataFrame, max_files_per_trigger: int | None = None) -> DataFrame:
    """``readStream`` over a Parquet folder with the schema of ``like``."""
    reader = spark.readStream.schema(like.schema).format("parquet")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)


def predict_stream(
    run: FittedRun,
    stream: DataFrame,
    key_col: str,
    out_path: str | None = None,
    available_now: bool = True,
):
    """Start the scoring query; returns ``(query, out_path)``.

    With ``available_now`` the query drains what is there and stops.
    """
    spark = stream.sparkSession
    out = out_path or scratch_path(spark, f"stream-out-{uuid.uuid4().hex}")
    ckpt = os.path.join(out + "-checkpoint")
    scored = predict_batch(run, stream, key_col, detail=False).select(
        "sample_index", "pred", "predicted_class", "proba"
    )
    writer = scored.writeStream.format("parquet").option("checkpointLocation", ckpt).outputMode("append")
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    query = writer.start(out)
    return query, out


def score_folder(run: FittedRun, spark: SparkSession, in_path: str, like: DataFrame, key_col: str) -> DataFrame:
    """Drain a Parquet folder through the streaming query and read the result back."""
    q, out = predict_stream(run, stream_source(spark, in_path, like), key_col)
    q.awaitTermination()
    return spark.read.parquet(out)
