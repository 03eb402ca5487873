"""Exact position of each row within its group, without one task per group.

``row_number() over (partition by g order by k)`` sends every row of a group
to one task, so a class or feature holding a third of the data lands on one
executor.  ``index_within`` range-partitions on (g, k) instead, so a hot group
spreads over many partitions; each partition numbers its rows locally, a
small table of per-(group, partition) block sizes gives every block its
offset, and a join adds it back.  The result equals ``row_number() - 1``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsight.session import ensure_checkpoint_dir


def index_within(
    df: DataFrame,
    group_cols: list[str],
    order_cols: list[Column | str],
    out_col: str = "idx",
    num_partitions: int | None = None,
    checkpoint: bool = True,
) -> DataFrame:
    """Add ``out_col`` = 0-based rank of the row inside its group.

    ``order_cols`` must order rows totally within a group (append a unique key).
    With ``checkpoint`` the range-partitioned rows are written to the shared
    checkpoint folder first, so block numbers stay fixed if tasks are retried.
    """
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) for c in group_cols] + [F.col(c) if isinstance(c, str) else c for c in order_cols]
    ranged = (
        df.repartitionByRange(n, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_pos", F.monotonically_increasing_id())
        .withColumn("_blk", F.shiftright(F.col("_pos"), 33))
    )
    if checkpoint:
        ensure_checkpoint_dir(spark)
        ranged = ranged.checkpoint(eager=True)
    blocks = ranged.groupBy(*group_cols, "_blk").agg(
        F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_cnt")
    )
    w = Window.partitionBy(*group_cols).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_cnt").over(w), F.lit(0)))
    blocks = blocks.select(*group_cols, "_blk", "_first", "_before")
    joined = ranged.join(blocks, on=[*group_cols, "_blk"], how="inner")
    return joined.withColumn(out_col, F.col("_before") + F.col("_pos") - F.col("_first")).drop(
        "_pos", "_blk", "_first", "_before"
    )


def running_totals(
    df: DataFrame,
    order_cols: list[Column],
    sum_cols: list[str],
    prefix: str = "cum_",
    num_partitions: int | None = None,
    checkpoint: bool = True,
) -> DataFrame:
    """Add ``cum_<c>`` = sum of ``c`` over all rows up to and including this one.

    The global order is ``order_cols`` (must be total).  Rows are range
    partitioned, each block sums locally, and block offsets come from a table
    with one row per block, so no task ever holds the whole ordering.
    """
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order_cols).withColumn("_blk", F.spark_partition_id())
    if checkpoint:
        ensure_checkpoint_dir(spark)
        ranged = ranged.checkpoint(eager=True)
    w = Window.partitionBy("_blk").orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = ranged.select("*", *[F.sum(c).over(w).alias(f"_l_{c}") for c in sum_cols])
    totals = ranged.groupBy("_blk").agg(*[F.sum(c).alias(f"_t_{c}") for c in sum_cols])
    wb = Window.orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    # one row per block: the offsets table is bounded by the partition count
    offsets = totals.select("_blk", *[F.coalesce(F.sum(f"_t_{c}").over(wb), F.lit(0)).alias(f"_o_{c}") for c in sum_cols])
    out = local.join(F.broadcast(offsets), "_blk")
    for c in sum_cols:
        out = out.withColumn(f"{prefix}{c}", F.col(f"_l_{c}") + F.col(f"_o_{c}"))
    return out.drop("_blk", *[f"_l_{c}" for c in sum_cols], *[f"_o_{c}" for c in sum_cols])
