"""The first k rows of an order without merging k rows per task in one task.

``first_k`` counts rows per bin of the order (a bounded histogram), finds the
bin of the k-th row by running totals, takes all bins before it as they are and
ranks only the rows of that bin, spread over tasks by their number. The plan is
the same for every k.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsight.operators.ranking import index_within

_TASK_ROWS = 200_000


def hash_bin(hex_col: Column) -> Column:
    """Bin of a hexadecimal hash: its first three digits, 4,096 bins in hash order."""
    return F.conv(F.substring(hex_col, 1, 3), 16, 10).cast("int")


def descending_count_bin(count_col: Column) -> Column:
    """Bin of a positive count, larger counts first: 32 bins per doubling."""
    return -F.floor(F.log2(count_col.cast("double")) * 32).cast("int")


def first_k(df: DataFrame, bin_of: Column, order_cols: list[Column | str], k: int) -> DataFrame:
    """The first ``k`` rows (all if fewer), in no particular order.

    ``bin_of`` is an integer that never falls along the order and has a bounded
    number of values; ``order_cols`` order the rows totally. ``df`` is read up to
    three times: pass a written table where it is costly.
    """
    if k <= 0:
        return df.limit(0)
    bins = sorted((r["_bin"], r["n"]) for r in df.groupBy(bin_of.alias("_bin")).agg(F.count(F.lit(1)).alias("n")).collect())
    before = 0
    for at, n in bins:
        if before + n >= k:
            break
        before += n
    else:
        return df
    if before + n == k:
        return df.where(bin_of <= at)
    last = df.where(bin_of == at).withColumn("_one", F.lit(0))
    last = index_within(last, ["_one"], order_cols, "_rank", num_partitions=-(-n // _TASK_ROWS)).where(F.col("_rank") < k - before)
    return df.where(bin_of < at).unionByName(last.drop("_one", "_rank"))
