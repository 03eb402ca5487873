"""Derived views over the driver tables, in Spark and as DuckDB SQL.

Both forms compute the same rows, so oracle queries can read the SQL form
as a sub-query while the Spark query reads the DataFrame form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsight.functions.exprs import hash_unit, hash_unit_sql
from tabsight.sources.tables import read_table

EVENT_TYPES_SORTED = ["click", "error", "purchase", "signup", "view"]

# --- lineitem with nulls -----------------------------------------------------
LI_NULLS_SQL = (
    "(SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, "
    "CASE WHEN l_linenumber = 7 THEN NULL ELSE l_tax END AS l_tax, "
    "CASE WHEN l_linenumber = 6 THEN NULL ELSE l_returnflag END AS l_returnflag, "
    "l_linestatus, CAST(NULL AS DOUBLE) AS l_empty FROM lineitem)"
)


def li_nulls(spark: SparkSession, d: str) -> DataFrame:
    li = read_table(spark, d, "lineitem")
    return li.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
        F.when(F.col("l_linenumber") == 7, F.lit(None)).otherwise(F.col("l_tax")).alias("l_tax"),
        F.when(F.col("l_linenumber") == 6, F.lit(None)).otherwise(F.col("l_returnflag")).alias("l_returnflag"),
        "l_linestatus",
        F.lit(None).cast("double").alias("l_empty"),
    )


# --- lineitem with leaky and constant columns ---------------------------------
LI_LEAK_SQL = (
    "(SELECT l_orderkey, l_partkey, l_linenumber, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus, "
    "2 * l_linenumber + 1 AS leak_num, "
    "CASE l_returnflag WHEN 'A' THEN 'x' WHEN 'N' THEN 'y' ELSE 'z' END AS leak_cat, "
    "1 AS const FROM lineitem)"
)


def li_leak(spark: SparkSession, d: str) -> DataFrame:
    li = read_table(spark, d, "lineitem")
    return li.select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
        (F.lit(2) * F.col("l_linenumber") + 1).alias("leak_num"),
        F.when(F.col("l_returnflag") == "A", "x").when(F.col("l_returnflag") == "N", "y").otherwise("z").alias("leak_cat"),
        F.lit(1).alias("const"),
    )


# --- binary scored view: y_true and p1 from md5 of the event id ---------------
SCORED2_SQL = (
    "(SELECT event_id, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS y_true, "
    "CAST('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0 AS p1, "
    "1.0 - CAST('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0 AS p0 FROM events)"
)


def _md5_slice(c, start: int):
    return F.conv(F.substring(F.md5(c.cast("string")), start, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def scored2(spark: SparkSession, d: str) -> DataFrame:
    ev = read_table(spark, d, "events")
    p1 = _md5_slice(F.col("event_id"), 1)
    return ev.select(
        "event_id",
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("y_true"),
        p1.alias("p1"),
        (F.lit(1.0) - p1).alias("p0"),
    )


# --- five-class scored view ----------------------------------------------------
def _slice_sql(start: int) -> str:
    return f"(CAST('0x' || substr(md5(CAST(event_id AS VARCHAR)), {start}, 8) AS BIGINT) / 4294967296.0 + 0.01)"


_S = [_slice_sql(1 + 6 * i) for i in range(5)]
_SUM = " + ".join(_S)
SCORED5_SQL = (
    "(SELECT event_id, CASE event_type "
    + " ".join(f"WHEN '{e}' THEN {i}" for i, e in enumerate(EVENT_TYPES_SORTED))
    + " END AS y_true, ["
    + ", ".join(f"{s} / ({_SUM})" for s in _S)
    + "] AS proba FROM events)"
)


def scored5(spark: SparkSession, d: str) -> DataFrame:
    ev = read_table(spark, d, "events")
    y = F.lit(None).cast("int")
    for i, e in reversed(list(enumerate(EVENT_TYPES_SORTED))):
        y = F.when(F.col("event_type") == e, F.lit(i)).otherwise(y)
    # one md5 per row, its slices as columns, then the normalised array
    h = ev.select("event_id", y.alias("y_true"), F.md5(F.col("event_id").cast("string")).alias("_h"))
    sl = h.select(
        "event_id", "y_true",
        *[(F.conv(F.substring("_h", 1 + 6 * i, 8), 16, 10).cast("long") / F.lit(4294967296.0) + F.lit(0.01)).alias(f"_s{i}")
          for i in range(5)],
    )
    total = sum((F.col(f"_s{i}") for i in range(1, 5)), F.col("_s0"))
    tot = sl.select("event_id", "y_true", *[f"_s{i}" for i in range(5)], total.alias("_t"))
    return tot.select("event_id", "y_true", F.array(*[F.col(f"_s{i}") / F.col("_t") for i in range(5)]).alias("proba"))


# --- hash helpers for splits ---------------------------------------------------
def holdout_unit(key_cols: list[str], seed: int):
    return hash_unit(key_cols, seed)


def holdout_unit_sql(key_cols: list[str], seed: int) -> str:
    return hash_unit_sql(key_cols, seed)
