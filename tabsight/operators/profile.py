"""Column profiling and target ranking (A1-A4).

Profiling is one aggregate over the whole table: row count, non-null count
and distinct count for every column.  The result is a small DataFrame with
one row per column that all scores and gates read.

Scale: exact ``count(distinct)`` over many columns expands every row once per
column.  ``mode="auto"`` runs an approximate pass first (HyperLogLog++, one
row per partition is shuffled) and recounts exactly only the columns whose
approximate count lies near a decision boundary of the cardinality ladder or
the id/constant gates.  ``mode="approx"`` never recounts and must not be used
to decide ``n_unique == n_rows``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabsight.errors import InputError
from pyspark.sql import types as T

from tabsight.functions.exprs import (
    FLOAT_TYPES,
    card_score_expr,
    col,
    nan_to_null,
    name_score_expr,
)

PROFILE_SCHEMA = "column_name string, ordinal int, dtype string, n_rows long, n_nonnull long, n_unique long"


def _unpivot_profile(df: DataFrame, stats: DataFrame, distinct_prefix: str = "u") -> DataFrame:
    """One aggregate row → one row per column, built with ``stack``."""
    pieces = []
    for i, field in enumerate(df.schema.fields):
        name = field.name.replace("'", "''")
        pieces.append(
            f"'{name}', {i}, '{field.dataType.simpleString()}', `nn{i}`, `{distinct_prefix}{i}`"
        )
    stack = f"stack({len(pieces)}, {', '.join(pieces)}) AS (column_name, ordinal, dtype, n_nonnull, n_unique)"
    return stats.selectExpr("n_rows", stack).select(
        F.col("column_name"),
        F.col("ordinal").cast("int").alias("ordinal"),
        F.col("dtype"),
        F.col("n_rows").cast("long").alias("n_rows"),
        F.col("n_nonnull").cast("long").alias("n_nonnull"),
        F.col("n_unique").cast("long").alias("n_unique"),
    )


def _value_key(field) -> tuple["F.Column", "F.Column"]:
    """Two longs that stand for a value in distinct counting; the first is null for null (and NaN).

    Integral values stand for themselves; others are hashed to 64 + 64 bits,
    so no text crosses the network.
    """
    c = col(field.name)
    if isinstance(field.dataType, T.IntegralType):
        return c.cast("long"), F.lit(0).cast("long")
    if isinstance(field.dataType, FLOAT_TYPES):
        c = F.when(F.isnan(c), F.lit(None)).when(c == 0, F.lit(0.0)).otherwise(c.cast("double"))
    elif not isinstance(field.dataType, T.AtomicType):
        c = c.cast("string")
    return F.when(c.isNotNull(), F.xxhash64(c)), F.xxhash64(F.lit(1), c)


def value_cells(df: DataFrame) -> DataFrame:
    """``ordinal, v, w, cnt``: how often each column has each value; null values have a null ``v``.

    (column, value) pairs are counted with a map-side partial aggregate.
    """
    structs = []
    for i, f in enumerate(df.schema.fields):
        v, w = _value_key(f)
        structs.append(F.struct(F.lit(i).alias("ordinal"), v.alias("v"), w.alias("w")))
    pairs = F.explode(F.array(*structs))
    return df.select(pairs.alias("x")).select("x.ordinal", "x.v", "x.w").groupBy("ordinal", "v", "w").agg(
        F.count(F.lit(1)).alias("cnt")
    )


def column_meta(df: DataFrame) -> DataFrame:
    """``column_name, ordinal, dtype``: one row per column."""
    return df.sparkSession.createDataFrame(
        [(f.name, i, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)],
        "column_name string, ordinal int, dtype string",
    )


def profile_of_cells(meta: DataFrame, cells: DataFrame) -> DataFrame:
    """The exact profile from the counted values of every column."""
    per = cells.groupBy("ordinal").agg(
        F.sum("cnt").alias("n_rows"),
        F.sum(F.when(F.col("v").isNotNull(), F.col("cnt")).otherwise(0)).alias("n_nonnull"),
        F.count("v").alias("n_unique"),
    )
    # one row per column on both sides
    return meta.join(per, "ordinal").select(
        "column_name",
        F.col("ordinal").cast("int").alias("ordinal"),
        "dtype",
        F.col("n_rows").cast("long").alias("n_rows"),
        F.col("n_nonnull").cast("long").alias("n_nonnull"),
        F.col("n_unique").cast("long").alias("n_unique"),
    )


def _exact_profile(df: DataFrame) -> DataFrame:
    """Exact profile by one unpivot and one keyed aggregate.

    The per-column totals come from a second, tiny aggregate.  This
    avoids the Expand plan of many ``count(distinct)`` in one aggregate.
    """
    return profile_of_cells(column_meta(df), value_cells(df))


def near_boundary(n_rows: int, n_unique: float, rsd: float) -> bool:
    """Whether an estimated distinct count could lie on the other side of a rule's limit."""
    slack = 4 * rsd
    limits = [1, 2, min(50, int(0.05 * n_rows)), 0.5 * n_rows, n_rows]
    return n_unique <= 64 or any(abs(n_unique - b) <= slack * max(b, 1) + 1 for b in limits)


def profile_columns(df: DataFrame, mode: str = "exact", rsd: float = 0.02) -> DataFrame:
    """Rows, non-nulls and distinct non-null values for every column (A1).

    Returns ``column, ordinal, dtype, n_rows, n_nonnull, n_unique``.
    NaN counts as missing, as in pandas.
    """
    if not df.columns:
        raise InputError("Cannot profile a table without columns.")
    clean = nan_to_null(df)
    if mode == "exact":
        return _exact_profile(df)
    if mode not in ("approx", "auto"):
        raise InputError(f"Unknown profile mode '{mode}'; use exact, approx or auto.")
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for i, name in enumerate(df.columns):
        aggs.append(F.count(col(name)).alias(f"nn{i}"))
        aggs.append(F.approx_count_distinct(col(name), rsd).alias(f"u{i}"))
    approx = _unpivot_profile(df, clean.agg(*aggs))
    if mode == "approx":
        return approx
    # auto: recount exactly where the approximate value could flip a decision.
    rows = approx.collect()  # one row per column: bounded by the schema width
    n = rows[0]["n_rows"] if rows else 0
    recount = [r["ordinal"] for r in rows if near_boundary(n, r["n_unique"], rsd)]
    if not recount:
        return approx
    exact_aggs = [F.count_distinct(col(df.columns[i])).alias(f"e{i}") for i in recount]
    exact_row = clean.agg(*exact_aggs).collect()[0]  # one row
    fixed = {i: exact_row[f"e{i}"] for i in recount}
    mapping = F.create_map(*[x for i, v in fixed.items() for x in (F.lit(i), F.lit(v))])
    return approx.withColumn(
        "n_unique",
        F.coalesce(F.element_at(mapping, F.col("ordinal")), F.col("n_unique")).cast("long"),
    )


def score_profile(profile: DataFrame) -> DataFrame:
    """Target likelihood per column from a profile (A2)."""
    name_s = name_score_expr(F.col("column_name"))
    card_s = card_score_expr(F.col("n_unique"), F.col("n_rows"))
    return (
        profile.withColumn("name_score", F.round(name_s, 4))
        .withColumn("card_score", F.round(card_s, 4))
        .withColumn("score", F.round(F.lit(0.5) * name_s + F.lit(0.5) * card_s, 4))
    )


def rank_target_candidates(df: DataFrame, mode: str = "exact") -> DataFrame:
    """All columns ranked by target likelihood, best first, ties in column order (A3).

    Returns ``rank, column, ordinal, score, name_score, card_score, n_unique``.
    The ranking window runs over one row per column, never over data rows.
    """
    scored = score_profile(profile_columns(df, mode=mode))
    w = Window.orderBy(F.col("score").desc(), F.col("ordinal").asc())
    return scored.select(
        F.row_number().over(w).alias("rank"),
        "column_name",
        "ordinal",
        "score",
        "name_score",
        "card_score",
        "n_unique",
    )


def target_likelihood(df: DataFrame, column: str) -> float:
    """Score of one column (A2), from a profile of that column only."""
    if column not in df.columns:
        raise InputError(f"Column '{column}' not found; available columns: {df.columns}")
    row = score_profile(profile_columns(df.select(col(column)))).select("score").first()
    return float(row["score"])


# Escalation thresholds.
STRONG_AUTO_THRESHOLD = 0.80
STRONG_AUTO_GAP = 0.20
AMBIGUITY_GAP = 0.10
NOT_CLASSIFICATION_THRESHOLD = 0.40
LOW_SCORE_FLAG = 0.2


def resolve_target_table(ranked: DataFrame) -> DataFrame:
    """Escalation decision from a ranking (A4), as one row.

    Returns ``status, target, candidates, top_score, second_score, n_candidates``;
    ``candidates`` lists the top two in ranking order when the choice is ambiguous.
    """
    pos = ranked.filter(F.col("score") > 0)
    w = Window.orderBy(F.col("score").desc(), F.col("ordinal").asc())
    pos = pos.withColumn("pos", F.row_number().over(w))
    agg = pos.agg(
        F.count(F.lit(1)).alias("n_candidates"),
        F.max(F.when(F.col("pos") == 1, F.col("score"))).alias("top_score"),
        F.max(F.when(F.col("pos") == 2, F.col("score"))).alias("second_score"),
        F.max(F.when(F.col("pos") == 1, F.col("column_name"))).alias("top_col"),
        F.max(F.when(F.col("pos") == 2, F.col("column_name"))).alias("second_col"),
    )
    gap = F.col("top_score") - F.col("second_score")
    status = (
        F.when(F.col("n_candidates") == 0, F.lit("not_classification"))
        .when(F.col("top_score") < NOT_CLASSIFICATION_THRESHOLD, F.lit("not_classification"))
        .when(F.col("n_candidates") == 1, F.lit("weak_auto"))
        .when((F.col("top_score") > STRONG_AUTO_THRESHOLD) & (gap > STRONG_AUTO_GAP), F.lit("strong_auto"))
        .when(gap < AMBIGUITY_GAP, F.lit("human_required"))
        .otherwise(F.lit("weak_auto"))
    )
    return agg.select(
        status.alias("status"),
        F.when(status.isin("weak_auto", "strong_auto"), F.col("top_col")).alias("target"),
        F.when(status == "human_required", F.array("top_col", "second_col")).alias("candidates"),
        F.col("top_score"),
        F.col("second_score"),
        F.col("n_candidates"),
    )


def resolve_target(df: DataFrame, target_col: str | None = None, mode: str = "exact"):
    """``(column | [col1, col2] | None, status)`` like the escalation rule (A4)."""
    if target_col is not None:
        if target_col not in df.columns:
            raise InputError(f"No column '{target_col}' to use as target; there are {df.columns}.")
        return target_col, "override"
    row = resolve_target_table(rank_target_candidates(df, mode=mode)).first()
    status = row["status"]
    if status == "human_required":
        return list(row["candidates"]), status
    return row["target"], status


def low_score_flag(df: DataFrame, column: str) -> bool:
    """True when a user-chosen target scores below 0.2 (warn, do not block)."""
    return target_likelihood(df, column) < LOW_SCORE_FLAG
