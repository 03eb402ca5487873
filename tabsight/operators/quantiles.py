"""Exact quantiles of many columns in three scans.

``percentile``/``median`` keep a value→count map whose final merge happens in
one task, so a continuous column of a very large table does not fit.  Here,
at every size and for all columns together:

1. one aggregate: counts, and a ``percentile_approx`` bracket around every
   needed rank;
2. one aggregate checks each bracket (values below its low end, values up to
   its high end).  A bracket whose ends are the same value is the answer; one
   that missed is widened to the whole column;
3. one pass keeps the values inside the remaining brackets, counts each
   distinct value (combined on the map side, so ties cost one row), adds up the
   counts in order with the distributed :func:`running_totals`, and picks the
   two values around each quantile for linear interpolation (NumPy's default).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsight.functions.exprs import col
from tabsight.operators.ranking import running_totals

APPROX_ACCURACY = 10_000
BRACKET = 4.0 / APPROX_ACCURACY


def exact_quantiles(df: DataFrame, columns: list[str], probs: list[float]) -> dict[str, list[float | None]]:
    """``{column: [q(p) for p in probs]}`` with linear interpolation; None for an all-null column."""
    if not columns:
        return {}
    clean = df.select(
        *[
            F.when(~F.isnan(col(c).cast("double")), col(c).cast("double")).alias(f"v{i}")
            for i, c in enumerate(columns)
        ]
    )
    lo_p = [max(0.0, p - BRACKET) for p in probs]
    hi_p = [min(1.0, p + BRACKET) for p in probs]
    aggs = []
    for i in range(len(columns)):
        v = F.col(f"v{i}")
        aggs += [F.count(v).alias(f"n{i}"), F.percentile_approx(v, lo_p + hi_p, APPROX_ACCURACY).alias(f"b{i}")]
    first = clean.agg(*aggs).first()  # one row: counts and bracket ends
    # per (column, probability): the ranks around the quantile, its fraction, the bracket
    need = {}
    for i in range(len(columns)):
        n = first[f"n{i}"]
        for j, p in enumerate(probs) if n else ():
            h = (n - 1) * p
            need[i, j] = (math.floor(h), min(math.floor(h) + 1, n - 1), h - math.floor(h), first[f"b{i}"][j], first[f"b{i}"][len(probs) + j])
    out: dict[str, list[float | None]] = {c: [None] * len(probs) for c in columns}
    if not need:
        return out
    checks = []
    for (i, j), (_, _, _, lo, hi) in need.items():
        v = F.col(f"v{i}")
        checks += [F.count_if(v < F.lit(lo)).alias(f"b{i}_{j}"), F.count_if(v <= F.lit(hi)).alias(f"u{i}_{j}")]
    seen = clean.agg(*checks).first()  # one row
    open_ = {}
    for (i, j), (k0, k1, frac, lo, hi) in need.items():
        below, upto = seen[f"b{i}_{j}"], seen[f"u{i}_{j}"]
        if not below <= k0 <= k1 < upto:
            lo, hi, below = -math.inf, math.inf, 0  # missed: the whole column
        if lo == hi:
            out[columns[i]][j] = lo
        else:
            open_[i, j] = (k0 - below, k1 - below, frac, lo, hi)
    if open_:
        found = _ranked(clean, open_)
        for (i, j), (k0, k1, frac, _, _) in open_.items():
            a, b = found[f"{i}_{j}", k0], found[f"{i}_{j}", k1]
            out[columns[i]][j] = a if a == b else a + (b - a) * frac
    return out


def _ranked(clean: DataFrame, open_: dict) -> dict[tuple[str, int], float]:
    """The values at the wanted 0-based ranks inside each bracket."""
    hits = [
        F.when((F.col(f"v{i}") >= F.lit(lo)) & (F.col(f"v{i}") <= F.lit(hi)), F.struct(F.lit(f"{i}_{j}").alias("q"), F.col(f"v{i}").alias("v")))
        for (i, j), (_, _, _, lo, hi) in open_.items()
    ]
    values = clean.select(F.explode(F.array_compact(F.array(*hits))).alias("x")).select("x.q", "x.v")
    counts = values.groupBy("q", "v").agg(F.count(F.lit(1)).alias("n"))
    summed = running_totals(counts, [F.col("q"), F.col("v")], ["n"])
    # totals run over all brackets: a bracket begins after those before it (one row per bracket)
    starts = summed.groupBy("q").agg(F.min(F.col("cum_n") - F.col("n")).alias("before"))
    wanted = [(f"{i}_{j}", k) for (i, j), (k0, k1, *_) in open_.items() for k in {k0, k1}]
    ranks = clean.sparkSession.createDataFrame(wanted, "q string, rank long")
    # both sides have at most two rows per (column, probability): broadcast
    ranks = ranks.join(F.broadcast(starts), "q").select("q", "rank", (F.col("rank") + F.col("before")).alias("at"))
    here = (summed["q"] == ranks["q"]) & (ranks["at"] < summed["cum_n"]) & (ranks["at"] >= summed["cum_n"] - summed["n"])
    rows = summed.join(F.broadcast(ranks), here).select(ranks["q"], "rank", "v").collect()
    return {(r["q"], r["rank"]): r["v"] for r in rows}
