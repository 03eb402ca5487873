"""Model explanations as Spark plans.

Permutation importance scores every (feature, repeat) variant of all rows (or
of a sample, on request) in ONE ``model.transform``. A row's partner in a repeat
comes from a keyed bijection of the row numbers, computed row by row, so nothing
is sorted per repeat and the rows are joined once per repeat.
"""

from __future__ import annotations

from pyspark.ml import Model
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsight.functions.exprs import DEFAULT_SEED, key_string
from tabsight.operators import split
from tabsight.operators.ranking import index_within
from tabsight.session import cut_lineage

# Fixed values.
IMPORTANCE_REPEATS = 5


def _with_proba_of_columns(model: Model, df: DataFrame, inputs: list[str]) -> DataFrame:
    from tabsight.operators.models import with_proba_of_columns

    return with_proba_of_columns(model, df, inputs)


def _partitions(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def permutation_importance(
    model: Model,
    rows: DataFrame,
    feature_columns: list[str],
    key_cols: list[str],
    n_repeats: int = IMPORTANCE_REPEATS,
    sample: int | None = None,
    seed: int = DEFAULT_SEED,
    label_col: str = "label",
) -> DataFrame:
    """``feature, importance, std`` sorted by importance.

    importance = baseline accuracy − mean permuted accuracy over ``n_repeats``
    seeded permutations of the feature over all rows, or over ``sample`` of
    them; std is the population std over repeats.  The result is written, so
    reading it repeats nothing.
    """
    base = rows.select(*key_cols, label_col, *feature_columns)
    if sample is not None:
        base = split.sample_n(base, sample, key_cols, seed)
    base = cut_lineage(_numbered(base, key_cols, seed, "_i"), "importance-rows")
    n = base.count()
    repeats = base.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_repeats - 1))).alias("_r"))
    partner = base.select(F.col("_i").alias("_p"), F.struct(*[F.col(c).cast("double").alias(c) for c in feature_columns]).alias("_other"))
    # all features of a repeat share its permutation: one join of the rows per repeat
    pairs = repeats.withColumn("_p", permuted_index(F.col("_i"), F.col("_r"), n, seed)).join(partner, "_p")
    rows_v = pairs.select("*", F.explode(F.array(*[F.lit(c) for c in feature_columns])).alias("_f")).select(
        "_f", "_r", label_col,
        *[F.when(F.col("_f") == c, F.col("_other")[c]).otherwise(F.col(c).cast("double")).alias(c) for c in feature_columns],
    )
    baseline = base.select(F.lit("__baseline__").alias("_f"), F.lit(-1).alias("_r"), label_col,
                           *[F.col(c).cast("double").alias(c) for c in feature_columns])
    allrows = rows_v.unionByName(baseline)
    scored = _with_proba_of_columns(model, allrows, feature_columns)
    acc = scored.groupBy("_f", "_r").agg(
        F.avg(F.when(F.col("pred") == F.col(label_col).cast("int"), 1.0).otherwise(0.0)).alias("acc")
    )
    base_acc = acc.where(F.col("_f") == "__baseline__").select(F.col("acc").alias("_b"))
    drops = acc.where(F.col("_f") != "__baseline__")
    b = base_acc.first()["_b"]  # one number
    out = drops.groupBy(F.col("_f").alias("feature")).agg(
        (F.lit(b) - F.avg("acc")).alias("importance"),
        F.stddev_pop(F.lit(b) - F.col("acc")).alias("std"),
    )
    out = cut_lineage(out, "importance")  # one row per feature
    return out.orderBy(F.col("importance").desc(), F.col("feature"))


_ROUNDS = 3
_WALK_STEPS = 32


def permuted_index(i: Column, key: Column, n: int, seed: int = DEFAULT_SEED) -> Column:
    """Where a keyed bijection of 0..n-1 sends ``i``; every ``key`` has its own.

    A number is split into two digits (a place on an a x b board with a*b >= n,
    fewer than a places beyond n); rounds add a hash of one digit to the other,
    which permutes the board. A result beyond n-1 is mapped again until it is
    below n (cycle walking). Up to 1,000 rows the board has at most 32 such
    places; beyond, a walk of 32 steps would have to miss n rows out of n + sqrt(n)
    each time.
    """
    a = max(1, int(n**0.5))
    b = max(1, -(-n // a))

    def rounds(x: Column) -> Column:
        low, high = F.pmod(x, F.lit(a)), F.floor(x / F.lit(a))
        for r in range(_ROUNDS):
            low = F.pmod(low + F.pmod(F.xxhash64(F.lit(seed), key, F.lit(2 * r), high), F.lit(a)), F.lit(a))
            high = F.pmod(high + F.pmod(F.xxhash64(F.lit(seed), key, F.lit(2 * r + 1), low), F.lit(b)), F.lit(b))
        return (low + high * F.lit(a)).cast("long")

    first = rounds(i.cast("long"))
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(_WALK_STEPS)), first, lambda x, _: F.when(x < n, x).otherwise(rounds(x)))
    return F.when(first < n, first).otherwise(walk) if a * b > n else first


def _numbered(rows: DataFrame, key_cols: list[str], seed: int, out_col: str) -> DataFrame:
    """Rows numbered from 0 by md5(seed|key), without a global window."""
    keyed = rows.withColumn("_g", F.lit(0))
    return index_within(keyed, ["_g"], [F.md5(key_string(key_cols, seed)), *key_cols], out_col).drop("_g")


def shapley_summary(
    model: Model,
    rows: DataFrame,
    background: DataFrame,
    feature_columns: list[str],
    key_cols: list[str],
    n_rows: int | None = None,
    n_permutations: int = 10,
    max_display: int | None = None,
    seed: int = DEFAULT_SEED,
    per_row_values: bool = False,
) -> DataFrame:
    """Mean |Shapley value| per feature by permutation sampling.

    For each explained row (all, or ``n_rows`` chosen by md5 order), each seeded
    permutation and each prefix length j, a hybrid row takes the first j
    features of the permutation from the explained row and the rest from a
    background row; all hybrids are scored in ONE transform, in the task that
    holds their row, and only summed there.  The score is
    the probability of the class predicted for the explained row; the
    difference between consecutive prefixes is the contribution of the
    feature added.  Returns ``feature, mean_abs_shap`` (the top ``max_display``, if given),
    or with ``per_row_values`` the values ``_i, feature, phi, f_x, f_bg``.
    """
    nf = len(feature_columns)
    x = rows.select(*key_cols, *feature_columns)
    bg = background.select(*key_cols, *feature_columns)
    if n_rows is not None:
        x, bg = split.sample_n(x, n_rows, key_cols, seed), split.sample_n(bg, n_rows, key_cols, seed + 1)
    inputs = [f"_x{j}" for j in range(nf)]
    # numbered rows are written once, without what only orders them
    x = _numbered(x, key_cols, seed, "_i").select("_i", *[F.col(c).cast("double").alias(i) for c, i in zip(feature_columns, inputs)])
    bg = _numbered(bg, key_cols, seed + 1, "_b")
    n_bg = bg.count()
    bg = bg.select("_b", *[F.col(c).cast("double").alias(f"_bg{j}") for j, c in enumerate(feature_columns)])
    parts = _partitions(rows)
    # explained row i uses background row i mod n_bg; a stated number of parts,
    # which adaptive execution leaves: few bytes here become many hybrids
    x = x.withColumn("_b", F.pmod(F.col("_i"), F.lit(n_bg))).repartition(parts, "_b")
    # the class to explain: the prediction for the row itself
    x = _with_proba_of_columns(model, x, inputs).select(
        "_b", "_i", *inputs, F.col("pred").alias("_cls"), F.element_at("proba", F.col("pred") + 1).alias("_fx"))
    perms = x.join(bg.repartition(parts, "_b"), "_b").select("*", F.explode(F.sequence(F.lit(0), F.lit(n_permutations - 1))).alias("_p"))
    # position of every feature in this row's permutation: rank of md5(seed|i|p|feature)
    keyed = F.array(*[
        F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("_i").cast("string"), F.col("_p").cast("string"), F.lit(str(j)))).alias("h"),
                 F.lit(j).alias("f"))
        for j in range(nf)
    ])
    perms = perms.withColumn("_order", F.transform(F.array_sort(keyed), lambda s: s["f"]))
    at = F.explode(F.sequence(F.lit(0), F.lit(nf - 1))).alias("_j")  # the whole row is scored above
    hyb = perms.select("*", at).select(
        "_b", "_i", "_cls", "_fx", "_j",
        F.when(F.col("_j") > 0, F.element_at("_order", F.greatest(F.col("_j"), F.lit(1)))).alias("_added"), F.element_at("_order", F.col("_j") + 1).alias("_next"),
        # a feature is the row's own if it is among the first j of the permutation
        *[F.when(F.array_position("_order", F.lit(j)) <= F.col("_j"), F.col(i)).otherwise(F.col(f"_bg{j}")).alias(i) for j, i in enumerate(inputs)],
    )
    scored = _with_proba_of_columns(model, hyb, inputs).withColumn("_v", F.element_at("proba", F.col("_cls") + 1))
    whole = (F.col("_j") == nf - 1) & F.col("_v").isNotNull()

    def gained(j: int) -> Column:
        """What a hybrid adds to the sum of the feature's differences."""
        part = F.when(F.col("_added") == j, F.col("_v")).when(F.col("_next") == j, -F.col("_v"))
        own = F.when(whole & (F.col("_next") == j), F.col("_fx"))
        return F.coalesce(part + own, part, F.when(F.col("_v").isNotNull(), F.lit(0.0)))

    # a row's hybrids are in the task of its _b: nothing is shuffled after the scoring
    sums = scored.groupBy("_b", "_i").agg(
        *[(F.sum(gained(j)) / n_permutations).alias(f"_phi{j}") for j in range(nf)],
        F.first("_fx").alias("f_x"), F.avg(F.when(F.col("_j") == 0, F.col("_v"))).alias("f_bg"),
    )
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"_phi{j}").alias("phi")) for j, c in enumerate(feature_columns)])
    values = sums.select("_i", F.explode(cells).alias("_c"), "f_x", "f_bg").select("_i", "_c.feature", "_c.phi", "f_x", "f_bg")
    if per_row_values:
        return values
    summary = values.groupBy("feature").agg(F.avg(F.abs("phi")).alias("mean_abs_shap"))
    ordered = summary.orderBy(F.col("mean_abs_shap").desc(), "feature")
    return ordered if max_display is None else ordered.limit(max_display)


def comparison_table(results: DataFrame, selected: str, best_score: float, scoring: str = "balanced_accuracy") -> DataFrame:
    """Comparison rows and selection reason from search results."""
    best = results.groupBy("name").agg(
        F.max(F.struct("stage", "score")).alias("_b"), F.max("fit_ok").alias("fit_ok")
    )
    reason = (
        f"{selected}: highest {scoring} of the last stage, {best_score:.4f}"
        if best_score >= 0
        else f"{selected}: fallback, no trial ended with a score"
    )
    return best.select(
        "name",
        F.col("_b.stage").alias("last_stage"),
        F.col("_b.score").alias("score"),
        "fit_ok",
        (F.col("name") == F.lit(selected)).alias("selected"),
        F.lit(reason).alias("reason"),
    )
