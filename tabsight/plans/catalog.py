"""Registered queries: one Spark plan and one oracle SQL text per inventory id.

Every query reads the driver tables (or views Spark derives from them) in
full.  ``oracle`` is DuckDB SQL over the same tables; ``None`` marks an
operator that SQL cannot express (model fits, iterative search), for which
only a row check applies.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.feature import MinMaxScaler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsight.operators import evaluate, explain, kernel_shap, lime_quartile, lime_words, models, prep, profile, quality, report, split, text, validate
from tabsight.operators.profile_store import ProfileStore
from tabsight.plans import train, vectors
from tabsight.session import scratch_path
from tabsight.sources import images, registry, tabular
from tabsight.plans import sqltext as S
from tabsight.plans import views as V
from tabsight.sources.tables import read_table


@dataclass(frozen=True)
class Entry:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    oracle: str | None


REGISTRY: dict[str, Entry] = {}


def register(name: str, oracle: str | None):
    def deco(fn):
        REGISTRY[name] = Entry(name, fn, oracle)
        return fn

    return deco


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


# ---------------------------------------------------------------------------
# A1-A4 profiling and target ranking
# ---------------------------------------------------------------------------


@register("A01_profile_columns", S.profile_sql("lineitem"))
def a01(spark, d):
    return profile.profile_columns(t(spark, d, "lineitem"))


@register("A01_profile_batches", S.profile_sql("lineitem"))
def a01b(spark, d):
    """``lineitem`` added to a profile store in four batches, each read once."""
    li = t(spark, d, "lineitem")
    store = ProfileStore(spark, scratch_path(spark, f"profile-{uuid.uuid4().hex}"))
    for i in range(4):
        store.add(f"part-{i}", li.where(F.pmod(F.col("l_orderkey"), F.lit(4)) == i))
    return store.profile()


@register(
    "A02_target_likelihood",
    f"SELECT column_name, ordinal, score, name_score, card_score FROM ({S.scored_profile_sql('orders')})",
)
def a02(spark, d):
    sp = profile.score_profile(profile.profile_columns(t(spark, d, "orders")))
    return sp.select("column_name", "ordinal", "score", "name_score", "card_score")


@register("A03_rank_target_candidates", S.ranked_sql("lineitem"))
def a03(spark, d):
    return profile.rank_target_candidates(t(spark, d, "lineitem"))


_RESOLVE_TABLES = ("lineitem", "orders", "customer", "events", "part")


@register(
    "A04_resolve_target",
    " UNION ALL ".join(f"SELECT * FROM ({S.resolve_sql(x)})" for x in _RESOLVE_TABLES),
)
def a04(spark, d):
    out = None
    for name in _RESOLVE_TABLES:
        one = profile.resolve_target_table(profile.rank_target_candidates(t(spark, d, name)))
        one = one.withColumn("candidates", F.array_join("candidates", ","))
        one = one.select(F.lit(name).alias("table_name"), "*")
        out = one if out is None else out.unionByName(one)
    return out


# ---------------------------------------------------------------------------
# A5-A14 quality gates, U1-U2
# ---------------------------------------------------------------------------

_LEAK_COLS = ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_discount", "l_tax",
              "l_returnflag", "l_linestatus", "leak_num", "leak_cat", "const"]
_LEAK_TYPES = {"l_orderkey": "bigint", "l_partkey": "bigint", "l_linenumber": "int", "l_quantity": "double",
               "l_discount": "double", "l_tax": "double", "l_returnflag": "string", "l_linestatus": "string",
               "leak_num": "int", "leak_cat": "string", "const": "int"}
_LEAK_NUM = [c for c in _LEAK_COLS if _LEAK_TYPES[c] != "string"]
_LEAK_CAT = [c for c in _LEAK_COLS if _LEAK_TYPES[c] == "string"]
_LEAK_IDLIKE = [c for c in _LEAK_COLS if _LEAK_TYPES[c] in ("bigint", "int", "string")]


@register("A05_value_counts", S.value_counts_sql("customer", "c_nationkey"))
def a05(spark, d):
    return quality.value_counts(t(spark, d, "customer"), "c_nationkey")


@register("A06_contingency", S.contingency_sql("part", "p_type", ["p_name", "p_brand"]))
def a06(spark, d):
    return quality.contingency(t(spark, d, "part"), "p_type", ["p_name", "p_brand"])


_A07_SRC = (
    f"(SELECT *, CASE WHEN l_discount > 0.05 THEN 'hi' ELSE 'lo' END AS disc_hi FROM {V.LI_LEAK_SQL})"
)


@register(
    "A07_cramers_v",
    f"SELECT feature, n, r, k, round(chi2, 6) AS chi2, round(v, 8) AS v FROM ("
    f"{S.cramers_sql(S.contingency_sql(_A07_SRC, 'l_linestatus', ['l_returnflag', 'leak_cat', 'disc_hi']))})",
)
def a07(spark, d):
    df = V.li_leak(spark, d).withColumn(
        "disc_hi", F.when(F.col("l_discount") > 0.05, "hi").otherwise("lo")
    )
    cells = quality.contingency(df, "l_linestatus", ["l_returnflag", "leak_cat", "disc_hi"])
    return quality.cramers_v(cells).select(
        "feature", "n", "r", "k", F.round("chi2", 6).alias("chi2"), F.round("v", 8).alias("v")
    )


@register(
    "A08_pearson_with_target",
    "SELECT feature, n_pairs, round(r, 8) AS r FROM ("
    + S.pearson_sql(V.LI_LEAK_SQL, "l_linenumber", [c for c in _LEAK_NUM if c != "l_linenumber"]) + ")",
)
def a08(spark, d):
    feats = [c for c in _LEAK_NUM if c != "l_linenumber"]
    out = quality.pearson_with_target(V.li_leak(spark, d), "l_linenumber", feats)
    return out.select("feature", "n_pairs", F.round("r", 8).alias("r"))


def _warn_sql(target):
    return S.warnings_sql(V.LI_LEAK_SQL, target, _LEAK_COLS, _LEAK_NUM, _LEAK_CAT, _LEAK_IDLIKE, _LEAK_TYPES)


@register(
    "A09_detect_leakage",
    "SELECT column_name, issue, metric, round(value, 6) AS value, detail FROM ("
    + _warn_sql("l_returnflag") + ") WHERE issue = 'feature_leakage'",
)
def a09(spark, d):
    w = quality.detect_leakage(V.li_leak(spark, d), "l_returnflag")
    return w.select("column_name", "issue", "metric", F.round("value", 6).alias("value"), "detail")


@register(
    "A10_leakage_report",
    "SELECT feature, metric, round(value, 4) AS value, CAST(CASE WHEN metric = 'pearson' THEN 0.95 ELSE 0.9 END AS DOUBLE) AS threshold FROM ("
    + S.leakage_scores_sql(V.LI_LEAK_SQL, "l_linenumber", [c for c in _LEAK_NUM if c != "l_linenumber"], _LEAK_CAT)
    + ") WHERE abs(value) > CASE WHEN metric = 'pearson' THEN 0.95 ELSE 0.9 END",
)
def a10(spark, d):
    return quality.leakage_report(V.li_leak(spark, d), "l_linenumber", 0.95, 0.9)


@register(
    "A11_detect_id_columns",
    "SELECT column_name, issue, value, detail FROM ("
    + S.warnings_sql("customer", "c_mktsegment", S.TABLE_COLUMNS["customer"], ["c_custkey", "c_nationkey", "c_acctbal"],
                     ["c_name", "c_mktsegment"], ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"],
                     dict(zip(S.TABLE_COLUMNS["customer"], S.TABLE_TYPES["customer"])))
    + ") WHERE issue = 'id_column'",
)
def a11(spark, d):
    return quality.detect_id_columns(t(spark, d, "customer")).select("column_name", "issue", "value", "detail")


@register(
    "A12_detect_constant_columns",
    "SELECT column_name, issue, value, detail FROM (" + _warn_sql("l_returnflag") + ") WHERE issue = 'constant_column'",
)
def a12(spark, d):
    return quality.detect_constant_columns(V.li_leak(spark, d)).select("column_name", "issue", "value", "detail")


@register(
    "A13_detect_imbalance",
    "SELECT class_name, issue, round(value, 8) AS value, detail FROM ("
    + S.warnings_sql("customer", "c_nationkey", S.TABLE_COLUMNS["customer"], ["c_custkey", "c_nationkey", "c_acctbal"],
                     ["c_name", "c_mktsegment"], ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"],
                     dict(zip(S.TABLE_COLUMNS["customer"], S.TABLE_TYPES["customer"])))
    + ") WHERE issue = 'class_imbalance'",
)
def a13(spark, d):
    w = quality.detect_imbalance(t(spark, d, "customer"), "c_nationkey")
    return w.select("class_name", "issue", F.round("value", 8).alias("value"), "detail")


@register(
    "A13_detect_imbalance_boundary",
    "SELECT class_name, n, fraction FROM (" + S.value_counts_sql("documents", "source") + ") WHERE fraction < 0.05",
)
def a13b(spark, d):
    return quality.value_counts(t(spark, d, "documents"), "source").where(F.col("fraction") < 0.05)


@register(
    "U02_quality_warnings",
    "SELECT gate, seq, column_name, class_name, issue, metric, round(value, 6) AS value, detail FROM ("
    + _warn_sql("l_returnflag") + ")",
)
def u02(spark, d):
    w = quality.quality_warnings(V.li_leak(spark, d), "l_returnflag")
    return w.withColumn("value", F.round("value", 6))


@register("A14_summarize_quality", S.summary_sql(_warn_sql("l_returnflag")))
def a14(spark, d):
    return quality.summarize_quality(V.li_leak(spark, d), "l_returnflag")


# ---------------------------------------------------------------------------
# preprocessing
# ---------------------------------------------------------------------------

_PART_FIT = "(SELECT * FROM part WHERE p_size <= 10)"
_LI_FEATS_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                 "l_discount", "l_tax"]
_LI_FEATS_CAT = ["l_returnflag"]
_LI_PREP_SQL = f"(SELECT * EXCLUDE (l_empty) FROM {V.LI_NULLS_SQL})"


def _li_prep_df(spark, d):
    return V.li_nulls(spark, d).drop("l_empty")


@register("F01_encode_categories_fit", S.dictionary_sql("part", ["p_name", "p_brand", "p_type"]))
def f01(spark, d):
    return prep.fit_dictionary(t(spark, d, "part"), ["p_name", "p_brand", "p_type"])


@register(
    "F02_encode_categories_transform",
    S.encoded_sql("part", _PART_FIT, [], ["p_name", "p_brand", "p_type"], ["p_partkey"]),
)
def f02(spark, d):
    part = t(spark, d, "part")
    fit_rows = part.where(F.col("p_size") <= 10).select("p_name", "p_brand", "p_type", "p_size")
    pre = prep.fit_preprocess(fit_rows, target="p_size")
    return pre.encode(part.select("p_partkey", "p_name", "p_brand", "p_type"), keep=["p_partkey"])


@register(
    "A15_median",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CAST(median(CAST({c} AS DOUBLE)) AS DOUBLE) AS median FROM {V.LI_NULLS_SQL}"
        for c in _LI_FEATS_NUM
    ),
)
def a15(spark, d):
    m = prep.medians(V.li_nulls(spark, d), _LI_FEATS_NUM)
    # one value per column, computed by one Spark aggregate
    return spark.createDataFrame(list(m.items()), "column_name string, median double")


_ENC_LI = S.encoded_sql(_LI_PREP_SQL, _LI_PREP_SQL, _LI_FEATS_NUM, _LI_FEATS_CAT, [])


@register(
    "A16_mean_std",
    f"WITH e AS ({_ENC_LI}) "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, round(avg({c}), 9) AS mean, round(stddev_pop({c}), 9) AS std, "
        f"round(CASE WHEN stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END, 9) AS scale FROM e"
        for c in _LI_FEATS_CAT + _LI_FEATS_NUM
    ),
)
def a16(spark, d):
    df = _li_prep_df(spark, d)
    pre = prep.fit_preprocess(df, target="l_linestatus")
    enc = pre.encode(df)
    out = prep.mean_std(enc, pre.feature_columns)
    return out.select("column_name", *[F.round(c, 9).alias(c) for c in ("mean", "std", "scale")])


@register(
    "F06_fit_preprocess",
    S.scaled_sql(
        S.encoded_sql(_LI_PREP_SQL, _LI_PREP_SQL, _LI_FEATS_NUM, _LI_FEATS_CAT, ["l_linestatus"]),
        _LI_FEATS_CAT + _LI_FEATS_NUM,
        ["CAST(dense_rank() OVER (ORDER BY l_linestatus) - 1 AS DOUBLE) AS label"],
    ),
)
def f06(spark, d):
    df = _li_prep_df(spark, d)
    pre = prep.fit_preprocess(df, target="l_linestatus")
    out = pre.transform(pre.encode_target(df), keep=["label"])
    return out.select("label", *[F.round(c, 6).alias(c) for c in pre.feature_columns])


@register(
    "F03_impute_median",
    "SELECT l_orderkey, l_linenumber, "
    f"coalesce(TRY_CAST(l_tax AS DOUBLE), (SELECT median(l_tax) FROM {V.LI_NULLS_SQL})) AS l_tax FROM {V.LI_NULLS_SQL}",
)
def f03(spark, d):
    df = V.li_nulls(spark, d)
    fill = prep.medians(df, ["l_tax"])["l_tax"]
    return df.select("l_orderkey", "l_linenumber", F.coalesce(F.expr("try_cast(l_tax AS DOUBLE)"), F.lit(fill)).alias("l_tax"))


@register(
    "F04_standard_scale",
    "WITH st AS (SELECT avg(l_extendedprice) AS m, stddev_pop(l_extendedprice) AS s FROM lineitem) "
    "SELECT l_orderkey, l_linenumber, round((l_extendedprice - m) / CASE WHEN s = 0 THEN 1.0 ELSE s END, 6) AS z "
    "FROM lineitem, st",
)
def f04(spark, d):
    li = t(spark, d, "lineitem")
    st = prep.mean_std(li, ["l_extendedprice"]).first()
    return li.select(
        "l_orderkey", "l_linenumber",
        F.round((F.col("l_extendedprice") - F.lit(st["mean"])) / F.lit(st["scale"]), 6).alias("z"),
    )


@register(
    "F05_encode_target",
    "SELECT o_orderkey, o_orderstatus, CAST(dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS DOUBLE) AS label, "
    "o_orderstatus AS decoded FROM orders",
)
def f05(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    pre = prep.fit_preprocess(o, target="o_orderstatus")
    enc = pre.encode_target(o)
    return enc.select("o_orderkey", "o_orderstatus", "label", pre.decode_target("label", "decoded"))


@register(
    "A17_class_weights",
    "SELECT o_orderpriority AS class_name, count(*) AS n, "
    "sum(count(*)) OVER () / (count(*) OVER () * count(*)) AS weight FROM orders GROUP BY 1",
)
def a17(spark, d):
    return prep.class_weights(t(spark, d, "orders"), "o_orderpriority")


# ---------------------------------------------------------------------------
# Samples, folds, hold-out
# ---------------------------------------------------------------------------

_LI_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_LI_KEY_SQL = "concat_ws('|', '42', " + ", ".join(f"CAST({c} AS VARCHAR)" for c in _LI_KEY) + ")"


@register(
    "K02_sample_n",
    f"SELECT {', '.join(_LI_KEY)} FROM lineitem ORDER BY md5({_LI_KEY_SQL}), {', '.join(_LI_KEY)} LIMIT 500",
)
def k02(spark, d):
    return split.sample_n(t(spark, d, "lineitem").select(*_LI_KEY), 500, _LI_KEY)


@register(
    "K03_stratified_kfold",
    f"SELECT {', '.join(_LI_KEY)}, l_returnflag, CAST((row_number() OVER (PARTITION BY l_returnflag "
    f"ORDER BY md5({_LI_KEY_SQL}), {', '.join(_LI_KEY)}) - 1) % 3 AS INTEGER) AS fold FROM lineitem",
)
def k03(spark, d):
    li = t(spark, d, "lineitem").select(*_LI_KEY, "l_returnflag")
    return split.assign_folds(li, "l_returnflag", _LI_KEY, k=3, mode="exact")


@register(
    "K03_hash_folds",
    f"SELECT {', '.join(_LI_KEY)}, CAST(least(floor({S.hash_unit_sql(_LI_KEY, 42)} * 3), 2) AS INTEGER) AS fold FROM lineitem",
)
def k03h(spark, d):
    li = t(spark, d, "lineitem").select(*_LI_KEY, "l_returnflag")
    return split.assign_folds(li, "l_returnflag", _LI_KEY, k=3, mode="hash").drop("l_returnflag")


@register(
    "K04_stratified_holdout",
    "WITH r AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus "
    "ORDER BY md5(concat_ws('|', '42', CAST(o_orderkey AS VARCHAR))), o_orderkey) - 1 AS i, "
    "count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders) "
    "SELECT o_orderkey, o_orderstatus, i < ceil(n * 0.2) AS is_test FROM r",
)
def k04(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return split.stratified_holdout(o, "o_orderstatus", ["o_orderkey"], mode="exact")


# ---------------------------------------------------------------------------
# Evaluation on the scored views
# ---------------------------------------------------------------------------

_S5_PRED = f"(SELECT *, CAST(list_position(proba, list_max(proba)) - 1 AS INTEGER) AS y_pred FROM {V.SCORED5_SQL})"


def _scored5_pred(spark, d):
    s5 = V.scored5(spark, d)
    return s5.withColumn("y_pred", evaluate.argmax(F.col("proba")))


@register(
    "F12_argmax",
    f"SELECT event_id, y_pred FROM {_S5_PRED}",
)
def f12(spark, d):
    return _scored5_pred(spark, d).select("event_id", "y_pred")


@register(
    "F13_apply_threshold",
    f"SELECT event_id, CASE WHEN p1 > 0.3 THEN 1 ELSE 0 END AS y_pred FROM {V.SCORED2_SQL}",
)
def f13(spark, d):
    s2 = V.scored2(spark, d)
    return s2.select("event_id", evaluate.apply_threshold(F.array("p0", "p1"), 0.3, 2).alias("y_pred"))


@register(
    "F14_one_hot_pseudo_proba",
    f"SELECT event_id, [CASE WHEN y_pred = 0 THEN 1.0 ELSE 0.0 END, CASE WHEN y_pred = 1 THEN 1.0 ELSE 0.0 END, "
    f"CASE WHEN y_pred = 2 THEN 1.0 ELSE 0.0 END, CASE WHEN y_pred = 3 THEN 1.0 ELSE 0.0 END, "
    f"CASE WHEN y_pred = 4 THEN 1.0 ELSE 0.0 END]::DOUBLE[] AS proba FROM {_S5_PRED}",
)
def f14(spark, d):
    return _scored5_pred(spark, d).select("event_id", evaluate.one_hot_proba(F.col("y_pred"), 5).alias("proba"))


@register(
    "A18_confusion_matrix",
    f"WITH p AS {_S5_PRED}, cls AS (SELECT y_true AS c FROM p UNION SELECT y_pred FROM p), "
    "cells AS (SELECT y_true, y_pred, count(*) AS n FROM p GROUP BY 1, 2) "
    "SELECT a.c AS true_class, b.c AS pred_class, coalesce(n, 0) AS n FROM cls a CROSS JOIN cls b "
    "LEFT JOIN cells ON cells.y_true = a.c AND cells.y_pred = b.c",
)
def a18(spark, d):
    return evaluate.confusion_matrix(_scored5_pred(spark, d), "y_true", "y_pred")


@register(
    "A19_core_metrics",
    f"SELECT sum(tp) / sum(support) AS accuracy, round(sum(precision * support) / sum(support), 10) AS precision, "
    f"round(sum(recall * support) / sum(support), 10) AS recall, round(sum(f1 * support) / sum(support), 10) AS f1 "
    f"FROM ({S.per_class_sql(_S5_PRED, 'y_true', 'y_pred')})",
)
def a19(spark, d):
    m = evaluate.core_metrics(_scored5_pred(spark, d), "y_true", "y_pred")
    return m.select("accuracy", *[F.round(c, 10).alias(c) for c in ("precision", "recall", "f1")])


@register(
    "A20_classification_report",
    f"WITH pc AS ({S.per_class_sql(_S5_PRED, 'y_true', 'y_pred')}) "
    "SELECT CAST(class_name AS VARCHAR) AS class_name, round(precision, 10) AS precision, round(recall, 10) AS recall, "
    "round(f1, 10) AS f1, support FROM pc "
    "UNION ALL SELECT 'macro avg', round(avg(precision), 10), round(avg(recall), 10), round(avg(f1), 10), sum(support) FROM pc "
    "UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 10), "
    "round(sum(recall * support) / sum(support), 10), round(sum(f1 * support) / sum(support), 10), sum(support) FROM pc",
)
def a20(spark, d):
    r = evaluate.classification_report(_scored5_pred(spark, d), "y_true", "y_pred")
    return r.select("class_name", *[F.round(c, 10).alias(c) for c in ("precision", "recall", "f1")], "support")


@register(
    "A21_balanced_accuracy",
    f"SELECT round(avg(recall), 10) AS balanced_accuracy FROM ({S.per_class_sql(_S5_PRED, 'y_true', 'y_pred')}) WHERE support > 0",
)
def a21(spark, d):
    b = evaluate.balanced_accuracy(_scored5_pred(spark, d), "y_true", "y_pred")
    return b.select(F.round("balanced_accuracy", 10).alias("balanced_accuracy"))


@register("E01_roc_curve", S.roc_sql(V.SCORED2_SQL, "y_true", "p1"))
def e01(spark, d):
    return evaluate.roc_curve(V.scored2(spark, d), "y_true", "p1")


@register(
    "E02_youden_threshold",
    f"SELECT round(auc, 10) AS auc, youden_threshold, youden_j FROM ({S.threshold_sql(V.SCORED2_SQL, 'y_true', 'p1')})",
)
def e02(spark, d):
    s = evaluate.threshold_summary(V.scored2(spark, d), "y_true", "p1")
    return s.select(F.round("auc", 10).alias("auc"), "youden_threshold", "youden_j")


@register(
    "E03_f1_threshold",
    f"SELECT round(auc, 10) AS auc, f1_threshold, f1 FROM ({S.threshold_sql(V.SCORED2_SQL, 'y_true', 'p1')})",
)
def e03(spark, d):
    s = evaluate.threshold_summary(V.scored2(spark, d), "y_true", "p1")
    return s.select(F.round("auc", 10).alias("auc"), "f1_threshold", "f1")


# ---------------------------------------------------------------------------
# Prediction report tables (scored5 as the predictions)
# ---------------------------------------------------------------------------

_NAMES_SQL = "['" + "', '".join(V.EVENT_TYPES_SORTED) + "']"


def _hist_sql(x: str, b: str) -> str:
    i0 = f"least(floor({x} * {b}), {b} - 1)"
    i1 = f"(CASE WHEN {x} < {i0} * (1.0 / {b}) THEN {i0} - 1 ELSE {i0} END)"
    return f"CAST(CASE WHEN {x} >= ({i1} + 1) * (1.0 / {b}) AND {i1} <> {b} - 1 THEN {i1} + 1 ELSE {i1} END AS INTEGER)"


@register(
    "A22_prediction_distribution",
    f"SELECT y_pred AS class_index, list_extract({_NAMES_SQL}, y_pred + 1) AS class_name, count(*) AS n, "
    "count(*) * 100.0 / sum(count(*)) OVER () AS pct, "
    "row_number() OVER (ORDER BY count(*) DESC, y_pred) = 1 AS is_most, "
    f"row_number() OVER (ORDER BY count(*) ASC, y_pred) = 1 AS is_least FROM {_S5_PRED} GROUP BY y_pred",
)
def a22(spark, d):
    return report.prediction_distribution(_scored5_pred(spark, d), "y_pred", V.EVENT_TYPES_SORTED)


@register(
    "A23_prediction_entropy",
    f"WITH c AS (SELECT y_pred, count(*) AS n FROM {_S5_PRED} GROUP BY 1), "
    "t AS (SELECT sum(n) AS tot, count(*) AS k, max(n) AS top FROM c), "
    "e AS (SELECT -sum(n / tot * log2(n / tot + 1e-10)) AS ent FROM c, t) "
    "SELECT tot AS n_samples, k AS n_pred_classes, top / tot AS dominance_ratio, round(ent, 10) AS entropy, "
    "CASE WHEN k > 1 THEN log2(k) ELSE 1.0 END AS max_entropy, "
    "round(ent / CASE WHEN k > 1 THEN log2(k) ELSE 1.0 END, 10) AS normalized_entropy FROM t, e",
)
def a23(spark, d):
    e = report.prediction_entropy(_scored5_pred(spark, d), "y_pred")
    return e.select("n_samples", "n_pred_classes", "dominance_ratio", F.round("entropy", 10).alias("entropy"),
                    "max_entropy", F.round("normalized_entropy", 10).alias("normalized_entropy"))


@register(
    "A24_confidence_stats",
    f"WITH c AS (SELECT list_max(proba) AS c FROM {_S5_PRED}), q AS (SELECT quantile_cont(c, [0.25, 0.5, 0.75]) AS q FROM c) "
    "SELECT round(avg(c), 10) AS mean, round(q[2], 10) AS median, round(stddev_pop(c), 10) AS std, min(c) AS min, max(c) AS max, "
    "round(q[1], 10) AS q25, round(q[3], 10) AS q75, "
    "avg(CASE WHEN c > 0.9 THEN 1.0 ELSE 0.0 END) * 100 AS high_conf_pct, "
    "avg(CASE WHEN c < 0.6 THEN 1.0 ELSE 0.0 END) * 100 AS low_conf_pct FROM c, q GROUP BY q",
)
def a24(spark, d):
    cs = report.confidence_stats(_scored5_pred(spark, d), "proba")
    return cs.select(*[F.round(c, 10).alias(c) if c in ("mean", "median", "std", "q25", "q75") else F.col(c) for c in cs.columns])


@register(
    "A25_per_class_confidence",
    f"SELECT y_pred AS class_index, count(*) AS n, round(avg(proba[y_pred + 1]), 10) AS mean, "
    f"round(stddev_pop(proba[y_pred + 1]), 10) AS std, min(proba[y_pred + 1]) AS min, max(proba[y_pred + 1]) AS max "
    f"FROM {_S5_PRED} GROUP BY 1",
)
def a25(spark, d):
    pc = report.per_class_confidence(_scored5_pred(spark, d), "y_pred", "proba")
    return pc.select("class_index", "n", F.round("mean", 10).alias("mean"), F.round("std", 10).alias("std"), "min", "max")


@register(
    "A26_confidence_histogram",
    f"WITH p AS (SELECT y_pred, list_max(proba) AS c, proba[y_pred + 1] AS pc FROM {_S5_PRED}), "
    "s AS (SELECT y_pred, count(*) AS n_c FROM p GROUP BY 1) "
    f"SELECT -1 AS scope, 20 AS bins, {_hist_sql('c', '20')} AS bin, count(*) AS n FROM p WHERE c BETWEEN 0 AND 1 GROUP BY 3 "
    f"UNION ALL SELECT p.y_pred, CAST(least(n_c, 15) AS INTEGER), {_hist_sql('pc', 'least(n_c, 15)')}, count(*) "
    "FROM p JOIN s ON p.y_pred = s.y_pred WHERE pc BETWEEN 0 AND 1 GROUP BY 1, 2, 3",
)
def a26(spark, d):
    return report.confidence_histogram(_scored5_pred(spark, d), "y_pred", "proba")


_IMPORTANCE_SQL = (
    "SELECT feature, abs(r) AS importance FROM ("
    + S.pearson_sql(V.LI_LEAK_SQL, "l_linenumber", [c for c in _LEAK_NUM if c != "l_linenumber"]) + ") WHERE r IS NOT NULL"
)


def _importance_df(spark, d):
    feats = [c for c in _LEAK_NUM if c != "l_linenumber"]
    r = quality.pearson_with_target(V.li_leak(spark, d), "l_linenumber", feats)
    return r.where(F.col("r").isNotNull()).select("feature", F.abs("r").alias("importance"))


@register(
    "A27_importance_top_n",
    f"SELECT feature, round(importance, 8) AS importance FROM ({_IMPORTANCE_SQL}) ORDER BY importance DESC, feature LIMIT 3",
)
def a27(spark, d):
    top = report.top_n(_importance_df(spark, d), "importance", 3)
    return top.select("feature", F.round("importance", 8).alias("importance"))


@register(
    "F15_prediction_detail",
    f"SELECT event_id AS sample_index, y_pred AS predicted_class, list_extract({_NAMES_SQL}, y_pred + 1) AS predicted_label, "
    "list_max(proba) AS confidence, "
    + ", ".join(f"proba[{i + 1}] AS prob_{n}" for i, n in enumerate(V.EVENT_TYPES_SORTED))
    + f" FROM {_S5_PRED}",
)
def f15(spark, d):
    return report.prediction_detail(_scored5_pred(spark, d), "event_id", "y_pred", "proba", V.EVENT_TYPES_SORTED, classes="predicted")


@register(
    "F16_interpretation_flags",
    f"WITH c AS (SELECT y_pred, count(*) AS n FROM {_S5_PRED} GROUP BY 1), "
    "d AS (SELECT max(n) / sum(n) AS dom FROM c), "
    f"k AS (SELECT avg(CASE WHEN list_max(proba) < 0.6 THEN 1.0 ELSE 0.0 END) * 100 AS low, "
    f"avg(CASE WHEN list_max(proba) > 0.9 THEN 1.0 ELSE 0.0 END) * 100 AS high FROM {_S5_PRED}) "
    "SELECT 'tabular' AS dataset_type, CASE WHEN dom > 0.85 THEN 'strong_dominance' WHEN dom > 0.55 THEN 'moderate_dominance' "
    "ELSE 'balanced' END AS dominance_finding, CASE WHEN low > 30 THEN 'low_confidence' WHEN high > 60 THEN 'high_confidence' END "
    "AS confidence_finding, CASE WHEN low > 20 THEN 'many_low_confidence' WHEN high > 70 THEN 'mostly_high_confidence' END "
    "AS overall_flag FROM d, k",
)
def f16(spark, d):
    p = _scored5_pred(spark, d)
    return report.interpretation_flags(
        report.prediction_entropy(p, "y_pred"), report.confidence_stats(p, "proba"), "tabular"
    )


_F17_SQL = (
    f"WITH a AS (SELECT avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END) AS acc FROM {_S5_PRED}), "
    f"f AS (SELECT feature FROM ({_IMPORTANCE_SQL}) ORDER BY importance DESC, feature LIMIT 1), "
    f"w AS (SELECT list_sort(list_distinct(list(replace(issue, '_', ' ')))) AS fr, count(*) AS n FROM ({_warn_sql('l_returnflag')})) "
    "SELECT 'argmax' AS model_name, acc AS accuracy, feature AS top_feature, "
    "'argmax predicted ' || printf('%.0f', acc * 100) || ' of 100 held-out rows correctly. ' || "
    "'Strongest feature: ' || feature || '. ' || "
    "CASE WHEN n = 0 THEN 'Data checks: nothing found.' "
    "ELSE 'Data checks found: ' || array_to_string(fr, ', ') || '.' END "
    "AS narrative FROM a, f, w"
)


@register("F17_narrative", _F17_SQL)
def f17(spark, d):
    p = _scored5_pred(spark, d)
    acc = p.agg(F.avg(F.when(F.col("y_true") == F.col("y_pred"), 1.0).otherwise(0.0)).alias("accuracy"))
    top = report.top_n(_importance_df(spark, d), "importance", 1).select(F.col("feature").alias("top_feature"))
    warn = quality.quality_warnings(V.li_leak(spark, d), "l_returnflag").agg(
        F.collect_set("issue").alias("issues"), (F.count(F.lit(1)) == 0).alias("passed")
    )
    none_d = F.lit(None).cast("double")
    none_s = F.lit(None).cast("string")
    none_a = F.lit(None).cast("array<string>")
    none_b = F.lit(None).cast("boolean")
    # three one-row parts, stacked and collapsed (no join)
    parts = (
        acc.select("accuracy", none_s.alias("top_feature"), none_a.alias("issues"), none_b.alias("passed"))
        .unionByName(top.select(none_d.alias("accuracy"), "top_feature", none_a.alias("issues"), none_b.alias("passed")))
        .unionByName(warn.select(none_d.alias("accuracy"), none_s.alias("top_feature"), "issues", "passed"))
    )
    run = parts.agg(
        F.lit("argmax").alias("model_name"),
        F.max("accuracy").alias("accuracy"),
        F.max("top_feature").alias("top_feature"),
        F.max("issues").alias("issues"),
        F.max("passed").alias("passed"),
    )
    return report.narrative(run).select("model_name", "accuracy", "top_feature", "narrative")


# ---------------------------------------------------------------------------
# text
# ---------------------------------------------------------------------------

# the whole document on one line: newlines become spaces
_ONE_LINE_SQL = "replace(d.text, chr(10), ' ')"
_TEXT_LINES_SQL = (
    "(SELECT d.doc_id AS line_key, CASE WHEN d.doc_id % 5 = 1 THEN CAST(l.quality AS VARCHAR) || ',' || "
    f"{_ONE_LINE_SQL} WHEN d.doc_id % 11 = 3 THEN {_ONE_LINE_SQL} "
    f"ELSE CAST(l.quality AS VARCHAR) || chr(9) || {_ONE_LINE_SQL} END AS text "
    "FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"
)
_PY_TRIM_SQL = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _trim_sql(x: str) -> str:
    return _PY_TRIM_SQL.format(x=x)


def _text_lines(spark, d):
    docs = t(spark, d, "documents")
    labels = t(spark, d, "labels")
    j = labels.join(docs, "doc_id")  # J4: equi-join on the document key
    first = F.regexp_replace(F.col("text"), "\n", " ")  # the whole document as one line
    q = F.col("quality").cast("string")
    line = (
        F.when(F.col("doc_id") % 5 == 1, F.concat(q, F.lit(","), first))
        .when(F.col("doc_id") % 11 == 3, first)
        .otherwise(F.concat(q, F.lit("\t"), first))
    )
    return j.select(F.col("doc_id").alias("line_key"), line.alias("text"))


@register(
    "J04_labelled_documents",
    "SELECT d.doc_id, l.quality, l.toxic, d.lang, d.n_chars FROM labels l JOIN documents d ON l.doc_id = d.doc_id",
)
def j04(spark, d):
    return t(spark, d, "labels").join(t(spark, d, "documents"), "doc_id").select("doc_id", "quality", "toxic", "lang", "n_chars")


@register(
    "S04_read_text_lines",
    f"SELECT {_trim_sql('line')} AS text FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) "
    f"WHERE length({_trim_sql('line')}) > 0",
)
def s04(spark, d):
    from tabsight.session import scratch_path

    out = scratch_path(spark, f"text-lines-{uuid.uuid4().hex}")
    t(spark, d, "documents").select("text").write.mode("overwrite").text(out)
    return text.read_text_lines(spark, out, min_lines=1).select("text")


@register(
    "S05_parse_labelled_lines",
    "WITH s AS (SELECT line_key, text, CASE WHEN instr(text, chr(9)) > 0 THEN instr(text, chr(9)) "
    f"WHEN instr(text, ',') > 0 THEN instr(text, ',') ELSE 0 END AS p FROM {_TEXT_LINES_SQL}), "
    f"q AS (SELECT line_key, p, {_trim_sql('substr(text, 1, greatest(p - 1, 0))')} AS label, "
    f"{_trim_sql('substr(text, p + 1)')} AS body FROM s) "
    "SELECT line_key, label, body AS text FROM q WHERE p > 0 AND length(label) > 0 AND length(body) > 0",
)
def s05(spark, d):
    return text.parse_labelled_lines(_text_lines(spark, d))


@register(
    "S06_read_unlabelled_lines",
    "SELECT conv_id, turn, "
    + _trim_sql("CASE WHEN instr(line, chr(9)) > 0 THEN substr(line, instr(line, chr(9)) + 1) ELSE line END")
    + " AS text FROM (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN role || chr(9) || replace(text, chr(10), ' ') "
    "ELSE replace(text, chr(10), ' ') END AS line FROM conversations)",
)
def s06(spark, d):
    c = t(spark, d, "conversations")
    first = F.regexp_replace(F.col("text"), "\n", " ")  # the whole turn as one line
    lines = c.select(
        "conv_id", "turn",
        F.when(F.col("turn") % 2 == 0, F.concat(F.col("role"), F.lit("\t"), first)).otherwise(first).alias("text"),
    )
    return text.read_unlabelled_lines(lines)


_CLEAN_SQL = (
    "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '<[^>]+>', ' ', 'g'), "
    "'https?://\\S+', ' ', 'g'), '[^\\P{{C}}\\t\\n]', '', 'g'), '\\s+', ' ', 'g'))"
)


@register("F07_clean_text", "SELECT page_id, " + _CLEAN_SQL.format(x="html") + " AS text FROM pages")
def f07(spark, d):
    return t(spark, d, "pages").select("page_id", text.clean_text(F.col("html")).alias("text"))


_KERAS_SPLIT_SQL = (
    "string_split(regexp_replace(lower({x}), '[!\"#$%&()*+,\\-./:;<=>?@\\[\\\\\\]^_`{{|}}~\\t\\n]', ' ', 'g'), ' ')"
)
_DOC_TOKENS_SQL = (
    "(SELECT doc_id, pos, word FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM "
    f"(SELECT doc_id, {_KERAS_SPLIT_SQL.format(x=_CLEAN_SQL.format(x='text'))} AS w FROM documents)) WHERE word <> '')"
)
_VOCAB_SQL = (
    f"SELECT word, count, index FROM (SELECT word, count(*) AS count, "
    "row_number() OVER (ORDER BY count(*) DESC, min(doc_id * 100000000 + pos)) + 1 AS index "
    f"FROM {_DOC_TOKENS_SQL} GROUP BY word) WHERE index < 10000"
)


def _clean_docs(spark, d):
    return t(spark, d, "documents").select("doc_id", text.clean_text(F.col("text")).alias("text"))


@register("F08_fit_vocabulary", _VOCAB_SQL)
def f08(spark, d):
    return text.fit_vocabulary(_clean_docs(spark, d), "text", ["doc_id"]).words


_SEQ_SQL = (
    f"WITH v AS ({_VOCAB_SQL}), s AS (SELECT t.doc_id, CAST(list(coalesce(v.index, 1) ORDER BY t.pos) AS INTEGER[]) AS ids "
    f"FROM {_DOC_TOKENS_SQL} t LEFT JOIN v ON t.word = v.word GROUP BY t.doc_id) "
    "SELECT d.doc_id, coalesce(s.ids, CAST([] AS INTEGER[])) AS ids FROM documents d LEFT JOIN s ON d.doc_id = s.doc_id"
)


@register("F09_texts_to_sequences", _SEQ_SQL)
def f09(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "text")
    _vocab, seq = text.fit_transform_sequences(docs, "doc_id", "text")
    return seq


@register(
    "F10_pad_sequences",
    f"WITH s AS ({_SEQ_SQL}) SELECT doc_id, CAST(list_concat(list_transform(range(greatest(120 - len(ids), 0)), lambda x: 0), "
    "CASE WHEN len(ids) > 120 THEN ids[len(ids) - 119:] ELSE ids END) AS INTEGER[]) AS x FROM s",
)
def f10(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "text")
    _vocab, seq = text.fit_transform_sequences(docs, "doc_id", "text")
    return seq.select("doc_id", text.pad_sequences(F.col("ids"), 120).alias("x"))


_TOK_SQL = (
    "(SELECT doc_id, regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}_]{2,}') AS t FROM documents)"
)
_TERMS_SQL = (
    f"(SELECT doc_id, unnest(t) AS term FROM {_TOK_SQL} UNION ALL "
    f"SELECT doc_id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) FROM {_TOK_SQL})"
)
_TFIDF_SQL = (
    f"WITH tf AS (SELECT doc_id, term, count(*) AS tf FROM {_TERMS_SQL} GROUP BY 1, 2), "
    "n AS (SELECT count(DISTINCT doc_id) AS n FROM documents), "
    "st AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY 1), "
    "kept AS (SELECT term, df FROM st WHERE df >= 2 ORDER BY cf DESC, term LIMIT 20000), "
    "terms AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS idx, df, ln((1.0 + n) / (1.0 + df)) + 1.0 AS idf FROM kept, n), "
    "w AS (SELECT tf.doc_id, tf.term, terms.idx, tf.tf, (1.0 + ln(tf.tf)) * terms.idf AS w FROM tf JOIN terms ON tf.term = terms.term) "
    "SELECT doc_id, term, idx, tf, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 8) AS weight FROM w"
)


@register("F11_tfidf", _TFIDF_SQL)
def f11(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "text")
    _model, out = text.fit_transform_tfidf(docs, "doc_id", "text")
    return out.select("doc_id", "term", "idx", "tf", F.round("weight", 8).alias("weight"))


# ---------------------------------------------------------------------------
# Models on Spark ML (rows checks: fits are not SQL)
# ---------------------------------------------------------------------------


def _customer(spark, d):
    return t(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")


def _orders_features(spark, d):
    return t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority")


def _customer_features(spark, d):
    """Encoded customers with the market segment as label; the fitted preprocessor."""
    cust = _customer(spark, d)
    pre = prep.fit_preprocess(cust.drop("c_custkey"), "c_mktsegment")
    data = train.feature_table(pre, cust.withColumn(train.ROW_KEY, F.col("c_custkey").cast("string")), [train.ROW_KEY])
    return pre, data


_runs: dict[tuple[str, str], train.FittedRun] = {}


def _customer_run(spark, d):
    """The training run over all candidates; M05, M10 and F18 show parts of one run per session and table."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _runs:
        _runs.clear()
        _runs[key] = train.train_tabular(_customer(spark, d), "c_mktsegment", ["c_custkey"], importance=True)
    return _runs[key]


@register("M04_cross_val_score", None)
def m04(spark, d):
    cust = _customer(spark, d)
    pre = prep.fit_preprocess(cust.drop("c_custkey"), "c_mktsegment")
    data = train.feature_table(pre, cust.withColumn(train.ROW_KEY, F.col("c_custkey").cast("string")), [train.ROW_KEY])
    k = split.n_folds_for(data, "label", 3)
    folded = split.assign_folds(data, "label", [train.ROW_KEY], k=k, mode="exact").persist()
    scores = models.cross_val_score(models.fallback_candidate(), folded, k, len(pre.feature_columns), len(pre.classes))
    folded.unpersist()
    return spark.createDataFrame([(i, s) for i, s in enumerate(scores)], "fold int, balanced_accuracy double")


@register("M05_successive_halving", None)
def m05(spark, d):
    return _customer_run(spark, d).search.drop("seconds")


def _orders_run(spark, d, importance=False):
    o = _orders_features(spark, d)
    return train.train_tabular(
        o, "o_orderpriority", ["o_orderkey"], candidates=[models.fallback_candidate()], search=False,
        importance=importance, quality_check=False,
    )


@register("M06_fit_winner", None)
def m06(spark, d):
    run = _orders_run(spark, d)
    m = {k: v for k, v in run.metrics.items() if k != "confusion"}
    return spark.createDataFrame([(k, float(v)) for k, v in m.items()], "metric string, value double")


@register(
    "M11_predict_batch",
    "SELECT o_orderkey AS sample_index, true AS label_of_class, true AS confidence_is_largest, CAST(1.0 AS DOUBLE) AS prob_sum FROM orders",
)
def m11(spark, d):
    run = _orders_run(spark, d)
    out = train.predict_batch(run, _orders_features(spark, d), "o_orderkey")
    probs = [F.col(f"`{c}`") for c in out.columns if c.startswith("prob_")]
    names = F.array(*[F.lit(c) for c in run.classes])
    return out.select(
        "sample_index",
        (F.col("predicted_label") == F.element_at(names, F.col("predicted_class") + 1)).alias("label_of_class"),
        (F.abs(F.col("confidence") - F.greatest(*probs)) < 1e-9).alias("confidence_is_largest"),
        F.round(sum(probs[1:], probs[0]), 6).alias("prob_sum"),
    )


@register(
    "E04_permutation_importance",
    "SELECT unnest(['o_orderkey', 'o_custkey', 'o_totalprice', 'o_orderstatus']) AS feature, true AS in_range",
)
def e04(spark, d):
    imp = _orders_run(spark, d, importance=True).importance
    return imp.select("feature", (F.col("importance").between(-1, 1) & (F.col("std") >= 0)).alias("in_range"))


@register("M10_train_pipeline", None)
def m10(spark, d):
    run = _customer_run(spark, d)
    top = run.importance.first()
    return spark.createDataFrame(
        [(run.model_name, run.metrics["accuracy"], run.metrics["balanced_accuracy"], top["feature"] if top else None,
          run.quality["summary"] if run.quality else None)],
        "model_name string, accuracy double, balanced_accuracy double, top_feature string, quality string",
    )


@register("M09_random_search", None)
def m09(spark, d):
    pre, data = _customer_features(spark, d)
    # complement and multinomial counts need values of 0 and more
    scaled = MinMaxScaler(inputCol="features", outputCol="scaled").fit(data).transform(data)
    positive = scaled.drop("features").withColumnRenamed("scaled", "features")
    out = None
    for kind in ("LogisticRegression", "RandomForest", "MLP", "NaiveBayes"):  # not the one-vs-rest families: README
        rows = positive if kind == "NaiveBayes" else data
        _p, _m, results = models.random_search(kind, rows, "label", [train.ROW_KEY], len(pre.feature_columns), len(pre.classes))
        named = results.drop("seconds").withColumn("family", F.lit(kind))
        out = named if out is None else out.unionByName(named)
    return out


def _labelled_docs(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "text")
    return t(spark, d, "labels").select("doc_id", F.col("quality").cast("string").alias("quality")).join(docs, "doc_id")


@register("M02_text_candidates", None)
def m02(spark, d):
    ld = _labelled_docs(spark, d).withColumn("text", text.clean_text(F.col("text")))
    counts = text.checkpointed_term_counts(ld, "doc_id", "text")
    tf = text.fit_tfidf(ld, "doc_id", "text", tf=counts)
    vec = tf.vectors(ld, "doc_id", "text", tf=counts)
    classes = sorted(r[0] for r in ld.select("quality").distinct().collect())
    labelled = ld.select("doc_id", (F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("quality")) - 1)
                         .cast("double").alias("label"))
    data = vec.join(labelled, "doc_id")
    n_feat = tf._size()
    _name, _score, results = models.successive_halving(
        models.text_candidates(), data, "label", ["doc_id"], n_feat
    )
    return results.drop("seconds")


@register("M10_train_text", None)
def m10t(spark, d):
    ld = _labelled_docs(spark, d)
    run = train.train_text(ld, "doc_id", "text", "quality")
    m = {k: v for k, v in run.metrics.items() if k != "confusion"}
    return spark.createDataFrame([(run.model_name, k, float(v)) for k, v in m.items()], "model_name string, metric string, value double")


@register("M11_predict_text", None)
def m11t(spark, d):
    ld = _labelled_docs(spark, d)
    run = train.train_text(ld, "doc_id", "text", "quality", candidates=[models.fallback_candidate()], search=False)
    lines = text.read_unlabelled_lines(t(spark, d, "benchmark").select("item_id", "text"))
    return train.predict_text(run, lines, "item_id", "text")


@register("M03_vector_candidates", None)
def m03(spark, d):
    from pyspark.ml.functions import array_to_vector

    emb = t(spark, d, "embeddings").select(
        "vec_id", array_to_vector(F.col("embedding")).alias("features"), F.col("label").cast("double").alias("label")
    )
    cand = models.vector_candidates()[0]
    model, pred, _flagged = train.fit_winner(cand, emb, ["vec_id"], emb.select("label").distinct().count())
    m = {k: v for k, v in train.holdout_metrics(pred).items() if k != "confusion"}
    return spark.createDataFrame([(k, float(v)) for k, v in m.items()], "metric string, value double")


@register("M10_train_vectors", "SELECT vec_id AS sample_index, true AS same, true AS confidence_is_largest FROM embeddings")
def m10v(spark, d):
    """A head trained on ``embeddings``, saved, found in the runs table, loaded and applied to all rows."""
    base = scratch_path(spark, f"vectors-{uuid.uuid4().hex}")
    emb = t(spark, d, "embeddings")
    run = vectors.train_vectors(emb, "vec_id", "embedding", "label", save_path=base + "/model", registry_path=base + "/runs")
    found = registry.list_runs(spark, base + "/runs").where(F.col("dataset_type") == "vector").first()
    again = vectors.FittedVectorRun.load(spark, found["model_dir"])
    before = vectors.predict_vectors(run, emb, "vec_id", "embedding").select("sample_index", F.col("predicted_label").alias("_before"))
    after = vectors.predict_vectors(again, emb, "vec_id", "embedding")
    probs = [F.col(f"`{c}`") for c in after.columns if c.startswith("prob_")]
    return after.join(before, "sample_index").select(
        "sample_index", (F.col("_before") == F.col("predicted_label")).alias("same"),
        (F.abs(F.col("confidence") - F.greatest(*probs)) < 1e-9).alias("confidence_is_largest"),
    )


@register("S14_save_load_fitted", "SELECT o_orderkey AS sample_index, true AS same FROM orders")
def s14(spark, d):
    base = scratch_path(spark, f"model-{uuid.uuid4().hex}")
    run = train.train_tabular(
        _orders_features(spark, d), "o_orderpriority", ["o_orderkey"], candidates=[models.fallback_candidate()], search=False,
        importance=False, quality_check=False, save_path=base + "/model", registry_path=base + "/runs",
    )
    # the run is looked up in the runs table and loaded from there
    found = registry.list_runs(spark, base + "/runs").where(F.col("model_name") == run.model_name).first()
    again = train.FittedRun.load(spark, found["model_dir"])
    before = train.predict_batch(run, _orders_features(spark, d), "o_orderkey", detail=False)
    after = train.predict_batch(again, _orders_features(spark, d), "o_orderkey", detail=False)
    b = before.select("sample_index", F.col("pred").alias("pred_before"))
    a = after.select("sample_index", F.col("pred").alias("pred_after"))
    return b.join(a, "sample_index").select("sample_index", (F.col("pred_before") == F.col("pred_after")).alias("same"))


@register("T01_predict_stream", "SELECT event_id AS sample_index, true AS known_class, CAST(1.0 AS DOUBLE) AS prob_sum FROM events")
def t01(spark, d):
    from tabsight.streaming.scoring import predict_stream, stream_source

    ev = t(spark, d, "events").select("event_id", "user_id", "value", "event_type")
    run = train.train_tabular(ev, "event_type", ["event_id"], candidates=[models.fallback_candidate()], search=False,
                              importance=False, quality_check=False)
    stream = stream_source(spark, f"{d}/events*.parquet", t(spark, d, "events"))
    q, out = predict_stream(run, stream.select("event_id", "user_id", "value", "event_type"), "event_id")
    q.awaitTermination()
    scored = spark.read.parquet(out)
    total = F.aggregate("proba", F.lit(0.0), lambda a, b: a + b)
    return scored.select("sample_index", F.col("predicted_class").isin(run.classes).alias("known_class"), F.round(total, 6).alias("prob_sum"))


# ---------------------------------------------------------------------------
# Explanations and comparison rows (rows checks)
# ---------------------------------------------------------------------------


def _orders_scaled(spark, d, run):
    o = _orders_features(spark, d)
    return run.pre.transform(o.withColumn("_key", F.col("o_orderkey")), keep=["_key"])


@register("E07_shapley_summary", None)
def e07(spark, d):
    run = _orders_run(spark, d)
    rows = _orders_scaled(spark, d, run)
    return explain.shapley_summary(run.model, rows, rows, run.pre.feature_columns, ["_key"], n_permutations=10)


@register("E07_kernel_shapley", None)
def e07k(spark, d):
    run = _orders_run(spark, d)
    rows = _orders_scaled(spark, d, run)
    background = kernel_shap.background_summary(rows, run.pre.feature_columns)
    values = kernel_shap.kernel_shapley(run.model, rows, background, run.pre.feature_columns, ["_key"])
    return kernel_shap.shapley_importance(values, run.pre.feature_columns)


@register("E05_lime_tabular", None)
def e05(spark, d):
    run = _orders_run(spark, d)
    rows = _orders_scaled(spark, d, run)
    inst = rows.where("_key % 20 = 0")  # the queries: every id divisible by 20
    bins = lime_quartile.fit_quartile_bins(rows, run.pre.feature_columns)
    return lime_quartile.lime_quartile(run.model, inst, bins, run.pre.feature_columns, "_key")


@register("E06_lime_text", None)
def e06(spark, d):
    from pyspark.ml.classification import LogisticRegression

    ld = _labelled_docs(spark, d).withColumn("text", text.clean_text(F.col("text")))
    counts = text.checkpointed_term_counts(ld, "doc_id", "text")
    tf = text.fit_tfidf(ld, "doc_id", "text", tf=counts)
    vec = tf.vectors(ld, "doc_id", "text", tf=counts)
    classes = sorted(r[0] for r in ld.select("quality").distinct().collect())
    lab = ld.select("doc_id", (F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("quality")) - 1)
                    .cast("double").alias("label"))
    rows = vec.join(lab, "doc_id").persist()  # read twice by the fit
    model = LogisticRegression(maxIter=100).fit(rows)
    rows.unpersist()
    inst = ld.where("doc_id % 20 = 0").select("doc_id", "text")  # the queries: every id divisible by 20
    return lime_words.lime_text(model, tf, inst, "doc_id", "text")


@register("F18_selection_reason", None)
def f18(spark, d):
    run = _customer_run(spark, d)
    best = run.search.where("stage = 3 AND fit_ok").agg(F.max("score")).first()[0]
    return explain.comparison_table(run.search, run.model_name, -1.0 if best is None else best)


# ---------------------------------------------------------------------------
# SQL-checkable sources and rules
# ---------------------------------------------------------------------------

_SHAPE_TABLES = ("lineitem", "orders", "customer", "part", "events")


@register(
    "M08_recommend_baseline",
    " UNION ALL ".join(
        f"SELECT '{x}' AS table_name, count(*) AS n_rows, {len(S.TABLE_COLUMNS[x]) - 1} AS n_features, "
        f"CASE WHEN count(*) <= 500 OR {len(S.TABLE_COLUMNS[x]) - 1} <= 20 THEN 'MLP-Small' "
        f"WHEN {len(S.TABLE_COLUMNS[x]) - 1} <= 100 THEN 'MLP-Medium' ELSE 'MLP-Large' END AS recommended FROM {x}"
        for x in _SHAPE_TABLES
    ),
)
def m08(spark, d):
    out = None
    for x in _SHAPE_TABLES:
        df = t(spark, d, x)
        nf = len(df.columns) - 1
        row = df.agg(F.count(F.lit(1)).alias("n_rows"))
        rec = models.baseline_expr(F.lit("tabular"), F.lit(nf), F.col("n_rows"))
        one = row.select(F.lit(x).alias("table_name"), "n_rows", F.lit(nf).alias("n_features"), rec.alias("recommended"))
        out = one if out is None else out.unionByName(one)
    return out


_ORDERS_CSV_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


@register(
    "S01_read_tabular",
    f"SELECT {', '.join(_ORDERS_CSV_COLS)}, CASE WHEN o_orderkey % 7 = 0 THEN o_orderstatus || chr(10) || 'café, \"quoted\"' "
    "ELSE o_orderpriority END AS note FROM orders",
)
def s01(spark, d):
    from tabsight.session import scratch_path

    out = scratch_path(spark, f"orders-csv-{uuid.uuid4().hex}")
    # line breaks, quotes and commas inside fields
    note = F.when(F.col("o_orderkey") % 7 == 0, F.concat("o_orderstatus", F.lit('\ncafé, "quoted"'))).otherwise(F.col("o_orderpriority"))
    rows = t(spark, d, "orders").select(*_ORDERS_CSV_COLS, note.alias("note"))
    rows.write.option("header", True).option("escape", '"').csv(out + ".csv")
    return tabular.read_tabular(spark, out + ".csv")


@register(
    "S02_clean_tabular",
    "SELECT l_orderkey, l_partkey, l_linenumber, l_tax, l_returnflag FROM " + V.LI_NULLS_SQL + " WHERE l_linenumber <> 7",
)
def s02(spark, d):
    li = V.li_nulls(spark, d)
    blank = F.col("l_linenumber") == 7
    cols = ["l_orderkey", "l_partkey", "l_linenumber", "l_tax", "l_returnflag"]
    df = li.select(
        F.when(blank, F.lit(None)).otherwise(F.lit(0)).alias("Unnamed: 0"),
        *[F.when(blank, F.lit(None)).otherwise(F.col(c)).alias(c) for c in cols],
    )
    return tabular.clean_tabular(df)


@register(
    "S11_detect_dataset_type",
    "SELECT count(*) AS n_files, avg(CASE WHEN regexp_matches(url, '(?i)\\.(png|jpe?g)$') THEN 1.0 ELSE 0.0 END) AS image_share, "
    "CASE WHEN count(*) = 0 OR avg(CASE WHEN regexp_matches(url, '(?i)\\.(png|jpe?g)$') THEN 1.0 ELSE 0.0 END) = 0 THEN 'unknown' "
    "WHEN avg(CASE WHEN regexp_matches(url, '(?i)\\.(png|jpe?g)$') THEN 1.0 ELSE 0.0 END) >= 0.5 THEN 'image' ELSE 'unknown' END "
    "AS dataset_type FROM pages",
)
def s11(spark, d):
    return tabular.listing_type(t(spark, d, "pages"), "url")


# one row per table: its counts and whether the rule holds
_SHAPES = {"region": ("region", 2), "orders": ("orders", 6), "lineitem_nulls": (V.LI_NULLS_SQL, 11)}


@register(
    "S03_require_shape",
    " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, count(*) AS n_rows, {k} AS n_columns, "
        + ("CASE WHEN count(l_empty) = 0 THEN 'l_empty' ELSE '' END" if name == "lineitem_nulls" else "''")
        + " AS empty_columns, count(*) >= 10"
        + (" AND count(l_empty) > 0" if name == "lineitem_nulls" else "")
        + f" AS usable FROM {src}"
        for name, (src, k) in _SHAPES.items()
    ),
)
def s03(spark, d):
    out = None
    for name in _SHAPES:
        df = V.li_nulls(spark, d) if name == "lineitem_nulls" else t(spark, d, name)
        one = validate.shape_report(df).select(
            F.lit(name).alias("table_name"), "n_rows", "n_columns", F.concat_ws(",", "empty_columns").alias("empty_columns"), "usable")
        out = one if out is None else out.unionByName(one)
    return out


@register("S10_image_class_gate", "SELECT label, count(*) AS n FROM embeddings GROUP BY label")
def s10(spark, d):
    return images.image_class_gate(t(spark, d, "embeddings"))


_EXPECTED = ["o_orderkey", "o_totalprice", "o_discount", "o_orderstatus", "o_clerk"]
_HAVE = "(SELECT column_name FROM (DESCRIBE orders))"
_WANT = "(SELECT unnest([" + ", ".join(f"'{c}'" for c in _EXPECTED) + "]) AS column_name)"
_PROBLEMS_SQL = (
    f"SELECT column_name, 'missing' AS problem FROM (SELECT * FROM {_WANT} EXCEPT SELECT * FROM {_HAVE}) "
    f"UNION ALL SELECT column_name, 'unexpected' FROM (SELECT * FROM {_HAVE} EXCEPT SELECT * FROM {_WANT})"
)


@register("V06_check_prediction_columns", _PROBLEMS_SQL)
def v06(spark, d):
    return validate.check_prediction_columns(t(spark, d, "orders"), _EXPECTED, strict=False)


_WORTH_SQL = (
    "(SELECT o_orderstatus AS stage, o_custkey % 25 AS ordinal, max(o_totalprice) AS score FROM orders GROUP BY ALL)"
)


@register(
    "W05_promotion",
    "SELECT stage, ordinal, score, CAST(row_number() OVER w AS INTEGER) AS rank, "
    "row_number() OVER w <= greatest(1, floor(count(*) OVER (PARTITION BY stage) * 0.5)) AS promoted "
    f"FROM {_WORTH_SQL} WINDOW w AS (PARTITION BY stage ORDER BY score DESC, ordinal)",
)
def w05(spark, d):
    # one score per (status, group of customers) stands for (stage, candidate)
    scores = t(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("stage"), (F.col("o_custkey") % 25).alias("ordinal")).agg(
        F.max("o_totalprice").alias("score"))
    return models.promotion_table(scores)


@register("S12_preview", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 5")
def s12(spark, d):
    return tabular.preview(t(spark, d, "orders"), ["o_orderkey"])


@register(
    "S13_write_predictions",
    f"SELECT CAST(event_id AS BIGINT) AS index, CAST(y_pred AS INTEGER) AS predicted_class, "
    f"list_extract({_NAMES_SQL}, y_pred + 1) AS label FROM {_S5_PRED}",
)
def s13(spark, d):
    from tabsight.session import scratch_path

    p = _scored5_pred(spark, d)
    names = F.array(*[F.lit(n) for n in V.EVENT_TYPES_SORTED])
    out = p.select(F.col("event_id").alias("index"), F.col("y_pred").alias("predicted_class"),
                   F.element_at(names, F.col("y_pred") + 1).alias("label"))
    path = scratch_path(spark, f"predictions-{uuid.uuid4().hex}")
    tabular.write_predictions(out, path, "csv")
    back = spark.read.option("header", True).schema("index long, predicted_class int, label string").csv(path)
    return back


@register(
    "K06_top_predictions_preview",
    f"SELECT event_id AS sample_index, list_extract({_NAMES_SQL}, y_pred + 1) AS predicted_label "
    f"FROM {_S5_PRED} ORDER BY event_id LIMIT 20",
)
def k06(spark, d):
    names = F.array(*[F.lit(n) for n in V.EVENT_TYPES_SORTED])
    p = _scored5_pred(spark, d).select(
        F.col("event_id").alias("sample_index"), F.element_at(names, F.col("y_pred") + 1).alias("predicted_label")
    )
    return tabular.preview(p, ["sample_index"], 20)


@register(
    "S15_latest_per_key",
    "SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM (SELECT *, row_number() OVER "
    "(PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1",
)
def s15(spark, d):
    o = t(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    out = registry.latest_per_key(o, ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return out.select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")


_TARGETS = [("customer", "c_mktsegment"), ("orders", "o_orderstatus"), ("lineitem", "l_returnflag"),
            ("events", "event_type"), ("labels", "quality")]


@register(
    "V04_validate_target",
    " UNION ALL ".join(
        f"SELECT '{x}' AS table_name, '{c}' AS column_name, count({c}) AS n_nonnull, count(DISTINCT {c}) AS n_classes FROM {x}"
        for x, c in _TARGETS
    ),
)
def v04(spark, d):
    out = None
    for x, c in _TARGETS:
        one = validate.target_stats(t(spark, d, x), c).select(
            F.lit(x).alias("table_name"), F.lit(c).alias("column_name"), "n_nonnull", "n_classes"
        )
        out = one if out is None else out.unionByName(one)
    return out


@register("V05_drop_all_null_columns", f"SELECT * EXCLUDE (l_empty) FROM {V.LI_NULLS_SQL}")
def v05(spark, d):
    return validate.drop_all_null_columns(V.li_nulls(spark, d))


@register("V07_dedupe_columns", "SELECT l_orderkey AS dup, l_partkey AS dup_2, l_suppkey AS dup_1 FROM lineitem")
def v07(spark, d):
    li = t(spark, d, "lineitem")
    return validate.dedupe_columns(li.select(F.col("l_orderkey").alias("dup"), F.col("l_partkey").alias("dup"),
                                             F.col("l_suppkey").alias("dup_1")))


@register("V09_select_features", "SELECT o_totalprice, o_orderpriority, o_custkey FROM orders")
def v09(spark, d):
    return validate.select_features(t(spark, d, "orders"), ["o_totalprice", "o_orderpriority", "o_custkey"])


@register(
    "V10_image_extension_filter",
    "SELECT page_id, url, regexp_matches(url, '(?i)\\.(png|jpe?g|bmp|gif|tiff?)$') AS is_image FROM pages",
)
def v10(spark, d):
    p = t(spark, d, "pages")
    return p.select("page_id", "url", validate.is_image_path(F.col("url")).alias("is_image"))


@register(
    "K05_folder_split",
    "WITH r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label "
    "ORDER BY md5(concat_ws('|', '42', CAST(vec_id AS VARCHAR))), vec_id) - 1 AS i, "
    "count(*) OVER (PARTITION BY label) AS n FROM embeddings) "
    "SELECT vec_id, label, i < ceil(n * 0.2) AS is_validation FROM r",
)
def k05(spark, d):
    e = t(spark, d, "embeddings").select("vec_id", "label")
    return split.folder_split(e, "label", "vec_id")


@register(
    "U05_distinct_labels",
    "SELECT DISTINCT label FROM (SELECT " + _trim_sql("substr(text, 1, greatest(p - 1, 0))") + " AS label, "
    + _trim_sql("substr(text, p + 1)") + " AS body FROM (SELECT text, CASE WHEN instr(text, chr(9)) > 0 THEN instr(text, chr(9)) "
    "WHEN instr(text, ',') > 0 THEN instr(text, ',') ELSE 0 END AS p FROM " + _TEXT_LINES_SQL + ") WHERE p > 0) "
    "WHERE length(label) > 0 AND length(body) > 0",
)
def u05(spark, d):
    return text.parse_labelled_lines(_text_lines(spark, d)).select("label").distinct()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v.build for k, v in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v.oracle for k, v in REGISTRY.items() if v.oracle is not None}
