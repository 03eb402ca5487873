"""SQL text builders for the DuckDB oracle queries.

Each builder writes plain ANSI/DuckDB SQL for one rule so the oracle
computes the answer independently of the Spark code path.
"""

from __future__ import annotations

from tabsight.functions.exprs import NEGATIVE_NAME_PATTERNS, POSITIVE_NAME_PATTERNS, hash_unit_sql  # noqa: F401

# Column lists of the driver tables (the oracle text is static SQL).
TABLE_COLUMNS = {
    "region": ["r_regionkey", "r_name"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "lineitem": [
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
    ],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
}

# Spark simpleString of each driver-table column type (for dtype columns).
TABLE_TYPES = {
    "region": ["int", "string"],
    "nation": ["int", "string", "int"],
    "customer": ["bigint", "string", "int", "double", "string"],
    "supplier": ["bigint", "string", "int", "double"],
    "part": ["bigint", "string", "string", "string", "int", "double"],
    "orders": ["bigint", "bigint", "string", "double", "timestamp_ntz", "string"],
    "lineitem": ["bigint", "bigint", "bigint", "int", "double", "double", "double", "double", "string", "string", "timestamp_ntz"],
    "events": ["bigint", "timestamp_ntz", "bigint", "string", "double", "string"],
}


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def name_score_sql(name_col: str) -> str:
    low = f"lower(trim({name_col}))"
    pos = " OR ".join(f"contains({low}, {lit(p)})" for p in POSITIVE_NAME_PATTERNS)
    neg = " OR ".join(f"contains({low}, {lit(p)})" for p in NEGATIVE_NAME_PATTERNS)
    return (
        f"CAST(greatest((CASE WHEN {pos} THEN 1.0 ELSE 0.0 END)::DOUBLE - (CASE WHEN {neg} THEN 0.7 ELSE 0.0 END)::DOUBLE, 0.0::DOUBLE) AS DOUBLE)"
    )


def card_score_sql(u: str, n: str) -> str:
    return (
        f"CAST(CASE WHEN {u} = {n} AND {n} > 8 THEN 0.0 WHEN {u} = 2 THEN 1.0 "
        f"WHEN {u} > 2 AND {u} <= least(50, floor(0.05 * {n})) THEN 0.8 "
        f"WHEN {u} > 0.5 * {n} THEN 0.1 ELSE 0.3 END AS DOUBLE)"
    )


def profile_sql(table: str, source: str | None = None) -> str:
    """Profile rows ``column_name, ordinal, dtype, n_rows, n_nonnull, n_unique``."""
    cols = TABLE_COLUMNS[table]
    types = TABLE_TYPES[table]
    src = source or table
    aggs = ", ".join(
        f"count({c}) AS nn{i}, count(DISTINCT {c}) AS u{i}" for i, c in enumerate(cols)
    )
    parts = " UNION ALL ".join(
        f"SELECT {lit(c)} AS column_name, {i} AS ordinal, {lit(types[i])} AS dtype, n_rows, "
        f"nn{i} AS n_nonnull, u{i} AS n_unique FROM s"
        for i, c in enumerate(cols)
    )
    return f"WITH s AS (SELECT count(*) AS n_rows, {aggs} FROM {src}) {parts}"


def scored_profile_sql(table: str) -> str:
    return (
        f"WITH p AS ({profile_sql(table)}), "
        f"c AS (SELECT *, {name_score_sql('column_name')} AS ns, {card_score_sql('n_unique', 'n_rows')} AS cs FROM p) "
        "SELECT *, round(ns, 4) AS name_score, round(cs, 4) AS card_score, round(0.5::DOUBLE * ns + 0.5::DOUBLE * cs, 4) AS score FROM c"
    )


def ranked_sql(table: str) -> str:
    return (
        f"WITH sp AS ({scored_profile_sql(table)}) "
        "SELECT CAST(row_number() OVER (ORDER BY score DESC, ordinal) AS INTEGER) AS rank, column_name, ordinal, "
        "score, name_score, card_score, n_unique FROM sp"
    )


def resolve_sql(table: str) -> str:
    return (
        f"WITH r AS ({ranked_sql(table)}), "
        "p AS (SELECT *, row_number() OVER (ORDER BY score DESC, ordinal) AS pos FROM r WHERE score > 0), "
        "a AS (SELECT count(*) AS n_candidates, max(CASE WHEN pos = 1 THEN score END) AS top_score, "
        "max(CASE WHEN pos = 2 THEN score END) AS second_score, "
        "max(CASE WHEN pos = 1 THEN column_name END) AS top_col, max(CASE WHEN pos = 2 THEN column_name END) AS second_col FROM p), "
        "b AS (SELECT *, CASE WHEN n_candidates = 0 THEN 'not_classification' "
        "WHEN top_score < 0.4 THEN 'not_classification' WHEN n_candidates = 1 THEN 'weak_auto' "
        "WHEN top_score > 0.8 AND top_score - second_score > 0.2 THEN 'strong_auto' "
        "WHEN top_score - second_score < 0.1 THEN 'human_required' ELSE 'weak_auto' END AS status FROM a) "
        f"SELECT {lit(table)} AS table_name, status, CASE WHEN status IN ('weak_auto', 'strong_auto') THEN top_col END AS target, "
        "CASE WHEN status = 'human_required' THEN concat_ws(',', top_col, second_col) END AS candidates, "
        "top_score, second_score, n_candidates FROM b"
    )


# --- quality gates -------------------------------------------------------------

def value_counts_sql(src: str, target: str) -> str:
    return (
        f"SELECT CAST({target} AS VARCHAR) AS class_name, count(*) AS n, "
        f"count(*) / sum(count(*)) OVER () AS fraction FROM {src} WHERE {target} IS NOT NULL GROUP BY 1"
    )


def contingency_sql(src: str, target: str, feats: list[str]) -> str:
    parts = " UNION ALL ".join(
        f"SELECT {lit(c)} AS feature, CAST({c} AS VARCHAR) AS f, CAST({target} AS VARCHAR) AS t FROM {src}"
        for c in feats
    )
    return f"SELECT feature, f, t, count(*) AS n FROM ({parts}) WHERE f IS NOT NULL AND t IS NOT NULL GROUP BY 1, 2, 3"


def cramers_sql(cells: str) -> str:
    """Independent form: margins by joins, Yates over the explicit 2x2 grid."""
    return (
        f"WITH cells AS ({cells}), "
        "rm AS (SELECT feature, f, sum(n) AS R FROM cells GROUP BY 1, 2), "
        "cm AS (SELECT feature, t, sum(n) AS C FROM cells GROUP BY 1, 2), "
        "tot AS (SELECT feature, sum(n) AS n, count(DISTINCT f) AS r, count(DISTINCT t) AS k FROM cells GROUP BY 1), "
        "obs AS (SELECT c.feature, sum(CAST(c.n AS DOUBLE) * c.n / (CAST(rm.R AS DOUBLE) * cm.C)) AS s "
        "FROM cells c JOIN rm ON c.feature = rm.feature AND c.f = rm.f JOIN cm ON c.feature = cm.feature AND c.t = cm.t GROUP BY 1), "
        "grid AS (SELECT rm.feature, rm.f, cm.t, rm.R, cm.C FROM rm JOIN cm ON rm.feature = cm.feature "
        "JOIN tot ON tot.feature = rm.feature WHERE tot.r = 2 AND tot.k = 2), "
        "yat AS (SELECT g.feature, sum(power(greatest(abs(coalesce(c.n, 0) - CAST(g.R AS DOUBLE) * g.C / tot.n) - 0.5, 0), 2) "
        "/ (CAST(g.R AS DOUBLE) * g.C / tot.n)) AS chi2y FROM grid g JOIN tot ON tot.feature = g.feature "
        "LEFT JOIN cells c ON c.feature = g.feature AND c.f = g.f AND c.t = g.t GROUP BY 1), "
        "chi AS (SELECT tot.feature, tot.n, tot.r, tot.k, CASE WHEN tot.r = 2 AND tot.k = 2 THEN yat.chi2y "
        "WHEN tot.r < 2 OR tot.k < 2 THEN 0.0 ELSE greatest(tot.n * (obs.s - 1.0), 0.0) END AS chi2 "
        "FROM tot JOIN obs ON obs.feature = tot.feature LEFT JOIN yat ON yat.feature = tot.feature) "
        "SELECT feature, n, r, k, chi2, CASE WHEN n * (least(r, k) - 1) > 0 THEN sqrt(chi2 / (n * (least(r, k) - 1))) ELSE 0.0 END AS v FROM chi"
    )


def pearson_sql(src: str, target: str, feats: list[str]) -> str:
    parts = []
    for c in feats:
        parts.append(
            f"SELECT {lit(c)} AS feature, count(*) AS n_pairs, CASE WHEN count(*) >= 5 AND min(raw) <> max(raw) "
            "AND count(y) = count(*) AND stddev_pop(x) > 0 AND stddev_pop(y) > 0 "
            "THEN covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) END AS r "
            f"FROM (SELECT CAST({c} AS DOUBLE) AS x, TRY_CAST({target} AS DOUBLE) AS y, {target} AS raw FROM {src} "
            f"WHERE {c} IS NOT NULL AND {target} IS NOT NULL)"
        )
    return " UNION ALL ".join(parts)


def leakage_scores_sql(src: str, target: str, num: list[str], cat: list[str]) -> str:
    return (
        f"SELECT feature, 'pearson' AS metric, r AS value FROM ({pearson_sql(src, target, num)}) WHERE r IS NOT NULL "
        f"UNION ALL SELECT feature, 'cramers_v' AS metric, v AS value FROM ({cramers_sql(contingency_sql(src, target, cat))}) WHERE n >= 5"
    )


def warnings_sql(src: str, target: str, cols: list[str], num: list[str], cat: list[str], idlike: list[str], types: dict) -> str:
    """All gates unioned, then first-wins de-duplication."""
    ordmap = " ".join(f"WHEN {lit(c)} THEN {i}" for i, c in enumerate(cols))
    feats = [c for c in cols if c != target]
    fmap = " ".join(f"WHEN {lit(c)} THEN {i}" for i, c in enumerate(feats))
    prof_aggs = ", ".join(f"count(DISTINCT {c}) AS u{i}" for i, c in enumerate(cols))
    prof_rows = " UNION ALL ".join(
        f"SELECT {lit(c)} AS column_name, {i} AS ordinal, {lit(types[c])} AS dtype, n_rows, u{i} AS n_unique FROM s"
        for i, c in enumerate(cols)
    )
    idset = ", ".join(lit(c) for c in idlike) or "''"
    return (
        f"WITH s AS (SELECT count(*) AS n_rows, {prof_aggs} FROM {src}), prof AS ({prof_rows}), "
        f"lk AS ({leakage_scores_sql(src, target, [c for c in num if c != target], [c for c in cat if c != target])}), "
        f"vc AS ({value_counts_sql(src, target)}), "
        "w AS ("
        f"SELECT 0 AS gate, CASE feature {fmap} END AS seq, feature AS column_name, CAST(NULL AS VARCHAR) AS class_name, "
        "'feature_leakage' AS issue, metric, value, "
        f"CASE WHEN metric = 'pearson' THEN printf('correlation %.4f with the target; limit 0.95', value) "
        "ELSE printf('association V %.4f with the target', value) END AS detail FROM lk "
        "WHERE abs(value) > 0.95 "
        "UNION ALL SELECT 1, 0, NULL, class_name, 'class_imbalance', 'fraction', fraction, "
        "printf('class %s: %d rows, %.1f%%; limit 5%%', class_name, n, fraction * 100) "
        "FROM vc WHERE fraction < 0.05 "
        "UNION ALL SELECT 2, ordinal, column_name, NULL, 'id_column', 'n_unique', n_unique, "
        "printf('one %s value per row, as a row key has', dtype) "
        f"FROM prof WHERE n_unique = n_rows AND n_rows > 8 AND column_name IN ({idset}) "
        "UNION ALL SELECT 3, ordinal, column_name, NULL, 'constant_column', 'n_unique', n_unique, "
        "'no two different values' FROM prof WHERE n_unique <= 1), "
        "d AS (SELECT *, row_number() OVER (PARTITION BY coalesce(column_name, class_name), issue ORDER BY gate, seq) AS k FROM w) "
        "SELECT gate, seq, column_name, class_name, issue, metric, value, detail FROM d WHERE k = 1"
    )


def summary_sql(warnings: str) -> str:
    return (
        f"WITH w AS ({warnings}), a AS (SELECT count(*) AS n_issues, "
        "string_agg(DISTINCT CASE issue WHEN 'feature_leakage' THEN 'Leakage' WHEN 'id_column' THEN 'ID columns' "
        "WHEN 'constant_column' THEN 'Constant columns' WHEN 'class_imbalance' THEN 'Imbalanced classes' ELSE issue END, ', ' "
        "ORDER BY CASE issue WHEN 'feature_leakage' THEN 'Leakage' WHEN 'id_column' THEN 'ID columns' "
        "WHEN 'constant_column' THEN 'Constant columns' WHEN 'class_imbalance' THEN 'Imbalanced classes' ELSE issue END) AS names FROM w) "
        "SELECT n_issues = 0 AS passed, n_issues, CASE WHEN n_issues = 0 THEN 'no findings' "
        "ELSE printf('%d findings: %s', n_issues, names) END AS summary FROM a"
    )


# --- preprocessing -------------------------------------------------------------

UNKNOWN = "'__UNKNOWN__'"


def dictionary_sql(src: str, feats: list[str]) -> str:
    vals = " UNION ALL ".join(
        f"SELECT {lit(c)} AS feature, coalesce(CAST({c} AS VARCHAR), {UNKNOWN}) AS value FROM {src} "
        f"UNION ALL SELECT {lit(c)}, {UNKNOWN}"
        for c in feats
    )
    return (
        "SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY value) - 1 AS idx "
        f"FROM (SELECT DISTINCT feature, value FROM ({vals}))"
    )


def encoded_sql(src: str, fit_src: str, numeric: list[str], categorical: list[str], keep: list[str]) -> str:
    """Dictionary-encoded, median-filled features (unscaled)."""
    dict_cte = dictionary_sql(fit_src, categorical) if categorical else None
    sel = [f"{k} AS {k}" for k in keep]
    joins = []
    for i, c in enumerate(categorical):
        sel.append(
            f"CAST(coalesce(d{i}.idx, (SELECT idx FROM dct WHERE feature = {lit(c)} AND value = {UNKNOWN})) AS DOUBLE) AS {c}"
        )
        joins.append(
            f"LEFT JOIN (SELECT value, idx FROM dct WHERE feature = {lit(c)}) d{i} "
            f"ON d{i}.value = coalesce(CAST(s.{c} AS VARCHAR), {UNKNOWN})"
        )
    for c in numeric:
        sel.append(f"coalesce(TRY_CAST(s.{c} AS DOUBLE), (SELECT median(CAST({c} AS DOUBLE)) FROM {fit_src})) AS {c}")
    with_ = f"WITH dct AS ({dict_cte}) " if dict_cte else ""
    return f"{with_}SELECT {', '.join(sel)} FROM {src} s {' '.join(joins)}"


def scaled_sql(encoded: str, feats: list[str], keep: list[str], digits: int = 6) -> str:
    stats = ", ".join(f"avg({c}) AS a_{c}, stddev_pop({c}) AS s_{c}" for c in feats)
    cols = [f"{k}" for k in keep] + [
        f"round(({c} - a_{c}) / (CASE WHEN s_{c} = 0 THEN 1.0 ELSE s_{c} END), {digits}) AS {c}" for c in feats
    ]
    return f"WITH e AS ({encoded}), st AS (SELECT {stats} FROM e) SELECT {', '.join(cols)} FROM e, st"


# --- evaluation ------------------------------------------------------------------

def per_class_sql(src: str, yt: str, yp: str) -> str:
    return (
        f"WITH cells AS (SELECT {yt} AS true_class, {yp} AS pred_class, count(*) AS n FROM {src} GROUP BY 1, 2), "
        "tr AS (SELECT true_class AS class_name, sum(n) AS support, sum(CASE WHEN true_class = pred_class THEN n ELSE 0 END) AS tp FROM cells GROUP BY 1), "
        "pr AS (SELECT pred_class AS class_name, sum(n) AS predicted FROM cells GROUP BY 1), "
        "b AS (SELECT coalesce(tr.class_name, pr.class_name) AS class_name, coalesce(tp, 0) AS tp, coalesce(support, 0) AS support, "
        "coalesce(predicted, 0) AS predicted FROM tr FULL OUTER JOIN pr ON tr.class_name = pr.class_name), "
        "m AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS precision, "
        "CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall FROM b) "
        "SELECT *, CASE WHEN precision + recall > 0 THEN 2.0 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM m"
    )


def roc_sql(src: str, yt: str, score: str) -> str:
    return (
        f"WITH c AS (SELECT {score} AS score, sum(CASE WHEN {yt} = 1 THEN 1 ELSE 0 END) AS pos, "
        f"sum(CASE WHEN {yt} = 1 THEN 0 ELSE 1 END) AS neg FROM {src} GROUP BY 1), "
        "t AS (SELECT sum(pos) AS P, sum(neg) AS N FROM c), "
        "r AS (SELECT score, sum(pos) OVER (ORDER BY score DESC) AS tps, sum(neg) OVER (ORDER BY score DESC) AS fps FROM c) "
        "SELECT CAST(NULL AS DOUBLE) AS threshold, CAST(0 AS BIGINT) AS tps, CAST(0 AS BIGINT) AS fps, 0.0::DOUBLE AS tpr, 0.0::DOUBLE AS fpr "
        "UNION ALL SELECT score, CAST(tps AS BIGINT), CAST(fps AS BIGINT), tps / P, fps / N FROM r, t"
    )


def threshold_sql(src: str, yt: str, score: str) -> str:
    return (
        f"WITH c AS (SELECT {score} AS score, sum(CASE WHEN {yt} = 1 THEN 1 ELSE 0 END) AS pos, "
        f"sum(CASE WHEN {yt} = 1 THEN 0 ELSE 1 END) AS neg FROM {src} GROUP BY 1), "
        "g AS (SELECT score, sum(pos) AS pos, sum(neg) AS neg FROM (SELECT * FROM c UNION ALL SELECT 0.0, 0, 0 UNION ALL SELECT 1.0, 0, 0) GROUP BY 1), "
        "t AS (SELECT CAST(sum(pos) AS DOUBLE) AS P, CAST(sum(neg) AS DOUBLE) AS N FROM c), "
        "r AS (SELECT score, pos, neg, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp FROM g), "
        "m AS (SELECT r.*, P, N, tp / P - fp / N AS j, 2.0 * tp / (2.0 * tp + fp + (P - tp)) AS f1 FROM r, t), "
        "yj AS (SELECT score, j FROM m WHERE pos + neg > 0 ORDER BY j DESC, score DESC LIMIT 1), "
        "bf AS (SELECT score, f1 FROM m WHERE tp + fp > 0 AND tp + fp < P + N ORDER BY f1 DESC, score ASC LIMIT 1) "
        "SELECT (SELECT sum(neg / N * (2.0 * tp - pos) / (2.0 * P)) FROM m) AS auc, "
        "CASE WHEN (SELECT j FROM yj) > 0 THEN least(greatest((SELECT score FROM yj), 0.0), 1.0) ELSE 1.0 END AS youden_threshold, "
        "CASE WHEN (SELECT j FROM yj) > 0 THEN (SELECT j FROM yj) ELSE 0.0 END AS youden_j, "
        "coalesce(least(greatest((SELECT score FROM bf), 0.0), 1.0), 0.5) AS f1_threshold, coalesce((SELECT f1 FROM bf), -1.0) AS f1"
    )
