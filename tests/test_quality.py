import math

import numpy as np
import pandas as pd

from tabsight.operators import quality


def _issues(df):
    return {(r["column_name"] or r["class_name"], r["issue"]) for r in df.collect()}


def test_leaky_numeric_flagged(spark):
    rng = np.random.default_rng(42)
    leaky = rng.normal(size=30)
    pdf = pd.DataFrame({"good": rng.normal(size=30), "leaky": leaky, "target": leaky})
    w = quality.detect_leakage(spark.createDataFrame(pdf), "target")
    assert {r["column_name"] for r in w.collect()} == {"leaky"}


def test_unrelated_not_flagged(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"feat": rng.normal(size=100), "target": rng.normal(size=100)})
    assert quality.detect_leakage(spark.createDataFrame(pdf), "target").count() == 0


def test_id_constant_imbalance(spark):
    ids = spark.createDataFrame(pd.DataFrame({"id": range(50), "val": [i * 0.5 for i in range(50)]}))
    assert _issues(quality.detect_id_columns(ids)) == {("id", "id_column")}
    const = spark.createDataFrame(pd.DataFrame({"const": [1] * 5, "var": [1, 2, 3, 4, 5]}))
    assert _issues(quality.detect_constant_columns(const)) == {("const", "constant_column")}
    imb = spark.createDataFrame(pd.DataFrame({"target": ["a"] * 98 + ["b"] * 2}))
    assert _issues(quality.detect_imbalance(imb, "target")) == {("b", "class_imbalance")}


def test_all_issues_and_clean(spark):
    n = 50
    pdf = pd.DataFrame({"id_col": range(n), "const_col": [7] * n, "leaky": [i % 2 for i in range(n)],
                        "target": [i % 2 for i in range(n)]})
    w = quality.quality_warnings(spark.createDataFrame(pdf), "target")
    assert w.count() >= 3
    clean = pd.DataFrame({"x": [i % 10 for i in range(20)], "y": [i * 1.37 for i in range(20)],
                          "target": ["a", "b"] * 10})
    s = quality.summarize_quality(spark.createDataFrame(clean), "target").first()
    assert s["passed"] and s["n_issues"] == 0
    assert s["summary"] == "no findings"


def _chi2_direct(table, correction=True):
    table = np.asarray(table, dtype=float)
    n = table.sum()
    e = table.sum(1, keepdims=True) * table.sum(0, keepdims=True) / n
    r, k = table.shape
    if (r - 1) * (k - 1) == 0:
        return 0.0
    if correction and (r - 1) * (k - 1) == 1:
        diff = np.maximum(np.abs(table - e) - 0.5, 0)
        return float((diff ** 2 / e).sum())
    return float(((table - e) ** 2 / e).sum())


def test_cramers_v_matches_direct_formula(spark):
    rng = np.random.default_rng(7)
    f = rng.choice(["a", "b"], size=200)
    t = np.where(rng.random(200) < 0.7, f, rng.choice(["a", "b"], size=200))
    g = rng.choice(["x", "y", "z"], size=200)
    pdf = pd.DataFrame({"f": f, "g": g, "t": t})
    cells = quality.contingency(spark.createDataFrame(pdf), "t", ["f", "g"])
    got = {r["feature"]: r["v"] for r in quality.cramers_v(cells).collect()}
    for name in ("f", "g"):
        ct = pd.crosstab(pdf[name], pdf["t"]).values
        chi2 = _chi2_direct(ct)
        v = math.sqrt(chi2 / (ct.sum() * (min(ct.shape) - 1)))
        assert abs(got[name] - v) < 1e-9


def test_pearson_non_numeric_target_is_null(spark):
    pdf = pd.DataFrame({"x": [float(i) for i in range(10)], "t": ["a", "b"] * 5})
    r = quality.pearson_with_target(spark.createDataFrame(pdf), "t").first()
    assert r["r"] is None and r["n_pairs"] == 10


def test_pearson_constant_feature_is_null(spark):
    pdf = pd.DataFrame({"x": [1.0] * 10, "t": [float(i) for i in range(10)]})
    assert quality.pearson_with_target(spark.createDataFrame(pdf), "t").first()["r"] is None
