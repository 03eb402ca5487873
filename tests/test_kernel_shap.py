from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler

from tabsight.errors import InputError
from tabsight.operators import kernel_shap as K
from tabsight.operators.models import with_proba

COLS = ["a", "b", "c", "d"]


def _fitted(spark, n=200):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame(rng.normal(size=(n, 4)), columns=COLS)
    pdf["label"] = ((pdf.a * pdf.b + pdf.c > 0).astype(float) + (pdf.a > 1)).astype(float)
    pdf["id"] = range(n)
    df = spark.createDataFrame(pdf)
    assembler = VectorAssembler(inputCols=COLS, outputCol="features")
    return pdf, df, RandomForestClassifier(numTrees=8, seed=1).fit(assembler.transform(df))


def _scores(spark, model, X):
    df = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(X)], "i long, " + ", ".join(f"{c} double" for c in COLS))
    out = with_proba(model, VectorAssembler(inputCols=COLS, outputCol="features").transform(df)).orderBy("i").collect()
    return np.array([r["proba"] for r in out])


def test_values_equal_exact_shapley_values(spark):
    pdf, df, model = _fitted(spark)
    background = K.background_summary(df, COLS, k=5)
    assert len(background) == 5 and abs(sum(w for w, _ in background) - 1) < 1e-12
    assert all(x[j] in set(pdf[c]) for _, x in background for j, c in enumerate(COLS))
    got = {r["id"]: r for r in K.kernel_shapley(model, df.where("id < 12"), background, COLS, ["id"]).collect()}
    assert len(got) == 12
    subsets = [s for k in range(5) for s in combinations(range(4), k)]
    for i in range(12):
        x = pdf.loc[i, COLS].to_numpy()
        hybrids = np.array([[x[j] if j in s else b[j] for j in range(4)] for s in subsets for _, b in background])
        p = _scores(spark, model, hybrids).reshape(len(subsets), len(background), -1)
        cls = int(p[-1, 0].argmax())
        v = {s: sum(w * p[k, m, cls] for m, (w, _) in enumerate(background)) for k, s in enumerate(subsets)}
        want = [
            sum(factorial(len(s)) * factorial(3 - len(s)) / 24 * (v[tuple(sorted((*s, j)))] - v[s]) for s in subsets if j not in s)
            for j in range(4)
        ]
        assert np.allclose(got[i]["phi"], want, atol=1e-9)
        assert abs(got[i]["f_x"] - v[0, 1, 2, 3]) < 1e-9 and abs(got[i]["f_bg"] - v[()]) < 1e-9


@pytest.mark.parametrize("n, limit", [(2, 4), (3, 100), (7, 40), (12, 200), (40, 80)])
def test_linear_scores_are_recovered_from_any_coalitions(n, limit):
    masks, weights = K.coalitions(n, limit)
    assert len(masks) <= limit and (weights > 0).all()
    assert {tuple(m) for m in masks} == {tuple(1 - m) for m in masks}  # with their complements
    per_mask, full, empty = K.score_coefficients(masks, weights, n)
    beta = np.random.default_rng(n).normal(size=n)
    phi = (masks @ beta + 2) @ per_mask + full * (beta.sum() + 2) + empty * 2
    assert np.allclose(phi, beta, atol=1e-8)


def test_too_few_coalitions_raise():
    with pytest.raises(InputError):
        K.coalitions(10, 19)


def test_one_feature_repeated_keys_and_summary(spark):
    _, df, model = _fitted(spark)
    twice = df.where("id = 1").union(df.where("id = 1"))
    background = K.background_summary(df, COLS, k=1)
    once = K.kernel_shapley(model, df.where("id = 1"), background, COLS, ["id"]).first()
    both = K.kernel_shapley(model, twice, background, COLS, ["id"]).collect()
    assert len(both) == 1 and np.allclose(both[0]["phi"], once["phi"])
    top = K.shapley_importance(K.kernel_shapley(model, df, background, COLS, ["id"]), COLS, 2).collect()
    assert len(top) == 2 and top[0]["mean_abs_shap"] >= top[1]["mean_abs_shap"] and "d" not in {r["feature"] for r in top}
    masks, weights = K.coalitions(1, 10)
    assert [v.tolist() for v in K.score_coefficients(masks, weights, 1)] == [[], [1.0], [-1.0]]


def test_background_without_complete_rows_raises(spark):
    with pytest.raises(InputError):
        K.background_summary(spark.createDataFrame([(None, 1.0)], "a double, b double"), ["a", "b"])
