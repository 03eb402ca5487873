import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tabsight.operators import explain, models


def _data(spark, n=300, seed=0):
    rng = np.random.default_rng(seed)
    X = rng.normal(size=(n, 3))
    y = (X[:, 0] * 2 + X[:, 1] > 0).astype(float)
    pdf = pd.DataFrame(X, columns=["a", "b", "c"])
    pdf["id"] = np.arange(n)
    pdf["label"] = y
    df = spark.createDataFrame(pdf)
    model = LogisticRegression(maxIter=50).fit(VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df))
    return df, model


def test_shapley_efficiency_and_ranking(spark):
    df, model = _data(spark)
    vals = explain.shapley_summary(model, df, df, ["a", "b", "c"], ["id"], n_rows=20, n_permutations=4, per_row_values=True)
    per = vals.groupBy("_i").agg(F.sum("phi").alias("s"), F.first("f_x").alias("fx"), F.first("f_bg").alias("fb")).collect()
    assert len(per) == 20
    for r in per:
        assert abs(r["s"] - (r["fx"] - r["fb"])) < 1e-9  # contributions add up exactly
    top = explain.shapley_summary(model, df, df, ["a", "b", "c"], ["id"], n_rows=40, n_permutations=4).collect()
    assert top[0]["feature"] == "a" and top[-1]["feature"] == "c"


def test_permutation_importance_ranks_signal_first(spark):
    df, model = _data(spark, seed=1)
    imp = explain.permutation_importance(model, df, ["a", "b", "c"], ["id"], n_repeats=3, sample=200).collect()
    assert [r["feature"] for r in imp][0] == "a"
    assert all(r["std"] >= 0 for r in imp)


def test_promotion_table(spark):
    rows = [("m1", 1, 0.5, 0), ("m2", 1, 0.7, 1), ("m3", 1, 0.7, 2), ("m4", 1, 0.1, 3), ("m2", 2, 0.8, 1), ("m3", 2, 0.6, 2)]
    res = spark.createDataFrame(rows, "name string, stage int, score double, ordinal int")
    got = {(r["stage"], r["name"]): (r["rank"], r["promoted"]) for r in models.promotion_table(res).collect()}
    assert got[(1, "m2")] == (1, True) and got[(1, "m3")] == (2, True) and got[(1, "m1")] == (3, False)
    assert got[(2, "m2")] == (1, True) and got[(2, "m3")] == (2, False)


def test_keyed_bijection_permutes_every_size(spark):
    from tabsight.operators.explain import permuted_index

    seen = set()
    for n in (1, 2, 3, 5, 17, 101, 1009):
        ids = spark.range(n).select(F.col("id").alias("i"), F.explode(F.array(*map(F.lit, range(3)))).alias("k"))
        got = ids.select("k", "i", permuted_index(F.col("i"), F.col("k"), n, 7).alias("p")).collect()
        for k in range(3):
            order = [r.p for r in sorted(got, key=lambda r: r.i) if r.k == k]
            assert sorted(order) == list(range(n))
            if n > 100:
                seen.add(tuple(order))
                fixed = sum(i == p for i, p in enumerate(order))
                apart = sum(abs(i - p) for i, p in enumerate(order)) / n
                assert fixed < 10 and 0.2 * n < apart < 0.5 * n  # a third of n for a random order
    assert len(seen) == 6


def test_shapley_shuffles_no_hybrids(spark):
    df, model = _data(spark)
    values = explain.shapley_summary(model, df, df, ["a", "b", "c"], ["id"], n_permutations=4, per_row_values=True)
    plan = values._jdf.queryExecution().executedPlan().toString()
    above, join, _ = plan.partition("SortMergeJoin [_b#")  # each row meets its background row here
    if not join:
        above, join, _ = plan.partition("BroadcastHashJoin [_b#")
    assert join and above.count("Generate explode") == 3 and "Exchange" not in above and "Window" not in above


def test_regressions_scored_by_expressions_equal_their_transform(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 3)) * [1.0, 50.0, 0.01]
    df = spark.createDataFrame([(i, *map(float, v), float(v[0] > 0), float(i % 3)) for i, v in enumerate(x)], "id long, a double, b double, c double, two double, three double")
    vectors = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features", handleInvalid="keep")
    odd = df.union(spark.createDataFrame([(900, float("nan"), 1.0, 2.0, 0.0, 0.0), (901, 1e300, -1e300, 0.0, 0.0, 0.0)], df.schema))
    for label in ("two", "three"):
        model = LogisticRegression(labelCol=label, maxIter=20).fit(vectors.transform(df))
        want = {r["id"]: r for r in models.with_proba(model, vectors.transform(odd)).select("id", "proba", "pred").collect()}
        scored = models.with_proba_of_columns(model, odd, ["a", "b", "c"])
        assert "UDF" not in scored._jdf.queryExecution().executedPlan().toString()
        got = scored.select("id", "proba", "pred").collect()
        assert len(got) == len(want) == 202
        for r in got:
            assert np.allclose(r["proba"], want[r["id"]]["proba"], rtol=1e-12, atol=1e-15, equal_nan=True)
            assert r["pred"] == want[r["id"]]["pred"]
