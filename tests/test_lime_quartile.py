import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tabsight.errors import InputError
from tabsight.functions.hashing import hash_ints
from tabsight.operators import lime_quartile as L

COLS = ["a", "b", "c"]


def _data(spark, n=400):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame(rng.normal(size=(n, 3)), columns=COLS)
    pdf["c"] = rng.integers(0, 2, n).astype(float)  # two values: fewer than three distinct quartiles
    pdf["label"] = (2 * pdf.a + pdf.b > 0).astype(float)
    pdf["id"] = range(n)
    df = spark.createDataFrame(pdf)
    return pdf, df, LogisticRegression(maxIter=50).fit(VectorAssembler(inputCols=COLS, outputCol="features").transform(df))


def test_bins_follow_the_training_rows(spark):
    pdf, df, _ = _data(spark)
    bins = L.fit_quartile_bins(df, COLS)
    for c in COLS:
        edges = sorted(set(np.quantile(pdf[c], L.QUARTILES)))
        assert np.allclose(bins[c].edges, edges)
        where = np.searchsorted(edges, pdf[c])
        assert np.allclose(bins[c].shares, [(where == b).mean() for b in range(len(edges) + 1)])
        ends = [pdf[c].min(), *edges, pdf[c].max()]
        for b, points in enumerate(bins[c].points):
            assert len(points) == 64 and all(ends[b] <= p <= ends[b + 1] for p in points)
    got = df.select(bins["a"].bin_of(F.col("a")).alias("b")).toPandas()["b"]
    assert (got == np.searchsorted(bins["a"].edges, pdf["a"])).all()
    e = bins["a"].edges
    assert bins["a"].rules("a") == [f"a <= {e[0]:.2f}", f"{e[0]:.2f} < a <= {e[1]:.2f}", f"{e[1]:.2f} < a <= {e[2]:.2f}", f"a > {e[2]:.2f}"]


def test_rules_explain_the_signal(spark):
    pdf, df, model = _data(spark)
    bins = L.fit_quartile_bins(df, COLS)
    far = pdf[(pdf.a > bins["a"].edges[2]) & (pdf.b > bins["b"].edges[2])].id.tolist()[:5]
    out = L.lime_quartile(model, df.where(F.col("id").isin(far)), bins, COLS, "id", num_samples=2000).collect()
    assert len(out) == 15
    for i in far:
        mine = sorted((r for r in out if r["id"] == i), key=lambda r: -abs(r["weight"]))
        # in the top quarter of both, a counts twice b and c nothing
        assert [r["feature"] for r in mine] == ["a", "b", "c"]
        assert mine[0]["rule"] == bins["a"].rules("a")[3] and mine[0]["weight"] > mine[1]["weight"] > 0


def test_result_does_not_depend_on_partitions_and_keeps_the_top(spark):
    _, df, model = _data(spark)
    bins = L.fit_quartile_bins(df, COLS)
    few = df.where("id < 4")
    one = L.lime_quartile(model, few.coalesce(1), bins, COLS, "id", 300, num_features=2).collect()
    many = L.lime_quartile(model, few.repartition(9), bins, COLS, "id", 300, num_features=2).collect()
    key = lambda r: (r["id"], r["feature"])
    assert len(one) == 8 and [key(r) for r in sorted(one, key=key)] == [key(r) for r in sorted(many, key=key)]
    for a, b in zip(sorted(one, key=key), sorted(many, key=key)):
        assert a["rule"] == b["rule"] and abs(a["weight"] - b["weight"]) < 1e-9


@pytest.mark.parametrize("n_classes", [2, 3])
def test_blocks_equal_the_plan_over_samples(spark, monkeypatch, n_classes):
    """The numpy form draws, scores and explains the same samples as the plan that serves any model."""
    _, df, model = _data(spark)
    if n_classes == 3:
        three = df.withColumn("label", F.when(F.col("b") > 1, 2.0).otherwise(F.col("label")))
        model = LogisticRegression(maxIter=20).fit(VectorAssembler(inputCols=COLS, outputCol="features").transform(three))
    bins = L.fit_quartile_bins(df, COLS)
    some = df.where("id < 30").union(df.where("id < 3"))  # keys 0 to 2 come twice
    some = some.withColumn("id", F.when(F.col("id") != 7, F.col("id")))  # and one is null
    run = lambda: {(r["id"], r["feature"]): (r["rule"], r["weight"]) for r in L.lime_quartile(model, some, bins, COLS, "id", 400, num_features=2).collect()}
    blocks = run()
    monkeypatch.setattr(L, "_MAX_PATTERN_FEATURES", -1)
    plan = run()
    assert blocks.keys() == plan.keys() and len(blocks) == 60
    for k, (rule, weight) in plan.items():
        assert blocks[k][0] == rule and blocks[k][1] == pytest.approx(weight, rel=1e-9, abs=1e-12)


def test_hashes_are_sparks(spark):
    rows = spark.range(2000).select(F.col("id"), (F.col("id") * 2654435761 % 4294967296 - 2147483648).cast("int").alias("v"))
    got = rows.select("v", F.xxhash64(F.lit(42), "id").alias("h"), F.xxhash64(F.lit(42), "id", "v").alias("hv"), F.xxhash64(F.lit(42), "id", "v", F.lit(3)).alias("hv3")).toPandas()
    hv = hash_ints(got["v"].to_numpy(), got["h"].to_numpy())
    assert (hv == got["hv"]).all() and (hash_ints(np.int64(3), hv) == got["hv3"]).all()


def test_feature_without_values_raises(spark):
    with pytest.raises(InputError):
        L.fit_quartile_bins(spark.createDataFrame([(None, 1.0)], "a double, b double"), ["a", "b"])
