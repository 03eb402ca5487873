import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tabsight.errors import InputError
from tabsight.functions.exprs import UNKNOWN_TOKEN
from tabsight.operators import prep, split
from tabsight.operators.ranking import index_within, running_totals


def test_index_within_equals_row_number(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b", "c"], 2000, p=[0.8, 0.15, 0.05]), "k": rng.permutation(2000)})
    df = spark.createDataFrame(pdf)
    for parts in (2, 16):
        got = index_within(df, ["g"], ["k"], num_partitions=parts)
        want = df.withColumn("want", F.row_number().over(Window.partitionBy("g").orderBy("k")) - 1)
        joined = got.join(want, ["g", "k"])
        assert joined.count() == 2000
        assert joined.where(F.col("idx") != F.col("want")).count() == 0


def test_running_totals(spark):
    pdf = pd.DataFrame({"s": np.arange(500, dtype=float), "v": np.ones(500, dtype=int)})
    out = running_totals(spark.createDataFrame(pdf), [F.col("s").desc()], ["v"], num_partitions=7)
    got = {r["s"]: r["cum_v"] for r in out.collect()}
    assert all(got[s] == 500 - int(s) for s in got)


def test_dictionary_sorted_with_unknown(spark):
    pdf = pd.DataFrame({"color": ["red", "blue", None, "Zed", "red", "green"], "score": [1, 2, 3, 4, 5, 6],
                        "target": ["a", "b", "a", "b", "a", "b"]})
    pre = prep.fit_preprocess(spark.createDataFrame(pdf), "target")
    d = {r["value"]: r["idx"] for r in pre.dictionary.where(F.col("feature") == "color").collect()}
    assert list(sorted(d, key=d.get)) == sorted(["red", "blue", "Zed", "green", UNKNOWN_TOKEN])
    new = spark.createDataFrame(pd.DataFrame({"color": ["purple", "red", None], "score": [None, 1, 2]}))
    enc = pre.encode(new).collect()
    unk = d[UNKNOWN_TOKEN]
    assert enc[0]["color"] == unk and enc[2]["color"] == unk and enc[1]["color"] == d["red"]
    assert enc[0]["score"] == float(np.median([1, 2, 3, 4, 5, 6]))


def test_scaling_zero_variance_and_decode(spark):
    pdf = pd.DataFrame({"c": [5.0] * 10, "x": np.arange(10.0), "target": list("ab") * 5})
    df = spark.createDataFrame(pdf)
    pre = prep.fit_preprocess(df, "target")
    assert pre.scales["c"] == 1.0
    out = pre.transform(pre.encode_target(df), keep=["label"]).toPandas()
    assert np.allclose(out["c"], 0.0)
    assert abs(out["x"].std(ddof=0) - 1.0) < 1e-9
    back = pre.encode_target(df).select(pre.decode_target("label", "y"), "target").collect()
    assert all(r["y"] == r["target"] for r in back)


def test_fit_errors(spark):
    with pytest.raises(InputError):
        prep.fit_preprocess(spark.createDataFrame([(1, None), (2, "a"), (3, "b")], "x int, t string"), "t")
    with pytest.raises(InputError):
        prep.fit_preprocess(spark.createDataFrame([(None, "a"), (None, "b")], "x double, t string"), "t")
    with pytest.raises(InputError):
        prep.fit_preprocess(spark.createDataFrame([(1, "a"), (2, "a")], "x int, t string"), "t")


def test_preprocessor_save_load(spark, tmp_path):
    pdf = pd.DataFrame({"color": ["r", "g", "b", "r"], "v": [1.0, None, 3.0, 4.0], "t": ["x", "y", "x", "y"]})
    df = spark.createDataFrame(pdf)
    pre = prep.fit_preprocess(df, "t")
    pre.save(str(tmp_path / "p"))
    again = prep.Preprocessor.load(spark, str(tmp_path / "p"))
    a = pre.transform(df).collect()
    b = again.transform(df).collect()
    assert a == b


def test_folds_independent_of_partitioning(spark):
    pdf = pd.DataFrame({"id": range(3000), "y": [i % 3 for i in range(3000)]})
    df = spark.createDataFrame(pdf)
    for mode in ("hash", "exact"):
        a = split.assign_folds(df.repartition(2), "y", ["id"], 3, mode=mode).select("id", "fold")
        b = split.assign_folds(df.repartition(16), "y", ["id"], 3, mode=mode).select("id", "fold")
        assert a.join(b, "id").where(a["fold"] != b["fold"]).count() == 0
    exact = split.assign_folds(df, "y", ["id"], 3, mode="exact")
    sizes = exact.groupBy("y", "fold").count().collect()
    assert {r["count"] for r in sizes} == {334, 333}


def test_holdout_and_samples(spark):
    pdf = pd.DataFrame({"id": range(1000), "y": ["a"] * 900 + ["b"] * 100})
    df = spark.createDataFrame(pdf)
    h = split.stratified_holdout(df, "y", ["id"])
    counts = {r["y"]: r["count"] for r in h.where("is_test").groupBy("y").count().collect()}
    assert counts == {"a": 180, "b": 20}
    assert split.sample_n(df, 77, ["id"]).count() == 77
    assert split.n_folds_for(df, "y", 3) == 3
    one_each = spark.createDataFrame(pd.DataFrame({"id": range(12), "y": ["a"] * 11 + ["b"]}))
    flags = split.stratified_holdout(one_each, "y", ["id"]).where("is_test").count()
    assert flags == 3  # plain split: ceil(0.2 * 12)
    with pytest.raises(InputError, match="at least 10"):
        split.stratified_holdout(df.limit(5), "y", ["id"])


def test_class_weights(spark):
    df = spark.createDataFrame(pd.DataFrame({"y": ["a"] * 30 + ["b"] * 10}))
    w = {r["class_name"]: r["weight"] for r in prep.class_weights(df, "y").collect()}
    assert abs(w["a"] - 40 / (2 * 30)) < 1e-12 and abs(w["b"] - 40 / (2 * 10)) < 1e-12
    assert prep.class_weights(df.where("y = 'a'"), "y").count() == 0


def test_exact_quantiles_bracket_path(spark, monkeypatch):
    from tabsight.operators import quantiles

    monkeypatch.setattr(quantiles, "BRACKET", 0.01)
    rng = np.random.default_rng(11)
    a = rng.normal(size=5001)
    b = np.round(rng.random(5001) * 20)  # many ties
    df = spark.createDataFrame(pd.DataFrame({"a": a, "b": b}))
    got = quantiles.exact_quantiles(df, ["a", "b"], [0.0, 0.25, 0.5, 0.9, 1.0])
    for name, arr in (("a", a), ("b", b)):
        want = np.percentile(arr, [0, 25, 50, 90, 100])
        assert np.allclose(got[name], want, rtol=0, atol=1e-12), (name, got[name], want)


def test_large_dictionary_path_joins(spark, monkeypatch):
    monkeypatch.setattr(prep, "BROADCAST_BYTES", 0)
    pdf = pd.DataFrame({"c": [f"v{i % 7}" for i in range(40)], "n": range(40), "t": ["a", "b"] * 20})
    df = spark.createDataFrame(pdf)
    pre = prep.fit_preprocess(df, "t")
    assert pre.broadcast_features() == set()  # the encode step shuffles the dictionary
    rows = [("v3", 1), ("zz", 2), (None, 3), (None, 3)]
    out = pre.encode(spark.createDataFrame(rows, "c string, n long"))
    assert out.count() == 4
    got = {r["c"] for r in out.collect()}
    d = {r["value"]: r["idx"] for r in pre.dictionary.collect()}
    assert got == {float(d["v3"]), float(d[UNKNOWN_TOKEN])}
    assert sorted(d, key=d.get) == sorted(d)
