import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import GBTClassifier, OneVsRest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabsight.errors import InputError
from tabsight.operators import models
from tabsight.operators.boosting import OneVsRestBoosting
from tabsight.plans.train import load_model


def _data(spark, n=300, k=3):
    rng = np.random.default_rng(7)
    y = rng.integers(0, k, n)
    pdf = pd.DataFrame({"a": rng.normal(size=n) + y, "b": rng.integers(0, 6, n).astype(float), "c": rng.normal(size=n) - y % 2, "label": y.astype(float)})
    pdf["id"] = np.arange(n)
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(spark.createDataFrame(pdf))


def _raw(model, df):
    rows = model.transform(df).select("id", vector_to_array("rawPrediction").alias("r")).orderBy("id").collect()
    return np.array([r["r"] for r in rows])


def test_agrees_with_sparks_trees(spark):
    df = _data(spark, n=31)  # at most 32 values of a feature: the same cuts
    ours = OneVsRestBoosting(3, maxIter=12).fit(df)
    sparks = OneVsRest(classifier=GBTClassifier(maxIter=12, maxDepth=3, stepSize=0.1)).fit(df)
    assert np.allclose(_raw(ours, df), _raw(sparks, df), atol=1e-6)
    many = _data(spark)
    a = _raw(OneVsRestBoosting(3, maxIter=12).fit(many.repartition(5)), many)
    b = _raw(OneVsRest(classifier=GBTClassifier(maxIter=12, maxDepth=3, stepSize=0.1)).fit(many), many)
    assert np.allclose(a, b, atol=1e-6)


def test_a_level_of_all_classes_is_one_job(spark):
    sc, df = spark.sparkContext, _data(spark).persist()
    df.count()
    estimator = models.tabular_candidates(300)[3].build(3, 3)
    sc.setJobGroup("boosting", "fit")
    estimator.fit(df)
    jobs = len(sc.statusTracker().getJobIdsForGroup("boosting"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 100 * 3 + 50  # Spark's one-vs-rest starts several for each of 300 trees


def test_partitions_copies_and_saving(spark, tmp_path):
    df = _data(spark)
    model = OneVsRestBoosting(3, maxIter=15).fit(df)
    want = _raw(model, df)
    assert np.allclose(_raw(OneVsRestBoosting(3, maxIter=15, task_cells=20).fit(df.repartition(7)), df), want)
    assert np.allclose(_raw(OneVsRestBoosting(3, maxIter=15).fit(df.unionAll(df)), df), want)
    model.write().overwrite().save(str(tmp_path / "m"))
    assert np.array_equal(_raw(load_model("OneVsRestBoostingModel", str(tmp_path / "m")), df), want)
    proba = models.with_proba(model, df).select(F.aggregate("proba", F.lit(0.0), lambda a, b: a + b).alias("s")).collect()
    assert all(abs(r["s"] - 1) < 1e-9 for r in proba)


def test_odd_rows(spark):
    df = _data(spark)
    constant = df.withColumn("features", F.expr("features")).where("label = 1")
    got = _raw(OneVsRestBoosting(3, maxIter=3).fit(constant), df)
    assert (got.argmax(axis=1) == 1).all()
    for bad in (df.where("false"), df.withColumn("label", F.lit(9.0)), df.withColumn("label", F.lit(None).cast("double"))):
        with pytest.raises(InputError):
            OneVsRestBoosting(3).fit(bad)


def test_random_search_grows_the_classes_together(spark):
    space = {"maxIter": [4], "maxDepth": [2], "stepSize": [0.2]}
    df = _data(spark)
    best, model, results = models.random_search("GradientBoosting", df, "label", ["id"], 3, 3, n_trials=1, space=space)
    assert best == {"maxIter": 4, "maxDepth": 2, "stepSize": 0.2} and results.first()["fit_ok"] and len(model.rounds) == 4
    sparks = OneVsRest(classifier=GBTClassifier(maxIter=4, maxDepth=2, stepSize=0.2)).fit(df)
    assert (_raw(model, df).argmax(axis=1) == _raw(sparks, df).argmax(axis=1)).mean() > 0.95
