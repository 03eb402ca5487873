import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from tabsight.operators import models, prep, report
from tabsight.plans import train


def _matrix(spark, n, k, seed=0, n_feat=4):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, k, n)
    X = rng.normal(size=(n, n_feat)) + y[:, None] * 1.5
    pdf = pd.DataFrame(X, columns=[f"feat_{i}" for i in range(n_feat)])
    pdf["id"] = np.arange(n)
    pdf["target"] = [f"c{v}" for v in y]
    return spark.createDataFrame(pdf)


def _features(spark, df):
    pre = prep.fit_preprocess(df.drop("id"), "target")
    keyed = df.withColumn(train.ROW_KEY, F.col("id").cast("string"))
    return pre, train.feature_table(pre, keyed, [train.ROW_KEY])


class Boom(LogisticRegression):
    def _fit(self, dataset):
        raise RuntimeError("boom")


def test_search_winner_crash_and_promotion(spark):
    df = _matrix(spark, 200, 2)
    pre, data = _features(spark, df)
    lr = models.fallback_candidate()
    cands = [
        models.Candidate("bad", lambda f, k: Boom()),
        models.Candidate("lr1", lr.factory),
        models.Candidate("lr2", lambda f, k: LogisticRegression(maxIter=5, regParam=0.5)),
        models.Candidate("lr3", lambda f, k: LogisticRegression(maxIter=50)),
    ]
    name, score, results = models.successive_halving(cands, data, "label", [train.ROW_KEY], 4, time_budget_sec=600)
    rows = results.collect()
    bad = [r for r in rows if r["name"] == "bad"]
    assert bad and not bad[0]["fit_ok"] and bad[0]["score"] == 0.0 and "boom" in bad[0]["error"]
    per_stage = {s: len([r for r in rows if r["stage"] == s]) for s in (1, 2, 3)}
    assert per_stage == {1: 4, 2: 2, 3: 1}
    assert name in {"lr1", "lr2", "lr3"} and 0.0 <= score <= 1.0
    assert models.successive_halving([], data, "label", [train.ROW_KEY], 4)[0] is None


@pytest.mark.parametrize("k", [2, 3, 5])
def test_multiclass_one_path_and_reload(spark, tmp_path, k):
    df = _matrix(spark, 100 * k, k, seed=k)
    run = train.train_tabular(df, "target", ["id"], candidates=[models.fallback_candidate()], search=False,
                              importance=(k == 3), quality_check=False)
    assert run.classes == [f"c{i}" for i in range(k)]
    assert 0.0 <= run.metrics["accuracy"] <= 1.0
    assert (run.threshold is not None) == (k == 2)
    pred = train.predict_batch(run, df, "id", detail=False)
    names = {r["predicted_class"] for r in pred.collect()}
    assert names <= set(run.classes)
    run.save(str(tmp_path / "m"))
    again = train.FittedRun.load(spark, str(tmp_path / "m"))
    a = {r["sample_index"]: r["pred"] for r in pred.collect()}
    b = {r["sample_index"]: r["pred"] for r in train.predict_batch(again, df, "id", detail=False).collect()}
    assert a == b
    if k == 3:
        imp = run.importance.collect()
        assert len(imp) == 5 and imp == sorted(imp, key=lambda r: -r["importance"])


def test_stream_equals_batch(spark, tmp_path):
    from tabsight.streaming.scoring import score_folder

    df = _matrix(spark, 300, 3, seed=9)
    run = train.train_tabular(df, "target", ["id"], candidates=[models.fallback_candidate()], search=False,
                              importance=False, quality_check=False)
    src = str(tmp_path / "in")
    df.repartition(3).write.parquet(src)
    streamed = score_folder(run, spark, src, df, "id")
    batch = train.predict_batch(run, df, "id", detail=False)
    s = {r["sample_index"]: r["pred"] for r in streamed.collect()}
    b = {r["sample_index"]: r["pred"] for r in batch.collect()}
    assert s == b and len(s) == 300


def test_recommendation_and_manual(spark):
    assert models.recommend_baseline("tabular", 5, 100) == "MLP-Small"
    assert models.recommend_baseline("tabular", 50, 1000) == "MLP-Medium"
    assert models.recommend_baseline("tabular", 500, 1000) == "MLP-Large"
    cands = models.tabular_candidates(100)
    assert models.select_candidate(cands, "tabular", 5, 100, "RandomForest").name == "RandomForest"
    with pytest.raises(ValueError):
        models.select_candidate(cands, "tabular", 5, 100, "nope")


def test_random_search(spark):
    df = _matrix(spark, 200, 2, seed=3)
    pre, data = _features(spark, df)
    params, model, results = models.random_search("LogisticRegression", data, "label", [train.ROW_KEY], 4, 2, n_trials=3)
    assert results.count() == 3 and params is not None and model is not None


def test_search_rows_are_dealt_by_their_number(spark, monkeypatch):
    seen = []

    class Watched(LogisticRegression):
        def _fit(self, dataset):
            seen.append((dataset.rdd.getNumPartitions(), dataset.count()))
            return super()._fit(dataset)

    monkeypatch.setattr(models, "TASK_ROWS", 50)
    monkeypatch.setattr(models, "_estimator_for", lambda kind, p, f, k: Watched(**p))
    data = _features(spark, _matrix(spark, 200, 2, seed=3))[1].coalesce(1)  # as one small file comes
    params, _model, _results = models.random_search("LogisticRegression", data, "label", [train.ROW_KEY], 4, 2, n_trials=2)
    assert params is not None and [n for n, _ in seen] == [4, 4, 4] and seen[-1][1] == 200
    seen.clear()
    models.successive_halving([models.Candidate("lr", lambda f, k: Watched())], data, "label", [train.ROW_KEY], 4, cv=2, parallelism=1)
    assert [n for n, _ in seen] == [1, 1, 3, 3, 4, 4]


def test_report_tables(spark):
    rows = [(0, [0.9, 0.1]), (0, [0.6, 0.4]), (1, [0.3, 0.7]), (0, [0.55, 0.45]), (1, [0.05, 0.95])]
    df = spark.createDataFrame(rows, "pred int, proba array<double>")
    e = report.prediction_entropy(df, "pred").first()
    p = np.array([3, 2]) / 5
    assert abs(e["entropy"] - float(-(p * np.log2(p + 1e-10)).sum())) < 1e-12
    assert e["dominance_ratio"] == 0.6 and e["max_entropy"] == 1.0
    c = report.confidence_stats(df, "proba").first()
    conf = np.array([0.9, 0.6, 0.7, 0.55, 0.95])
    assert abs(c["median"] - np.median(conf)) < 1e-12 and abs(c["q25"] - np.percentile(conf, 25)) < 1e-12
    assert abs(c["std"] - conf.std()) < 1e-12 and c["high_conf_pct"] == 20.0
    h = {r["bin"]: r["n"] for r in report.confidence_histogram(df, "pred", "proba").where("scope = -1").collect()}
    want, _ = np.histogram(conf, bins=20, range=(0, 1))
    assert h == {i: int(v) for i, v in enumerate(want) if v}
    d = report.prediction_distribution(df, "pred", ["no", "yes"]).collect()
    assert {r["class_name"]: r["is_most"] for r in d} == {"no": True, "yes": False}
    run = spark.createDataFrame(
        [("LR", 0.87, "age", ["id_column", "class_imbalance"], False), ("LR", None, None, None, None)],
        "model_name string, accuracy double, top_feature string, issues array<string>, passed boolean",
    )
    n = [r["narrative"] for r in report.narrative(run).collect()]
    assert n[0] == ("LR predicted 87 of 100 held-out rows correctly. Strongest feature: age. "
                    "Data checks found: class imbalance, id column.")
    assert n[1] == "LR has no held-out score. Feature strength was not measured. Data checks: nothing found."


def test_scoring_options(spark):
    df = spark.createDataFrame([(0.0, 0), (1.0, 1), (1.0, 0), (0.0, 0)], "label double, pred int")
    assert models.score_predictions(df, "accuracy") == 0.75
    assert models.score_predictions(df, "balanced_accuracy") == 0.75
    custom = models.score_predictions(df, lambda cells: cells.where("true_class = pred_class").groupBy().sum("n").first()[0])
    assert custom == 3.0
    with pytest.raises(ValueError, match="Unknown scoring"):
        models.score_predictions(df, "bogus")


def test_metrics_from_cells_matches_spark(spark):
    from tabsight.operators import evaluate

    rng = np.random.default_rng(4)
    yt = rng.integers(0, 4, 500)
    yp = np.where(rng.random(500) < 0.5, yt, rng.integers(0, 5, 500))
    df = spark.createDataFrame(pd.DataFrame({"y": yt, "p": yp}))
    cells = [(r[0], r[1], r[2]) for r in evaluate.confusion_long(df, "y", "p").collect()]
    got = train.metrics_from_cells(cells)
    m = evaluate.core_metrics(df, "y", "p").first()
    for k in ("accuracy", "precision", "recall", "f1"):
        assert abs(got[k] - m[k]) < 1e-12
    assert abs(got["balanced_accuracy"] - evaluate.balanced_accuracy(df, "y", "p").first()[0]) < 1e-12


def test_text_train_predict_reload(spark, tmp_path):
    good = [f"great film wonderful story number {i}" for i in range(30)]
    bad = [f"awful film boring story number {i}" for i in range(30)]
    df = spark.createDataFrame([(i, t, "pos" if i < 30 else "neg") for i, t in enumerate(good + bad)],
                               "doc_id long, text string, label string")
    run = train.train_text(df, "doc_id", "text", "label", candidates=[models.fallback_candidate()], search=False)
    assert run.classes == ["neg", "pos"] and run.metrics["accuracy"] > 0.9
    new = spark.createDataFrame([(100, "a wonderful great film"), (101, "boring awful")], "k long, t string")
    got = {r["sample_index"]: r["predicted_class"] for r in train.predict_text(run, new, "k", "t").collect()}
    assert got == {100: "pos", 101: "neg"}
    run.save(str(tmp_path / "tm"))
    again = train.FittedTextRun.load(spark, str(tmp_path / "tm"))
    assert {r["sample_index"]: r["predicted_class"] for r in train.predict_text(again, new, "k", "t").collect()} == got


def test_stream_restart_is_exactly_once(spark, tmp_path):
    from tabsight.streaming.scoring import predict_stream, stream_source

    df = _matrix(spark, 200, 2, seed=5)
    run = train.train_tabular(df, "target", ["id"], candidates=[models.fallback_candidate()], search=False,
                              importance=False, quality_check=False)
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    df.where("id < 100").write.parquet(src + "/a")
    for _ in range(2):  # the second start finds nothing new in its checkpoint
        q, _ = predict_stream(run, stream_source(spark, src + "/*", df), "id", out_path=out)
        q.awaitTermination()
    assert spark.read.parquet(out).count() == 100
    df.where("id >= 100").write.parquet(src + "/b")
    q, _ = predict_stream(run, stream_source(spark, src + "/*", df), "id", out_path=out)
    q.awaitTermination()
    got = spark.read.parquet(out)
    assert got.count() == 200 and got.select("sample_index").distinct().count() == 200
