import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tabsight.errors import InputError
from tabsight.operators import models, relu_net
from tabsight.operators.relu_net import Adam, ReluNetClassifier, ReluNetModel, loss_and_gradient
from tabsight.plans import train


def rings(spark, n=1200, seed=3, parts=4):
    """Three classes by the distance from the centre: no linear rule finds them."""
    rnd = np.random.default_rng(seed)
    x = rnd.normal(0, 1, (n, 2))
    y = np.digitize((x * x).sum(axis=1), [0.8, 2.2])
    rows = [(i, float(k), [float(v) for v in r]) for i, (k, r) in enumerate(zip(y, x, strict=True))]
    df = spark.createDataFrame(rows, "id long, label double, x array<double>")
    return df.select("id", "label", array_to_vector("x").alias("features")).repartition(parts)


def accuracy(df):
    return df.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]


@pytest.mark.parametrize("sizes", [[3, 2], [4, 5, 3], [5, 7, 6, 4]])
def test_gradient_equals_finite_differences(sizes):
    rnd = np.random.default_rng(0)
    flat = relu_net.initial_weights(sizes, 1)
    x, y = rnd.normal(0, 1, (9, sizes[0])), rnd.integers(0, sizes[-1], 9)
    _, grad = loss_and_gradient(flat, sizes, x, y, 0.5)
    for i in range(len(flat)):
        step = np.zeros_like(flat)
        step[i] = 1e-6
        up, down = (loss_and_gradient(flat + s, sizes, x, y, 0.5)[0] for s in (step, -step))
        assert grad[i] == pytest.approx((up - down) / 2e-6, abs=1e-6)


def test_adam_follows_its_formula():
    rnd = np.random.default_rng(2)
    w = rnd.normal(0, 1, 4)
    adam, m, v, want = Adam(np.concatenate([w, np.zeros(8)]), 0, 0.01), 0.0, 0.0, w.copy()
    for t in range(1, 6):
        g = rnd.normal(0, 1, 4)
        adam.step(g)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        want -= 0.01 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8 / np.sqrt(1 - 0.999**t))
        assert np.allclose(adam.w, want, atol=1e-12)


def test_one_group_is_plain_adam_in_numpy(spark):
    data = rings(spark, 300)
    net = ReluNetClassifier([8], 3, alpha=0.1, maxIter=3, rate=0.01)
    rows = net._rows(data).orderBy("draw", "y").toPandas()
    x, y, held = np.stack(rows["x"]), rows["y"].to_numpy(), rows["held"].to_numpy()
    flat = relu_net.initial_weights([2, 8, 3], net.seed)
    adam, seen = Adam(np.concatenate([flat, np.zeros(2 * len(flat))]), 0, 0.01), []
    for epoch in range(3):
        order = np.random.default_rng([net.seed, epoch, 0]).permutation(np.flatnonzero(~held))
        for at in range(0, len(order), relu_net.BATCH_ROWS):
            some = order[at : at + relu_net.BATCH_ROWS]
            adam.step(loss_and_gradient(adam.w, [2, 8, 3], x[some], y[some], 0.1)[1])
        p = relu_net.probabilities(adam.w, [2, 8, 3], x[held])
        seen.append(((p.argmax(axis=1) == y[held]).mean(), adam.w.copy()))
    fitted = net.fit(data)
    assert fitted.history == pytest.approx([s for s, _ in seen])
    assert np.allclose(fitted.weights, max(seen, key=lambda s: s[0])[1], atol=1e-9)
    again = net.fit(data.repartition(11))
    assert np.allclose(again.weights, fitted.weights, atol=1e-9)


def test_learns_what_a_linear_rule_cannot_and_stops_early(spark):
    data = rings(spark)
    model = ReluNetClassifier([32], 3, maxIter=150, rate=0.01).fit(data)
    scored = model.transform(rings(spark, seed=4))
    assert accuracy(scored) > 0.9
    assert len(model.history) < 150
    sums = models.with_proba(model, data).select(F.aggregate("proba", F.lit(0.0), lambda a, b: a + b).alias("s"), "pred", "label")
    assert sums.where(F.abs(F.col("s") - 1) > 1e-9).count() == 0


def test_groups_are_averaged(spark):
    model = ReluNetClassifier([32], 3, maxIter=60, rate=0.01, task_rows=100).fit(rings(spark))  # 12 groups, added up in tasks
    assert accuracy(model.transform(rings(spark, seed=4))) > 0.85


def test_penalty_shrinks_the_weights(spark):
    data = rings(spark, 400)
    small, large = (ReluNetClassifier([16], 3, alpha=a, maxIter=30, rate=0.01, tol=-1.0).fit(data) for a in (0.0, 50.0))
    norms = [sum(float((w * w).sum()) for w, _ in relu_net.layers(m.weights, m.sizes)) for m in (small, large)]
    assert norms[1] < norms[0] / 2


def test_nulls_repeated_rows_and_no_rows(spark):
    same = spark.range(50).select(F.lit(1.0).alias("label"), array_to_vector(F.array(F.lit(0.5), F.lit(2.0))).alias("features"))
    nulls = spark.range(2).select(F.lit(0.0).alias("label"), F.lit(None).cast(same.schema["features"].dataType).alias("features"))
    nan = same.limit(1).select("label", array_to_vector(F.array(F.lit(float("nan")), F.lit(1.0))).alias("features"))
    model = ReluNetClassifier([4], 2, maxIter=5).fit(same.unionByName(nulls).unionByName(nan))
    assert np.isfinite(model.weights).all()
    out = model.transform(nulls.unionByName(same.limit(1))).collect()
    assert [r["probability"] is None for r in out] == [True, True, False]
    assert [r["prediction"] is None for r in out] == [True, True, False]
    with pytest.raises(InputError):
        ReluNetClassifier([4], 2).fit(nulls)
    with pytest.raises(InputError):
        ReluNetClassifier([4], 1).fit(same)


def test_saved_and_loaded(spark, tmp_path):
    data = rings(spark, 200)
    model = ReluNetClassifier([8], 3, maxIter=4).fit(data)
    model.write().overwrite().save(str(tmp_path / "net"))
    again = ReluNetModel.load(str(tmp_path / "net"))
    want, got = ({r["id"]: r["probability"] for r in m.transform(data).collect()} for m in (model, again))
    assert want == got


def test_a_run_keeps_its_network(spark, tmp_path):
    x = rings(spark, 200).select("id", F.concat(F.lit("c"), F.col("label").cast("int")).alias("target"), vector_to_array("features").alias("v"))
    df = x.select("id", "target", F.col("v")[0].alias("a"), F.col("v")[1].alias("b"))
    small = models.Candidate("Net", lambda f, k: ReluNetClassifier([8], k, maxIter=5))
    run = train.train_tabular(df, "target", ["id"], candidates=[small], search=False, importance=False, quality_check=False)
    run.save(str(tmp_path / "run"))
    again = train.FittedRun.load(spark, str(tmp_path / "run"))
    want, got = ({r["sample_index"]: r["pred"] for r in train.predict_batch(m, df, "id", detail=False).collect()} for m in (run, again))
    assert want == got and len(want) == 200


def test_candidates_use_the_network():
    nets = {c.name: c.build(4, 3) for c in models.tabular_candidates(1000) if c.name.startswith("MLP")}
    assert {n: (e.hidden, e.getMaxIter(), e.alpha) for n, e in nets.items()} == {
        "MLP-Small": ([64], 150, 1e-3),
        "MLP-Medium": ([128, 64], 200, 1e-3),
        "MLP-Large": ([256, 128, 64], 250, 1e-4),
    }
