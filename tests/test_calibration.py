import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tabsight.operators import models
from tabsight.operators.calibration import CalibratedLinearSVC, CalibratedSVCModel, fit_sigmoids


def platt(m, positive, steps=200):
    """Newton's method on the same loss, in numpy."""
    n1, n0 = positive.sum(), (~positive).sum()
    t = np.where(positive, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 0.0, math.log((n0 + 1) / (n1 + 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(a * m + b))
        g = np.array([(m * (t - p)).sum(), (t - p).sum()])
        w = p * (1 - p)
        h = np.array([[(m * m * w).sum(), (m * w).sum()], [(m * w).sum(), w.sum()]])
        d = np.linalg.solve(h + 1e-12 * np.eye(2), g)
        a, b = a - d[0], b - d[1]
    return a, b


def table(spark, n_classes, n=600, seed=1, noise=1.0):
    rnd = np.random.default_rng(seed)
    y = rnd.choice(n_classes, n, p=np.arange(1, n_classes + 1) / np.arange(1, n_classes + 1).sum())
    centres = rnd.normal(0, 1.2, (n_classes, 6))
    x = centres[y] + rnd.normal(0, noise, (n, 6))
    rows = [(i, float(k), [float(v) for v in r]) for i, (k, r) in enumerate(zip(y, x, strict=True))]
    df = spark.createDataFrame(rows, "id long, label double, x array<double>")
    return df.select("id", "label", array_to_vector("x").alias("features")).repartition(4)


def log_loss(df, p_col):
    own = F.element_at(p_col, F.col("label").cast("int") + 1)
    return df.agg(F.avg(-F.log(F.greatest(own, F.lit(1e-15))))).first()[0]


def test_sigmoids_equal_numpy(spark):
    rnd = np.random.default_rng(2)
    rows, want = [], {}
    for g, (scale, shift, n) in enumerate([(1.0, 0.0, 400), (-3.0, 1.0, 300), (0.05, -2.0, 500), (20.0, 0.0, 200)]):
        m = rnd.normal(shift, 1, n)
        p = rnd.random(n) < 1 / (1 + np.exp(-scale * m))
        want[g] = platt(m, p)
        rows += [(g, float(a), bool(b)) for a, b in zip(m, p, strict=True)]
    rows += [(0, None, True), (9, 1.0, True), (9, 2.0, True)]  # a null margin; one class only
    got = fit_sigmoids(spark.createDataFrame(rows, "curve int, margin double, positive boolean"))
    for key, ab in want.items():
        assert got[key] == pytest.approx(ab, rel=1e-4, abs=1e-4)
    assert all(map(math.isfinite, got[9]))


@pytest.mark.parametrize(("n_classes", "ensemble"), [(4, True), (2, False)])
def test_log_loss_beats_the_bare_sigmoid(spark, tmp_path, n_classes, ensemble):
    df = table(spark, n_classes).persist()
    train, test = df.where("id % 3 > 0"), df.where("id % 3 = 0")
    model = CalibratedLinearSVC(n_classes, ensemble=ensemble, regParam=1e-3).fit(train)
    assert len(model.members) == (3 if ensemble else 1)
    scored = models.with_proba(model, test).cache()
    assert scored.columns == ["id", "label", "features", "probability", "prediction", "proba", "pred"]
    sums = scored.select(F.aggregate("proba", F.lit(0.0), lambda a, b: a + b).alias("s"), "pred", "prediction").collect()
    assert all(abs(r.s - 1) < 1e-9 and r.pred == r.prediction for r in sums)
    raw = CalibratedSVCModel([model.members[0]], [[(-1.0, 0.0)] * len(model.members[0])], n_classes, "features")
    loss, plain = log_loss(scored, "proba"), log_loss(models.with_proba(raw, test), "proba")
    assert loss < plain and loss < math.log(n_classes)
    acc = scored.agg(F.avg((F.col("pred") == F.col("label")).cast("double"))).first()[0]
    assert acc > 0.6
    model.write().overwrite().save(str(tmp_path / "m"))
    again = CalibratedSVCModel.load(str(tmp_path / "m"))
    a = {r.id: r.proba for r in scored.collect()}
    assert {r.id: r.proba for r in models.with_proba(again, test).collect()} == a


def test_margins_are_out_of_fold(spark):
    """Labels without any relation to the features: curves on own margins would look sure, these must not."""
    rnd = np.random.default_rng(5)
    rows = [(float(rnd.integers(0, 2)), [float(v) for v in rnd.normal(size=40)]) for _ in range(120)]
    df = spark.createDataFrame(rows, "label double, x array<double>").select("label", array_to_vector("x").alias("features"))
    scored = models.with_proba(CalibratedLinearSVC(2).fit(df), df)
    sure = scored.agg(F.avg(F.abs(F.col("proba")[1] - 0.5))).first()[0]
    raw = CalibratedLinearSVC(2, ensemble=False)._svms([df])[0]
    own = models.with_proba(CalibratedSVCModel([raw], [[(-1.0, 0.0)]], 2, "features"), df).agg(F.avg(F.abs(F.col("proba")[1] - 0.5))).first()[0]
    assert sure < 0.2 < own


def test_penalty_is_on_the_summed_loss(spark):
    cand = models.fallback_candidate()
    assert cand.build(3, 2, n_rows=250).getRegParam() == 1 / 250
    assert models.text_candidates()[0].build(3, 2, n_rows=50).getRegParam() == 1 / 50
    assert all(c.l2 == 1.0 for c in (*models.vector_candidates(), models.tabular_candidates(10)[-1]))
    assert models.text_candidates()[2].l2 is None
