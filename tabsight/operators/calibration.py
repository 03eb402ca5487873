"""Linear SVM with calibrated probabilities (M2) as a Spark ML estimator.

The rows are dealt to ``numFolds`` folds by a hash of their features (equal
rows share a fold). Per fold, one-vs-rest linear SVMs are fitted on the other
folds and score the fold's own rows; these out-of-fold margins give each class
a logistic curve ``1 / (1 + exp(a * margin + b))`` with Platt's smoothed
targets. A row's probabilities are the normalised curves, averaged over the
folds' models (``ensemble=True``), or those of one SVM fitted on all rows with
curves from the pooled margins.

All curves (folds x classes) are fitted together by Newton's method: an
iteration is one aggregate over the margins that returns seven sums per curve.
"""

from __future__ import annotations

import json
import math
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Estimator, Model
from pyspark.ml.classification import LinearSVC, LinearSVCModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasMaxIter, HasRegParam
from pyspark.ml.util import MLWritable, MLWriter
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsight.errors import InputError
from tabsight.functions.exprs import DEFAULT_SEED
from tabsight.session import cut_lineage

NEWTON_STEPS = 50
#: Tolerance of the SVM fits and of the curves.
TOLERANCE = 1e-4
_RIDGE = 1e-12
_TASK_ROWS = 20_000


def _softplus(x: Column) -> Column:
    """log(1 + exp(x)) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def fit_sigmoids(margins: DataFrame, curve_col: str = "curve", margin_col: str = "margin", positive_col: str = "positive") -> dict[int, tuple[float, float]]:
    """``(a, b)`` of every curve ``P(positive) = 1 / (1 + exp(a * margin + b))``.

    Curves are numbered from 0. The targets are (n+ + 1) / (n+ + 2) and
    1 / (n- + 2). Each step is one aggregate for all curves; a step that raises
    a curve's loss is halved. The driver holds two numbers per curve. Rows with
    a null margin are ignored.
    """
    rows = margins.where(F.col(margin_col).isNotNull()).select(
        F.col(curve_col).cast("int").alias("_c"), F.col(margin_col).cast("double").alias("_m"), F.col(positive_col).cast("boolean").alias("_p")
    )
    state: dict[int, dict] = {}
    for r in rows.groupBy("_c").agg(F.count_if("_p").alias("pos"), F.count_if(~F.col("_p")).alias("neg")).collect():
        pos, neg = r["pos"], r["neg"]
        state[r["_c"]] = {
            "at": (0.0, math.log((neg + 1.0) / (pos + 1.0))), "step": (0.0, 0.0), "loss": math.inf, "done": False,
            "high": (pos + 1.0) / (pos + 2.0), "low": 1.0 / (neg + 2.0),
        }
    for _ in range(NEWTON_STEPS):
        open_ = {c: s for c, s in state.items() if not s["done"]}
        if not open_:
            break

        def value(of) -> Column:  # a number per curve
            known = [float(of(state[c])) if c in state else 0.0 for c in range(max(state) + 1)]
            return F.element_at(F.array(*map(F.lit, known)), F.col("_c") + 1)

        m = F.col("_m")
        z = value(lambda s: s["at"][0]) * m + value(lambda s: s["at"][1])
        target = F.when(F.col("_p"), value(lambda s: s["high"])).otherwise(value(lambda s: s["low"]))
        sums = (
            rows.where(F.col("_c").isin(list(open_)))
            .select("_c", m, z.alias("_z"), target.alias("_t"))
            .select("_c", m, "_z", "_t", F.exp(-_softplus(F.col("_z"))).alias("_q"))  # 1 / (1 + exp(z))
            .select("_c", m, (F.col("_t") * F.col("_z") + _softplus(-F.col("_z"))).alias("_l"), (F.col("_t") - F.col("_q")).alias("_g"), (F.col("_q") * (1 - F.col("_q"))).alias("_h"))
            .groupBy("_c")
            .agg(F.sum("_l").alias("loss"), F.sum(m * F.col("_g")).alias("ga"), F.sum("_g").alias("gb"),
                 F.sum(m * m * F.col("_h")).alias("haa"), F.sum(m * F.col("_h")).alias("hab"), F.sum("_h").alias("hbb"))
            .collect()
        )
        for r in sums:
            s = open_[r["_c"]]
            if r["loss"] > s["loss"] + 1e-12 * abs(s["loss"]):  # too far: half the step back
                s["step"] = (s["step"][0] / 2, s["step"][1] / 2)
                s["at"] = (s["at"][0] - s["step"][0], s["at"][1] - s["step"][1])
                s["done"] = max(map(abs, s["step"])) < 1e-9
                continue
            haa, hab, hbb = r["haa"] + _RIDGE, r["hab"], r["hbb"] + _RIDGE
            det = haa * hbb - hab * hab
            s["loss"] = r["loss"]
            if abs(det) < 1e-300:
                s["done"] = True
                continue
            s["step"] = (-(hbb * r["ga"] - hab * r["gb"]) / det, -(haa * r["gb"] - hab * r["ga"]) / det)
            s["at"] = (s["at"][0] + s["step"][0], s["at"][1] + s["step"][1])
            s["done"] = max(map(abs, s["step"])) < 1e-6 * (1 + max(map(abs, s["at"])))
    return {c: s["at"] for c, s in state.items()}


def _normalised(name: str, total: Column, even: Column) -> Column:
    return F.transform(F.col(name), lambda v: F.when(total > 0, v / total).otherwise(even))


def _with_margins(df: DataFrame, svms: list[LinearSVCModel], out_col: str) -> DataFrame:
    """The margin of every binary SVM as one array column."""
    names = [f"{out_col}{c}" for c in range(len(svms))]
    for svm, name in zip(svms, names, strict=True):
        df = svm.copy().setRawPredictionCol(name).setPredictionCol(name + "_label").transform(df).drop(name + "_label")
    return df.withColumn(out_col, F.array(*(vector_to_array(F.col(n))[1] for n in names))).drop(*names)


class CalibratedLinearSVC(Estimator, HasFeaturesCol, HasLabelCol, HasMaxIter, HasRegParam):
    """One-vs-rest linear SVM whose probabilities are fitted out of fold."""

    def __init__(self, n_classes: int, num_folds: int = 3, ensemble: bool = True, maxIter: int = 100, regParam: float = 0.0) -> None:
        super().__init__()
        self._setDefault(maxIter=100, regParam=0.0, featuresCol="features", labelCol="label")
        self._set(maxIter=maxIter, regParam=regParam)
        self.n_classes, self.num_folds, self.ensemble = n_classes, num_folds, ensemble

    def _classes(self) -> list[int]:
        """The positive class of every curve."""
        return [1] if self.n_classes == 2 else list(range(self.n_classes))

    def _svms(self, parts: list[DataFrame]) -> list[list[LinearSVCModel]]:
        """One binary SVM per part and curve, fitted side by side."""
        svm = LinearSVC(maxIter=self.getMaxIter(), regParam=self.getRegParam(), tol=TOLERANCE, featuresCol=self.getFeaturesCol(), labelCol="_y")

        def fit(task: tuple[DataFrame, int]) -> LinearSVCModel:
            data, c = task
            return svm.fit(data.select(self.getFeaturesCol(), (F.col(self.getLabelCol()) == c).cast("double").alias("_y")))

        with ThreadPoolExecutor(max_workers=8) as pool:
            fitted = list(pool.map(fit, [(data, c) for data in parts for c in self._classes()]))
        size = len(self._classes())
        return [fitted[i : i + size] for i in range(0, len(fitted), size)]

    def _margins(self, svms: list[LinearSVCModel], data: DataFrame, member: int) -> DataFrame:
        scored = _with_margins(data.select(self.getFeaturesCol(), self.getLabelCol()), svms, "_margin")
        rows = scored.select(F.col(self.getLabelCol()).cast("int").alias("y"), F.posexplode("_margin").alias("curve", "margin"))
        own = F.element_at(F.array(*map(F.lit, self._classes())), F.col("curve") + 1)
        number = F.lit(member * len(svms)) + F.col("curve")
        return rows.select(number.alias("curve"), "margin", (F.col("y") == own).alias("positive"))

    def _fit(self, data: DataFrame) -> "CalibratedSVCModel":
        fold = F.pmod(F.xxhash64(F.lit(DEFAULT_SEED), F.col(self.getFeaturesCol())), F.lit(self.num_folds))
        rows = data.select(self.getFeaturesCol(), self.getLabelCol(), fold.cast("int").alias("_fold"))
        # every step of a fit is a job over all partitions: no more of them than the rows need
        cached = rows.coalesce(max(1, -(-data.count() // _TASK_ROWS))).persist()
        folds = [r[0] for r in cached.select("_fold").distinct().orderBy("_fold").collect()]  # numFolds rows
        if not folds:
            raise InputError("The calibrated SVM needs rows to fit on.")
        members = self._svms([cached.where(F.col("_fold") != f) if len(folds) > 1 else cached for f in folds])
        margins = None
        for i, (svms, f) in enumerate(zip(members, folds, strict=True)):
            own = self._margins(svms, cached.where(F.col("_fold") == f), i if self.ensemble else 0)
            margins = own if margins is None else margins.unionByName(own)
        if not self.ensemble:
            members = self._svms([cached])
        curves = fit_sigmoids(cut_lineage(margins, "svm-margins"))
        cached.unpersist()
        fitted = [[curves.get(i * len(svms) + c, (-1.0, 0.0)) for c in range(len(svms))] for i, svms in enumerate(members)]
        return CalibratedSVCModel(members, fitted, self.n_classes, self.getFeaturesCol())


class CalibratedSVCModel(Model, MLWritable):
    """Adds ``probability`` and ``prediction``; no row-wise Python."""

    def __init__(self, members: list[list[LinearSVCModel]], curves: list[list[tuple[float, float]]], n_classes: int, features_col: str) -> None:
        super().__init__()
        self.members, self.curves, self.n_classes, self.features_col = members, curves, n_classes, features_col

    def _transform(self, data: DataFrame) -> DataFrame:
        out, parts = data, []
        for i, (svms, curves) in enumerate(zip(self.members, self.curves, strict=True)):
            raw = f"_svm_raw{i}"
            svms = [m.copy().setFeaturesCol(self.features_col) for m in svms]
            out = _with_margins(out, svms, raw)
            p = [F.exp(-_softplus(F.lit(float(a)) * F.col(raw)[c] + F.lit(float(b)))) for c, (a, b) in enumerate(curves)]
            name = f"_svm_p{i}"
            if self.n_classes == 2:
                out = out.withColumn(name, F.array(1 - p[0], p[0]))
            else:
                out = out.withColumn(name, F.array(*p))
                total = F.aggregate(F.col(name), F.lit(0.0), lambda x, y: x + y)
                even = F.lit(1.0 / self.n_classes)
                out = out.withColumn(name, _normalised(name, total, even))
            out = out.drop(raw)
            parts.append(name)
        mean = [sum((F.col(n)[c] for n in parts[1:]), F.col(parts[0])[c]) / len(parts) for c in range(self.n_classes)]
        out = out.withColumn("_svm_mean", F.array(*mean)).drop(*parts)
        best = F.array_position("_svm_mean", F.array_max("_svm_mean")) - 1  # the first of equals
        return out.withColumn("probability", array_to_vector("_svm_mean")).withColumn("prediction", best.cast("double")).drop("_svm_mean")

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def load(cls, path: str) -> "CalibratedSVCModel":
        spark = SparkSession.getActiveSession()
        meta = json.loads(spark.read.text(path + "/calibration").first()[0])
        members = [[LinearSVCModel.load(f"{path}/svm-{i}-{c}") for c in range(len(m))] for i, m in enumerate(meta["curves"])]
        return cls(members, [[tuple(ab) for ab in m] for m in meta["curves"]], meta["n_classes"], meta["features_col"])


class _Writer(MLWriter):
    def __init__(self, model: CalibratedSVCModel) -> None:
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        m = self.model
        for i, svms in enumerate(m.members):
            for c, svm in enumerate(svms):
                svm.write().overwrite().save(f"{path}/svm-{i}-{c}")
        meta = json.dumps({"curves": m.curves, "n_classes": m.n_classes, "features_col": m.features_col})
        SparkSession.getActiveSession().createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(path + "/calibration")
