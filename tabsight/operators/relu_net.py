"""ReLU network with an L2 penalty and early stopping (M1) as a Spark ML estimator.

The rows are dealt to groups of about ``task_rows`` rows, at most ``max_groups``
of them. One epoch is one job: every group starts from the epoch's weights, takes
Adam steps on mini-batches of its rows as they stream through (a task holds one
Arrow batch), and gives back its weights and moments, multiplied by its row
count. These are added up in tasks and the driver takes the mean, so it holds a
few copies of the network and no rows. With one group this is plain mini-batch
Adam, whatever the input's partitions.

A tenth of the rows, drawn by a hash of their features (equal rows stay
together), is held out. The job of an epoch also scores it with the weights it
starts from. The fit ends when this accuracy has not risen by more than ``tol``
for ``patience`` epochs, and keeps the best weights. Without held-out rows the
mean training loss takes its place.

Rows with null features or label, or a NaN among the features, are not fitted on;
rows with null features get a null probability and prediction. A fit without rows
raises InputError.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasMaxIter
from pyspark.ml.util import MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsight.errors import InputError
from tabsight.functions.exprs import DEFAULT_SEED

BATCH_ROWS = 200
LEARNING_RATE = 0.001
#: Decay of Adam's two moments and the term beside the root.
ADAM = (0.9, 0.999, 1e-8)
HELD_OUT_ONE_IN = 10
_EPOCH_SCHEMA = "rows long, held long, correct long, loss double, steps double, state binary"


# ---- the network in numpy ------------------------------------------------------------

def n_weights(sizes: list[int]) -> int:
    """Weights and biases of a network with these layer sizes."""
    return sum((a + 1) * b for a, b in zip(sizes, sizes[1:], strict=False))


def layers(flat: np.ndarray, sizes: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Views ``(matrix, bias)`` of every layer in the flat weights."""
    out, at = [], 0
    for a, b in zip(sizes, sizes[1:], strict=False):
        out.append((flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + (a + 1) * b]))
        at += (a + 1) * b
    return out


def initial_weights(sizes: list[int], seed: int) -> np.ndarray:
    """Uniform weights scaled by the layer's width on both sides."""
    rng = np.random.default_rng(seed)
    flat = np.empty(n_weights(sizes))
    for w, b in layers(flat, sizes):
        bound = math.sqrt(6.0 / sum(w.shape))
        w[:] = rng.uniform(-bound, bound, w.shape)
        b[:] = rng.uniform(-bound, bound, b.shape)
    return flat


def probabilities(flat: np.ndarray, sizes: list[int], x: np.ndarray, hidden: list | None = None) -> np.ndarray:
    """Softmax output; the input of every layer is appended to ``hidden``."""
    net = layers(flat, sizes)
    for i, (w, b) in enumerate(net):
        if hidden is not None:
            hidden.append(x)
        x = x @ w + b
        if i + 1 < len(net):
            x = np.maximum(x, 0.0)
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def loss_and_gradient(flat: np.ndarray, sizes: list[int], x: np.ndarray, y: np.ndarray, alpha: float) -> tuple[float, np.ndarray]:
    """Mean cross-entropy plus ``alpha / 2 |w|^2 / rows`` (biases are free), and its gradient."""
    inputs: list[np.ndarray] = []
    p = probabilities(flat, sizes, x, inputs)
    n = len(y)
    loss = -np.log(np.maximum(p[np.arange(n), y], 1e-300)).mean()
    grad = np.empty_like(flat)
    net, grads = layers(flat, sizes), layers(grad, sizes)
    delta = p.copy()
    delta[np.arange(n), y] -= 1.0
    delta /= n
    for (w, _), (gw, gb), into in zip(reversed(net), reversed(grads), reversed(inputs), strict=True):
        loss += 0.5 * alpha * float((w * w).sum()) / n
        gw[:] = into.T @ delta + alpha * w / n
        gb[:] = delta.sum(axis=0)
        delta = (delta @ w.T) * (into > 0)  # the input of a layer is positive where its unit is on
    return float(loss), grad


class Adam:
    """Weights with their two moments; ``state`` is the three of them as one array."""

    def __init__(self, state: np.ndarray, steps: float, rate: float) -> None:
        self.state, self.steps, self.rate = state.copy(), steps, rate
        self.w, self.m, self.v = self.state.reshape(3, -1)

    def step(self, gradient: np.ndarray) -> None:
        b1, b2, eps = ADAM
        self.steps += 1
        self.m += (1 - b1) * (gradient - self.m)
        self.v += (1 - b2) * (gradient * gradient - self.v)
        rate = self.rate * math.sqrt(1 - b2**self.steps) / (1 - b1**self.steps)
        self.w -= rate * self.m / (np.sqrt(self.v) + eps)


# ---- in the tasks --------------------------------------------------------------------

def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=float).reshape(-1, width)


def _epoch(shared, sizes: list[int], steps: float, alpha: float, rate: float, seed: int, epoch: int, train: bool):
    """One epoch of one group: ``_EPOCH_SCHEMA`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = np.frombuffer(shared.value)
        first = start.reshape(3, -1)[0]
        adam = Adam(start, steps, rate)
        rows = held = correct = 0
        total = 0.0
        for number, batch in enumerate(batches):
            x, y = _matrix(batch.column("x"), sizes[0]), np.asarray(batch.column("y"))
            out = np.asarray(batch.column("held").to_numpy(zero_copy_only=False), dtype=bool)
            if out.any():
                held += int(out.sum())
                correct += int((probabilities(first, sizes, x[out]).argmax(axis=1) == y[out]).sum())
            order = np.random.default_rng([seed, epoch, number]).permutation(np.flatnonzero(~out))
            rows += len(order)
            for at in range(0, len(order) if train else 0, BATCH_ROWS):
                some = order[at : at + BATCH_ROWS]
                loss, gradient = loss_and_gradient(adam.w, sizes, x[some], y[some], alpha)
                total += loss * len(some)
                adam.step(gradient)
        state = (adam.state * rows).tobytes() if train else b""
        yield pa.RecordBatch.from_pydict(
            {"rows": [rows], "held": [held], "correct": [correct], "loss": [total], "steps": [adam.steps * rows], "state": [state]}
        )

    return run


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of a task's ``_EPOCH_SCHEMA`` rows, as one row."""
    sums, state = None, None
    for batch in batches:
        for row in batch.to_pylist():
            one = np.frombuffer(row.pop("state"))
            state = one if state is None else state + one
            sums = row if sums is None else {k: sums[k] + row[k] for k in row}
    if sums is not None:
        yield pa.RecordBatch.from_pydict({**{k: [v] for k, v in sums.items()}, "state": [state.tobytes()]})


# ---- estimator -----------------------------------------------------------------------

class ReluNetClassifier(Estimator, HasFeaturesCol, HasLabelCol, HasMaxIter):
    """Feed-forward network: ReLU layers, softmax, Adam, L2, early stopping."""

    def __init__(self, hidden: list[int], n_classes: int, alpha: float = 1e-3, maxIter: int = 200, patience: int = 10,
                 tol: float = 1e-4, rate: float = LEARNING_RATE, seed: int = DEFAULT_SEED, task_rows: int = 50_000,
                 max_groups: int = 1024) -> None:
        super().__init__()
        self._setDefault(maxIter=200, featuresCol="features", labelCol="label")
        self._set(maxIter=maxIter)
        self.hidden, self.n_classes, self.alpha, self.patience, self.tol = list(hidden), n_classes, alpha, patience, tol
        self.rate, self.seed, self.task_rows, self.max_groups = rate, seed, task_rows, max_groups

    def _rows(self, data: DataFrame) -> DataFrame:
        features, label = F.col(self.getFeaturesCol()), F.col(self.getLabelCol())
        draw = F.xxhash64(F.lit(self.seed), vector_to_array(features))
        rows = data.where(features.isNotNull() & label.isNotNull()).select(
            vector_to_array(features).alias("x"), label.cast("long").alias("y"), draw.alias("draw"),
            (F.pmod(draw, F.lit(HELD_OUT_ONE_IN)) == 0).alias("held"),
        )
        return rows.where(~F.exists("x", F.isnan))

    def _fit(self, data: DataFrame) -> "ReluNetModel":
        spark = data.sparkSession
        rows = self._rows(data)
        seen = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("width"), F.min("y").alias("low"), F.max("y").alias("high")).first()
        if not seen["n"]:
            raise InputError("The network needs rows to fit on.")
        if seen["low"] < 0 or seen["high"] >= self.n_classes:
            raise InputError(f"Labels must be from 0 to {self.n_classes - 1}.")
        sizes = [seen["width"], *self.hidden, self.n_classes]
        groups = max(1, min(self.max_groups, -(-seen["n"] // self.task_rows)))
        # equal rows are dealt over all groups; their order in a group is the hash's
        dealt = rows.repartition(groups).sortWithinPartitions("draw", "y").drop("draw").persist()
        weights = initial_weights(sizes, self.seed)
        state, steps = np.concatenate([weights, np.zeros(2 * len(weights))]), 0.0
        best, score, waited = weights, -math.inf, 0
        history: list[float] = []
        try:
            for epoch in range(self.getMaxIter() + 1):
                last = epoch == self.getMaxIter()  # scores the weights of the last epoch only
                shared = spark.sparkContext.broadcast(state.tobytes())
                task = _epoch(shared, sizes, steps, self.alpha, self.rate, self.seed, epoch, not last)
                sums = dealt.mapInArrow(task, _EPOCH_SCHEMA)
                if groups > 8:
                    sums = sums.repartition(math.isqrt(groups)).mapInArrow(_add_up, _EPOCH_SCHEMA)
                got = next(_add_up(iter([pa.RecordBatch.from_pylist([r.asDict() for r in sums.collect()])]))).to_pylist()[0]
                shared.destroy()
                # the accuracy belongs to the weights before this epoch, the training loss to the epoch
                now = got["correct"] / got["held"] if got["held"] else (-got["loss"] / got["rows"] if not last else -math.inf)
                if epoch > 0 or not got["held"]:
                    history.append(now)
                    waited = 0 if now > score + self.tol else waited + 1
                    if now > score:
                        best, score = state[: len(weights)], now
                    if waited >= self.patience:
                        break
                if last or not got["rows"]:
                    break
                state, steps = np.frombuffer(got["state"]) / got["rows"], got["steps"] / got["rows"]
        finally:
            dealt.unpersist()
        return ReluNetModel(best.copy(), sizes, self.getFeaturesCol(), history)


class ReluNetModel(Model, MLWritable):
    """Adds ``probability`` and ``prediction`` (the first of equal classes)."""

    def __init__(self, weights: np.ndarray, sizes: list[int], features_col: str, history: list[float] | None = None) -> None:
        super().__init__()
        self.weights, self.sizes, self.features_col, self.history = weights, sizes, features_col, history or []

    def _transform(self, data: DataFrame) -> DataFrame:
        weights, sizes = self.weights, self.sizes

        @F.pandas_udf("array<double>")
        def score(x: pd.Series) -> pd.Series:
            known = x.dropna()
            if not len(known):
                return pd.Series([None] * len(x), dtype=object)
            p = probabilities(weights, sizes, np.stack(known.to_numpy()))
            return pd.Series(list(p), index=known.index).reindex(x.index)

        array = vector_to_array(F.col(self.features_col))
        out = data.withColumn("_net", F.when(F.col(self.features_col).isNotNull(), score(F.when(F.col(self.features_col).isNotNull(), array))))
        best = (F.array_position("_net", F.array_max("_net")) - 1).cast("double")
        vector = F.when(F.col("_net").isNotNull(), array_to_vector(F.coalesce("_net", F.array(F.lit(0.0)))))
        return out.withColumn("probability", vector).withColumn("prediction", best).drop("_net")

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def load(cls, path: str) -> "ReluNetModel":
        row = SparkSession.getActiveSession().read.parquet(path + "/network").first()
        meta = json.loads(row["meta"])
        return cls(np.frombuffer(bytes(row["weights"])).copy(), meta["sizes"], meta["features_col"], meta["history"])


class _Writer(MLWriter):
    def __init__(self, model: ReluNetModel) -> None:
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        m = self.model
        meta = json.dumps({"sizes": m.sizes, "features_col": m.features_col, "history": m.history})
        one = SparkSession.getActiveSession().createDataFrame([(meta, bytearray(m.weights.tobytes()))], "meta string, weights binary")
        one.coalesce(1).write.mode("overwrite").parquet(path + "/network")
