"""Linear models by variance-reduced local steps (SCOPE): logistic, hinge and positive-unlabelled; softmax; one against the rest.

Each outer iteration computes the full gradient at the current weights, lets every partition make local steps with the
gradient correction on samples it draws itself, and averages the partitions' weights. Rows are sparse throughout: a local
step takes a small block of drawn rows and touches the columns of these rows only. The other change, a decay and a multiple
of the full gradient, is kept as two numbers until the end. A partition streams its rows in Arrow batches, which are its
sample pool. Weights are a dense array on the driver - classes x features doubles, 8 MB for a million features - and are
broadcast; they come back as sums of their changed entries that executors add up first.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.functions import losses as L
from grainmill.functions.linalg import once
from grainmill.functions.vectors import DenseRows, Rows, packed, rows_of
from grainmill.schema import EngineError

_P = Params._dummy()
#: Rows of a local step at most, and features up to which margins are an expression of the plan (beyond, weights are broadcast).
BLOCK_ROWS, PLAN_FEATURES = 256, 256


def restart_every(reg: float, step: float) -> int:
    """Local steps after which decay and gradient are folded into the weights, so that the decay doesn't vanish."""
    return 10**8 if reg == 0 or reg * step >= 1 else round(-4 / math.log10(1 - reg * step))


def sample_rows(df: DataFrame, features: str, label: str) -> DataFrame:
    """(y, x): rows with a label and features; x stays the vector or array it is."""
    t = df.schema[features].dataType
    x = F.col(features) if isinstance(t, VectorUDT) else F.col(features).cast("array<double>")
    return df.select(F.col(label).cast("double").alias("y"), x.alias("x")).where("y IS NOT NULL AND x IS NOT NULL")


def n_features(rows: DataFrame) -> int:
    """Features of the first row; the others must not have more."""
    first = rows.select("x").first()
    if first is None:
        raise EngineError("no rows to train on")
    return len(first[0]) if isinstance(first[0], list) else first[0].size


def _read(b: pa.RecordBatch, d: int) -> tuple[Rows | DenseRows, np.ndarray]:
    return packed(rows_of(b.column("x"), d), d), b.column("y").to_numpy(zero_copy_only=False)


class Kernel:
    """Margins, losses and gradient factors for weights of shape (width, d + 1), the last column being the intercept."""

    def __init__(self, loss: L.Loss | L.MultiLoss, width: int, intercept: bool) -> None:
        self.loss, self.width, self.intercept = loss, width, intercept

    def margins(self, x: Rows | DenseRows, w: np.ndarray) -> np.ndarray:
        return x.dot(w[:, :-1]) + (w[:, -1] if self.intercept else 0.0)

    def factors(self, m: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Losses, and factors of shape (rows, width), from margins of the same shape."""
        loss, f = self.loss.kernel(m if isinstance(self.loss, L.MultiLoss) else m[:, 0], y)
        return loss, f if f.ndim == 2 else f[:, None]

    def add(self, x: Rows | DenseRows, factors: np.ndarray, w: np.ndarray) -> None:
        """Adds the rows times their factors to w."""
        x.add_to(w[:, :-1], factors)
        if self.intercept:
            w[:, -1] += factors.sum(axis=0)


def full_gradient(rows: DataFrame, w: np.ndarray, kernel: Kernel) -> tuple[np.ndarray, float, int]:
    """Mean gradient (width, d + 1), mean loss and number of rows. A task sends the sums of touched weights; executors add them before the driver does."""
    shared = rows.sparkSession.sparkContext.broadcast(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = shared.value
        g, loss, n = np.zeros_like(now), 0.0, 0
        for b in batches:
            x, y = _read(b, now.shape[1] - 1)
            one, f = kernel.factors(kernel.margins(x, now), y)
            kernel.add(x, f, g)
            loss, n = loss + float(one.sum()), n + len(y)
        if n:
            yield _sums(np.concatenate([g.ravel(), [loss, n]]))

    total = _add_up(rows.mapInArrow(run, "i int, v double"), w.size + 2)
    shared.destroy()
    n = int(total[-1])
    if not n:
        raise EngineError("no rows to train on")
    return total[:-2].reshape(w.shape) / n, float(total[-2]) / n, n


def _sums(v: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(v)
    return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(v[at])], names=["i", "v"])


def _add_up(parts: DataFrame, size: int) -> np.ndarray:
    out = np.zeros(size)
    got = parts.groupBy("i").agg(F.sum("v").alias("v")).toArrow()  # at most one row a weight
    out[got.column("i").to_numpy()] = got.column("v").to_numpy()
    return out


def block_rows(x: Rows | DenseRows, step: float) -> int:
    """Rows of a block: so many that their steps together stay below the inverse of the mean squared length of a row."""
    length = float((x.val**2).sum()) / max(1, len(x)) + 1.0
    return int(np.clip(1 / (step * length), 1, BLOCK_ROWS))


def local_steps(x: Rows | DenseRows, y: np.ndarray, anchor: np.ndarray, gradient: np.ndarray, start: np.ndarray, kernel: Kernel, step: float, reg: float, rng: np.random.Generator, every: int) -> np.ndarray:
    """The weights after as many variance-reduced steps as rows, in blocks of drawn rows.

    A block moves the weights by its factors at the present weights less those at `anchor`, and, a step a row, by the full
    gradient there and the decay. Weights are `decay * moved + drift * gradient`, so only the first part costs memory traffic.
    """
    moved, decay, drift, since = start.copy(), 1.0, 0.0, 0
    at_anchor = kernel.factors(kernel.margins(x, anchor), y)[1]
    drawn, size, keep = rng.integers(0, len(y), len(y)), block_rows(x, step), 1 - reg * step
    for block in np.split(drawn, np.arange(size, len(drawn), size)):
        part, n = x.take(block), len(block)
        m = decay * kernel.margins(part, moved) + drift * kernel.margins(part, gradient)
        change = kernel.factors(m, y[block])[1] - at_anchor[block]
        shrunk = keep**n
        drift = shrunk * drift - (step * n if reg == 0 else (1 - shrunk) / reg)
        decay *= shrunk
        kernel.add(part, -step / decay * change, moved)
        since += n
        if since >= every:
            moved, decay, drift, since = decay * moved + drift * gradient, 1.0, 0.0, 0
    return decay * moved + drift * gradient


def train(rows: DataFrame, width: int, d: int, kernel: Kernel, step: float, reg: float, iterations: int, seed: int, every: int, w: np.ndarray | None = None, tol: float = 0.0) -> tuple[np.ndarray, list[float]]:
    """Weights (width, d + 1) and the mean loss before each outer iteration. `tol` > 0 ends early when the loss stalls."""
    w = np.zeros((width, d + 1)) if w is None else w
    history: list[float] = []
    for it in range(iterations):
        g, loss, _ = full_gradient(rows, w, kernel)
        history.append(loss)
        if tol and len(history) > 1 and abs(history[-2] - loss) < tol * max(1.0, abs(loss)):
            break
        shared = rows.sparkSession.sparkContext.broadcast((w, g))

        def run(batches: Iterator[pa.RecordBatch], it: int = it, shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            from pyspark import TaskContext

            part, (now, full) = TaskContext.get().partitionId(), shared.value
            own, n = now, 0
            for k, b in enumerate(batches):
                x, y = _read(b, d)
                if len(y):
                    own = local_steps(x, y, now, full, own, kernel, step, reg, np.random.default_rng([seed, it, part, k]), every)
                    n += len(y)
            if n:
                yield _sums(np.append((own - now).ravel(), 1.0))

        total = _add_up(rows.mapInArrow(run, "i int, v double"), w.size + 1)
        shared.destroy()
        w = w + total[:-1].reshape(w.shape) / total[-1]
    return w, history


class _ScopeParams(HasFeaturesCol, HasLabelCol):
    stepSize = Param(_P, "stepSize", "length of local steps", typeConverter=TypeConverters.toFloat)
    maxIter = Param(_P, "maxIter", "outer iterations", typeConverter=TypeConverters.toInt)
    regParam = Param(_P, "regParam", "L2 penalty", typeConverter=TypeConverters.toFloat)
    elasticNetParam = Param(_P, "elasticNetParam", "accepted, has no effect", typeConverter=TypeConverters.toFloat)
    factor = Param(_P, "factor", "accepted, has no effect", typeConverter=TypeConverters.toFloat)
    numPartitions = Param(_P, "numPartitions", "partitions to train on, 0 = as they are", typeConverter=TypeConverters.toInt)
    tol = Param(_P, "tol", "end early below this relative change of the loss, 0 = never", typeConverter=TypeConverters.toFloat)
    restartFrequency = Param(_P, "restartFrequency", "local steps between folds, 0 = by rule", typeConverter=TypeConverters.toInt)
    lossFunc = Param(_P, "lossFunc", "loss", typeConverter=TypeConverters.toString)
    posWeight = Param(_P, "posWeight", "weight of positives; for UPULR the class prior", typeConverter=TypeConverters.toFloat)
    fitIntercept = Param(_P, "fitIntercept", "fit an intercept", typeConverter=TypeConverters.toBoolean)
    numClasses = Param(_P, "numClasses", "classes", typeConverter=TypeConverters.toInt)
    seed = Param(_P, "seed", "seed of the local draws", typeConverter=TypeConverters.toInt)

    _defaults = {"stepSize": 1.0, "maxIter": 5, "regParam": 0.0, "elasticNetParam": 0.0, "factor": 0.0, "numPartitions": 0, "tol": 0.0, "restartFrequency": 0, "posWeight": 1.0, "fitIntercept": True, "numClasses": 2, "seed": 42, "featuresCol": "features", "labelCol": "label"}


class _Scope(Estimator, _ScopeParams, DefaultParamsWritable, DefaultParamsReadable):
    """fit(df) trains from zero weights, fit_from(df, weights) from given ones of shape (width, d + 1). Rows without label or features are left out."""

    _loss_default, _losses = "LR", ("LR",)

    def _init(self, kw: dict) -> None:
        self._setDefault(lossFunc=self._loss_default, **self._defaults)
        self._set(**{k: v for k, v in kw.items() if v is not None})
        if self.getOrDefault("lossFunc") not in self._losses:
            raise EngineError(f"lossFunc is one of {self._losses}")

    def _kernel(self, rows: DataFrame) -> Kernel:
        raise NotImplementedError

    def _model(self) -> _ScopeModel:
        raise NotImplementedError

    def _fit(self, df: DataFrame) -> Model:
        return self.fit_from(df, None)

    def fit_from(self, df: DataFrame, weights: np.ndarray | None) -> Model:
        rows = sample_rows(df, self.getFeaturesCol(), self.getLabelCol())
        if self.getOrDefault("numPartitions") > 0:
            rows = rows.repartition(self.getOrDefault("numPartitions"))
        rows = rows.persist()
        try:
            d = n_features(rows)
            kernel = self._kernel(rows)
            step, reg = self.getOrDefault("stepSize"), self.getOrDefault("regParam")
            every = self.getOrDefault("restartFrequency") or restart_every(reg, step)
            w, history = train(rows, kernel.width, d, kernel, step, reg, self.getOrDefault("maxIter"), self.getOrDefault("seed"), every, weights, self.getOrDefault("tol"))
        finally:
            rows.unpersist()
        model = self._copyValues(self._model()._set(content=weights_text(w)))
        model.loss_history = history
        return model


class _ScopeModel(Model, _ScopeParams, DefaultParamsWritable, DefaultParamsReadable):
    """Weights as JSON with the metadata, so that saving and loading need no further files: rows of numbers, or shape and entries that aren't 0."""

    lossFunc = _ScopeParams.lossFunc
    content = Param(_P, "content", "weights", typeConverter=TypeConverters.toString)

    def __init__(self) -> None:
        super().__init__()
        self._setDefault(**self._defaults)
        self.loss_history: list[float] = []

    @property
    def weights(self) -> np.ndarray:
        got = json.loads(self.getOrDefault("content"))
        if isinstance(got, list):
            return np.array(got)
        out = np.zeros(got["shape"])
        out.ravel()[got["at"]] = got["values"]
        return out

    @property
    def coefficients(self) -> np.ndarray:
        return self.weights[:, :-1]

    @property
    def intercepts(self) -> np.ndarray:
        return self.weights[:, -1]

    def margins(self, df: DataFrame) -> Column:
        """array<double> of the margins: in the plan for few features, else by an Arrow function over sparse rows with the weights broadcast."""
        w, t, x = self.weights, df.schema[self.getFeaturesCol()].dataType, F.col(self.getFeaturesCol())
        if w.shape[1] - 1 <= PLAN_FEATURES:
            a = vector_to_array(x) if isinstance(t, VectorUDT) else x.cast("array<double>")
            return F.array(*[L.dot(a, r[:-1].tolist()) + F.lit(float(r[-1])) for r in w])
        shared = df.sparkSession.sparkContext.broadcast(w)

        @F.arrow_udf("array<double>")
        def score(v: pa.Array) -> pa.Array:
            own = shared.value
            valid = v.is_valid()
            m = rows_of(v.filter(valid), own.shape[1] - 1).dot(own[:, :-1]) + own[:, -1]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1]), pa.int32()), pa.array(m.ravel()))
            place = np.cumsum(valid.to_numpy(zero_copy_only=False)) - 1
            return lists.take(pa.array(place, mask=~valid.to_numpy(zero_copy_only=False)))

        return score(x if isinstance(t, VectorUDT) else x.cast("array<double>"))


def weights_text(w: np.ndarray) -> str:
    at = np.flatnonzero(w)
    return json.dumps(w.tolist() if w.size < 10_000 else {"shape": list(w.shape), "at": at.tolist(), "values": w.ravel()[at].tolist()})


class LinearScope(_Scope):
    """Binary linear model; lossFunc LR, SVM, SSVM (with posWeight) or UPULR (posWeight is the share of positives among all)."""

    _losses = ("LR", "SVM", "SSVM", "UPULR")

    @keyword_only
    def __init__(self, *, stepSize=None, maxIter=None, regParam=None, elasticNetParam=None, factor=None, numPartitions=None, tol=None, restartFrequency=None, lossFunc=None, posWeight=None, fitIntercept=None, seed=None, featuresCol=None, labelCol=None) -> None:  # noqa: ANN001
        super().__init__()
        self._init(self._input_kwargs)

    def _kernel(self, rows: DataFrame) -> Kernel:
        kind, weight = self.getOrDefault("lossFunc"), self.getOrDefault("posWeight")
        if kind == "UPULR":
            ratio = rows.agg(F.avg((F.col("y") > 0.5).cast("double"))).head()[0]
            loss = L.upu_logit(weight, ratio)
        else:
            loss = {"LR": L.logit, "SVM": L.hinge, "SSVM": L.smooth_hinge}[kind](weight)
        return Kernel(loss, 1, self.getOrDefault("fitIntercept"))

    def _model(self) -> LinearScopeModel:
        return LinearScopeModel()


class LinearScopeModel(_ScopeModel):
    """Adds rawPrediction (the margin), probability (its sigmoid, for every loss) and prediction."""

    def _transform(self, df: DataFrame) -> DataFrame:
        out = df.withColumn("rawPrediction", F.get(self.margins(df), 0))
        return out.withColumn("probability", L.sigmoid(F.col("rawPrediction"))).withColumn("prediction", (F.col("probability") > 0.5).cast("double"))


class MultiLinearScope(_Scope):
    """Softmax with K - 1 weight vectors; class 0 is the pivot."""

    _loss_default, _losses = "SR", ("SR",)

    @keyword_only
    def __init__(self, *, numClasses=None, stepSize=None, maxIter=None, regParam=None, elasticNetParam=None, factor=None, numPartitions=None, tol=None, restartFrequency=None, lossFunc=None, fitIntercept=None, seed=None, featuresCol=None, labelCol=None) -> None:  # noqa: ANN001
        super().__init__()
        self._init(self._input_kwargs)

    def _kernel(self, rows: DataFrame) -> Kernel:
        return Kernel(L.multi_logit(), self.getOrDefault("numClasses") - 1, self.getOrDefault("fitIntercept"))

    def _model(self) -> MultiLinearScopeModel:
        return MultiLinearScopeModel()


def softmax_with_pivot(m: Column) -> Column:
    """Probabilities of classes 0 .. K-1 from the margins of classes 1 .. K-1, which are evaluated once."""
    share = lambda e: once(F.aggregate(e, F.lit(0.0), lambda a, x: a + x), lambda total: F.transform(e, lambda x: x / total))
    powers = lambda all_: once(F.array_max(all_), lambda top: F.transform(all_, lambda x: F.exp(x - top)))
    return once(F.concat(F.array(F.lit(0.0)), m), lambda all_: once(powers(all_), share))


def argmax(a: Column) -> Column:
    """The place of the largest value."""
    return once(a, lambda x: (F.array_position(x, F.array_max(x)) - 1).cast("double"))


class MultiLinearScopeModel(_ScopeModel):
    """Adds probability and rawPrediction (both the class probabilities) and prediction."""

    def _transform(self, df: DataFrame) -> DataFrame:
        out = df.withColumn("probability", softmax_with_pivot(self.margins(df)))
        return out.withColumn("rawPrediction", F.col("probability")).withColumn("prediction", argmax(F.col("probability")))


class OVRLinearScope(_Scope):
    """K hinge classifiers, one per class against the rest; lossFunc SVM or SSVM."""

    _loss_default, _losses = "SVM", ("SVM", "SSVM")

    @keyword_only
    def __init__(self, *, numClasses=None, stepSize=None, maxIter=None, regParam=None, elasticNetParam=None, factor=None, numPartitions=None, tol=None, restartFrequency=None, lossFunc=None, fitIntercept=None, seed=None, featuresCol=None, labelCol=None) -> None:  # noqa: ANN001
        super().__init__()
        self._init(self._input_kwargs)

    def _kernel(self, rows: DataFrame) -> Kernel:
        loss = L.multi_hinge() if self.getOrDefault("lossFunc") == "SVM" else L.multi_smooth_hinge()
        return Kernel(loss, self.getOrDefault("numClasses"), self.getOrDefault("fitIntercept"))

    def _model(self) -> OVRLinearScopeModel:
        return OVRLinearScopeModel()


class OVRLinearScopeModel(_ScopeModel):
    """Adds rawPrediction and probability (both the margins) and prediction, the class of the largest margin."""

    def _transform(self, df: DataFrame) -> DataFrame:
        out = df.withColumn("rawPrediction", self.margins(df))
        return out.withColumn("probability", F.col("rawPrediction")).withColumn("prediction", argmax(F.col("rawPrediction")))
