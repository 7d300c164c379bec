"""A feed-forward network trained by data-parallel mini-batches with model averaging: activations, dropout, penalties, ADADELTA.

Per epoch every partition starts from the shared weights, makes its own mini-batch steps over its Arrow batches, and the
weights are averaged over the partitions, weighted by rows. Only weights travel. `Mlp` in `wrappers` puts it behind the preparation of dense tables.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.functions.vectors import rows_of
from grainmill.models.scope import _add_up, _sums, n_features, sample_rows
from grainmill.schema import EngineError

# Hidden activations; the ones WithDropout drop units while training.
ACTIVATIONS = ("Linear", "Rectifier", "RectifierWithDropout", "Tanh", "TanhWithDropout", "Maxout", "MaxoutWithDropout", "Sigmoid")


def activate(kind: str, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Output and derivative. Maxout takes the larger of each unit and its negation halved, a two-piece maximum."""
    base = kind.removesuffix("WithDropout")
    if base == "Linear":
        return z, np.ones_like(z)
    if base == "Rectifier":
        return np.maximum(z, 0), (z > 0).astype(float)
    if base == "Tanh":
        t = np.tanh(z)
        return t, 1 - t * t
    if base == "Maxout":
        return np.maximum(z, -0.5 * z), np.where(z > 0, 1.0, -0.5)
    s = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
    return s, s * (1 - s)


#: Mini-batches a partition should have at least; fewer, larger partitions are made of too small ones.
BATCHES_PER_PARTITION = 20


def shapes(sizes: list[int]) -> list[tuple[int, int]]:
    return [(a + 1, b) for a, b in zip(sizes, sizes[1:], strict=False)]


def initial(sizes: list[int], seed: int) -> np.ndarray:
    """Weights of all layers in one vector; the last row of a layer is its bias."""
    rng = np.random.default_rng(seed)
    parts = []
    for a, b in shapes(sizes):
        w = rng.normal(0, np.sqrt(2 / a), (a, b))
        w[-1] = 0
        parts.append(w.ravel())
    return np.concatenate(parts)


def layers(flat: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    out, at = [], 0
    for a, b in shapes(sizes):
        out.append(flat[at : at + a * b].reshape(a, b))
        at += a * b
    return out


def _dense_rows(x: pa.Array, width: int) -> np.ndarray:
    """A batch of rows as a dense matrix: a layer is a matrix product anyway."""
    rows = rows_of(x, width)
    out = np.zeros((len(rows), width))
    out[rows.owner, rows.idx] = rows.val
    return out


@dataclass
class Network:
    """Classifier over a vector or array column; labels are 0 .. n_classes - 1, or numbers with n_classes = 0 (squared loss)."""

    hidden: list[int] = field(default_factory=lambda: [200, 200])
    n_classes: int = 2
    activation: str = "Rectifier"
    epochs: int = 10
    batch: int = 32
    learn_rate: float = 0.1
    momentum: float = 0.5
    momentum_stable: float = 0.99
    l1: float = 0.0
    l2: float = 0.0
    dropout: float = 0.5
    input_dropout: float = 0.0
    adadelta: bool = True
    rho: float = 0.99
    eps: float = 1e-8
    elastic_rate: float = 0.0
    seed: int = 42
    features: str = "features"
    label: str = "label"

    def _forward(self, x: np.ndarray, ws: list[np.ndarray], rng: np.random.Generator | None) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        drop = self.dropout if rng is not None and self.activation.endswith("WithDropout") else 0.0
        if rng is not None and self.input_dropout:
            x = x * (rng.random(x.shape) >= self.input_dropout) / (1 - self.input_dropout)
        outs, slopes = [x], []
        for w in ws[:-1]:
            h, s = activate(self.activation, outs[-1] @ w[:-1] + w[-1])
            if drop:
                keep = (rng.random(h.shape) >= drop) / (1 - drop)
                h, s = h * keep, s * keep
            outs.append(h)
            slopes.append(s)
        z = outs[-1] @ ws[-1][:-1] + ws[-1][-1]
        if self.n_classes:
            z = np.exp(z - z.max(axis=1, keepdims=True))
            z /= z.sum(axis=1, keepdims=True)
        return outs, slopes, z

    def _gradient(self, x: np.ndarray, y: np.ndarray, flat: np.ndarray, sizes: list[int], rng: np.random.Generator | None) -> tuple[np.ndarray, float]:
        """Mean gradient and summed loss."""
        ws = layers(flat, sizes)
        outs, slopes, p = self._forward(x, ws, rng)
        if self.n_classes:
            at = y.astype(int)
            loss = -np.log(np.maximum(p[np.arange(len(y)), at], 1e-15)).sum()
            delta = p.copy()
            delta[np.arange(len(y)), at] -= 1
        else:
            delta = p - y[:, None]
            loss = 0.5 * (delta**2).sum()
        delta /= len(y)
        grads = []
        for i in range(len(ws) - 1, -1, -1):
            grads.append(np.vstack([outs[i].T @ delta, delta.sum(axis=0)]).ravel())
            if i:
                delta = (delta @ ws[i][:-1].T) * slopes[i - 1]
        g = np.concatenate(grads[::-1])
        return g + self.l2 * flat + self.l1 * np.sign(flat), float(loss)

    def fit(self, df: DataFrame) -> NetworkModel:
        if self.activation not in ACTIVATIONS:
            raise EngineError(f"activation is one of {ACTIVATIONS}")
        rows = sample_rows(df, self.features, self.label).persist()
        try:
            # weights are averaged over partitions, so each should make a fair number of steps before
            most = max(1, rows.count() // (self.batch * BATCHES_PER_PARTITION))
            train = rows.coalesce(most) if rows.rdd.getNumPartitions() > most else rows
            sizes = [n_features(rows), *self.hidden, self.n_classes or 1]
            flat, history = initial(sizes, self.seed), []
            means = np.zeros((2, len(flat)))  # ADADELTA's running means of squared gradients and steps, averaged like the weights
            for epoch in range(self.epochs):
                flat, means, loss = self._epoch(train, flat, means, sizes, epoch)
                history.append(loss)
        finally:
            rows.unpersist()
        return NetworkModel(self, sizes, flat, history)

    def _epoch(self, rows: DataFrame, start: np.ndarray, means: np.ndarray, sizes: list[int], epoch: int) -> tuple[np.ndarray, np.ndarray, float]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            rng = np.random.default_rng([self.seed, epoch, TaskContext.get().partitionId()])
            w, n, loss, t = start.copy(), 0, 0.0, 0
            (g2, d2), v = means, np.zeros_like(w)
            for b in batches:
                x, y = _dense_rows(b.column("x"), sizes[0]), b.column("y").to_numpy(zero_copy_only=False)
                order = rng.permutation(len(y))
                for lo in range(0, len(y), self.batch):
                    at = order[lo : lo + self.batch]
                    g, part = self._gradient(x[at], y[at], w, sizes, rng)
                    loss, n, t = loss + part, n + len(at), t + 1
                    if self.adadelta:
                        g2 = self.rho * g2 + (1 - self.rho) * g * g
                        step = -np.sqrt(d2 + self.eps) / np.sqrt(g2 + self.eps) * g
                        d2 = self.rho * d2 + (1 - self.rho) * step * step
                    else:
                        m = min(self.momentum_stable, self.momentum + (self.momentum_stable - self.momentum) * t / 1000)
                        v = m * v - self.learn_rate * g
                        step = v
                    w = w + step
                    if self.elastic_rate:
                        w -= self.elastic_rate * (w - start)
            if n:
                yield _sums(np.concatenate([w * n, g2 * n, d2 * n, [loss, n]]))

        total = _add_up(rows.mapInArrow(run, "i int, v double"), 3 * len(start) + 2)
        flat, *state = (total[:-2] / total[-1]).reshape(3, -1)
        return flat, np.stack(state), float(total[-2] / total[-1])


@dataclass
class NetworkModel:
    spec: Network
    sizes: list[int]
    flat: np.ndarray
    loss_history: list[float]

    def transform(self, df: DataFrame) -> DataFrame:
        """`df` with scores (class probabilities, or one number) and prediction."""
        spec, sizes, flat = self.spec, self.sizes, self.flat

        @F.arrow_udf("array<double>")
        def score(v: pa.Array) -> pa.Array:
            valid = v.is_valid().to_numpy(zero_copy_only=False)
            p = spec._forward(_dense_rows(v.filter(pa.array(valid)), sizes[0]), layers(flat, sizes), None)[2]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, p.shape[1]), pa.int32()), pa.array(p.ravel()))
            return lists.take(pa.array(np.cumsum(valid) - 1, mask=~valid))

        t = df.schema[spec.features].dataType
        x = F.col(spec.features) if isinstance(t, VectorUDT) else F.col(spec.features).cast("array<double>")
        best: Column = (F.array_position("scores", F.array_max("scores")) - 1).cast("double") if spec.n_classes else F.get("scores", 0)
        return df.withColumn("scores", score(x)).withColumn("prediction", best)

    def save(self) -> str:
        return json.dumps({"spec": vars(self.spec), "sizes": self.sizes, "flat": self.flat.tolist(), "loss": self.loss_history})

    @classmethod
    def load(cls, text: str) -> NetworkModel:
        d = json.loads(text)
        return cls(Network(**d["spec"]), d["sizes"], np.array(d["flat"]), d["loss"])


class NetworkStage(Model, HasFeaturesCol, DefaultParamsWritable, DefaultParamsReadable):
    """A trained network as a stage of a pipeline: adds prediction and, for classes, probability and rawPrediction."""

    content = Param(Params._dummy(), "content", "the network", typeConverter=TypeConverters.toString)

    def _transform(self, df: DataFrame) -> DataFrame:
        m = NetworkModel.load(self.getOrDefault("content"))
        out = m.transform(df)
        if m.spec.n_classes:
            out = out.withColumn("probability", array_to_vector("scores")).withColumn("rawPrediction", array_to_vector("scores"))
        return out.drop("scores")


@dataclass
class NetworkTrainer:
    """What a pipeline's `fit` calls: trains the network and gives its stage."""

    spec: Network

    def fit(self, df: DataFrame) -> NetworkStage:
        return NetworkStage()._set(content=self.spec.fit(df).save())
