"""Loss functions as column expressions and as numpy kernels: the loss and the factor g with gradient = g * x.

m is the margin w.x + b (without intercept b = 0), y the label in {0, 1}, s = 2y - 1, c = y (pos_weight - 1) + 1. Multi-class
losses take an array of margins: K - 1 for multi_logit (class 0 is the pivot), K for the hinge losses.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def log1p_exp(x: Column) -> Column:
    """log(1 + exp(x)) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(x, F.lit(-700.0))))


def np_log1p_exp(x: np.ndarray) -> np.ndarray:
    return np.maximum(x, 0) + np.log1p(np.exp(-np.abs(x)))


def np_sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -700, 700)))


@dataclass(frozen=True)
class Loss:
    """A binary loss: `column(m, y)` gives (loss, factor) as columns, `kernel(m, y)` the same for arrays."""

    name: str
    column: Callable[[Column, Column], tuple[Column, Column]]
    kernel: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def logit(pos_weight: float = 1.0) -> Loss:
    """Logistic loss; positives weigh pos_weight."""

    def column(m: Column, y: Column) -> tuple[Column, Column]:
        c = F.when(y > 0.5, float(pos_weight)).otherwise(1.0)
        return c * F.when(y > 0.5, log1p_exp(-m)).otherwise(log1p_exp(m)), (sigmoid(m) - y) * c

    def kernel(m: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c = np.where(y > 0.5, pos_weight, 1.0)
        return c * np_log1p_exp(np.where(y > 0.5, -m, m)), (np_sigmoid(m) - y) * c

    return Loss("logit", column, kernel)


def upu_logit(prior: float, pos_ratio: float) -> Loss:
    """Unbiased positive-unlabelled logistic loss: `prior` is the share of positives among all, pos_ratio that of labelled rows."""
    pw, uw = prior / pos_ratio, 1.0 / (1.0 - pos_ratio)

    def column(m: Column, y: Column) -> tuple[Column, Column]:
        return F.when(y > 0.5, -pw * m).otherwise(uw * log1p_exp(m)), F.when(y > 0.5, F.lit(-pw)).otherwise(uw * sigmoid(m))

    def kernel(m: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.where(y > 0.5, -pw * m, uw * np_log1p_exp(m)), np.where(y > 0.5, -pw, uw * np_sigmoid(m))

    return Loss("upu_logit", column, kernel)


def hinge(pos_weight: float = 1.0) -> Loss:
    """max(0, 1 - s m), weighted."""

    def column(m: Column, y: Column) -> tuple[Column, Column]:
        s = F.when(y > 0.5, 1.0).otherwise(-1.0)
        c = F.when(y > 0.5, float(pos_weight)).otherwise(1.0)
        return c * F.greatest(F.lit(0.0), 1 - s * m), c * F.when(s * m < 1, -s).otherwise(0.0)

    def kernel(m: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s, c = np.where(y > 0.5, 1.0, -1.0), np.where(y > 0.5, pos_weight, 1.0)
        return c * np.maximum(0, 1 - s * m), c * np.where(s * m < 1, -s, 0.0)

    return Loss("hinge", column, kernel)


def smooth_hinge(pos_weight: float = 1.0) -> Loss:
    """Quadratic between margins 0 and 1, linear below 0."""

    def column(m: Column, y: Column) -> tuple[Column, Column]:
        s = F.when(y > 0.5, 1.0).otherwise(-1.0)
        c = F.when(y > 0.5, float(pos_weight)).otherwise(1.0)
        h = F.greatest(F.lit(0.0), 1 - s * m)
        return c * F.when(s * m < 0, h - 0.5).otherwise(h * h / 2), c * F.when(s * m < 0, -s).otherwise(-s * h)

    def kernel(m: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s, c = np.where(y > 0.5, 1.0, -1.0), np.where(y > 0.5, pos_weight, 1.0)
        h = np.maximum(0, 1 - s * m)
        return c * np.where(s * m < 0, h - 0.5, h * h / 2), c * np.where(s * m < 0, -s, -s * h)

    return Loss("smooth_hinge", column, kernel)


def squared() -> Loss:
    return Loss("squared", lambda m, y: ((m - y) * (m - y) / 2, m - y), lambda m, y: ((m - y) ** 2 / 2, m - y))


def poisson() -> Loss:
    return Loss("poisson", lambda m, y: (F.exp(m) - y * m, F.exp(m) - y), lambda m, y: (np.exp(m) - y * m, np.exp(m) - y))


@dataclass(frozen=True)
class MultiLoss:
    """A multi-class loss: `column(margins, y)` gives (loss, array of factors), `kernel` the same for arrays of shape (n, width)."""

    name: str
    column: Callable[[Column, Column], tuple[Column, Column]]
    kernel: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
    pivot: bool


def multi_logit() -> MultiLoss:
    """Softmax with class 0 as pivot: log(1 + sum exp(m_k)) - m_y, shifted by the largest margin."""

    def column(m: Column, y: Column) -> tuple[Column, Column]:
        top = F.greatest(F.array_max(m), F.lit(0.0))
        total = F.aggregate(m, F.exp(-top), lambda a, x: a + F.exp(x - top))
        own = F.coalesce(F.when(y > 0.5, F.get(m, F.round(y).cast("int") - 1)), F.lit(0.0))
        grad = F.transform(m, lambda x, i: F.exp(x - top) / total - F.when(F.round(y).cast("int") == i + 1, 1.0).otherwise(0.0))
        return F.log(total) + top - own, grad

    def kernel(m: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        y = y.astype(int)
        top = np.maximum(m.max(axis=1), 0)
        e = np.exp(m - top[:, None])
        total = np.exp(-top) + e.sum(axis=1)
        own = np.where(y > 0, m[np.arange(len(y)), np.maximum(y - 1, 0)], 0.0)
        g = e / total[:, None]
        g[np.arange(len(y))[y > 0], y[y > 0] - 1] -= 1
        return np.log(total) + top - own, g

    return MultiLoss("multi_logit", column, kernel, True)


def _one_against_rest(name: str, one: Loss) -> MultiLoss:
    def column(m: Column, y: Column) -> tuple[Column, Column]:
        def target(i: Column) -> Column:
            return F.when(F.round(y).cast("int") == i, 1.0).otherwise(0.0)

        losses = F.transform(m, lambda x, i: one.column(x, target(i))[0])
        return F.aggregate(losses, F.lit(0.0), lambda a, x: a + x), F.transform(m, lambda x, i: one.column(x, target(i))[1])

    def kernel(m: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        t = (y.astype(int)[:, None] == np.arange(m.shape[1])).astype(float)
        loss, g = one.kernel(m, t)
        return loss.sum(axis=1), g

    return MultiLoss(name, column, kernel, False)


def multi_hinge() -> MultiLoss:
    return _one_against_rest("multi_hinge", hinge())


def multi_smooth_hinge() -> MultiLoss:
    return _one_against_rest("multi_smooth_hinge", smooth_hinge())


def dot(values: Column, weights: list[float]) -> Column:
    """Inner product of an array column with fixed weights."""
    return F.aggregate(F.zip_with(values, F.array(*[F.lit(float(w)) for w in weights]), lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
