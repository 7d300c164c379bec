"""Updaters: new weights from weights and gradients, as column expressions. Any object with `update(w, g)` will do."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F


class Updater(Protocol):
    """`w` is the stored array, `g` the array of gradients; the result replaces the stored array."""

    def update(self, w: Column, g: Column) -> Column: ...


def _at(c: Column, i: int) -> Column:
    return F.get(c, i).cast("double")


@dataclass(frozen=True)
class Sgd:
    """w -= lr * g."""

    lr: float = 0.01

    def update(self, w: Column, g: Column) -> Column:
        return F.array(_at(w, 0) - self.lr * _at(g, 0))


@dataclass(frozen=True)
class Momentum:
    """State [w, step]: step = -lr * g + coff * last step."""

    lr: float = 0.01
    coff: float = 0.1

    def update(self, w: Column, g: Column) -> Column:
        step = -self.lr * _at(g, 0) + self.coff * _at(w, 1)
        return F.array(_at(w, 0) + step, step)


@dataclass(frozen=True)
class DelayCompensated:
    """State [w, weight before the last step]: the step is corrected by g^2 times the distance from that weight."""

    lr: float = 0.01
    coff: float = 0.1

    def update(self, w: Column, g: Column) -> Column:
        step = -self.lr * _at(g, 0) - self.coff * _at(g, 0) * _at(g, 0) * (_at(w, 0) - _at(w, 1))
        return F.array(_at(w, 0) + step, _at(w, 0))


@dataclass(frozen=True)
class Ftrl:
    """FTRL-proximal with state [z, n, w]. `force_sparse` resets z and n of a weight that is 0."""

    alpha: float = 1.0
    beta: float = 1.0
    lambda1: float = 1.0
    lambda2: float = 1.0
    force_sparse: bool = False

    def update(self, w: Column, g: Column) -> Column:
        z0, n0, w0, g0 = _at(w, 0), _at(w, 1), _at(w, 2), _at(g, 0)
        n = n0 + g0 * g0
        z = z0 + g0 - (F.sqrt(n) - F.sqrt(n0)) / self.alpha * w0
        new = F.when(F.abs(z) <= self.lambda1, 0.0).otherwise(-(z - F.signum(z) * self.lambda1) / (self.lambda2 + (self.beta + F.sqrt(n)) / self.alpha))
        if self.force_sparse:
            off = new == 0
            return F.array(F.when(off, 0.0).otherwise(z), F.when(off, 0.0).otherwise(n), new)
        return F.array(z, n, new)


@dataclass(frozen=True)
class Elementwise:
    """w_i -= lr * g_i for every element, as field-aware factors need."""

    lr: float = 0.01

    def update(self, w: Column, g: Column) -> Column:
        return F.zip_with(w, g, lambda a, b: a.cast("double") - self.lr * b.cast("double"))


@dataclass(frozen=True)
class AdaGrad:
    """State: weights, then as many sums of squared gradients."""

    lr: float = 0.1
    eps: float = 1e-8

    def update(self, w: Column, g: Column) -> Column:
        half = (F.size(w) / 2).cast("int")
        acc = F.zip_with(F.slice(w, half + 1, half), g, lambda s, x: s.cast("double") + x * x)
        step = F.zip_with(g, acc, lambda x, s: self.lr * x / (F.sqrt(s) + self.eps))
        return F.concat(F.zip_with(F.slice(w, F.lit(1), half), step, lambda a, b: a.cast("double") - b), acc)
