"""Vector algebra on columns (arrays, maps) and the few dense kernels models need."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def once(c: Column, use: Callable[[Column], Column]) -> Column:
    """use(c) with `c` evaluated a single time per row, however often it is used: it is bound as the variable of a lambda."""
    return F.get(F.transform(F.array(c), use), 0)


def array_dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def array_axpy(alpha: float, x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: a * F.lit(alpha) + b)


def array_scale(alpha: float, x: Column) -> Column:
    return F.transform(x, lambda a: a * F.lit(alpha))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)


def map_dot(a: Column, b: Column) -> Column:
    """Inner product of two sparse vectors held as maps; absent keys are 0."""
    return F.aggregate(F.map_entries(a), F.lit(0.0), lambda s, e: s + e["value"] * F.coalesce(F.try_element_at(b, e["key"]), F.lit(0.0)))


def map_axpy(alpha: float, x: Column, y: Column) -> Column:
    """alpha * x + y of sparse vectors held as maps."""
    return F.map_zip_with(x, y, lambda _, a, b: F.coalesce(a, F.lit(0.0)) * F.lit(alpha) + F.coalesce(b, F.lit(0.0)))


def clipped_sigmoid(x: Column, bound: float = 30.0) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(x, F.lit(bound)), F.lit(-bound))))


def combined_dot(a: float, v1: np.ndarray, b: float, v2: np.ndarray, x: np.ndarray, at: np.ndarray | None = None) -> float:
    """(a v1 + b v2) . x without building the sum; `at` are the indices of a sparse x."""
    return float((a * v1[at] + b * v2[at]) @ x) if at is not None else float(a * (v1 @ x) + b * (v2 @ x))


def symmetric_rank_one(alpha: float, x: np.ndarray, m: np.ndarray) -> np.ndarray:
    return m + alpha * np.outer(x, x)


def packed_rank_one(alpha: float, x: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """The same on the packed upper triangle, column by column."""
    i, j = np.triu_indices(len(x))
    o = np.lexsort((i, j))
    return packed + alpha * x[i[o]] * x[j[o]]


def packed_times_vector(packed: np.ndarray, x: np.ndarray, alpha: float = 1.0, beta: float = 0.0, y: np.ndarray | None = None) -> np.ndarray:
    """alpha A x + beta y for A given as packed upper triangle."""
    n = len(x)
    i, j = np.triu_indices(n)
    o = np.lexsort((i, j))
    a = np.zeros((n, n))
    a[i[o], j[o]] = a[j[o], i[o]] = packed
    return alpha * (a @ x) + (beta * y if y is not None else 0)


def matrix_multiply(alpha: float, a: np.ndarray, b: np.ndarray, beta: float = 0.0, c: np.ndarray | None = None) -> np.ndarray:
    """alpha A B + beta C, for matrices and vectors."""
    return alpha * (a @ b) + (beta * c if c is not None else 0)
