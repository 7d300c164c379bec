"""Vector columns as Arrow arrays: sparse rows in and out of vectorised functions without making them dense."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column
from pyspark.sql import functions as F

from grainmill.schema import EngineError

#: How Arrow carries a vector column: type 0 is sparse, 1 dense.
VECTOR = pa.struct([
    pa.field("type", pa.int8(), False),
    pa.field("size", pa.int32()),
    pa.field("indices", pa.list_(pa.field("element", pa.int32(), False))),
    pa.field("values", pa.list_(pa.field("element", pa.float64(), False))),
])


#: Cells of a block of rows that are multiplied as a small matrix; columns up to which rows may be held as one.
SMALL_BLOCK, DENSE_WIDTH = 65_536, 1024


@dataclass(frozen=True)
class Rows:
    """Rows of a sparse matrix: row i has the entries ends[i] to ends[i + 1] of idx and val."""

    ends: np.ndarray
    idx: np.ndarray
    val: np.ndarray

    def __len__(self) -> int:
        return len(self.ends) - 1

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.ends))

    def take(self, at: np.ndarray) -> Rows:
        lens = np.diff(self.ends)[at]
        ends = np.append(0, np.cumsum(lens))
        place = np.arange(ends[-1]) - np.repeat(ends[:-1], lens) + np.repeat(self.ends[:-1][at], lens)
        return Rows(ends, self.idx[place], self.val[place])

    def dot(self, w: np.ndarray) -> np.ndarray:
        """(rows, classes): the product with weights of shape (classes, columns)."""
        if not len(self):
            return np.zeros((0, len(w)))
        owner = self.owner
        return np.stack([np.bincount(owner, weights=self.val * k[self.idx], minlength=len(self)) for k in w], axis=1)

    def add_to(self, w: np.ndarray, factors: np.ndarray) -> None:
        """Adds factors[i, k] times row i to w[k], touching the columns of the rows only."""
        cols, at = np.unique(self.idx, return_inverse=True)
        if len(cols) * len(self) <= SMALL_BLOCK:  # a few rows: a product over the columns they have
            own = np.zeros((len(self), len(cols)))
            np.add.at(own, (self.owner, at), self.val)
            w[:, cols] += factors.T @ own
        else:
            f = factors[self.owner]
            for k in range(len(w)):
                w[k][cols] += np.bincount(at, weights=f[:, k] * self.val, minlength=len(cols))


@dataclass(frozen=True)
class DenseRows:
    """Rows that are mostly filled, as a matrix; the interface is that of `Rows`."""

    matrix: np.ndarray

    def __len__(self) -> int:
        return len(self.matrix)

    @property
    def val(self) -> np.ndarray:
        return self.matrix

    def take(self, at: np.ndarray) -> DenseRows:
        return DenseRows(self.matrix[at])

    def dot(self, w: np.ndarray) -> np.ndarray:
        return self.matrix @ w.T

    def add_to(self, w: np.ndarray, factors: np.ndarray) -> None:
        w += factors.T @ self.matrix


def packed(rows: Rows, width: int) -> Rows | DenseRows:
    """The form in which rows are cheaper to multiply: a matrix for few columns that are a quarter filled at least."""
    if width > DENSE_WIDTH or len(rows.idx) * 4 < len(rows) * width:
        return rows
    out = np.zeros((len(rows), width))
    np.add.at(out, (rows.owner, rows.idx), rows.val)
    return DenseRows(out)


def rows_of(x: pa.Array, width: int) -> Rows:
    """The rows of a vector or list column without NULL; indices beyond `width` are an error."""
    if pa.types.is_struct(x.type):
        values, indices, dense = x.field("values"), x.field("indices"), x.field("type").to_numpy(zero_copy_only=False) == 1
    else:
        values, indices, dense = x, None, np.ones(len(x), bool)
    lens = pc.fill_null(pc.list_value_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.append(0, np.cumsum(lens))
    val = values.flatten().to_numpy(zero_copy_only=False).astype(float)
    idx = np.arange(ends[-1]) - np.repeat(ends[:-1], lens)
    if not dense.all():
        idx[np.repeat(~dense, lens)] = indices.filter(pa.array(~dense)).flatten().to_numpy(zero_copy_only=False)
    if len(idx) and idx.max() >= width:
        raise EngineError(f"a vector has an entry at {int(idx.max())}, the first row has {width} features")
    keep = val != 0
    if not keep.all():
        ends = np.append(0, np.cumsum(np.bincount(np.repeat(np.arange(len(lens)), lens)[keep], minlength=len(lens))))
        idx, val = idx[keep], val[keep]
    return Rows(ends, idx, val)


def _sparse(valid: np.ndarray, lens: np.ndarray, idx: pa.Array, val: np.ndarray, size: int) -> pa.Array:
    offs = pa.array(np.append(0, np.cumsum(lens)), pa.int32())
    n = len(lens)
    parts = [pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, size, np.int32)), pa.ListArray.from_arrays(offs, idx.cast(pa.int32()), type=VECTOR.field("indices").type), pa.ListArray.from_arrays(offs, pa.array(val), type=VECTOR.field("values").type)]
    return pa.StructArray.from_arrays(parts, fields=list(VECTOR), mask=pa.array(~valid))


def one_hot(index: Column, size: int) -> Column:
    """A sparse vector with a one at the index; NULL stays NULL."""

    @F.arrow_udf(VectorUDT())
    def hot(at: pa.Array) -> pa.Array:
        valid = pc.is_valid(at).to_numpy(zero_copy_only=False)
        return _sparse(valid, valid.astype(np.int64), at.drop_null(), np.ones(int(valid.sum())), size)

    return hot(index.cast("int"))


def multi_hot(indices: Column, size: int) -> Column:
    """A sparse vector with a one at each of the sorted distinct indices; NULL stays NULL."""

    @F.arrow_udf(VectorUDT())
    def hot(at: pa.Array) -> pa.Array:
        lens = pc.fill_null(pc.list_value_length(at), 0).to_numpy(zero_copy_only=False)
        flat = at.flatten()
        return _sparse(pc.is_valid(at).to_numpy(zero_copy_only=False), lens, flat, np.ones(len(flat)), size)

    return hot(indices.cast("array<int>"))


def sparse_vector(indices: Column, values: Column, size: int) -> Column:
    """A sparse vector of `size` from indices and values, in any order; of an index given more than once the last value holds.

    Entries whose index or value is NULL or whose index is outside 0 .. size - 1 are left out. NULL indices give NULL.
    """

    @F.arrow_udf(VectorUDT())
    def build(i: pa.Array, v: pa.Array) -> pa.Array:
        valid = (pc.is_valid(i).to_numpy(zero_copy_only=False)) & (pc.is_valid(v).to_numpy(zero_copy_only=False))
        i, v = i.filter(pa.array(valid)), v.filter(pa.array(valid))
        lens = pc.list_value_length(i).to_numpy()
        owner = np.repeat(np.flatnonzero(valid), lens)
        idx = pc.fill_null(i.flatten(), -1).to_numpy(zero_copy_only=False)
        val = v.flatten().to_numpy(zero_copy_only=False).astype(float)
        ok = (idx >= 0) & (idx < size) & pc.is_valid(v.flatten()).to_numpy(zero_copy_only=False)
        owner, idx, val = owner[ok], idx[ok], val[ok]
        order = np.lexsort((np.arange(len(idx)), idx, owner))
        owner, idx, val = owner[order], idx[order], val[order]
        last = np.ones(len(idx), bool)
        last[:-1] = (owner[1:] != owner[:-1]) | (idx[1:] != idx[:-1])
        return _sparse(valid, np.bincount(owner[last], minlength=len(valid)), pa.array(idx[last]), val[last], size)

    return build(indices.cast("array<bigint>"), values.cast("array<double>"))
