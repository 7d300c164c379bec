"""Rows of a fixed number: the first in an order, or a sample that a retry draws again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.schema import EngineError


def take_first(df: DataFrame, n: int, order: list[str | Column]) -> DataFrame:
    """The first `n` rows in an order. Every task hands on `n` rows at most. Ties may fall either way; fewer rows are all taken."""
    if n < 0:
        raise EngineError("a number of rows isn't negative")
    return df.orderBy(*order).limit(n)


def take_sample(df: DataFrame, n: int, keys: list[str], seed: int = 42) -> DataFrame:
    """`n` rows drawn without replacement, each row alike: those with the smallest hash of their keys and the seed.

    The draw doesn't depend on partitions or on the order of rows. Rows of one key are drawn one after the other, NULL keys
    like any other; a frame of fewer rows is taken whole.
    """
    drawn = F.xxhash64(*[F.col(k) for k in keys], F.lit(seed))
    return take_first(df, n, [drawn, *[F.col(k) for k in keys]])
