"""Filling containers of fixed capacity: best-fit decreasing with a segment tree over remaining capacities.

The sizes are counted in one narrow pass; only (key, piece, size) is shuffled, into shards of about SHARD_ITEMS items, and
every shard is packed on its own. A shard leaves at most a few containers half full, so with thousands of containers a
shard the loss against one global packing is far below a percent, and no task grows with the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.llm.tokens import VOCABULARY, count_tokens

CAPACITY, SHARD_ITEMS = 4096, 20_000


class OpenBins:
    """Open bins by remaining capacity: the tightest one that still takes `size` in O(log capacity)."""

    def __init__(self, capacity: int) -> None:
        self.top = 1
        while self.top <= capacity:
            self.top *= 2
        self.tree = [0] * (2 * self.top)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _change(self, room: int, by: int) -> None:
        i = room + self.top
        while i:
            self.tree[i] += by
            i >>= 1

    def put(self, room: int, which: int) -> None:
        self.bins[room].append(which)
        self._change(room, 1)

    def take(self, size: int) -> tuple[int, int] | None:
        """(room, bin) of the tightest open bin with room >= size, removed; None if there is none."""
        tree, i = self.tree, size + self.top
        if not tree[i]:
            while i > 1 and (i & 1 or not tree[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.top:
                i = 2 * i if tree[2 * i] else 2 * i + 1
        room = i - self.top
        self._change(room, -1)
        return room, self.bins[room].pop()


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item; sizes are integers from 0 to capacity."""
    out = np.empty(len(sizes), np.int64)
    open_, n = OpenBins(capacity), 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        got = open_.take(size)
        if got is None:
            got, n = (capacity, n), n + 1
        out[i] = got[1]
        open_.put(got[0] - size, got[1])
    return out


def sized_pieces(df: DataFrame, key: str, text: str, capacity: int, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc, n_tokens, n_pieces, piece, size): every text whole, or cut in pieces of `capacity` and a rest if it exceeds it."""
    key_type = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = count_tokens(b.column("t").to_pylist(), vocabulary)
            yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(n.astype(np.int32))], names=["doc", "n_tokens"])

    counted = df.select(F.col(key).alias("doc"), F.col(text).cast("string").alias("t")).mapInArrow(run, f"doc {key_type}, n_tokens int")
    pieces = F.greatest(F.ceil(F.col("n_tokens") / capacity), F.lit(1)).cast("int")
    return counted.withColumn("n_pieces", pieces).select("doc", "n_tokens", "n_pieces", F.explode(F.sequence(F.lit(1), F.col("n_pieces"))).alias("piece")).withColumn("size", F.least(F.lit(capacity), F.col("n_tokens") - (F.col("piece") - 1) * capacity).cast("int"))


def pack(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(<key>, n_tokens, n_pieces, piece, size, container, container_fill): a container for every text or piece.

    Empty and NULL texts have size 0 and go into an open container as well. Rows with equal or NULL keys are packed one by one;
    they are spread over the shards by their place in the input, so that no key makes a shard too large.
    """
    shards = max(1, round(df.count() / shard_items))
    key_type = df.schema[key].dataType.simpleString()
    items = sized_pieces(df, key, text, capacity, vocabulary).withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id(), "doc"), F.lit(shards)).cast("int"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        sizes = pdf["size"].to_numpy(np.int64)
        place = best_fit_decreasing(sizes, capacity)
        fill = np.bincount(place, weights=sizes)[place].astype(np.int32)
        return pdf.drop(columns=["shard"]).assign(container=pdf["shard"].to_numpy(np.int64) * (1 << 32) + place, container_fill=fill)

    packed = items.groupBy("shard").applyInPandas(one, f"doc {key_type}, n_tokens int, n_pieces int, piece int, size int, container bigint, container_fill int")
    return packed.withColumnRenamed("doc", key)
