"""Most frequent values: a hierarchy of count-sketches over hash prefixes, descended on the driver, verified by a second scan.

Every value gets a 64-bit hash. For each prefix length (8, 16, ... 64 bits) a count-sketch with signed hashes counts the
prefixes; the shortest ones are counted exactly because they fit. Heavy values have heavy prefixes, so the search goes
from 8 bits down and only ever extends prefixes whose estimate is near the threshold. The width follows from the share asked
for; after the pass the second moment of what isn't heavy says how far an estimate may be off, and a sketch that is too
narrow for this table is made again with four times the width, so no heavy value is lost and no list is cut. Memory:
LEVELS x DEPTH x width counters per column, whatever the number of distinct values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEPTH = 5
LEVEL_BITS = (8, 16, 24, 32, 40, 48, 56, 64)
#: Share of the threshold at which an estimate still counts as heavy: room for the error of a sketch. The median of DEPTH
#: estimates is taken as certain within ERRORS standard deviations of one of them.
SLACK, ERRORS = 0.7, 2.5
#: Counters a row of a sketch has for each value that may be heavy, and the widest sketch (2 ** 20 x 5 x 8 counters are 335 MB).
CELLS_PER_VALUE, MOST_BITS = 20, 20


class TooNarrow(Exception):
    """The sketch's error is too large for the threshold."""


def width_bits_of(min_share: float) -> int:
    """Bits of a row's width for values of at least `min_share`: at most 1 / min_share of them exist."""
    return min(MOST_BITS, max(8, int(np.ceil(np.log2(CELLS_PER_VALUE / min_share)))))


_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _cells(prefix: np.ndarray, level: int, width_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and sign of prefixes in each of DEPTH rows."""
    with np.errstate(over="ignore"):
        x = (prefix[None, :] ^ np.uint64(level * 0x51ED270B)) * _MULT[:DEPTH, None]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(29)
    return (x >> np.uint64(64 - width_bits)).astype(np.int64), 1 - 2 * (x & np.uint64(1)).astype(np.int64)


class PrefixSketch:
    """The counters of one column. Linear: sketches of parts of a table add up to the sketch of the table."""

    def __init__(self, width_bits: int) -> None:
        self.width_bits = width_bits
        self.table = np.zeros((len(LEVEL_BITS), DEPTH, 1 << width_bits), np.int64)
        self.n = 0

    def add(self, hashes: np.ndarray) -> None:
        values, counts = np.unique(hashes.astype(np.uint64), return_counts=True)
        self.n += int(counts.sum())
        width = 1 << self.width_bits
        for li, bits in enumerate(LEVEL_BITS):
            prefix = values >> np.uint64(64 - bits)
            if bits <= self.width_bits:
                self.table[li, 0] += np.bincount(prefix.astype(np.int64), weights=counts, minlength=width).astype(np.int64)
                continue
            at, sign = _cells(prefix, li, self.width_bits)
            for d in range(DEPTH):
                self.table[li, d] += np.bincount(at[d], weights=sign[d] * counts, minlength=width).astype(np.int64)

    def estimate(self, prefix: np.ndarray, li: int) -> np.ndarray:
        if LEVEL_BITS[li] <= self.width_bits:
            return self.table[li, 0][prefix.astype(np.int64)]
        at, sign = _cells(prefix, li, self.width_bits)
        return np.median(np.stack([sign[d] * self.table[li, d][at[d]] for d in range(DEPTH)]), axis=0)

    def error(self, li: int, heavy: np.ndarray) -> float:
        """Standard deviation of one estimate at a level: the second moment of what isn't heavy, spread over the width. Exact levels have none."""
        if LEVEL_BITS[li] <= self.width_bits:
            return 0.0
        moment = np.median((self.table[li].astype(float) ** 2).sum(axis=1)) - float((heavy**2).sum())
        return float(np.sqrt(max(moment, 0.0) / (1 << self.width_bits)))

    def descend(self, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """Hashes whose count may reach the threshold, and the estimates. Raises TooNarrow if one that does could be missed."""
        floor = SLACK * threshold
        most = int(8 * max(self.n, 1) / floor) + 256
        cand = np.arange(256, dtype=np.uint64)
        est = np.zeros(256)
        for li in range(len(LEVEL_BITS)):
            if li:
                cand = ((cand[:, None] << np.uint64(8)) | np.arange(256, dtype=np.uint64)).ravel()
            est = self.estimate(cand, li)
            heavy = est >= floor
            cand, est = cand[heavy], est[heavy]
            if len(cand) > most or ERRORS * self.error(li, est) > threshold - floor:
                raise TooNarrow
        return cand, est


def sketch_columns(df: DataFrame, values: dict[str, Column], width_bits: int) -> dict[str, PrefixSketch]:
    """One pass: a sketch per named column over its values that aren't NULL. Each task sends its non-zero counters once."""
    names = list(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [PrefixSketch(width_bits) for _ in names]
        for b in batches:
            for s, c in zip(own, b.columns, strict=True):
                s.add(c.drop_null().to_numpy(zero_copy_only=False).view(np.uint64))
        for k, s in enumerate(own):
            flat = s.table.ravel()
            at = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at) + 1, k, np.int32)), pa.array(np.append(at, -1)), pa.array(np.append(flat[at], s.n))], names=["col", "cell", "n"])

    hashed = df.select(*[F.when(v.isNotNull(), F.xxhash64(v.cast("string"))).alias(f"h{i}") for i, v in enumerate(values.values())])
    cells = hashed.mapInArrow(run, "col int, cell bigint, n bigint").groupBy("col", "cell").agg(F.sum("n").alias("n")).where("n <> 0")
    out = {n: PrefixSketch(width_bits) for n in names}
    got = cells.toArrow()  # at most columns x levels x depth x width rows
    col, cell, n = (got.column(x).to_numpy() for x in ("col", "cell", "n"))
    for k, name in enumerate(names):
        own = col == k
        place, count = cell[own], n[own]
        out[name].n = int(count[place < 0].sum())
        out[name].table.ravel()[place[place >= 0]] = count[place >= 0]
    return out


def heavy_items(df: DataFrame, values: dict[str, Column], min_share: float, width_bits: int | None = None) -> DataFrame:
    """(col_name, item, approx_count, n, total): every value with at least `min_share` of a column's rows that aren't NULL.

    approx_count is the sketch's estimate, n the exact count of the second scan, which keeps only rows whose hash is a
    candidate before it aggregates. A sketch that turns out too narrow is made again wider, up to 2 ** MOST_BITS a row; a
    column so flat that even this isn't enough has its shares counted exactly. An empty or all-NULL column gives no rows.
    """
    spark = df.sparkSession
    ddl = "col_name string, item string, approx_count bigint, n bigint, total bigint"
    out, todo, bits = spark.createDataFrame([], ddl), dict(values), width_bits or width_bits_of(min_share)
    while todo:
        sketches = sketch_columns(df, todo, bits)
        for name, v in list(todo.items()):
            s, text = sketches[name], v.cast("string")
            least = min_share * s.n
            rows = df.select(text.alias("item"), F.xxhash64(text).alias("h")).where("item IS NOT NULL")
            try:
                found, est = s.descend(least) if s.n else (np.zeros(0, np.uint64), np.zeros(0))
            except TooNarrow:
                if bits < MOST_BITS:
                    continue
                exact = rows.groupBy("item").agg(F.count(F.lit(1)).alias("n")).withColumn("approx_count", F.col("n"))
            else:
                pairs = [(int(h), int(e)) for h, e in zip(found.view(np.int64), est, strict=True)]
                cand = spark.createDataFrame(pairs, "h bigint, approx_count bigint")
                exact = rows.join(F.broadcast(cand), "h").groupBy("item", "approx_count").agg(F.count(F.lit(1)).alias("n"))  # at most 8 / (SLACK * min_share) + 256 candidates
            del todo[name]
            out = out.unionByName(exact.where(F.col("n") >= F.lit(least)).select(F.lit(name).alias("col_name"), "item", "approx_count", "n", F.lit(s.n).cast("bigint").alias("total")))
        bits = min(MOST_BITS, bits + 2)
    return out
