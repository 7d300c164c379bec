"""Frequency of every distinct value or term: radix partitions by hash bits, spilled to disk and split again, aggregated by DuckDB.

The shuffle partitions by the leading bits of a term's hash; their number follows from the size of the table. A cell that
still holds more than a task should - a hot term - is found by counting the cells, and is spread over several tasks by the
record's hash, so that each holds whole (term, record) pairs and records are counted exactly. Within a task rows that exceed
`leaf_bytes` are written to disk by bits of another hash of the term, and then of the record; a partition that is still
too large is split further in the same way. DuckDB aggregates each leaf in bounded memory. Parts of one term add up.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.session import clean, shared_dir

#: Bits per split on disk, bytes a leaf holds at most (DuckDB needs some four times as much to aggregate it), DuckDB's memory, rows a task takes.
RADIX_BITS, LEAF_BYTES, LEAF_MEMORY, TASK_ROWS = 6, 32 << 20, "200MB", 500_000
#: Bits of the term's hash that the shuffle may use; the rest is for splits on disk.
MOST_CELL_BITS = 24


def term_rows(df: DataFrame, record: str, single: list[str] = (), multi: list[str] = (), delimiter: str = ",") -> DataFrame:
    """(feat_name, category, record): one row an occurrence. Blanks removed, missing values and list elements dropped."""
    cols = [F.struct(F.lit(c).alias("feat_name"), F.array(F.col(c).cast("string")).alias("items")) for c in single]
    cols += [F.struct(F.lit(c).alias("feat_name"), F.split(F.col(c), re.escape(delimiter)).alias("items")) for c in multi]
    long = df.select(F.col(record).alias("record"), F.inline(F.array(*cols))).select("record", "feat_name", F.explode("items").alias("item"))
    return long.select("record", "feat_name", clean("item").alias("category")).where("category IS NOT NULL")


def cell_bits(rows: int, task_rows: int = TASK_ROWS) -> int:
    """Leading bits of the term's hash that give cells of about a quarter of what a task takes, so that tasks of several cells are even."""
    return min(MOST_CELL_BITS, max(2, (4 * max(rows, 1) // task_rows).bit_length()))


def _place(hashed: DataFrame, bits: int, task_rows: int) -> tuple[DataFrame, int]:
    """`hashed` (th, rh, ...) with the number of the partition each row belongs to, and how many there are.

    A cell with more than `task_rows` rows gets partitions of its own, as many as it needs, and its rows go to them by the
    record's hash. There are at most rows / task_rows such cells, which bounds what is broadcast; the others share a fixed number.
    """
    cell = F.shiftrightunsigned("th", 64 - bits)
    counts = hashed.groupBy(cell.alias("c")).agg(F.count(F.lit(1)).alias("n"))
    total, over = counts.agg(F.sum("n"), F.collect_list(F.when(F.col("n") > task_rows, F.struct("c", "n")))).head()
    total, large = total or 0, sorted((r["c"], -(-r["n"] // task_rows)) for r in over)
    shared = max(1, -(-int(total) // task_rows))
    first, rows = shared, []
    for c, n in large:
        rows.append((c, first, n))
        first += n
    if not rows:
        return hashed.withColumn("part", F.pmod(cell, F.lit(shared)).cast("int")), shared
    table = hashed.sparkSession.createDataFrame(rows, "big bigint, first int, n int")
    own = F.when(F.col("big").isNotNull(), F.col("first") + F.pmod(F.shiftrightunsigned("rh", 8), F.col("n")).cast("int")).otherwise(F.pmod(cell, F.lit(shared)).cast("int"))
    return hashed.join(F.broadcast(table), cell == F.col("big"), "left").withColumn("part", own).drop("big", "first", "n"), first  # at most rows / task_rows rows


def _hashes(b: pa.RecordBatch, columns: tuple[str, ...]) -> np.ndarray:
    """A 64-bit hash of the values of `columns` in each row, the same in every process; equal values are hashed once."""
    out = np.zeros(b.num_rows, np.uint64)
    for c in columns:
        d = b.column(c).dictionary_encode()
        known = pd.util.hash_array(np.array([repr(x) for x in d.dictionary.to_pylist()] + [""], object), categorize=False)
        with np.errstate(over="ignore"):
            out = (out ^ known[pc.fill_null(d.indices, len(known) - 1).to_numpy()]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return out


class Spill:
    """Rows of one task split by hash bits into files of the shared folder, oversized ones again, down to leaves of at most `leaf_bytes`.

    Levels take RADIX_BITS bits of the term's hash each, then those of the record's. Rows that agree in all bits of both are
    copies of one (term, record) pair, which DuckDB folds as it reads them.
    """

    def __init__(self, folder: str, leaf_bytes: int = LEAF_BYTES) -> None:
        self.folder, self.leaf_bytes = folder, leaf_bytes
        self.shifts = [(columns, s) for columns in (("feat_name", "category"), ("record",)) for s in range(64 - RADIX_BITS, 0, -RADIX_BITS)]
        self.leaves = self.splits = 0

    def split(self, batches: Iterator[pa.RecordBatch], level: int = 0) -> Iterator[list[pa.RecordBatch] | Iterator[pa.RecordBatch]]:
        """The leaves, one after the other: lists of batches, or a stream for rows that can't be told apart any further."""
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.nbytes
            if size > self.leaf_bytes:
                break
        else:
            self.leaves += 1
            yield held
            return
        if level >= len(self.shifts):
            self.leaves += 1
            yield (b for part in (held, batches) for b in part)
            return
        self.splits += 1
        columns, shift = self.shifts[level]
        if self.splits == 1:
            self._open()
        names = [f"{self.path}/{level}-{uuid.uuid4().hex}" for _ in range(1 << RADIX_BITS)]
        sinks: dict[int, tuple] = {}
        sizes = [0] * (1 << RADIX_BITS)
        for b in (x for part in (held, batches) for x in part):
            digit = (_hashes(b, columns) >> np.uint64(shift)).astype(np.int64) & ((1 << RADIX_BITS) - 1)
            for d in np.unique(digit).tolist():
                if d not in sinks:
                    out = self.fs.open_output_stream(names[d])
                    sinks[d] = (out, pa.ipc.new_stream(out, b.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")))
                own = b.filter(pa.array(digit == d))
                sizes[d] += own.nbytes
                sinks[d][1].write_batch(own)
        held.clear()
        for out, w in sinks.values():
            w.close()
            out.close()
        together, size = [], 0  # small partitions make a leaf together
        for d in sorted(sinks):
            with self.fs.open_input_stream(names[d]) as f:
                if sizes[d] > self.leaf_bytes:
                    yield from self.split(iter(pa.ipc.open_stream(f)), level + 1)
                else:
                    if size + sizes[d] > self.leaf_bytes:
                        self.leaves += 1
                        yield together
                        together, size = [], 0
                    together += list(pa.ipc.open_stream(f))
                    size += sizes[d]
            self.fs.delete_file(names[d])
        if together:
            self.leaves += 1
            yield together

    def _open(self) -> None:
        """The folder of this task's files, in the shared folder's own file system; only made when something has to be split."""
        remote = "://" in self.folder or self.folder.startswith("file:")
        self.fs, path = pafs.FileSystem.from_uri(self.folder.replace("s3a://", "s3://")) if remote else (pafs.LocalFileSystem(), self.folder)
        self.path = f"{path.rstrip('/')}/terms-{uuid.uuid4().hex}"
        self.fs.create_dir(self.path, recursive=True)

    def close(self) -> None:
        if self.splits:
            self.fs.delete_dir(self.path)


def _aggregate(rows: list[pa.RecordBatch] | Iterator[pa.RecordBatch], schema: pa.Schema, memory: str, spill: str | None) -> pa.Table:
    import duckdb

    con = duckdb.connect()
    con.execute(f"SET threads = 1; SET memory_limit = '{memory}'; SET preserve_insertion_order = false")
    if spill:
        con.execute(f"SET temp_directory = '{spill}'")
    part = pa.RecordBatchReader.from_batches(schema, iter(rows))
    con.register("part", part)
    got = con.sql("SELECT feat_name, category, count(*) AS n_occurrences, count(DISTINCT record) AS n_records FROM part GROUP BY ALL").to_arrow_table()
    con.close()
    return got


def term_counts(df: DataFrame, record: str, single: list[str] = (), multi: list[str] = (), delimiter: str = ",", task_rows: int = TASK_ROWS, leaf_bytes: int = LEAF_BYTES, memory: str = LEAF_MEMORY) -> DataFrame:
    """(feat_name, category, n_occurrences, n_records): every distinct value of `single` columns and element of `multi` columns.

    n_records counts distinct values of `record` (NULL counts as no record). Repeated rows count as occurrences, not as
    records. An empty table gives no rows.
    """
    rows = term_rows(df, record, list(single), list(multi), delimiter)
    hashed = rows.select("feat_name", "category", "record", F.xxhash64("feat_name", "category").alias("th"), F.xxhash64("record").alias("rh"))
    bits = cell_bits(df.count() * (len(single) + 4 * len(multi)), task_rows)
    folder = shared_dir(df.sparkSession)
    local = folder.removeprefix("file:") if folder.startswith(("file:", "/")) else None
    placed, parts = _place(hashed, bits, task_rows)

    def aggregate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spill = Spill(folder, leaf_bytes)
        try:
            for leaf in spill.split(b for b in batches if b.num_rows):
                first = leaf[0] if isinstance(leaf, list) and leaf else None
                if isinstance(leaf, list) and first is None:
                    continue
                if first is None:
                    first = next(leaf)
                    leaf = (b for part in ([first], leaf) for b in part)  # noqa: PLW2901
                yield from _aggregate(leaf, first.schema, memory, os.path.join(local, f"terms-{uuid.uuid4().hex}") if local else None).to_batches()
        finally:
            spill.close()

    per_leaf = placed.repartitionById(parts, "part").select("feat_name", "category", "record").mapInArrow(aggregate, "feat_name string, category string, n_occurrences bigint, n_records bigint")
    return per_leaf.groupBy("feat_name", "category").agg(F.sum("n_occurrences").alias("n_occurrences"), F.sum("n_records").alias("n_records"))


def mark_terms(counts: DataFrame, n_records: int, rare_below: int = 3, common_share: float = 0.2) -> DataFrame:
    """`counts` with a mark: `rare` below `rare_below` records, `common` above `common_share` of all records, else NULL."""
    mark = F.when(F.col("n_records") < rare_below, "rare").when(F.col("n_records") > F.lit(common_share * n_records), "common")
    return counts.withColumn("mark", mark)
