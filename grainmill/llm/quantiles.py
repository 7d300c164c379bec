"""Percentiles per group with relative-rank compactors (the REQ sketch), mergeable over partitions, loads and days.

A sketch is a stack of compactors. Level h holds values of weight 2**h. A full compactor sorts itself, keeps its upper part
untouched and sends every second value of the rest one level up, so values near the top of the distribution keep weight 1
and the rank error shrinks with the distance from the top: about `RANK_ERROR / k * (n - rank)` (one standard deviation).
The lower the number of compactions, the shorter the part that is compacted (by the trailing ones of a counter), which is
what makes the bound hold under any order of merges.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.session import clean_num, cut

#: Sketch size (even), sections a compactor begins with, standard deviation of the rank error of a sketch with k = 1.
K, SECTIONS, RANK_ERROR = 32, 3, 0.1307
#: Groups that may be broadcast to be counted exactly; more are joined by a shuffle.
MOST_BROADCAST = 200_000
#: Standard deviations beyond which an estimate is taken as certain; anything nearer is checked exactly.
CERTAIN = 8.0


def section_plan(state: int, k: int) -> tuple[int, int]:
    """Number and size of the sections of a compactor after `state` compactions: sections double as they shrink by sqrt 2."""
    n, size, exact = SECTIONS, k, float(k)
    while state >= 1 << (n - 1) and exact / 2**0.5 >= 4:
        exact /= 2**0.5
        size = max(4, 2 * round(exact / 2))
        n *= 2
    return n, size


class ReqSketch:
    def __init__(self, k: int = K, seed: int | list[int] = 0) -> None:
        self.k, self.n, self.levels, self.states = k, 0, [np.zeros(0)], [0]
        self.rng = np.random.default_rng(seed)

    def capacity(self, h: int) -> int:
        n, size = section_plan(self.states[h], self.k)
        return 2 * n * size

    def update(self, values: np.ndarray) -> None:
        self.n += len(values)
        self.levels[0] = np.concatenate([self.levels[0], values])
        self._compress()

    def merge(self, other: ReqSketch) -> None:
        self.n += other.n
        while len(self.levels) < len(other.levels):
            self.levels.append(np.zeros(0))
            self.states.append(0)
        for h, v in enumerate(other.levels):
            self.levels[h] = np.concatenate([self.levels[h], v])
            self.states[h] |= other.states[h]
        self._compress()

    def _compress(self) -> None:
        h = 0
        while h < len(self.levels):
            cap = self.capacity(h)
            if len(self.levels[h]) > cap:
                n, size = section_plan(self.states[h], self.k)
                trailing = (~self.states[h] & (self.states[h] + 1)).bit_length() - 1
                kept = max(cap // 2, cap - (trailing + 1) * size)
                v = np.sort(self.levels[h])
                m = (len(v) - kept) // 2 * 2
                if h + 1 == len(self.levels):
                    self.levels.append(np.zeros(0))
                    self.states.append(0)
                self.levels[h + 1] = np.concatenate([self.levels[h + 1], v[:m][int(self.rng.integers(2)) :: 2]])
                self.levels[h] = v[m:]
                self.states[h] += 1
            h += 1

    @property
    def exact(self) -> bool:
        return len(self.levels) == 1

    def weighted(self) -> tuple[np.ndarray, np.ndarray]:
        """Values in order and the estimated number of values up to each."""
        v = np.concatenate(self.levels)
        w = np.repeat(2 ** np.arange(len(self.levels)), [len(x) for x in self.levels])
        o = np.argsort(v, kind="stable")
        return v[o], np.cumsum(w[o])

    def quantiles(self, ps: np.ndarray) -> np.ndarray:
        """The smallest value with at least p of all values at or below it."""
        v, c = self.weighted()
        return v[np.minimum(np.searchsorted(c, np.maximum(np.ceil(ps * self.n - 1e-9), 1)), len(v) - 1)]

    def below(self, x: float) -> int:
        """Estimated number of values < x."""
        v, c = self.weighted()
        i = int(np.searchsorted(v, x, side="left"))
        return int(c[i - 1]) if i else 0

    def rank_error(self, rank: float) -> float:
        """One standard deviation of the error of an estimated rank (0 while nothing was compacted)."""
        return 0.0 if self.exact else RANK_ERROR / self.k * max(self.n - rank, 1.0)


_SKETCH = "n bigint, level int, state bigint, vals array<double>"


def _rows(keys: list[list], schema: list[str], ns: list[int], levels: list[int], states: list[int], offs: np.ndarray, vals: np.ndarray, key_types: list[pa.DataType]) -> pa.RecordBatch:
    cols = [pa.array(k, t) for k, t in zip(keys, key_types, strict=True)]
    lists = pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(vals))
    return pa.RecordBatch.from_arrays([*cols, pa.array(ns, pa.int64()), pa.array(levels, pa.int32()), pa.array(states, pa.int64()), lists], names=[*schema, "n", "level", "state", "vals"])


#: Values a task holds of groups that are still small, compactor stacks it holds of the others, parts of a group that one task of the first merge level takes.
PENDING_VALUES, HELD_SKETCHES, FAN_IN = 400_000, 2000, 64


def _rng_seed(*parts: object) -> list[int]:
    """A seed of its own for each task and key, so that the coins of different parts are independent and a retry draws the same ones."""
    return [zlib.crc32(repr(x).encode()) for x in parts]


def sketch_parts(df: DataFrame, keys: list[str], value: Column, k: int = K, pending_values: int = PENDING_VALUES) -> DataFrame:
    """Sketches of the rows of each task, per combination of `keys`: one row a level, with the part they belong to. No shuffle.

    A group is held as its values until they exceed one compactor, from then on as a stack of compactors, over all batches of
    the task. Only when the values of small groups exceed `pending_values`, or more than HELD_SKETCHES groups are large, are
    these handed on and begun anew; so memory is bounded, and a task sends a hot group as one sketch, not as its values.
    """
    key_fields = [df.schema[c] for c in keys]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in key_fields) + ", __part int, " + _SKETCH
    cap = 2 * SECTIONS * k
    src = df.select(*keys, value.alias("__v")).where("__v IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        big: dict[tuple, ReqSketch] = {}
        types: list[pa.DataType] = []

        def rows(cols: list[list], ns: list[int], levels: list[int], states: list[int], offs: np.ndarray, vals: np.ndarray) -> pa.RecordBatch:
            return _rows([*cols, [part] * len(ns)], [*keys, "__part"], ns, levels, states, offs, vals, [*types, pa.int32()])

        def fold(tables: list, last: bool) -> Iterator[pa.RecordBatch | pa.Table]:
            """Moves large groups into their sketches; gives what is left of the others, as a table or (`last`, or too many) as rows to send."""
            t = pa.Table.from_batches([b for x in tables for b in (x.to_batches() if isinstance(x, pa.Table) else [x])]).combine_chunks()
            d = t.select(keys).to_pandas(integer_object_nulls=True)
            code = d.groupby(keys, dropna=False, sort=False).ngroup().to_numpy()
            v = t.column("__v").to_numpy()
            o = np.lexsort((v, code))
            v, code = v[o], code[o]
            starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            sizes = np.diff(np.r_[starts, len(code)])
            firsts = o[starts]
            cols = [t.column(c).take(pa.array(firsts)).to_pylist() for c in keys]
            key_of = [_plain_key(x) for x in zip(*cols, strict=True)]
            small = np.array([sizes[g] <= cap and key not in big for g, key in enumerate(key_of)], bool)
            for g in np.flatnonzero(~small).tolist():
                if key_of[g] not in big:
                    big[key_of[g]] = ReqSketch(k, _rng_seed(part, key_of[g]))
                big[key_of[g]].update(v[starts[g] : starts[g] + sizes[g]])
                real[key_of[g]] = tuple(c[g] for c in cols)
            at, left = np.flatnonzero(small), np.repeat(small, sizes)
            if not len(at):
                return
            if last or left.sum() > pending_values // 2:
                yield rows([[c[i] for i in at.tolist()] for c in cols], sizes[at].tolist(), [0] * len(at), [0] * len(at), np.r_[0, np.cumsum(sizes[at])], v[left])
            else:
                yield t.take(pa.array(o[left]))

        real: dict[tuple, tuple] = {}

        def hand_on() -> Iterator[pa.RecordBatch]:
            for key, s in big.items():
                yield rows([[x] * len(s.levels) for x in real[key]], [s.n] + [0] * (len(s.levels) - 1), list(range(len(s.levels))), s.states, np.r_[0, np.cumsum([len(x) for x in s.levels])], np.concatenate(s.levels))
            big.clear()
            real.clear()

        pending, n = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            types = types or [b.schema.field(c).type for c in keys]
            pending.append(b)
            n += b.num_rows
            if n >= pending_values:
                kept = []
                for x in fold(pending, last=False):
                    if isinstance(x, pa.Table):
                        kept.append(x)
                    else:
                        yield x
                pending, n = kept, sum(x.num_rows for x in kept)
                if len(big) > HELD_SKETCHES:
                    yield from hand_on()
        if n:
            yield from fold(pending, last=True)
        yield from hand_on()

    return src.mapInArrow(run, ddl)


def _plain_key(key: tuple) -> tuple:
    """A key that equals itself, NaN included."""
    return tuple("NaN" if isinstance(x, float) and x != x else x for x in key)


def _sketch_of(ns: np.ndarray, levels: np.ndarray, states: np.ndarray, lists: list[np.ndarray], k: int, seed: list[int]) -> ReqSketch:
    """One sketch from rows of several parts: compactors of a level are put together, then compressed once."""
    s = ReqSketch(k, seed)
    s.n = int(ns.sum())
    top = int(levels.max()) + 1
    s.levels = [np.concatenate([v for v, h in zip(lists, levels, strict=True) if h == i] or [np.zeros(0)]) for i in range(top)]
    s.states = [int(np.bitwise_or.reduce(states[levels == i])) if (levels == i).any() else 0 for i in range(top)]
    s._compress()
    return s


def _merge_sorted(keys: list[str], ddl: str, emit, k: int):  # noqa: ANN001, ANN202
    """A function over batches sorted by `keys`: (keys, sketch) of each group goes to `emit`, whose rows come out. Only one sketch is carried from batch to batch."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried: tuple[tuple, ReqSketch] | None = None

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(c).to_pylist() for c in keys]
            n, level, state = (b.column(c).to_numpy() for c in ("n", "level", "state"))
            arr = b.column("vals")
            flat, offs = arr.values.to_numpy(), arr.offsets.to_numpy()
            key_of = [_plain_key(x) for x in zip(*cols, strict=True)]
            new = [0] + [i for i in range(1, b.num_rows) if key_of[i] != key_of[i - 1]] + [b.num_rows]
            out: list[tuple] = []
            for lo, hi in zip(new, new[1:], strict=False):
                s = _sketch_of(n[lo:hi], level[lo:hi], state[lo:hi], [flat[offs[i] : offs[i + 1]] for i in range(lo, hi)], k, _rng_seed("merge", key_of[lo], int(n[lo:hi].sum())))
                if carried is not None and _plain_key(carried[0]) == key_of[lo]:
                    carried[1].merge(s)
                    continue
                if carried is not None:
                    out += emit(*carried)
                carried = (tuple(c[lo] for c in cols), s)
            if out:
                yield batch_of(out)
        if carried is not None and (out := emit(*carried)):
            yield batch_of(out)

    return run


def _sketch_rows(key: tuple, s: ReqSketch) -> list[tuple]:
    return [(*key, s.n if h == 0 else 0, h, st, v.tolist()) for h, (v, st) in enumerate(zip(s.levels, s.states, strict=True))]


def merge_parts(parts: DataFrame, keys: list[str], ddl: str, emit, k: int = K, wide: bool = False) -> DataFrame:  # noqa: ANN001
    """Bring the parts of each combination of `keys` together and hand (keys, sketch) to `emit`, which gives rows for `ddl`.

    A task merges parts as they come and holds one sketch. `wide` merges in two levels: the parts of FAN_IN neighbouring tasks
    first, then what these gave, so that the parts of a group that all tasks have are spread over many tasks.
    """
    names = [c for c in parts.columns if c != "__part"]
    if wide and "__part" in parts.columns:
        salted = parts.select(*names, F.floor(F.col("__part") / FAN_IN).cast("int").alias("__salt"))
        by = [*keys, "__salt"]
        mid = ", ".join(f"`{c}` {salted.schema[c].dataType.simpleString()}" for c in by) + ", " + _SKETCH
        parts = salted.repartition(*by).sortWithinPartitions(*by).select(*by, "n", "level", "state", "vals").mapInArrow(_merge_sorted(by, mid, _sketch_rows, k), mid).drop("__salt")
    return parts.select(*names).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_merge_sorted(keys, ddl, emit, k), ddl)


def _is_wide(df: DataFrame) -> bool:
    """Whether `df` is read by more tasks than one merging task should take parts from, by the size the optimizer states."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size > FAN_IN * int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())


def load_sketches(df: DataFrame, group: str, load: str, value: str, k: int = K) -> DataFrame:
    """The form to keep: one sketch per group and load, one row a level (group, load, n, level, state, vals)."""
    ddl = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (group, load)) + ", " + _SKETCH
    return merge_parts(sketch_parts(df, [group, load], clean_num(value), k), [group, load], ddl, _sketch_rows, k, _is_wide(df))


def group_quantiles(sketches: DataFrame, group: str, ps: list[float] | None = None, k: int = K) -> DataFrame:
    """Median and quantileArray per group from kept sketches of any loads: group, n, median, quantile_array, rank_error_p50, rank_error_p95.

    The errors are one standard deviation of the rank, as a share of n: k = 32 gives at most 0.21 % at the median and 0.021 %
    at the 95th percentile; 0 where the group was small enough to be kept whole.
    """
    ps_a = np.array(ps if ps is not None else [i / 100 for i in range(101)])
    ddl = f"`{group}` {sketches.schema[group].dataType.simpleString()}, n bigint, median double, quantile_array array<double>, rank_error_p50 double, rank_error_p95 double"

    def emit(key: tuple, s: ReqSketch) -> list[tuple]:
        q = s.quantiles(np.r_[0.5, ps_a])
        return [(*key, s.n, float(q[0]), q[1:].tolist(), s.rank_error(0.5 * s.n) / s.n, s.rank_error(0.95 * s.n) / s.n)]

    return merge_parts(sketches.select(group, "n", "level", "state", "vals"), [group], ddl, emit, k)


def groups_reaching(df: DataFrame, group: str, value: str, tests: list[tuple[str, float, float]], min_count: int, k: int = K) -> DataFrame:
    """(group, stat): groups with at least `min_count` values whose percentile p is at least x, for each test (stat, p, x).

    Sketches are made per task and group and merged; those kept per load (`load_sketches`) would do as well. The p-th value is >= x exactly if fewer than p * n values
    are < x; where the sketch's estimate of that number is CERTAIN standard deviations away from p * n it decides, and only
    the groups in between are counted exactly in a second scan of the table. NULL groups form a group of their own.
    """
    parts = sketch_parts(df, [group], clean_num(value), k)
    g_type = df.schema[group].dataType.simpleString()

    def emit(key: tuple, s: ReqSketch) -> list[tuple]:
        out = []
        if s.n >= min_count:
            for stat, p, x in tests:
                b = s.below(x)
                far = abs(b - p * s.n) - CERTAIN * s.rank_error(min(b, p * s.n))
                sure = s.exact or far > 0
                if not sure or b < p * s.n - 1e-9:
                    out.append((*key, stat, sure))
        return out

    got = cut(merge_parts(parts, [group], f"`{group}` {g_type}, stat string, sure boolean", emit, k, _is_wide(df)))
    open_ = got.where("NOT sure")
    n_open = open_.count()
    if not n_open:
        return got.select(group, "stat")
    near = open_.select(F.col(group).alias("__o")).distinct()
    near = F.broadcast(near) if n_open <= MOST_BROADCAST else near
    counts = df.select(F.col(group).alias("__g"), clean_num(value).alias("__v")).where("__v IS NOT NULL").join(near, F.col("__g").eqNullSafe(F.col("__o")), "left_semi")
    exact = counts.groupBy("__g").agg(F.count("__v").alias("__n"), *[F.sum(F.when(F.col("__v") < x, 1).otherwise(0)).alias(f"__b_{stat}") for stat, _, x in tests])
    cases = F.array(*[F.struct(F.lit(stat).alias("__s"), ((F.col("__n") >= min_count) & (F.col(f"__b_{stat}") < p * F.col("__n") - 1e-9)).alias("__ok")) for stat, p, _ in tests])
    checked = exact.select("__g", F.inline(cases)).where("__ok")
    passed = open_.join(checked, F.col(group).eqNullSafe(F.col("__g")) & (F.col("stat") == F.col("__s")), "left_semi")
    return got.where("sure").select(group, "stat").unionByName(passed.select(group, "stat"))
