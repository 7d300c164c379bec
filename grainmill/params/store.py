"""Keyed parameters as a table: pull is a join, push an aggregation and a join, and every state is a snapshot in parquet."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.schema import EngineError
from grainmill.session import shared_dir
from grainmill.sources.files import read_model, write_model

# Kinds of payload and what one job does with the store.
DTYPES = {"byte": "tinyint", "short": "smallint", "int": "int", "long": "bigint", "float": "float", "double": "double", "float_array": "float", "double_array": "double"}
JOBS = ("train", "predict", "increment_train")


@dataclass(frozen=True)
class StoreConfig:
    """Name and shape of a parameter table: `length` values of one type per id, initialised to `init` or uniform in [low, high).

    Of the latter only the first `drawn` values are drawn, if given, and the others are `init`. `buckets` is the number of
    partitions by id a snapshot is kept in; 0 takes as many as a shuffle has, so that pulls and pushes don't shuffle it.
    """

    table: str = "params"
    dtype: str = "float_array"
    length: int = 1
    init: float = 0.0
    low: float | None = None
    high: float | None = None
    seed: int = 17
    buckets: int = 0
    drawn: int | None = None

    def check(self) -> None:
        if self.dtype not in DTYPES:
            raise EngineError(f"dtype is one of {', '.join(DTYPES)}")
        if not self.dtype.endswith("_array") and self.length != 1:
            raise EngineError(f"a {self.dtype} has one value")

    @property
    def element(self) -> str:
        return DTYPES[self.dtype]

    def initial(self, key: Column) -> Column:
        """The starting array of an id: the same for each run, whatever the partitioning."""
        if self.low is None or self.high is None:
            one = lambda i: F.lit(self.init)
        else:
            # a uniform number from the id's hash, so a retry or another plan draws the same one
            uniform = lambda i: F.shiftrightunsigned(F.xxhash64(key, F.lit(self.seed), i), 11) / float(2**53) * (self.high - self.low) + self.low
            one = uniform if self.drawn is None else lambda i: F.when(i < self.drawn, uniform(i)).otherwise(F.lit(float(self.init)))
        return F.transform(F.sequence(F.lit(0), F.lit(self.length - 1)), one).cast(f"array<{self.element}>")


def pull(params: DataFrame, keys: DataFrame, config: StoreConfig, key: str = "feat", start: int = 0, end: int | None = None) -> DataFrame:
    """`keys` with w: the stored weights of each row's key, initial ones for an unknown key, optionally only [start, end)."""
    right = params.select(F.col("id").alias("__id"), F.col("w").alias("__w"))
    w = F.coalesce("__w", config.initial(F.col(key)))
    if start or end is not None:
        w = F.slice(w, start + 1, (end if end is not None else config.length) - start)
    return keys.join(right, F.col(key) == F.col("__id"), "left").select(*keys.columns, w.alias("w"))


def push(params: DataFrame, grads: DataFrame, updater, config: StoreConfig) -> DataFrame:  # noqa: ANN001
    """The table after `updater` on every id of `grads` (id, g array): stored ids without a gradient stay, new ids start from the initial weights."""
    g = grads.select(F.col("id").alias("__id"), F.col("g").alias("__g"))
    j = params.join(g, F.col("id") == F.col("__id"), "full")
    key = F.coalesce("id", "__id")
    w = F.coalesce("w", config.initial(key))
    new = F.when(F.col("__g").isNull(), F.col("w")).otherwise(updater.update(w, F.col("__g")).cast(f"array<{config.element}>"))
    return j.select(key.alias("id"), new.alias("w"))


def dedupe_snapshot(saved: DataFrame, config: StoreConfig, key: str = "id", weights: str = "w", order: str = "saved_at") -> DataFrame:
    """(id, w): of an id saved more than once the last row; arrays of another length or with NULL or NaN are left out."""
    ok = (F.size(weights) == config.length) & ~F.exists(weights, lambda x: x.isNull() | F.isnan(x))
    return saved.where(ok & F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.max_by(weights, F.struct(F.col(order), F.col(weights))).alias("w"))


@dataclass
class ParamStore:
    """A parameter table with its snapshots below a shared folder. Each change writes a new snapshot, so a lost executor costs a re-read.

    train starts empty; predict and increment_train start from a model text at `model_path`. `tag` says which change a snapshot
    holds; a store on the same `folder` goes on with the last complete snapshot and its tag. The snapshot before the current
    one is kept, because plans made before a change may still read it; older ones are removed.
    """

    spark: SparkSession
    config: StoreConfig
    job: str = "train"
    model_path: str | None = None
    folder: str | None = None
    version: int = field(default=0, init=False)
    tag: str | None = field(default=None, init=False)

    def __post_init__(self) -> None:
        self.config.check()
        if self.job not in JOBS:
            raise EngineError(f"job is one of {', '.join(JOBS)}")
        own = self.folder is None
        self.folder = self.folder or f"{shared_dir(self.spark)}/store-{self.config.table}-{uuid.uuid4().hex[:8]}"
        self._names: dict[int, tuple[str, str]] = {}
        empty = self.spark.createDataFrame([], f"id bigint, w array<{self.config.element}>")
        if not own and self._reopen():
            return
        if self.job == "train":
            self._current = empty
        elif not self.model_path:
            raise EngineError(f"{self.job} needs a model")
        else:
            self.replace(read_model(self.spark, self.model_path).select("id", F.col("w").cast(f"array<{self.config.element}>")))

    @property
    def params(self) -> DataFrame:
        return self._current

    @property
    def buckets(self) -> int:
        return self.config.buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def _fs(self):  # noqa: ANN202
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), jvm.org.apache.hadoop.fs.Path

    def _reopen(self) -> bool:
        """Go on with the last complete snapshot in the folder, if there is one; its tag stands in the name of a marker file."""
        fs, path = self._fs()
        if not fs.exists(path(self.folder)):
            return False
        marks = [str(x.getPath().getName()) for x in fs.listStatus(path(self.folder)) if str(x.getPath().getName()).startswith("done-")]
        if not marks:
            return False
        _, version, tag = max(marks, key=lambda m: int(m.split("-", 2)[1])).split("-", 2)
        self.version, self.tag = int(version), tag or None
        self._current = self.spark.read.parquet(f"{self.folder}/v{version}")
        return True

    def _forget(self, version: int) -> None:
        fs, path = self._fs()
        name, mark = self._names.pop(version)
        fs.delete(path(mark), False)
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        fs.delete(path(f"{self.folder}/v{version}"), True)

    def replace(self, params: DataFrame, tag: str | None = None) -> None:
        """A new snapshot in buckets by id, so that pulls and pushes find equal ids together without a shuffle of the table."""
        if params.schema["w"].dataType.simpleString() != f"array<{self.config.element}>":
            raise EngineError(f"the store holds {self.config.dtype}, not {params.schema['w'].dataType.simpleString()}")
        self.version += 1
        path, name = f"{self.folder}/v{self.version}", f"grainmill_{self.config.table}_{uuid.uuid4().hex[:12]}"
        params.select("id", "w").write.mode("overwrite").format("parquet").bucketBy(self.buckets, "id").option("path", path).saveAsTable(name)
        fs, hadoop_path = self._fs()
        mark = f"{self.folder}/done-{self.version}-{tag or ''}"
        fs.create(hadoop_path(mark)).close()
        self._names[self.version], self._current, self.tag = (name, mark), self.spark.table(name), tag
        for old in [v for v in self._names if v < self.version - 1]:
            self._forget(old)

    def pull(self, keys: DataFrame, **kw: object) -> DataFrame:
        return pull(self._current, keys, self.config, **kw)

    def push(self, grads: DataFrame, updater, tag: str | None = None) -> None:  # noqa: ANN001
        self.replace(push(self._current, grads, updater, self.config), tag)

    def scan_range(self, low: int, high: int) -> DataFrame:
        """Parameters with low <= id < high; the bounds reach the parquet scan."""
        return self._current.where((F.col("id") >= low) & (F.col("id") < high))

    def scan_ids(self, ids: DataFrame, key: str = "id") -> DataFrame:
        return self._current.join(ids.select(F.col(key).alias("__i")).distinct(), F.col("id") == F.col("__i"), "left_semi")

    def clear_range(self, low: int, high: int) -> None:
        self.replace(self._current.where((F.col("id") < low) | (F.col("id") >= high)))

    def count(self) -> int:
        return self._current.count()

    def save(self, path: str, start: int = 0, end: int | None = None) -> None:
        """The model as text; the table stays usable."""
        write_model(self._current, path, start=start, end=end)
