"""Fit/transform operators for features. All transforms are column expressions, so a pipeline stays one plan."""

from __future__ import annotations

import bisect
import json
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainmill.functions.linalg import once
from grainmill.functions.vectors import multi_hot, one_hot
from grainmill.operators.running import exact_quantiles, running_total
from grainmill.schema import EngineError, SemanticSchema
from grainmill.session import cut, shared_dir

# Names of orders and of what to do with invalid values.
ORDERS = ("frequencyDesc", "frequencyAsc", "alphabetDesc", "alphabetAsc")
INVALID = ("keep", "error")
#: So many levels are looked up in a map within the plan, which is scanned; longer lists by a join.
MAP_LEVELS = 64


class _Columns(HasInputCols, HasOutputCols):
    """Input and output columns with the checks every operator makes before it runs."""

    dropInputCols = Param(Params._dummy(), "dropInputCols", "drop the input columns", typeConverter=TypeConverters.toBoolean)

    def _check(self, schema: T.StructType, kinds: tuple[type, ...]) -> None:
        ins, outs = self.getInputCols(), self.getOutputCols()
        if len(ins) != len(outs):
            raise EngineError(f"{len(ins)} input columns, {len(outs)} output columns")
        for c in ins:
            if c not in schema.names:
                raise EngineError(f"no column {c}")
            if not isinstance(schema[c].dataType, kinds):
                raise EngineError(f"column {c} has type {schema[c].dataType.simpleString()}")
        rest = set(schema.names) - (set(ins) if self.getOrDefault("dropInputCols") else set())
        for c in outs:
            if c in rest or outs.count(c) > 1:
                raise EngineError(f"output column {c} exists already")

    def _append(self, df: DataFrame, new: list[Column], own: list[str] | None = None) -> DataFrame:
        """The columns `own` of the frame (all, if not given) without dropped inputs, and the new ones."""
        drop = set(self.getInputCols()) if self.getOrDefault("dropInputCols") else set()
        return df.select(*[F.col(f"`{c}`") for c in own or df.columns if c not in drop], *[x.alias(o) for x, o in zip(new, self.getOutputCols(), strict=True)])


class _WithData(DefaultParamsWritable, DefaultParamsReadable):
    """A model whose fitted content is one JSON parameter, so that it is saved with the metadata."""

    content = Param(Params._dummy(), "content", "fitted content as JSON", typeConverter=TypeConverters.toString)

    def _data(self):  # noqa: ANN202
        return json.loads(self.getOrDefault("content"))


#: Levels of all columns a model keeps in its parameters (on the driver, as text); more are kept as a table in the shared folder.
MODEL_LEVELS = 100_000
#: Bytes of one column's level table up to which it is broadcast; a larger one is joined by a shuffle.
BROADCAST_BYTES = 64 << 20


def ordered_levels(counts: DataFrame, order: str, reserved: int = 0) -> DataFrame:
    """(col, level, idx) from (col, level, count): levels numbered from 0 in order, ties by level, the first `reserved` of each column if > 0.

    A limit is pushed below the shuffle. Without one the levels are range-partitioned and numbered by running totals, so a
    column of very many levels isn't sorted in one task.
    """
    first = {"frequencyDesc": [F.desc("count"), F.asc("level")], "frequencyAsc": [F.asc("count"), F.asc("level")], "alphabetDesc": [F.desc("level")], "alphabetAsc": [F.asc("level")]}[order]
    if reserved > 0:
        ranked = counts.withColumn("idx", F.row_number().over(Window.partitionBy("col").orderBy(*first)) - 1)
        return ranked.where(F.col("idx") < reserved).select("col", "level", "idx")
    ranked = running_total(counts.withColumn("one", F.lit(1)), ["col"], first, {"idx": "one"})
    return ranked.select("col", "level", F.col("idx").cast("int").alias("idx"))


class _Levels(_WithData):
    """Fitted levels by column: lists in the parameters, or beyond MODEL_LEVELS a table in the shared folder with the number and bytes of each column's.

    A saved model with a table refers to it where it is, so that folder has to outlive the session.
    """

    @staticmethod
    def fitted(ranked: DataFrame, n_cols: int) -> str:
        """The content for a model. The levels are computed once; only their numbers and sizes come to the driver before it is clear that they fit."""
        ranked = cut(ranked)
        sizes = {r["col"]: (r["n"], r["bytes"]) for r in ranked.groupBy("col").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("level") + 16).alias("bytes")).collect()}
        if sum(n for n, _ in sizes.values()) > MODEL_LEVELS:
            path = f"{shared_dir(ranked.sparkSession)}/levels-{uuid.uuid4().hex}"
            ranked.write.partitionBy("col").parquet(path)
            return json.dumps({"table": path, "sizes": [sizes.get(i, (0, 0)) for i in range(n_cols)]})
        out: list[list[str | None]] = [[None] * sizes.get(i, (0, 0))[0] for i in range(n_cols)]
        for r in ranked.toLocalIterator():  # at most MODEL_LEVELS
            out[r["col"]][r["idx"]] = r["level"]
        return json.dumps(out)

    @property
    def labels(self) -> list[list[str]]:
        """The levels of each column in order."""
        got = self._data()
        if isinstance(got, list):
            return got
        rows = SparkSession.active().read.parquet(got["table"]).collect()
        out: list[list] = [[None] * n for n, _ in got["sizes"]]
        for r in rows:
            out[r["col"]][r["idx"]] = r["level"]
        return out

    def _sizes(self) -> list[int]:
        got = self._data()
        return [len(x) for x in got] if isinstance(got, list) else [n for n, _ in got["sizes"]]

    def _level_table(self, spark: SparkSession, i: int) -> DataFrame:
        """(level, idx) of column i, marked for broadcast if its checked size allows it."""
        got = self._data()
        if isinstance(got, list):
            return F.broadcast(spark.createDataFrame(list(zip(got[i], range(len(got[i])), strict=True)), "level string, idx int"))
        table = spark.read.parquet(got["table"]).where(F.col("col") == i).select("level", "idx")
        return F.broadcast(table) if got["sizes"][i][1] <= BROADCAST_BYTES else table

    def _indexed(self, df: DataFrame, values: list[Column]) -> tuple[DataFrame, list[Column]]:
        """`df` with whatever columns the lookups need, and the index of each value: the number of levels for anything else, NULL included."""
        got, out = self._data(), []
        for i, (v, n) in enumerate(zip(values, self._sizes(), strict=True)):
            if not n:
                out.append(F.lit(0))
            elif isinstance(got, list) and n <= MAP_LEVELS:
                pairs = [x for j, level in enumerate(got[i]) for x in (F.lit(level), F.lit(j))]
                out.append(F.coalesce(F.try_element_at(F.create_map(*pairs), v), F.lit(n)))
            else:
                table = self._level_table(df.sparkSession, i).select(F.col("level").alias(f"__level{i}"), F.col("idx").alias(f"__idx{i}"))
                df = df.join(table, v == F.col(f"__level{i}"), "left")
                out.append(F.coalesce(F.col(f"__idx{i}"), F.lit(n)))
        return df, out


def _indices_of(tokens: Column, levels: list[str]) -> Column:
    """The sorted distinct numbers of the levels of a list, in an Arrow function (a lambda would scan the levels for each token); NULL for NULL."""
    known, other = pa.array(levels, pa.string()), len(levels)

    @F.arrow_udf("array<int>")
    def lookup(ts: pa.Array) -> pa.Array:
        lens = pc.fill_null(pc.list_value_length(ts), 0).to_numpy(zero_copy_only=False)
        at = pc.fill_null(pc.index_in(ts.flatten(), value_set=known), other).to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(lens)), lens)
        order = np.lexsort((at, owner))
        owner, at = owner[order], at[order]
        first = np.ones(len(at), bool)
        first[1:] = (owner[1:] != owner[:-1]) | (at[1:] != at[:-1])
        offs = np.append(0, np.cumsum(np.bincount(owner[first], minlength=len(lens))))
        return pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(at[first], pa.int32()), mask=pc.is_null(ts))

    return lookup(tokens)


class CategoryEncoder(Estimator, _Columns, DefaultParamsWritable, DefaultParamsReadable):
    """Levels to indices (or one-hot vectors with one more slot): unseen levels and NULL get the index after the last level.

    handleInvalid="error" makes unseen levels and NULL raise when the result is computed.
    """

    indexOnly = Param(Params._dummy(), "indexOnly", "index instead of one-hot vector", typeConverter=TypeConverters.toBoolean)
    handleInvalid = Param(Params._dummy(), "handleInvalid", "keep or error", typeConverter=TypeConverters.toString)
    stringOrderType = Param(Params._dummy(), "stringOrderType", "order of levels", typeConverter=TypeConverters.toString)
    categoriesReserved = Param(Params._dummy(), "categoriesReserved", "levels to keep, 0 = all", typeConverter=TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, indexOnly=True, handleInvalid="keep", stringOrderType="frequencyDesc", dropInputCols=False, categoriesReserved=0) -> None:  # noqa: ANN001
        super().__init__()
        self._setDefault(indexOnly=True, handleInvalid="keep", stringOrderType="frequencyDesc", dropInputCols=False, categoriesReserved=0)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> CategoryEncoderModel:
        self._check(df.schema, (T.NumericType, T.StringType, T.BooleanType))
        if self.getOrDefault("stringOrderType") not in ORDERS or self.getOrDefault("handleInvalid") not in INVALID:
            raise EngineError(f"stringOrderType is one of {ORDERS}, handleInvalid one of {INVALID}")
        ins = self.getInputCols()
        cells = F.array(*[F.struct(F.lit(i).alias("col"), F.col(f"`{c}`").cast("string").alias("level")) for i, c in enumerate(ins)])
        counts = df.select(F.inline(cells)).where("level IS NOT NULL").groupBy("col", "level").count()
        ranked = ordered_levels(counts, self.getOrDefault("stringOrderType"), self.getOrDefault("categoriesReserved"))
        return self._copyValues(CategoryEncoderModel()._set(content=_Levels.fitted(ranked, len(ins))))


class CategoryEncoderModel(Model, _Columns, _Levels):
    indexOnly, handleInvalid = CategoryEncoder.indexOnly, CategoryEncoder.handleInvalid
    stringOrderType, categoriesReserved = CategoryEncoder.stringOrderType, CategoryEncoder.categoriesReserved

    def __init__(self) -> None:
        super().__init__()
        self._setDefault(indexOnly=True, handleInvalid="keep", stringOrderType="frequencyDesc", dropInputCols=False, categoriesReserved=0)

    def _transform(self, df: DataFrame) -> DataFrame:
        self._check(df.schema, (T.NumericType, T.StringType, T.BooleanType))
        ins, new, own = self.getInputCols(), [], df.columns
        wide, found = self._indexed(df, [F.col(f"`{c}`").cast("string") for c in ins])
        for c, at, n in zip(ins, found, self._sizes(), strict=True):
            if self.getOrDefault("handleInvalid") == "error":
                at = F.when(at < n, at).otherwise(F.raise_error(F.concat(F.lit(f"column {c} has a level that wasn't fitted: "), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("NULL")))).cast("int"))
            new.append(at.cast("int") if self.getOrDefault("indexOnly") else one_hot(at, n + 1))
        return self._append(wide, new, own)


def split_tokens(c: Column, delimiter: str) -> Column:
    """Split by a regular expression; trailing empty tokens fall away, but an empty text is one empty token."""

    def trimmed(t: Column) -> Column:
        last = F.aggregate(F.transform(t, lambda x, i: F.when(x != "", i + 1).otherwise(0)), F.lit(0), lambda a, x: F.greatest(a, x))
        return F.slice(t, F.lit(1), last)

    return F.when(c == "", F.array(F.lit(""))).otherwise(F.when(c.isNotNull(), once(F.split(c, delimiter), trimmed)))


class MultiCategoryEncoder(Estimator, _Columns, DefaultParamsWritable, DefaultParamsReadable):
    """Delimited lists of levels to the sorted distinct indices of their levels, or to multi-hot vectors. NULL stays NULL."""

    delimiter = Param(Params._dummy(), "delimiter", "regular expression between tokens", typeConverter=TypeConverters.toString)
    indexOnly = CategoryEncoder.indexOnly
    outputSparse = Param(Params._dummy(), "outputSparse", "sparse multi-hot vectors", typeConverter=TypeConverters.toBoolean)
    categoriesReserved = CategoryEncoder.categoriesReserved

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, delimiter=",", indexOnly=True, outputSparse=True, dropInputCols=False, categoriesReserved=0) -> None:  # noqa: ANN001
        super().__init__()
        self._setDefault(delimiter=",", indexOnly=True, outputSparse=True, dropInputCols=False, categoriesReserved=0)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> MultiCategoryEncoderModel:
        self._check(df.schema, (T.StringType,))
        ins = self.getInputCols()
        cells = F.array(*[F.struct(F.lit(i).alias("col"), split_tokens(F.col(f"`{c}`"), self.getOrDefault("delimiter")).alias("t")) for i, c in enumerate(ins)])
        counts = df.select(F.inline(cells)).select("col", F.explode("t").alias("level")).groupBy("col", "level").count()
        ranked = ordered_levels(counts, "frequencyDesc", self.getOrDefault("categoriesReserved"))
        return self._copyValues(MultiCategoryEncoderModel()._set(content=_Levels.fitted(ranked, len(ins))))


class MultiCategoryEncoderModel(Model, _Columns, _Levels):
    delimiter, indexOnly, outputSparse, categoriesReserved = MultiCategoryEncoder.delimiter, MultiCategoryEncoder.indexOnly, MultiCategoryEncoder.outputSparse, MultiCategoryEncoder.categoriesReserved

    def __init__(self) -> None:
        super().__init__()
        self._setDefault(delimiter=",", indexOnly=True, outputSparse=True, dropInputCols=False, categoriesReserved=0)

    def _indices(self, df: DataFrame) -> tuple[DataFrame, list[Column]]:
        """`df` with what the lookups need, and per input column array<int> of the sorted distinct indices.

        Lists in the model are looked up by an Arrow function; tables, which may be large, by a join on the single tokens.
        """
        got, out = self._data(), []
        for i, (c, n) in enumerate(zip(self.getInputCols(), self._sizes(), strict=True)):
            tokens = split_tokens(F.col(f"`{c}`"), self.getOrDefault("delimiter"))
            if isinstance(got, list):
                out.append(_indices_of(tokens, got[i]))
                continue
            # rows are numbered and kept, so that the tokens' indices find back to them
            df = cut(df.withColumn(f"__row{i}", F.monotonically_increasing_id()))
            single = df.select(F.col(f"__row{i}").alias("__r"), F.explode(tokens).alias("__t"))
            found = single.join(self._level_table(df.sparkSession, i), F.col("__t") == F.col("level"), "left")
            lists = found.groupBy("__r").agg(F.array_sort(F.collect_set(F.coalesce("idx", F.lit(n)))).alias(f"__set{i}"))
            df = df.join(lists, F.col(f"__row{i}") == F.col("__r"), "left").drop("__r")
            out.append(F.when(F.col(f"`{c}`").isNotNull(), F.coalesce(f"__set{i}", F.array().cast("array<int>"))))
        return df, out

    def _transform(self, df: DataFrame) -> DataFrame:
        self._check(df.schema, (T.StringType,))
        own, new = df.columns, []
        wide, found = self._indices(df)
        for idx, n in zip(found, self._sizes(), strict=True):
            if self.getOrDefault("indexOnly"):
                new.append(_vector(idx.cast("array<double>")))
                continue
            hot = multi_hot(idx, n + 1)
            new.append(hot if self.getOrDefault("outputSparse") else _dense(hot))
        return self._append(wide, new, own)


def _vector(a: Column) -> Column:
    """A dense vector; NULL stays NULL, which the built-in conversion alone doesn't allow."""
    return F.when(a.isNotNull(), array_to_vector(F.coalesce(a, F.array().cast("array<double>"))))


def _dense(v: Column) -> Column:
    """The same vector in dense form."""
    return _vector(F.when(v.isNotNull(), vector_to_array(v)))


def clean_splits(quantiles: list[float]) -> list[float]:
    """Bucket borders from quantiles at i/n: the ends open, repeated borders once, ascending."""
    inner = sorted(set(quantiles[1:-1]))
    return [-float("inf"), *[x for x in inner if abs(x) != float("inf")], float("inf")]


def bucket_index(value: Column, splits: list[float], null_as_zero: bool = False) -> Column:
    """Left-closed buckets, the last one closed; NaN, and NULL unless null_as_zero, get the index after the last bucket."""
    x = F.coalesce(value.cast("double"), F.lit(0.0 if null_as_zero else float("nan")))
    inner = [float(s) for s in splits[1:-1]]

    def search(lo: int, hi: int) -> Column:
        """Halves the borders, so a value is compared with a logarithm of them."""
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(x >= inner[mid], search(mid + 1, hi)).otherwise(search(lo, mid))

    return F.when(F.isnan(x), len(splits) - 1).otherwise(search(0, len(inner))).cast("int")


class NumericBucketer(Estimator, _Columns, DefaultParamsWritable, DefaultParamsReadable):
    """Equal-frequency buckets. relativeError = 0 takes exact quantiles, else one sketch pass over all columns."""

    numBucketsArray = Param(Params._dummy(), "numBucketsArray", "buckets per column, two at least", typeConverter=TypeConverters.toListInt)
    relativeError = Param(Params._dummy(), "relativeError", "rank error of the quantiles", typeConverter=TypeConverters.toFloat)
    indexOnly, outputSparse = CategoryEncoder.indexOnly, MultiCategoryEncoder.outputSparse
    nullAsZero = Param(Params._dummy(), "nullAsZero", "bucket NULL as 0", typeConverter=TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, numBucketsArray=None, relativeError=5e-4, indexOnly=True, outputSparse=True, dropInputCols=False, nullAsZero=False) -> None:  # noqa: ANN001
        super().__init__()
        self._setDefault(relativeError=5e-4, indexOnly=True, outputSparse=True, dropInputCols=False, nullAsZero=False)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> NumericBucketerModel:
        self._check(df.schema, (T.NumericType,))
        ins, ns = self.getInputCols(), self.getOrDefault("numBucketsArray")
        if len(ns) != len(ins) or min(ns) < 2:
            raise EngineError("numBucketsArray needs a number of two or more for each input column")
        nums = df.select(*[F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")).alias(f"x{i}") for i, c in enumerate(ins)])
        err, splits = self.getOrDefault("relativeError"), []
        grids = [[j / n for j in range(n + 1)] for n in ns]
        if err:
            row = nums.agg(*[F.percentile_approx(f"x{i}", g, max(1, round(1 / err))).alias(f"q{i}") for i, g in enumerate(grids)]).head()
            splits = [clean_splits(row[i] or []) for i in range(len(ins))]
        else:
            long = nums.select(F.inline(F.array(*[F.struct(F.lit(str(i)).alias("feat_name"), F.col(f"x{i}").alias("v")) for i in range(len(ins))])))
            got = {(r[0], r[1]): r[2] for r in exact_quantiles(long, sorted({p for g in grids for p in g})).collect()}
            splits = [clean_splits([got[str(i), p] for p in g] if (str(i), 0.0) in got else []) for i, g in enumerate(grids)]
        return self._copyValues(NumericBucketerModel()._set(content=json.dumps(splits)))


class NumericBucketerModel(Model, _Columns, _WithData):
    numBucketsArray, relativeError, indexOnly, outputSparse, nullAsZero = NumericBucketer.numBucketsArray, NumericBucketer.relativeError, NumericBucketer.indexOnly, NumericBucketer.outputSparse, NumericBucketer.nullAsZero

    def __init__(self) -> None:
        super().__init__()
        self._setDefault(relativeError=5e-4, indexOnly=True, outputSparse=True, dropInputCols=False, nullAsZero=False)

    @property
    def splits_array(self) -> list[list[float]]:
        return self._data()

    def _transform(self, df: DataFrame) -> DataFrame:
        self._check(df.schema, (T.NumericType,))
        new = []
        for c, s in zip(self.getInputCols(), self.splits_array, strict=True):
            at = bucket_index(F.col(f"`{c}`"), s, self.getOrDefault("nullAsZero"))
            if self.getOrDefault("indexOnly"):
                new.append(at)
            else:
                hot = one_hot(at, len(s))
                new.append(hot if self.getOrDefault("outputSparse") else _dense(hot))
        return self._append(df, new)


class NumericStandardizer(Estimator, _Columns, DefaultParamsWritable, DefaultParamsReadable):
    """(x - mean) / unbiased std; NULL gives NaN, a std of zero NaN or infinity."""

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, dropInputCols=False) -> None:  # noqa: ANN001
        super().__init__()
        self._setDefault(dropInputCols=False)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> NumericStandardizerModel:
        self._check(df.schema, (T.NumericType,))
        xs = [F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")) for c in self.getInputCols()]
        row = df.agg(*[a for x in xs for a in (F.avg(x), F.stddev_samp(x))]).head()
        pairs = [[row[2 * i], row[2 * i + 1]] for i in range(len(xs))]
        return self._copyValues(NumericStandardizerModel()._set(content=json.dumps(pairs)))


class NumericStandardizerModel(Model, _Columns, _WithData):
    def __init__(self) -> None:
        super().__init__()
        self._setDefault(dropInputCols=False)

    @property
    def mean_std(self) -> list[list[float | None]]:
        return self._data()

    def _transform(self, df: DataFrame) -> DataFrame:
        self._check(df.schema, (T.NumericType,))
        new = []
        for c, (mean, std) in zip(self.getInputCols(), self.mean_std, strict=True):
            x = F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(float("nan"))) - F.lit(float("nan") if mean is None else mean)
            if std:
                new.append(x / F.lit(std))
            else:  # ANSI division by zero raises, so the IEEE result is spelled out
                new.append(F.when(F.isnan(x) | (x == 0), float("nan")).otherwise(F.signum(x) * F.lit(float("inf"))))
        return self._append(df, new)


class ColumnEliminator(Transformer, HasInputCols, DefaultParamsWritable, DefaultParamsReadable):
    """Drops columns; names that don't exist are ignored."""

    @keyword_only
    def __init__(self, *, inputCols=None) -> None:  # noqa: ANN001
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.drop(*self.getInputCols())


class ColumnRenamer(Transformer, HasInputCols, HasOutputCols, DefaultParamsWritable, DefaultParamsReadable):
    """Renames columns by position."""

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None) -> None:  # noqa: ANN001
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        ins, outs = self.getInputCols(), self.getOutputCols()
        if len(ins) != len(outs):
            raise EngineError(f"{len(ins)} input columns, {len(outs)} output columns")
        return df.withColumnsRenamed(dict(zip(ins, outs, strict=True)))


class VectorMerger(Transformer, HasInputCols, HasOutputCols, DefaultParamsWritable, DefaultParamsReadable):
    """Numbers and vectors side by side in one dense vector. A NULL number becomes NaN, a NULL vector makes the result NULL."""

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None) -> None:  # noqa: ANN001
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        parts = [vector_to_array(f"`{c}`") if isinstance(df.schema[c].dataType, VectorUDT) else F.array(F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(float("nan")))) for c in self.getInputCols()]
        return df.withColumn(self.getOutputCols()[0], _vector(F.concat(*parts)))


FEATURES_COL, LABEL_COL, SUFFIX = "features_processed", "label_processed", "_processed"
METHODS = ("normalize", "bucketize", "remain")


def build_pipeline(schema: SemanticSchema, method_for_num: str = "normalize", one_hot_num: bool = False, one_hot_cat: bool = False, one_hot_multi: bool = True, merge: bool = True, num_buckets: int = 40, relative_error: float = 5e-4, reserved_cat: int = 0, reserved_multi: int = 0, delimiter: str = ",") -> Pipeline:
    """Drop `Other` columns, process numbers, categories and lists of categories, merge them into one vector, index the label.

    The label is indexed by frequency, so the most frequent class becomes 0. Lists of indices have no fixed length, so merging
    them needs one_hot_multi.
    """
    if method_for_num not in METHODS:
        raise EngineError(f"method_for_num is one of {METHODS}")
    if merge and schema.multi_cat and not one_hot_multi:
        raise EngineError("index lists of multi-category columns vary in length and can't be merged; set one_hot_multi")
    stages: list = [ColumnEliminator(inputCols=schema.other)] if schema.other else []
    out = lambda cs: [c + SUFFIX for c in cs]
    merged: list[str] = []
    if schema.num:
        if method_for_num == "normalize":
            stages.append(NumericStandardizer(inputCols=schema.num, outputCols=out(schema.num), dropInputCols=True))
        elif method_for_num == "bucketize":
            stages.append(NumericBucketer(inputCols=schema.num, outputCols=out(schema.num), numBucketsArray=[num_buckets] * len(schema.num), relativeError=relative_error, indexOnly=not one_hot_num, outputSparse=False, dropInputCols=True))
        else:
            stages.append(ColumnRenamer(inputCols=schema.num, outputCols=out(schema.num)))
        merged += out(schema.num)
    if schema.cat:
        stages.append(CategoryEncoder(inputCols=schema.cat, outputCols=out(schema.cat), indexOnly=not one_hot_cat, dropInputCols=True, categoriesReserved=reserved_cat))
        merged += out(schema.cat)
    if schema.multi_cat:
        stages.append(MultiCategoryEncoder(inputCols=schema.multi_cat, outputCols=out(schema.multi_cat), delimiter=delimiter, indexOnly=not one_hot_multi, outputSparse=False, dropInputCols=True, categoriesReserved=reserved_multi))
        merged += out(schema.multi_cat)
    if merge and merged:
        stages += [VectorMerger(inputCols=merged, outputCols=[FEATURES_COL]), ColumnEliminator(inputCols=merged)]
    if schema.label:
        stages.append(CategoryEncoder(inputCols=schema.label[:1], outputCols=[LABEL_COL], dropInputCols=True))
    return Pipeline(stages=stages)


def pipeline_fit_transform(df: DataFrame, schema: SemanticSchema, **options: object) -> tuple[DataFrame, PipelineModel]:
    model = build_pipeline(schema, **options).fit(df)
    return model.transform(df), model


def bucket_of(x: float, splits: list[float]) -> int:
    """One value's bucket, for checks on the driver."""
    return len(splits) - 1 if x != x else max(0, bisect.bisect_right(splits[1:-1], x))
