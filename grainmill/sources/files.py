"""Tables and feature lines: CSV, LibSVM, id lines, field lines, sparse maps, catalog tables, model text."""

from __future__ import annotations

import re

from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainmill.functions.vectors import sparse_vector
from grainmill.session import BLANKS


#: A decimal number, with optional sign, fraction and exponent, and a whole one, in ASCII digits. Nothing else is read as a number.
_DECIMAL, _WHOLE = r"\A[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z", r"\A[+-]?[0-9]+\z"


def _decimal(c: Column, kind: str = "double") -> Column:
    """A finite decimal number, else NULL."""
    return F.when(c.rlike(_DECIMAL) & (F.abs(c.try_cast(kind)) < float("inf")), c.try_cast(kind))


def _whole(c: Column, kind: str = "bigint") -> Column:
    return F.when(c.rlike(_WHOLE), c.try_cast(kind))


def _tokens(line: Column, sep: str) -> Column:
    """The parts of a line, blanks around it removed; the blank as a separator takes tabs too."""
    return F.filter(F.split(F.trim(line, F.lit(BLANKS)), "[ \t]+" if sep == " " else re.escape(sep)), lambda x: x != "")


def _spread(df: DataFrame, partitions: int) -> DataFrame:
    return df.repartition(partitions) if partitions > 1 else df


def read_csv(spark: SparkSession, path: str, delimiter: str, schema: T.StructType, null_value: str = "", partitions: int = -1, header: bool = False) -> DataFrame:
    """A delimited table with a fixed schema; blanks around values are removed; repartitioned only if partitions > 1."""
    opts = {"sep": delimiter, "nullValue": null_value, "header": header, "ignoreLeadingWhiteSpace": True, "ignoreTrailingWhiteSpace": True}
    return _spread(spark.read.options(**opts).schema(schema).csv(path), partitions)


def write_csv(df: DataFrame, path: str, delimiter: str = ",", partitions: int = -1, header: bool = False) -> None:
    _spread(df, partitions).write.mode("overwrite").options(sep=delimiter, header=header).csv(path)


def read_libsvm(spark: SparkSession, path: str, num_features: int = -1, partitions: int = -1, label: str = "labelLibSVM", features: str = "featuresLibSVM") -> DataFrame:
    """One-based LibSVM files as label and sparse vector, by Spark's own reader."""
    reader = spark.read.format("libsvm")
    if num_features > 0:
        reader = reader.option("numFeatures", str(num_features))
    return _spread(reader.load(path).withColumnRenamed("label", label).withColumnRenamed("features", features), partitions)


def libsvm_lines(df: DataFrame, label: str, features: str, one_based: bool = False) -> DataFrame:
    """(value): `label idx:val ...`. A dense vector or array writes every index, a sparse vector its entries; zero-based by default."""
    base = 1 if one_based else 0
    is_vector = isinstance(df.schema[features].dataType, VectorUDT)
    if is_vector:
        from pyspark.ml.functions import vector_to_array as dense

        # A sparse vector keeps its own entries, zeros included, only as (indices, values) of its struct.
        text = df.select(F.col(label).cast("double").alias("y"), F.col(features).alias("v"), dense(features).alias("a"))
        pairs = _vector_pairs(F.col("v"))
    else:
        text = df.select(F.col(label).cast("double").alias("y"), F.col(features).cast("array<double>").alias("a"))
        pairs = F.transform("a", lambda x, i: F.struct(i.cast("bigint").alias("i"), x.alias("x")))
    items = F.transform(pairs, lambda p: F.concat_ws(":", (p["i"] + base).cast("string"), p["x"].cast("string")))
    return text.select(F.concat_ws(" ", F.col("y").cast("string"), F.array_join(items, " ")).alias("value"))


def _vector_pairs(v: Column) -> Column:
    """array<struct<i,x>> of a vector column, by its JSON form (built in, no Python)."""
    j = F.to_json(F.struct(v.alias("v")))
    kind = F.get_json_object(j, "$.v.type")
    vals = F.from_json(F.get_json_object(j, "$.v.values"), "array<double>")
    idx = F.when(kind == "0", F.from_json(F.get_json_object(j, "$.v.indices"), "array<bigint>")).otherwise(F.transform(vals, lambda _, i: i.cast("bigint")))
    return F.zip_with(idx, vals, lambda i, x: F.struct(i.alias("i"), x.alias("x")))


def write_libsvm(df: DataFrame, path: str, label: str, features: str, one_based: bool = False, partitions: int = -1) -> None:
    _spread(libsvm_lines(df, label, features, one_based), partitions).write.mode("overwrite").text(path)


def parse_libsvm(lines: DataFrame, line: str = "value", one_based: bool = False, need_sort: bool = False, rescale_binary_label: bool = False, ext_delimiter: str = " ", int_delimiter: str = ":", check: bool = False) -> DataFrame:
    """The columns of `lines` but the line itself, and label, indices, values: indices are zero-based in the result.

    rescale_binary_label maps -1 and 1 to 0 and 1. need_sort orders by index. check raises for a line without pairs or a pair
    without two parts; without it an unreadable number is NULL. Blank and NULL lines are dropped (with check they raise).
    """
    parts = _tokens(F.col(line), ext_delimiter)
    rows = lines.withColumn("__t", parts)
    rest = F.slice(F.col("__t"), 2, F.greatest(F.size("__t") - 1, F.lit(0)))
    pairs = F.transform(rest, lambda x: F.split(x, re.escape(int_delimiter)))
    if check:
        bad = (F.coalesce(F.size("__t"), F.lit(0)) < 2) | F.exists(F.coalesce(pairs, F.array().cast("array<array<string>>")), lambda p: F.size(p) < 2)
        rows = rows.withColumn("__t", F.when(bad, F.raise_error(F.concat(F.lit("not a LibSVM line: "), F.coalesce(F.col(line), F.lit("NULL")))).cast("array<string>")).otherwise(F.col("__t")))
    else:
        rows = rows.where(F.size("__t") > 0)
    y = _decimal(F.get("__t", 0))
    cells = F.transform(pairs, lambda p: F.struct((_whole(F.get(p, 0)) - (1 if one_based else 0)).alias("i"), _decimal(F.get(p, 1)).alias("x")))
    cells = F.array_sort(cells) if need_sort else cells
    keep = [c for c in lines.columns if c != line]
    out = rows.select(*keep, ((y + 1) / 2 if rescale_binary_label else y).alias("label"), cells.alias("c"))
    return out.select(*keep, "label", F.col("c")["i"].alias("indices"), F.col("c")["x"].alias("values"))


def read_libsvm_custom(spark: SparkSession, path: str, num_features: int, partitions: int = 2, label: str = "label", features: str = "features", **flags: object) -> DataFrame:
    """LibSVM files with free delimiters and base as label and sparse vector of `num_features` slots.

    Later pairs of one index win; pairs beyond the slots or that can't be read are left out.
    """
    parsed = parse_libsvm(spark.read.text(path), **flags)
    return _spread(parsed.select(F.col("label").alias(label), sparse_vector(F.col("indices"), F.col("values"), num_features).alias(features)), partitions)


def read_table(spark: SparkSession, name: str, partitions: int = -1) -> DataFrame:
    """A catalog table or view."""
    return _spread(spark.read.table(name), partitions)


def _feature_parts(line: Column, sep: str, width: int) -> tuple[Column, Column]:
    """Label (NULL if it is no number) and the parts of each feature; one of another number of parts has none that can be read."""
    t = _tokens(line, sep)
    y = _decimal(F.get(t, 0))
    parts = F.transform(F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))), lambda x: F.split(x, ":"))
    return F.when(y.isNotNull(), F.when(y > 0, 1.0).otherwise(0.0)), F.transform(parts, lambda p: F.when(F.size(p) == width, p))


def parse_id_lines(lines: DataFrame, line: str = "value", sep: str = " ") -> DataFrame:
    """`label id:val ...` as label (1 if > 0, else 0), ids array<bigint>, vals array<float>; other columns are kept. What can't be read is NULL."""
    label, pairs = _feature_parts(F.col(line), sep, 2)
    keep = [c for c in lines.columns if c != line]
    return lines.select(*keep, label.alias("label"), F.transform(pairs, lambda p: _whole(F.get(p, 0))).alias("ids"), F.transform(pairs, lambda p: _decimal(F.get(p, 1), "float")).alias("vals"))


def parse_field_lines(lines: DataFrame, line: str = "value", sep: str = " ") -> DataFrame:
    """`label field:id:val ...` as label, fields array<int>, ids array<bigint>, vals array<float>; other columns are kept. What can't be read is NULL."""
    label, triples = _feature_parts(F.col(line), sep, 3)
    keep = [c for c in lines.columns if c != line]
    part = lambda i, t: F.transform(triples, lambda p: _whole(F.get(p, i), t))
    vals = F.transform(triples, lambda p: _decimal(F.get(p, 2), "float"))
    return lines.select(*keep, label.alias("label"), part(0, "int").alias("fields"), part(1, "bigint").alias("ids"), vals.alias("vals"))


def parse_sparse_lines(lines: DataFrame, line: str = "value", ext_delimiter: str = ",", int_delimiter: str = ":") -> DataFrame:
    """`k:v,k:v` as features map<string,string>; the last value of a repeated key wins; other columns are kept."""
    pairs = F.transform(F.split(F.col(line), re.escape(ext_delimiter)), lambda x: F.split(x, re.escape(int_delimiter), 2))
    entries = F.transform(F.filter(pairs, lambda p: F.size(p) == 2), lambda p: F.struct(F.get(p, 0).alias("k"), F.get(p, 1).alias("v")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: o["k"] == e["k"]))
    keep = [c for c in lines.columns if c != line]
    return lines.select(*keep, F.map_from_entries(last).alias("features"))


def explode_samples(samples: DataFrame, key: str = "sample_id") -> DataFrame:
    """(key, label, [field,] feat, val): one row a feature of each sample."""
    cols = ["ids", "vals"] + (["fields"] if "fields" in samples.columns else [])
    z = samples.select(key, "label", F.explode(F.arrays_zip(*cols)).alias("z"))
    field = [F.col("z.fields").alias("field")] if "fields" in cols else []
    return z.select(key, "label", *field, F.col("z.ids").alias("feat"), F.col("z.vals").alias("val"))


def model_lines(params: DataFrame, key: str = "id", weights: str = "w", start: int = 0, end: int | None = None) -> DataFrame:
    """(value): `id<TAB>w0<TAB>w1...`, optionally only the weights [start, end)."""
    w = F.col(weights)
    if start or end is not None:
        w = F.slice(w, start + 1, F.greatest((F.lit(end) if end is not None else F.size(w)) - start, F.lit(0)))
    return params.select(F.concat_ws("\t", F.col(key).cast("string"), F.array_join(F.transform(w, lambda x: x.cast("string")), "\t")).alias("value"))


def write_model(params: DataFrame, path: str, **kw: object) -> None:
    """The model as text, replacing what is at `path`. The parameter table stays."""
    model_lines(params, **kw).write.mode("overwrite").text(path)


def parse_model(lines: DataFrame, line: str = "value") -> DataFrame:
    """(id, w) from `id<TAB>w0<TAB>w1...`."""
    t = F.split(F.col(line), "\t")
    return lines.select(F.get(t, 0).try_cast("bigint").alias("id"), F.transform(F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))), lambda x: x.try_cast("float")).alias("w"))


def read_model(spark: SparkSession, path: str) -> DataFrame:
    return parse_model(spark.read.text(path))


def vector_rows(df: DataFrame, key: str, features: str) -> DataFrame:
    """(key, idx, value): a vector or array column as rows, zeros included."""
    a = vector_to_array(features) if isinstance(df.schema[features].dataType, VectorUDT) else F.col(features)
    return df.select(key, F.posexplode(a).alias("idx", "value"))
