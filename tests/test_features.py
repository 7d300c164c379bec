"""Feature operators, sources, filters, functions."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from grainmill.features import transformers as X
from grainmill.functions import bits, cityhash, linalg
from grainmill.operators import filters
from grainmill.plans import feature_queries
from grainmill.schema import EngineError, parse_schema, read_schema
from grainmill.sources import files


def cats(spark, xs):
    return spark.createDataFrame([(x,) for x in xs], "c string")


def col(df, c):
    return [r[c] for r in df.collect()]


def test_category_order_ties_unseen(spark):
    df = cats(spark, ["b", "a", "c", "c", None])
    m = X.CategoryEncoder(inputCols=["c"], outputCols=["i"]).fit(df)
    assert m.labels == [["c", "a", "b"]] and col(m.transform(df), "i") == [2, 1, 0, 0, 3]
    assert X.CategoryEncoder(inputCols=["c"], outputCols=["i"], stringOrderType="alphabetDesc").fit(df).labels == [["c", "b", "a"]]
    top = X.CategoryEncoder(inputCols=["c"], outputCols=["i"], categoriesReserved=1).fit(df)
    assert col(top.transform(df), "i") == [1, 1, 0, 0, 1]
    hot = X.CategoryEncoder(inputCols=["c"], outputCols=["i"], indexOnly=False, dropInputCols=True).fit(df).transform(df)
    assert hot.columns == ["i"] and hot.collect()[4]["i"].toArray().tolist() == [0, 0, 0, 1]
    with pytest.raises(Exception, match="wasn't fitted"):
        X.CategoryEncoder(inputCols=["c"], outputCols=["i"], handleInvalid="error").fit(df.na.drop()).transform(df).collect()


def test_many_levels_and_empty(spark):
    xs = [f"v{i:03}" for i in range(200)]
    df = cats(spark, xs + [None])
    m = X.CategoryEncoder(inputCols=["c"], outputCols=["i"]).fit(df)
    assert col(m.transform(df), "i") == [*range(200), 200]
    assert col(X.CategoryEncoder(inputCols=["c"], outputCols=["i"]).fit(df.limit(0)).transform(df.limit(1)), "i") == [0]
    mm = X.MultiCategoryEncoder(inputCols=["c"], outputCols=["i"]).fit(df)
    assert col(mm.transform(cats(spark, ["v001,v000,zz", None])), "i")[0].toArray().tolist() == [0, 1, 200]


def test_schema_checks(spark):
    df = cats(spark, ["a"])
    with pytest.raises(EngineError):
        X.CategoryEncoder(inputCols=["c"], outputCols=["c"]).fit(df)
    with pytest.raises(EngineError):
        X.CategoryEncoder(inputCols=["c", "c"], outputCols=["i"]).fit(df)
    with pytest.raises(EngineError):
        X.NumericStandardizer(inputCols=["c"], outputCols=["i"]).fit(df)


def test_multi_category(spark):
    df = cats(spark, ["a,b", "b,b,c", "", None, "a,b,,"])
    m = X.MultiCategoryEncoder(inputCols=["c"], outputCols=["v"]).fit(df)
    assert m.labels[0][0] == "b" and set(m.labels[0]) == {"a", "b", "c", ""}
    got = col(m.transform(df), "v")
    assert got[3] is None and got[0].toArray().tolist() == sorted([m.labels[0].index("a"), m.labels[0].index("b")]) and len(got[4]) == 2
    hot = X.MultiCategoryEncoder(inputCols=["c"], outputCols=["v"], indexOnly=False).fit(df).transform(df)
    dense = X.MultiCategoryEncoder(inputCols=["c"], outputCols=["v"], indexOnly=False, outputSparse=False).fit(df).transform(df)
    a, b = col(hot, "v"), col(dense, "v")
    assert a[3] is None and b[3] is None and all(x.toArray().tolist() == y.toArray().tolist() for x, y in zip(a, b, strict=True) if x is not None)


def test_bucketer_edges(spark):
    xs = [float(i) for i in range(1, 11)] + [None, float("nan"), float("-inf"), float("inf")]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    m = X.NumericBucketer(inputCols=["x"], outputCols=["b"], numBucketsArray=[4], relativeError=0.0).fit(df)
    s = m.splits_array[0]
    assert s[0] == -math.inf and s[-1] == math.inf and s == sorted(set(s))
    assert col(m.transform(df), "b") == [X.bucket_of(float("nan") if x is None else x, s) for x in xs]
    const = X.NumericBucketer(inputCols=["x"], outputCols=["b"], numBucketsArray=[5]).fit(spark.createDataFrame([(2.0,)] * 5, "x double"))
    assert len(const.splits_array[0]) == 3
    zero = X.NumericBucketer(inputCols=["x"], outputCols=["b"], numBucketsArray=[4], nullAsZero=True).fit(df)
    assert col(zero.transform(df), "b")[10] == 0
    hot = X.NumericBucketer(inputCols=["x"], outputCols=["b"], numBucketsArray=[2], indexOnly=False).fit(df).transform(df)
    assert all(v.toArray().sum() == 1 for v in col(hot, "b"))


def test_standardizer(spark):
    df = spark.createDataFrame([(1, 5.0), (3, 5.0), (None, 5.0)], "x int, k double")
    out = X.NumericStandardizer(inputCols=["x", "k"], outputCols=["a", "b"]).fit(df).transform(df)
    a = col(out, "a")
    assert a[0] == pytest.approx(-1 / math.sqrt(2)) and math.isnan(a[2]) and all(math.isnan(v) for v in col(out, "b"))


@pytest.mark.parametrize("make", [
    lambda: X.CategoryEncoder(inputCols=["c"], outputCols=["o"]),
    lambda: X.MultiCategoryEncoder(inputCols=["c"], outputCols=["o"], outputSparse=False, indexOnly=False),
    lambda: X.NumericBucketer(inputCols=["x"], outputCols=["o"], numBucketsArray=[3]),
    lambda: X.NumericStandardizer(inputCols=["x"], outputCols=["o"]),
])
def test_save_and_load(spark, tmp_path, make):
    df = spark.createDataFrame([("a,b", 1.0), ("b", 2.0), (None, None)], "c string, x double")
    m = make().fit(df)
    m.write().overwrite().save(str(tmp_path / "m"))
    assert str(type(m).load(str(tmp_path / "m")).transform(df).collect()) == str(m.transform(df).collect())


def test_pipeline(spark):
    df = spark.createDataFrame([("k", 1.0, "a", "t1,t2", "0"), ("k", 3.0, "b", None, "1"), ("k", 5.0, "a", "t1", "0")], "k string, x double, c string, m string, y string")
    s = parse_schema(["k;Other", "x;Num", "c;Cat", "m;MultiCat", "y;Label"])
    out, model = X.pipeline_fit_transform(df.where("m IS NOT NULL"), s, method_for_num="remain")
    assert out.columns == [X.FEATURES_COL, X.LABEL_COL] and col(out, X.LABEL_COL) == [0, 0]
    again, _ = X.pipeline_fit_transform(df.where("m IS NOT NULL"), s, method_for_num="remain")
    assert again.collect() == out.collect()
    with pytest.raises(EngineError):
        X.build_pipeline(s, one_hot_multi=False)


def test_schema_file(spark, tmp_path):
    (tmp_path / "s").write_text("age;Num\n\ny;Label\n")
    s = read_schema(spark, str(tmp_path / "s"))
    assert s.num == ["age"] and s.struct.simpleString() == "struct<age:double,y:string>"
    for bad in (["a;Nope"], ["a"]):
        with pytest.raises(EngineError):
            parse_schema(bad)
    with pytest.raises(EngineError):
        parse_schema(["a;Num"], one_label=True)


def lines(spark, xs):
    return spark.createDataFrame([(x,) for x in xs], "value string")


def test_libsvm_flags(spark):
    df = lines(spark, ["-1 3:2 1:1.5", "1 1:x 2:3", "", None])
    r = files.parse_libsvm(df, one_based=True, need_sort=True, rescale_binary_label=True).collect()
    assert (r[0]["label"], r[0]["indices"], r[0]["values"]) == (0.0, [0, 2], [1.5, 2.0]) and r[1]["values"] == [None, 3.0] and len(r) == 2
    for bad in ("1", "1 3"):
        with pytest.raises(Exception, match="not a LibSVM line"):
            files.parse_libsvm(lines(spark, [bad]), check=True).collect()
    a = spark.createDataFrame([(1.0, Vectors.sparse(4, [1, 3], [0.5, 0.0])), (0.0, Vectors.dense([1, 0, 2]))], ["label", "features"])
    assert col(files.libsvm_lines(a, "label", "features"), "value") == ["1.0 1:0.5 3:0.0", "0.0 0:1.0 1:0.0 2:2.0"]


def test_custom_reader(spark, tmp_path):
    (tmp_path / "f.txt").write_text("1 0:2.0 3:1.5\n0 1:1\n")
    out = files.read_libsvm_custom(spark, str(tmp_path / "f.txt"), 4)
    assert sorted((r["label"], r["features"].toArray().tolist()) for r in out.collect()) == [(0.0, [0, 1, 0, 0]), (1.0, [2, 0, 0, 1.5])]


def test_sparse_lines_last_wins(spark):
    got = col(files.parse_sparse_lines(lines(spark, ["a:1,b:2,a:3", "x", "", None])), "features")
    assert got == [{"a": "3", "b": "2"}, {}, {}, None]


def test_model_text(spark):
    p = spark.createDataFrame([(5, [1.0, 2.5, 3.0]), (6, [0.0])], "id bigint, w array<float>")
    assert col(files.model_lines(p), "value") == ["5\t1.0\t2.5\t3.0", "6\t0.0"]
    assert col(files.model_lines(p, start=1, end=2), "value")[0] == "5\t2.5"
    assert files.parse_model(files.model_lines(p)).collect() == p.collect()


RULES = "[filter=1]\n# comment\ncity={bj,sh}\nage=[18,#]\nsex={m};city={gz}\n[filter=0]\nos={ios}\n[col]\nip=1\nage=0\n"


def rec(**f):
    return "1 \x01" + "\x01".join(f" {k}\x03{c}\x02{v} " for k, (c, v) in f.items())


def test_filter_rules(spark):
    r = filters.parse_rules(RULES)
    assert r.columns == ["ip"] and len(r.drop) == 3 and len(r.keep) == 1
    df = lines(spark, [rec(city=("bj", 1)), rec(xcity=("bj", 1), ip=("a", 1)), rec(age=("", 18)), rec(age=("", 17.9)), rec(sex=("m", 1), city=("gz", 1)), rec(sex=("m", 1)), rec(os=("web", 1)), rec(os=("ios", 1)), rec(age=("", "x"))])
    rows = filters.filter_records(filters.parse_records(df), r).collect()
    kept = [[f["name"] for f in x["feats"]] for x in rows]
    assert kept == [["xcity"], ["age"], ["sex"], ["os"], ["age"]]
    for bad in ("city={a}", "[filter=1]\ncity=a"):
        with pytest.raises(EngineError):
            filters.parse_rules(bad)
    ids = filters.hash_records(filters.parse_records(df)).collect()
    assert ids[0]["ids"] != ids[1]["ids"] and ids[2]["vals"] == [18.0]


def test_functions(spark):
    df = spark.createDataFrame([(255, [1.0, 2.0], {"a": 2.0}, {"a": 3.0, "b": 1.0}), (-1, [0.0, 1.0], {}, {"b": 1.0})], "n bigint, v array<double>, m map<string,double>, k map<string,double>")
    r = df.select(bits.hex_string(F.col("n"), 4).alias("h"), bits.extract_bits(F.col("n"), 4, 8).alias("e"), bits.unsigned(F.col("n"), 8).alias("u"), bits.bytes_int(bits.int_bytes(F.col("n"))).alias("b"), linalg.array_dot(F.col("v"), F.col("v")).alias("d"), linalg.map_dot(F.col("m"), F.col("k")).alias("md"), linalg.map_axpy(2.0, F.col("m"), F.col("k")).alias("ax")).collect()
    assert tuple(r[0]) == ("00ff", 15, 255, 255, 5.0, 6.0, {"a": 7.0, "b": 1.0})
    assert r[1]["b"] == -1 and r[1]["u"] == 255 and r[1]["e"] == 15
    assert bits.bytes_float(bits.float_bytes([1.5, -2.0]), start=1) == [-2.0] and bits.bytes_int_array(bits.int_array_bytes([1, -2, 3])) == [1, -2, 3]
    x = np.array([1.0, 2.0, 3.0])
    full = linalg.symmetric_rank_one(2.0, x, np.zeros((3, 3)))
    packed = linalg.packed_rank_one(2.0, x, np.zeros(6))
    assert np.allclose(linalg.packed_times_vector(packed, x), full @ x)
    assert linalg.combined_dot(2, x, -1, x, x) == pytest.approx(14)


def test_cityhash_known_values(spark):
    # of the published test: the empty string hashes to k2
    assert cityhash.city64(b"") == 0x9AE16A3B2F90404F
    for f in (cityhash.city64, cityhash.city128, lambda b: cityhash.city64_seed(b, 7)):
        assert len({f(b"x" * n) for n in range(400)}) == 400
    got = [r[0] for r in spark.createDataFrame([("a",), (None,), ("",)], "s string").select(cityhash.city_column(F.col("s"))).collect()]
    assert got[1] is None and got[2] == cityhash.signed(0x9AE16A3B2F90404F)


def test_vector_rows(spark):
    df = spark.createDataFrame([(1, Vectors.sparse(3, [2], [5.0]))], ["id", "v"])
    assert [tuple(r) for r in files.vector_rows(df, "id", "v").collect()] == [(1, 0, 0.0), (1, 1, 0.0), (1, 2, 5.0)]
    assert df.select(vector_to_array("v")).head()[0] == [0, 0, 5]


def test_id_queries_keep_every_usable_feature(spark, tmp_path):
    rows = [
        (1, "libffm", "-1 3:1148042581775140483:29.58 0:9223372036854775807:3.7e-2\t1:5:+.5 1:6:7."),
        (2, "libffm", "1 3:9223372036854775808:1 -3:4:1 3:4 3:4:1:2 3:12a:1 3:4:1e 3:4:nan 3:4:1e999 3:8:-2"),
        (3, "libffm", "yes 1:2:3"),
        (4, "libsvm", "+1. 1906:3.7e-2 9223372036854775807:2 7: 8:1f 9:1"),
        (5, "libsvm", ""),
        (6, "libsvm", None),
    ]
    spark.createDataFrame(rows, "line_no bigint, feed string, line string").write.parquet(str(tmp_path / "raw_samples.parquet"))
    got = sorted((*x[:-1], round(x[-1], 3)) for x in feature_queries.libffm_parse(spark, str(tmp_path)).collect())
    assert got == [(1, 0.0, 0, 2**63 - 1, 0.037), (1, 0.0, 1, 5, 0.5), (1, 0.0, 1, 6, 7.0), (1, 0.0, 3, 1148042581775140483, 29.58), (2, 1.0, 3, 8, -2.0)]
    got = sorted((*x[:-1], round(x[-1], 3)) for x in feature_queries.libsvm_ids_parse(spark, str(tmp_path)).collect())
    assert got == [(4, 1.0, 9, 1.0), (4, 1.0, 1906, 0.037), (4, 1.0, 2**63 - 1, 2.0)]


@pytest.mark.parametrize("name", ["pipeline_normalize", "pipeline_remain", "pipeline_bucketize"])
def test_pipeline_queries_take_rows_with_missing_numbers(spark, sf, name):
    n = feature_queries.table(spark, sf, "dense_samples").count()
    got = feature_queries.QUERIES[name](spark, sf)
    assert [x["n"] for x in got.groupBy("idx").agg(F.sum("n").alias("n")).collect()] == [n] * 3


def test_missing_numbers_are_in_the_bucket_after_the_last(spark, sf):
    out, model = X.pipeline_fit_transform(feature_queries.dense(spark, sf).select("age", "label"), parse_schema(["age;Num", "label;Label"]), method_for_num="bucketize", num_buckets=8)
    missing = feature_queries.dense(spark, sf).where("age IS NULL").count()
    assert missing and missing == sum(v[0] == len(model.stages[0].splits_array[0]) - 1 for v in col(out, X.FEATURES_COL))


def test_cat_unseen_null_transforms_every_row(spark, sf):
    assert feature_queries.cat_unseen_null(spark, sf).count() == feature_queries.table(spark, sf, "dense_samples").count()


@pytest.mark.parametrize("broadcast", [0, 64 << 20])
def test_many_levels_are_kept_as_a_table(spark, monkeypatch, tmp_path, broadcast):
    df = spark.createDataFrame([(f"v{i % 37}" if i % 11 else None, ",".join(f"t{j}" for j in (i % 5, i % 7, i % 5))) for i in range(300)] + [(None, None), ("", "")], "c string, m string")
    small = X.CategoryEncoder(inputCols=["c"], outputCols=["i"]).fit(df)
    multi = X.MultiCategoryEncoder(inputCols=["m"], outputCols=["v"], indexOnly=False).fit(df)
    monkeypatch.setattr(X, "MODEL_LEVELS", 3)
    monkeypatch.setattr(X, "BROADCAST_BYTES", broadcast)
    large = X.CategoryEncoder(inputCols=["c"], outputCols=["i"]).fit(df)
    big = X.MultiCategoryEncoder(inputCols=["m"], outputCols=["v"], indexOnly=False).fit(df)
    assert large._data()["table"] and large.labels == small.labels and big.labels == multi.labels
    unseen = df.union(spark.createDataFrame([("new", "t1,zz")], df.schema)).withColumn("level", F.lit("clash")).withColumn("idx", F.lit(1))
    for a, b in ((small, large), (multi, big)):
        x, y = a.transform(unseen), b.transform(unseen)
        assert x.columns == y.columns and sorted(map(str, x.collect())) == sorted(map(str, y.collect()))
    large.write().overwrite().save(str(tmp_path / "m"))
    again = X.CategoryEncoderModel.load(str(tmp_path / "m")).transform(df)
    assert sorted(map(str, again.collect())) == sorted(map(str, large.transform(df).collect()))


def test_one_hot_vectors_are_sparse(spark):
    df = cats(spark, ["b", "a", None])
    hot = X.CategoryEncoder(inputCols=["c"], outputCols=["i"], indexOnly=False).fit(df).transform(df)
    assert [type(v).__name__ for v in col(hot, "i")] == ["SparseVector"] * 3 and [v.indices.tolist() for v in col(hot, "i")] == [[1], [0], [2]]
    nums = spark.createDataFrame([(float(i),) for i in range(10)] + [(None,)], "x double")
    for sparse in (True, False):
        b = X.NumericBucketer(inputCols=["x"], outputCols=["b"], numBucketsArray=[5], indexOnly=False, outputSparse=sparse).fit(nums).transform(nums)
        assert {type(v).__name__ for v in col(b, "b")} == {"SparseVector" if sparse else "DenseVector"} and all(v.toArray().sum() == 1 for v in col(b, "b"))


def test_bucket_search_against_bisection(spark):
    splits = [-math.inf, *sorted({round(math.sin(i) * 50, 2) for i in range(40)}), math.inf]
    xs = [*splits[1:-1], *[s + 0.001 for s in splits[1:-1]], -1e9, 1e9, math.inf, -math.inf, math.nan, None]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = col(df.select(X.bucket_index(F.col("x"), splits).alias("b")), "b")
    assert got == [X.bucket_of(math.nan if x is None else x, splits) for x in xs]


def test_libsvm_of_a_million_features_stays_sparse(spark, tmp_path):
    (tmp_path / "f.svm").write_text("1 5:2 999999:3 5:4\n-1 1000000:1 7:x\n0\n")
    got = files.read_libsvm_custom(spark, str(tmp_path / "f.svm"), 1_000_000).collect()
    by = {r["label"]: r["features"] for r in got}
    assert by[1.0] == Vectors.sparse(1_000_000, [5, 999_999], [4.0, 3.0]) and by[-1.0] == by[0.0] == Vectors.sparse(1_000_000, [], [])
