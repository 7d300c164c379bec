"""Profiles, two-sample tests and ranking on hand-made frames, and against brute force."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainmill.operators import ks, profile, ranking
from grainmill.operators.running import exact_quantiles, running_total


def num(spark, xs, ys=None):
    ys = ys or [None] * len(xs)
    return spark.createDataFrame(list(zip(xs, ys, strict=True)), "x double, y string")


def test_moments_skip_null_and_nan(spark):
    r = profile.numeric_profile(num(spark, [1.0, 2.0, 2.0, None, float("nan"), 7.0]), ["x"], relative_error=0.0).head()
    v = np.array([1.0, 2, 2, 7])
    assert (r["count_all"], r["count_not_null"]) == (6, 4)
    assert r["std_val"] == pytest.approx(v.std(ddof=1)) and r["mean_val"] == pytest.approx(3)
    z = (v - 3) / v.std()
    assert r["skewness"] == pytest.approx((z**3).mean()) and r["kurtosis"] == pytest.approx((z**4).mean() - 3)
    assert r["median_val"] == 2.0 and r["quantile_array"][0] == 1.0 and r["quantile_array"][100] == 7.0


def test_all_null_and_empty(spark):
    df = num(spark, [None, None])
    r = profile.numeric_profile(df, ["x"], relative_error=0.0).head()
    assert r["mean_val"] is None and r["median_val"] is None and r["count_all"] == 2
    r = profile.numeric_profile(df.limit(0), ["x"]).head()
    assert r["count_all"] == 0 and r["median_val"] is None
    c = profile.category_profile(df.limit(0), ["y"], "x").head()
    assert c["concerned_categories"] == [] and c["auc"] is None


def test_label_rules(spark):
    df = num(spark, [1.0, 2.0, 3.0, 4.0], ["1", "0", None, "x"])
    r = profile.numeric_profile(df, ["x"], "y").head()
    assert r["count_all"] == 2 and r["corr_label"] == pytest.approx(-1)
    assert profile.is_binary(num(spark, [1.0, 2.0, None]), "x") and not profile.is_binary(num(spark, [1.0, 2.0, 3.0]), "x")


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_partitioning_does_not_matter(spark, parts):
    rng = np.random.default_rng(0)
    xs = [float(x) for x in rng.integers(0, 50, 500)]
    ys = [str(int(x + rng.normal(0, 10) > 25)) for x in xs]
    df = num(spark, xs, ys).repartition(parts).withColumn("c", F.col("x").cast("string"))
    auc = profile.level_auc(profile.level_counts(df, ["c"], "y")).head()["auc"]
    by = {}
    for x, y in zip(xs, ys, strict=True):
        by.setdefault(x, []).append(int(y))
    rate = {x: sum(v) / len(v) for x, v in by.items()}
    pos = [rate[x] for x, y in zip(xs, ys, strict=True) if y == "1"]
    neg = [rate[x] for x, y in zip(xs, ys, strict=True) if y == "0"]
    want = np.mean([(p > n) + 0.5 * (p == n) for p, n in itertools.product(pos, neg)])
    assert auc == pytest.approx(want)
    inverse = profile.numeric_auc(df.withColumn("z", -F.col("x")), ["x", "z"], "y").collect()
    assert sum(r["auc"] for r in inverse) == pytest.approx(1)


def test_auc_and_mi_edges(spark):
    df = spark.createDataFrame([("a", "1"), ("a", "0"), ("b", "1"), ("b", "0"), (None, "1")], "c string, y string")
    lv = profile.level_counts(df, ["c"], "y")
    assert profile.level_auc(lv).head()["auc"] == pytest.approx(0.5)
    assert profile.level_mi(lv).head()["mutual_information"] == pytest.approx(0)
    one = profile.level_counts(df.where("y = '1'"), ["c"], "y")
    assert profile.level_auc(one).head()["auc"] is None
    perfect = profile.level_counts(spark.createDataFrame([("a", "1"), ("b", "0")], "c string, y string"), ["c"], "y")
    assert profile.level_mi(perfect).head()["mutual_information"] == pytest.approx(1)


def test_top_levels_ties(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("c",), (None,)], "c string")
    got = [r["category"] for r in profile.top_levels(profile.level_counts(df, ["c"]), False, 2).orderBy("pos").collect()]
    assert got == ["c", "a"]


def test_sparse_modes(spark):
    df = spark.createDataFrame([({"c": "a", "y": "1", "n": "2"},), ({"y": "0", "n": "x"},), ({"c": "a"},), (None,)], "features map<string,string>")
    d = profile.level_counts(profile.sparse_to_dense(df, ["c"], ["n"], "y"), ["c"], "y")
    assert {(r["category"], r["n"], r["p"]) for r in d.collect()} == {("a", 1, 1), (profile.DEFAULT_LEVEL, 1, 0)}
    m = profile.level_counts(profile.sparse_to_dense(df, ["c"], ["n"], "y", "missing"), ["c"], "y")
    assert {(r["category"], r["n"]) for r in m.collect()} == {("a", 1)}
    with pytest.raises(ValueError):
        profile.sparse_to_dense(df, ["c"], [], "y", "other")


def test_running_total_and_quantiles(spark):
    rng = np.random.default_rng(2)
    rows = [("a" if rng.random() < 0.9 else None, float(v)) for v in rng.integers(0, 100, 400)]
    df = spark.createDataFrame(rows, "feat_name string, v double")
    for r in exact_quantiles(df, [0.0, 0.3, 0.5, 1.0]).collect():
        vs = sorted(v for k, v in rows if k == r["feat_name"])
        assert r["v"] == vs[max(1, math.ceil(round(r["p"] * len(vs), 9))) - 1]
    c = df.groupBy("feat_name", "v").count()
    got = {(r["feat_name"], r["v"]): r["b"] for r in running_total(c, ["feat_name"], ["v"], {"b": "count"}).collect()}
    assert all(n == sum(1 for k2, v2 in rows if k2 == k and v2 < v) for (k, v), n in got.items())


def test_ks(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(0, 1, 300).round(1), rng.normal(0.4, 1, 200).round(1)
    da, db = num(spark, [float(x) for x in a] + [None]), num(spark, [float(x) for x in b])
    r = ks.ks_test(da, db, [("x", "x"), ("x", "x")]).collect()
    assert len(r) == 2 and r[0]["d"] == pytest.approx(ks.local_statistic(a, b))
    assert r[0]["p_value"] == pytest.approx(ks.asymptotic_p(r[0]["d"], 300, 200))
    with pytest.raises(ValueError):
        ks.p_value(0.5, 1, 10)


def test_ks_exact_small():
    for n, m in ((2, 2), (3, 4), (5, 3)):
        ways = list(itertools.combinations(range(n + m), n))
        ds = []
        for w in ways:
            x = np.array(w, float)
            y = np.array([i for i in range(n + m) if i not in w], float)
            ds.append(round(ks.local_statistic(x, y) * n * m))
        for k in set(ds):
            assert ks.exact_p(k / (n * m), n, m) == pytest.approx(sum(v > k for v in ds) / len(ds))
            assert ks.exact_p(k / (n * m), n, m, strict=False) == pytest.approx(sum(v >= k for v in ds) / len(ds))


def test_ks_helpers():
    assert ks.kolmogorov_tail(0.39999) == pytest.approx(ks.kolmogorov_tail(0.40001), abs=1e-4)
    assert ks.kolmogorov_tail(1.36) == pytest.approx(0.0494, abs=1e-3)
    assert ks.one_sample_cdf(0.274, 10) == pytest.approx(0.6284796154565, abs=1e-9)
    x, y = ks.break_ties(np.array([1.0, 1.0, 2.0]), np.array([1.0, 2.0]))
    assert len(np.unique(np.concatenate([x, y]))) == 5
    assert ks.monte_carlo_p(0.5, 4, 4, 4000) == pytest.approx(ks.exact_p(0.5, 4, 4), abs=0.03)
    assert 0 <= ks.bootstrap_p(np.arange(5.0), np.arange(5.0) + 1, 200) <= 1
    assert ks.one_sample_statistic(np.array([0.1, 0.5, 0.9]), lambda v: v) == pytest.approx(0.9 - 2 / 3)


def brute_pairs(rows):
    c = d = 0
    for (g1, y1, v1), (g2, y2, v2) in itertools.combinations(rows, 2):
        if g1 == g2 and None not in (y1, y2, v1, v2):
            s = (y1 - y2) * (v1 - v2)
            c, d = c + (s > 0), d + (s < 0)
    return c, d


def test_pairs_against_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(str(g), int(y), float(v)) for g, y, v in zip(rng.integers(0, 6, 300), rng.integers(-1, 4, 300), rng.integers(0, 8, 300), strict=True)]
    rows += [("9", None, 1.0), ("9", 1, None), (None, 1, 2.0), (None, 0, 1.0)]
    df = spark.createDataFrame(rows, "g string, y int, v double")
    r = ranking.pair_counts(df, "y", "g", ["v"]).head()
    assert (r["concordant"], r["discordant"]) == brute_pairs([(g or "null", y, v) for g, y, v in rows])
    none = ranking.pair_rate(ranking.pair_counts(spark.createDataFrame([("a", 0, 1.0), ("a", 1, 2.0)], "g string, y int, v double"), "y", "g", ["v"])).head()
    assert none["pair_rate"] == -1.0


def test_ndcg_rules(spark):
    rows = [("a", 3, 0.1), ("a", 0, 0.9), ("a", 1, 0.5), ("b", 1, 1.0), ("c", None, 1.0), ("d", 0, 1.0), ("d", 0, 2.0), ("e", -1, 3.0), ("e", 2, None)]
    df = spark.createDataFrame(rows, "g string, y int, v double")
    got = {(r["grp"], r["k"]): (r["ndcg_desc"], r["ndcg_asc"]) for r in ranking.group_ndcg(df, "y", "g", ["v"], [2, 3]).collect()}
    g, l2 = ranking.GAINS, math.log2
    ideal2 = g[3] / l2(2) + g[1] / l2(3)
    assert got["a", 2] == pytest.approx(((g[1] / l2(3)) / ideal2, 1.0))
    assert got["b", 2] == got["c", 2] == got["d", 2] == (0.0, 0.0)
    assert got["a", 3][1] == pytest.approx(1.0) and got["e", 3] == (0.0, 0.0)
    rep = {r["metric"]: r["ndcg"] for r in ranking.ndcg_report(ranking.group_ndcg(df, "y", "g", ["v"], [2, 3])).collect()}
    assert rep["ndcg3"] == pytest.approx(1 / 5)


def test_samples_are_drawn_again_whatever_the_partitions(spark):
    from grainmill.operators import sampling

    df = spark.range(2000).withColumn("x", F.col("id") % 7)
    one = sampling.take_sample(df.repartition(7), 100, ["id"]).collect()
    assert len(one) == 100 == len({r["id"] for r in one}) and sorted(one) == sorted(sampling.take_sample(df.coalesce(1), 100, ["id"]).collect())
    assert set(one) != set(sampling.take_sample(df, 100, ["id"], seed=1).collect())
    means = [np.mean([r["id"] for r in sampling.take_sample(df, 200, ["id"], seed=s).collect()]) for s in range(8)]
    assert abs(np.mean(means) - 999.5) < 60
    odd = spark.createDataFrame([(None,), (None,), (1,)], "k int")
    assert sampling.take_sample(odd, 10, ["k"]).count() == 3 and sampling.take_sample(odd.limit(0), 3, ["k"]).count() == 0
