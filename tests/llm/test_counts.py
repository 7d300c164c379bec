"""Heavy items, quantile sketches and term counts against brute force."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from grainmill.llm import heavy, quantiles, terms


def zipf(n=30_000, seed=0):
    rng = np.random.default_rng(seed)
    return np.where(rng.random(n) < 0.33, -1, rng.zipf(1.3, n) % 1_000_000)


# ---- heavy items ---------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("share", [0.3, 0.01, 0.004])
def test_heavy_items_are_exact(spark, share):
    v = zipf()
    df = spark.createDataFrame([(int(x) if x != 3 else None, "clash") for x in v], "v bigint, item string").repartition(5)
    want = {str(x): n for x, n in Counter(v[v != 3].tolist()).items() if n >= share * (v != 3).sum()}
    got = {r["item"]: r for r in heavy.heavy_items(df, {"v": F.col("v")}, share).collect()}
    assert {k: r["n"] for k, r in got.items()} == want
    assert all(abs(r["approx_count"] - r["n"]) <= max(0.003, 0.3 * share) * len(v) for r in got.values())


def test_heavy_edges(spark):
    df = spark.createDataFrame([(None, "a"), (None, "a"), (None, "")], "x string, y string")
    assert [(r["item"], r["n"]) for r in heavy.heavy_items(df, {"x": F.col("x"), "y": F.col("y")}, 0.5).collect()] == [("a", 2)]
    assert heavy.heavy_items(df.limit(0), {"x": F.col("x")}, 0.5).count() == 0
    long = "z" * 200_000
    got = heavy.heavy_items(spark.createDataFrame([(long,), (long,), ("q",)], "y string"), {"y": F.col("y")}, 0.5).collect()
    assert [r["item"] == long for r in got] == [True]


def test_sketches_add_up():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**63, 5000).astype(np.uint64)
    a, b, c = heavy.PrefixSketch(8), heavy.PrefixSketch(8), heavy.PrefixSketch(8)
    a.add(h[:2000])
    b.add(h[2000:])
    c.add(h)
    assert (a.table + b.table == c.table).all() and a.n + b.n == c.n


def test_small_sketch_never_misses(spark):
    h = np.repeat(np.arange(1, 2001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), 10)
    heavy_ones = np.repeat(np.array([7, 8, 9], np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F), 400)
    s = heavy.PrefixSketch(10)
    s.add(np.concatenate([h, heavy_ones]))
    found, _ = s.descend(400)
    assert set(np.unique(heavy_ones).tolist()) <= set(found.tolist())
    flat = heavy.PrefixSketch(10)
    flat.add(np.arange(1 << 17, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    with pytest.raises(heavy.TooNarrow):
        flat.descend(50)


@pytest.mark.parametrize("most", [9, 14])
def test_a_flat_column_widens_the_sketch_or_is_counted(spark, monkeypatch, most):
    monkeypatch.setattr(heavy, "MOST_BITS", most)
    rows = [(i,) for i in range(6000)] + [(7,)] * 11 + [(9,)] * 10
    df = spark.createDataFrame(rows, "x bigint")
    got = {(r["item"], r["n"]) for r in heavy.heavy_items(df, {"x": F.col("x")}, 11 / len(rows), width_bits=8).collect()}
    assert got == {("7", 12), ("9", 11)}


# ---- quantiles -----------------------------------------------------------------------------------------------------------


def disc(v, p):
    return sorted(v)[max(1, math.ceil(round(p * len(v), 9))) - 1]


@pytest.mark.parametrize("order", ["random", "sorted", "reversed"])
@pytest.mark.parametrize("parts", [1, 40])
def test_rank_error_is_relative_to_the_top(order, parts):
    n = 200_000
    v = np.arange(n, dtype=float)
    v = {"random": np.random.default_rng(0).permutation(v), "sorted": v, "reversed": v[::-1]}[order]
    s = quantiles.ReqSketch(seed=3)
    for i, piece in enumerate(np.array_split(v, parts)):
        o = quantiles.ReqSketch(seed=100 + i)
        for x in np.array_split(piece, 7):
            o.update(x)
        s.merge(o)
    assert s.n == n and sum(len(x) << h for h, x in enumerate(s.levels)) == n
    assert sum(map(len, s.levels)) < 8000
    for p in (0.01, 0.25, 0.5, 0.9, 0.99, 0.999):
        got = s.quantiles(np.array([p]))[0]
        assert abs(got - p * n) <= 6 * s.rank_error(p * n) + 2
        assert abs(s.below(p * n) - p * n) <= 6 * s.rank_error(p * n) + 2
    assert s.quantiles(np.array([1.0]))[0] == n - 1


def scores(spark, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for g, n in [("hot", 30_000), *[(f"g{i}", int(rng.integers(1, 120))) for i in range(80)], (None, 60)]:
        level = float(rng.uniform(50, 150))
        rows += [(g, int(rng.integers(1, 4)), float(x)) for x in rng.normal(level, 30, n)]
    rows += [("g1", 1, None), ("g1", 2, float("nan")), ("nan", 1, float("nan")), ("tie", 1, 100.0)] + [("tie", 2, 100.0)] * 60
    return rows, spark.createDataFrame(rows, "group_key string, load_id int, score double").repartition(6)


def by_group(rows):
    out = defaultdict(list)
    for g, _, v in rows:
        if v is not None and v == v:
            out[g].append(v)
    return out


def test_groups_reaching_is_exact(spark):
    rows, df = scores(spark)
    tests = [("median", 0.5, 100.0), ("p95", 0.95, 150.0)]
    want = {(g, s) for g, v in by_group(rows).items() if len(v) >= 50 for s, p, x in tests if disc(v, p) >= x}
    got = [tuple(r) for r in quantiles.groups_reaching(df, "group_key", "score", tests, 50).collect()]
    assert set(got) == want and len(got) == len(want)
    # at the hot group's own quantiles nothing is certain, so the exact count has to decide
    hot = by_group(rows)["hot"]
    m = disc(hot, 0.5)
    for x, ok in ((m, True), (np.nextafter(m, np.inf), False)):
        got = {r["group_key"] for r in quantiles.groups_reaching(df, "group_key", "score", [("m", 0.5, float(x))], 50).collect()}
        assert ("hot" in got) == ok


def test_kept_sketches_combine(spark):
    rows, df = scores(spark, 1)
    kept = quantiles.load_sketches(df, "group_key", "load_id", "score").cache()
    got = {r["group_key"]: r for r in quantiles.group_quantiles(kept, "group_key").collect()}
    for g, v in by_group(rows).items():
        r = got[g]
        assert r["n"] == len(v) and len(r["quantile_array"]) == 101
        if g != "hot":
            assert r["median"] == disc(v, 0.5) and r["quantile_array"] == [disc(v, i / 100) for i in range(101)] and r["rank_error_p50"] == 0
        else:
            assert abs(np.searchsorted(np.sort(v), r["median"]) - len(v) / 2) < 6 * quantiles.RANK_ERROR / quantiles.K * len(v) / 2
    assert "nan" not in got
    assert quantiles.group_quantiles(quantiles.load_sketches(df.limit(0), "group_key", "load_id", "score"), "group_key").count() == 0


def test_small_memory_and_two_merge_levels_keep_the_bound(spark, monkeypatch):
    rows, df = scores(spark, 2)
    exact = by_group(rows)
    for pending, held in ((500, 2), (5_000, 2000)):
        monkeypatch.setattr(quantiles, "HELD_SKETCHES", held)
        monkeypatch.setattr(quantiles, "FAN_IN", 2)
        parts = quantiles.sketch_parts(df, ["group_key"], quantiles.clean_num("score"), pending_values=pending)
        per_part = parts.where("level = 0").groupBy("group_key", "__part").agg(F.sum("n").alias("n")).groupBy("group_key").agg(F.sum("n").alias("n")).collect()
        assert {r["group_key"]: r["n"] for r in per_part} == {g: len(v) for g, v in exact.items()}
        merged = {r["group_key"]: r for wide in (False, True) for r in quantiles.merge_parts(parts, ["group_key"], "group_key string, m double, n bigint", lambda key, s: [(*key, float(s.quantiles(np.array([0.5]))[0]), s.n)], wide=wide).collect()}
        for g, v in exact.items():
            assert merged[g]["n"] == len(v)
            lo, hi = (np.searchsorted(np.sort(v), merged[g]["m"], side=side) - len(v) / 2 for side in ("left", "right"))
            assert max(lo, -hi, 0) <= 1 + 6 * quantiles.RANK_ERROR / quantiles.K * len(v) / 2


def test_a_hot_group_is_sent_as_one_sketch_a_task(spark):
    df = spark.range(0, 400_000, 1, 4).select(F.lit("hot").alias("g"), F.rand(3).alias("x"))
    rows = quantiles.sketch_parts(df, ["g"], F.col("x"), pending_values=20_000).select(F.size("vals").alias("n"), "__part").collect()
    assert sum(r["n"] for r in rows) < 12_000 and {r["__part"] for r in rows} == {0, 1, 2, 3}


def test_identical_parts_draw_different_coins():
    v = np.arange(10_000, dtype=float)
    got = []
    for part in range(40):
        s = quantiles.ReqSketch(seed=quantiles._rng_seed(part, ("g",)))
        s.update(v)
        got.append(s.below(5000.0) - 5000)
    assert min(got) < 0 < max(got) and abs(np.mean(got)) < 3 * np.std(got) / 40**0.5 + 2


def test_groups_that_are_nan(spark):
    df = spark.createDataFrame([(float("nan"), float(i)) for i in range(300)] + [(None, 1.0)] * 60 + [(2.0, 5.0)] * 60, "g double, x double").repartition(5)
    got = quantiles.groups_reaching(df, "g", "x", [("m", 0.5, 1.0)], 50).collect()
    assert sorted(str(r["g"]) for r in got) == ["2.0", "None", "nan"]


# ---- terms ---------------------------------------------------------------------------------------------------------------


def brute_terms(rows):
    occ, rec = Counter(), defaultdict(set)
    for i, a, t in rows:
        cells = [("a", a)] + [("t", x) for x in (t.strip().split(",") if t is not None and t.strip() not in ("", "\\N") else [])]
        for f, x in cells:
            x = None if x is None else x.strip()
            if x not in (None, "", "\\N"):
                occ[f, x] += 1
                if i is not None:
                    rec[f, x].add(i)
    return {(*k, n, len(rec[k])) for k, n in occ.items()}


@pytest.mark.parametrize(("task_rows", "leaf_bytes"), [(200, 1000), (10**6, 3000), (1000, 10**6), (4_000_000, 32 << 20)])
def test_term_counts(spark, task_rows, leaf_bytes):
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(1500):
        i = int(rng.integers(0, 600)) if rng.random() > 0.02 else None
        rows.append((i, "hot" if rng.random() < 0.4 else f" v{rng.integers(0, 300)} ", ",".join(rng.choice(["x", "y", "", " z ", "\\N", f"r{rng.integers(0, 99)}"], 4))))
    rows += [(1, None, None), (1, "\\N", ""), (2, "e" * 100_000, ",,"), (3, "dup", "dup,dup")] + [(7, "hot", "x")] * 50
    df = spark.createDataFrame(rows, "id bigint, a string, t string").withColumn("leaf", F.lit(1)).repartition(3)
    got = [tuple(r) for r in terms.term_counts(df, "id", ["a"], ["t"], task_rows=task_rows, leaf_bytes=leaf_bytes).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_terms(rows)


def test_a_hot_term_is_spread_over_tasks(spark):
    df = spark.createDataFrame([(i, "hot") for i in range(4000)] + [(i, f"v{i}") for i in range(2000)], "id bigint, a string")
    rows = terms.term_rows(df, "id", ["a"]).select("*", F.xxhash64("feat_name", "category").alias("th"), F.xxhash64("record").alias("rh"))
    placed, parts = terms._place(rows, terms.cell_bits(6000, 200), 200)
    sizes = {r["part"]: r["count"] for r in placed.groupBy("part").count().collect()}
    assert sum(sizes.values()) == 6000 and max(sizes) < parts and len(sizes) > 30 and max(sizes.values()) <= 450
    assert placed.groupBy("category", "record").agg(F.countDistinct("part").alias("n")).where("n > 1").count() == 0


def test_leaves_on_disk_are_bounded_and_removed(tmp_path):
    rng = np.random.default_rng(1)
    term, record = rng.integers(0, 2**40, 20_000), rng.integers(0, 2**40, 20_000)
    term[:8000] = term[0]  # a hot term
    names = ["feat_name", "category", "record"]
    batch = pa.RecordBatch.from_arrays([pa.array(["a"] * 20_000), pa.array([f"{x:011x}" for x in term]), pa.array(record)], names=names)
    spill = terms.Spill(str(tmp_path), leaf_bytes=30_000)
    seen, sizes = [], []
    for leaf in spill.split(batch.slice(i, 500) for i in range(0, 20_000, 500)):
        assert isinstance(leaf, list)
        sizes.append(sum(b.nbytes for b in leaf))
        seen += [x for b in leaf for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert sorted(seen) == sorted(zip(*(c.to_pylist() for c in batch.columns), strict=True)) and max(sizes) <= 30_000
    assert spill.splits > 1
    spill.close()
    assert not any(tmp_path.iterdir())
    # copies of one pair can't be told apart: they come as a stream
    same = pa.RecordBatch.from_arrays([pa.array(["a"] * 4000), pa.array([None] * 4000, pa.string()), pa.array([7] * 4000)], names=names)
    leaves = [leaf if isinstance(leaf, list) else list(leaf) for leaf in terms.Spill(str(tmp_path), 1000).split(iter([same.slice(i, 100) for i in range(0, 4000, 100)]))]
    assert sum(b.num_rows for leaf in leaves for b in leaf) == 4000


def test_terms_empty_and_marks(spark):
    df = spark.createDataFrame([], "id bigint, a string, t string")
    assert terms.term_counts(df, "id", ["a"], ["t"]).count() == 0
    c = spark.createDataFrame([("a", "x", 9, 2), ("a", "y", 9, 3), ("a", "z", 9, 20), ("a", "w", 9, 21)], "feat_name string, category string, n_occurrences bigint, n_records bigint")
    assert {r["category"]: r["mark"] for r in terms.mark_terms(c, 100).collect()} == {"x": "rare", "y": None, "z": None, "w": "common"}
