"""Losses, updaters, store, learners, models, jobs, streaming."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from grainmill.functions import losses as L
from grainmill.models import network, scope, wrappers
from grainmill.params import jobs, learning, store, updaters
from grainmill.plans import learning_queries
from grainmill.schema import EngineError
from grainmill.streaming import incremental

BINARY = [L.logit(), L.logit(3.0), L.upu_logit(0.4, 0.2), L.hinge(), L.hinge(2.0), L.smooth_hinge(), L.smooth_hinge(2.0), L.squared(), L.poisson()]
MULTI = [L.multi_logit(), L.multi_hinge(), L.multi_smooth_hinge()]


@pytest.mark.parametrize("loss", BINARY, ids=lambda x: x.name)
def test_binary_loss(spark, loss):
    ms = [-800.0, -20.0, -1.3, 0.2, 1.7, 20.0] + ([800.0] if loss.name != "poisson" else [])
    grid = [(m, y) for m in ms for y in (0.0, 1.0)]
    m, y = np.array([g[0] for g in grid]), np.array([g[1] for g in grid])
    value, g = loss.kernel(m, y)
    assert np.isfinite(value).all()
    e = 1e-5
    at = np.abs(m) < 10
    numeric = (loss.kernel(m + e, y)[0] - loss.kernel(m - e, y)[0]) / (2 * e)
    assert np.allclose(numeric[at], g[at], atol=1e-4)
    df = spark.createDataFrame(grid, "m double, y double")
    cols = df.select(*[c.alias(n) for c, n in zip(loss.column(F.col("m"), F.col("y")), ("v", "g"), strict=True)]).collect()
    assert np.allclose([r["v"] for r in cols], value, rtol=1e-9, atol=1e-12) and np.allclose([r["g"] for r in cols], g, rtol=1e-9, atol=1e-12)


@pytest.mark.parametrize("loss", MULTI, ids=lambda x: x.name)
def test_multi_loss(spark, loss):
    rng = np.random.default_rng(0)
    k = 2 if loss.pivot else 3
    m, y = rng.normal(0, 2, (12, k)), rng.integers(0, 3, 12).astype(float)
    value, g = loss.kernel(m, y)
    for j in range(k):
        d = np.zeros_like(m)
        d[:, j] = 1e-6
        assert np.allclose((loss.kernel(m + d, y)[0] - loss.kernel(m - d, y)[0]) / 2e-6, g[:, j], atol=1e-4)
    df = spark.createDataFrame([(r.tolist(), float(t)) for r, t in zip(m, y, strict=True)], "m array<double>, y double")
    cols = df.select(*[c.alias(n) for c, n in zip(loss.column(F.col("m"), F.col("y")), ("v", "g"), strict=True)]).collect()
    assert np.allclose([r["v"] for r in cols], value) and np.allclose([r["g"] for r in cols], g)


def apply(spark, updater, w, g):
    df = spark.createDataFrame([(w, g)], "w array<double>, g array<double>")
    return df.select(updater.update(F.col("w"), F.col("g"))).head()[0]


@pytest.mark.parametrize("z", [-2.0, -1.0, 0.0, 1.0, 2.0])
@pytest.mark.parametrize("n", [0.0, 1.0])
@pytest.mark.parametrize("g", [-1.0, 0.0, 1.0])
def test_ftrl(spark, z, n, g):
    got = apply(spark, updaters.Ftrl(0.5, 1.0, 1.0, 0.5), [z, n, 0.3], [g])
    z1 = z + g - (np.sqrt(n + g * g) - np.sqrt(n)) / 0.5 * 0.3
    w = 0.0 if abs(z1) <= 1 else -(z1 - np.sign(z1)) / (0.5 + (1 + np.sqrt(n + g * g)) / 0.5)
    assert got == pytest.approx([z1, n + g * g, w])


def test_other_updaters(spark):
    assert apply(spark, updaters.Sgd(0.1), [1.0], [2.0]) == pytest.approx([0.8])
    assert apply(spark, updaters.Momentum(0.1, 0.5), [1.0, 0.4], [2.0]) == pytest.approx([1.0, 0.0])
    assert apply(spark, updaters.DelayCompensated(0.1, 0.5), [1.0, 0.5], [2.0]) == pytest.approx([1 - 0.2 - 1.0, 1.0])
    assert apply(spark, updaters.Elementwise(0.1), [1.0, 2.0], [1.0, -1.0]) == pytest.approx([0.9, 2.1])
    a = apply(spark, updaters.AdaGrad(0.1), [1.0, 0.0], [2.0])
    assert a == pytest.approx([0.9, 4.0])
    assert apply(spark, updaters.Ftrl(force_sparse=True), [0.5, 1.0, 0.2], [0.0]) == [0.0, 0.0, 0.0]


def test_store(spark, tmp_path):
    c = store.StoreConfig(length=2, low=-0.1, high=0.1)
    s = store.ParamStore(spark, c)
    s.replace(spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], "id bigint, w array<float>"))
    keys = spark.createDataFrame([(1, "x"), (9, "y"), (None, "z")], "feat bigint, tag string")
    a = {r["tag"]: r["w"] for r in s.pull(keys).collect()}
    assert a["x"] == [1.0, 2.0] and all(-0.1 <= v < 0.1 for v in a["y"]) and a["y"] == {r["tag"]: r["w"] for r in s.pull(keys).collect()}["y"]
    assert {r["tag"]: r["w"] for r in s.pull(keys, start=1, end=2).collect()}["x"] == [2.0]
    s.push(spark.createDataFrame([(1, [1.0]), (7, [1.0])], "id bigint, g array<double>"), updaters.Momentum(1.0, 0.0))
    got = {r["id"]: r["w"] for r in s.params.collect()}
    assert got[1] == [0.0, -1.0] and got[2] == [3.0, 4.0] and set(got) == {1, 2, 7}
    assert s.count() == 3 and s.scan_range(2, 7).count() == 1 and s.scan_ids(spark.createDataFrame([(7,), (7,)], "id bigint")).count() == 1
    s.save(str(tmp_path / "m"))
    again = store.ParamStore(spark, c, "increment_train", str(tmp_path / "m"))
    assert again.count() == 3 and s.count() == 3
    s.clear_range(0, 3)
    assert s.count() == 1
    for bad in (lambda: store.ParamStore(spark, c, "nope"), lambda: store.ParamStore(spark, c, "predict"), lambda: store.ParamStore(spark, store.StoreConfig(dtype="float", length=2)), lambda: s.replace(spark.createDataFrame([(1, [1])], "id bigint, w array<int>"))):
        with pytest.raises(EngineError):
            bad()


def samples(spark, n=300, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        x = rng.normal(0, 1, 2)
        y = float(x[0] - x[1] + rng.normal(0, 0.3) > 0)
        rows += [(i, y, 0, 0, 1.0), (i, y, 1, 11, float(x[0])), (i, y, 2, 22, float(x[1]))]
    return spark.createDataFrame(rows, "sample_id bigint, label double, field int, feat bigint, val double")


@pytest.mark.parametrize("make", [
    lambda: learning.LogisticLearner.sgd(1.0, epochs=3),
    lambda: learning.LogisticLearner.momentum(1.0, 0.3, epochs=3),
    lambda: learning.LogisticLearner.delay_compensated(1.0, 0.05, epochs=3),
    lambda: learning.LogisticLearner.ftrl(1.0, 1.0, 0.0001, 0.0, epochs=3),
])
def test_learners_learn(spark, make):
    learner, data = make(), samples(spark)
    s = store.ParamStore(spark, learner.config())
    info = learner.fit(data, s)
    assert info.losses[-1] < info.losses[0] and info.positives + info.negatives == 300
    p = learner.predict(data, s)
    assert wrappers.right_rate(p, "probability", "label").head()[0] > 0.85


def test_gradient_details(spark):
    data = spark.createDataFrame([(1, 1.0, 5, 2.0), (1, 1.0, 5, 2.0), (2, 0.0, 5, 1.0), (3, 1.0, None, 1.0)], "sample_id bigint, label double, feat bigint, val double")
    empty = spark.createDataFrame([], "id bigint, w array<float>")
    g, info = learning.gradients(data, empty, store.StoreConfig(), subsample_label=0.0, rate=0.5)
    assert {r["id"]: r["g"][0] for r in g.collect()}[5] == pytest.approx((-0.5 * 4 + 0.5 * 2) / 3)
    assert info.head()["loss"] == pytest.approx(3 * np.log(2))


def test_fm_gradient_is_the_derivative(spark):
    data = samples(spark, 20)
    conf = store.StoreConfig(dtype="double_array", length=3)
    base = {0: [0.1, 0.0, 0.0], 11: [0.3, 0.2, -0.1], 22: [-0.2, 0.4, 0.5]}

    def loss(w):
        p = spark.createDataFrame(list(w.items()), "id bigint, w array<double>")
        y = F.when(F.col("label") > 0, 1.0).otherwise(-1.0)
        return learning.fm_predict(data, p, conf).agg(F.avg(L.log1p_exp(-y * F.col("margin")))).head()[0]

    g = {r["id"]: r["g"] for r in learning.fm_gradients(data, spark.createDataFrame(list(base.items()), "id bigint, w array<double>"), conf)[0].collect()}
    for i, j in ((0, 0), (11, 0), (11, 1), (22, 2)):
        up = {k: [v + (1e-4 if (k, q) == (i, j) else 0) for q, v in enumerate(w)] for k, w in base.items()}
        assert (loss(up) - loss(base)) / 1e-4 == pytest.approx(g[i][j], abs=1e-3)


def test_ffm(spark):
    data = samples(spark, 60)
    learner = learning.FfmLearner(updaters.Elementwise(2.0), 2, 3, epochs=3)
    s = store.ParamStore(spark, learner.config(low=-0.5, high=0.5))
    info = learner.fit(data, s)
    assert info.losses[-1] < info.losses[0]
    assert learner.predict(data, s).count() == 60
    g, _ = learning.ffm_gradients(data, s.params, s.config, 2, 3)
    assert all(len(r["g"]) == 6 for r in g.collect())
    rare = spark.createDataFrame([(1, 1.0, 0, 1, 1.0), (2, 1.0, 0, 1, 1.0), (2, 1.0, 0, 2, 1.0)], data.schema)
    assert learning.frequent_features(rare).count() == 2


def brute_phi(rows, w, rank):
    """The margin of one sample by all pairs of its features, repeats added up."""
    merged = {}
    for f, i, x in rows:
        merged[f, i] = merged.get((f, i), 0.0) + x
    items = sorted(merged.items())
    return sum(sum(w[i][g * rank + r] * w[j][f * rank + r] for r in range(rank)) * x * y for a, ((f, i), x) in enumerate(items) for (g, j), y in items[a + 1 :])


def test_ffm_margin_and_gradient_against_pairs(spark):
    rng, rank, fields = np.random.default_rng(3), 2, 3
    rows = [(s, float(s % 2), int(rng.integers(0, fields)), int(rng.integers(1, 9)), float(rng.normal())) for s in range(40) for _ in range(int(rng.integers(1, 6)))]
    rows += [(0, 0.0, 1, 5, 1.0)] * 2 + [(1, 1.0, 7, 5, 1.0)]  # repeats, and a field beyond the last
    data = spark.createDataFrame(rows, "sample_id bigint, label double, field int, feat bigint, val double")
    w = {i: rng.normal(0, 0.5, rank * fields).tolist() for i in range(1, 9)}
    conf = store.StoreConfig(dtype="double_array", length=rank * fields)
    params = lambda x: spark.createDataFrame(list(x.items()), "id bigint, w array<double>")
    by = {}
    for s, _, f, i, x in rows:
        if f < fields:
            by.setdefault(s, []).append((f, i, x))
    got = {r["sample_id"]: r["margin"] for r in learning.ffm_margin(data, params(w), conf, rank).collect()}
    assert got == pytest.approx({s: brute_phi(v, w, rank) for s, v in by.items()})

    def loss(x):
        return np.mean([np.logaddexp(0, -(1 if s % 2 else -1) * brute_phi(v, x, rank)) for s, v in by.items()])

    g, info = learning.ffm_gradients(data, params(w), conf, rank, fields)
    g = {r["id"]: r["g"] for r in g.collect()}
    assert info.head()["n"] == 40 and info.head()["loss"] / 40 == pytest.approx(loss(w))
    for i, j in ((1, 0), (5, 3), (8, 5)):
        up = {k: [v + (1e-5 if (k, q) == (i, j) else 0) for q, v in enumerate(x)] for k, x in w.items()}
        assert (loss(up) - loss(w)) / 1e-5 == pytest.approx(g[i][j], abs=1e-4)


@pytest.mark.parametrize("make", [
    lambda: learning.FmLearner(updaters.Elementwise(0.5), 2, epochs=3),
    lambda: learning.FmLearner(updaters.Elementwise(0.5), 2, epochs=2, batches=2, subsample_label=0.0, rate=0.5),
    lambda: learning.FfmLearner(updaters.AdaGrad(0.2), 2, 3, epochs=3, min_count=1),
])
def test_factorization_learners(spark, make):
    learner, data = make(), samples(spark, 120)
    s = store.ParamStore(spark, learner.config())
    info = learner.fit(data, s)
    assert info.losses[-1] < info.losses[0] and learner.predict(data, s).count() == 120
    assert {len(r["w"]) for r in s.params.collect()} == {s.config.length}
    if isinstance(learner, learning.FfmLearner):
        assert all(x >= 1.0 for r in s.params.collect() for x in r["w"][6:])


def test_subsampled_label_weighs_more(spark):
    data = samples(spark, 20)
    conf, none = store.StoreConfig(dtype="double_array", length=2), spark.createDataFrame([], "id bigint, w array<double>")
    g, info = learning.fm_gradients(data, none, conf, subsample_label=0.0, rate=0.25)
    n0 = data.where("label = 0").select("sample_id").distinct().count()
    assert info.head()["loss"] == pytest.approx(np.log(2) * (20 - n0 + 4 * n0)) and info.head()["n"] == 20


def test_store_keeps_two_snapshots_and_goes_on(spark, tmp_path):
    conf = store.StoreConfig(dtype="double_array", length=1, buckets=3)
    s = store.ParamStore(spark, conf, folder=str(tmp_path / "s"))
    for i in range(4):
        s.push(spark.createDataFrame([(k, [1.0]) for k in range(5 + i)], "id bigint, g array<double>"), updaters.Sgd(0.5), tag=str(i))
    assert sorted(x.name for x in (tmp_path / "s").iterdir() if x.name.startswith("v")) == ["v3", "v4"]
    again = store.ParamStore(spark, conf, folder=str(tmp_path / "s"))
    assert again.tag == "3" and again.version == 4 and sorted(map(tuple, again.params.collect())) == sorted(map(tuple, s.params.collect()))
    again.push(spark.createDataFrame([(0, [1.0])], "id bigint, g array<double>"), updaters.Sgd(0.5), tag="4")
    assert {r["id"]: r["w"] for r in again.params.collect()}[0] == [-2.5]


def test_pull_does_not_shuffle_the_store(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        s = store.ParamStore(spark, store.StoreConfig(dtype="double_array", length=1))
        s.replace(spark.createDataFrame([(k, [1.0]) for k in range(50)], "id bigint, w array<double>"))
        plan = s.pull(samples(spark, 10).select("feat"))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def vectors(spark, classes, n=240, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 2, (classes, 4))
    return spark.createDataFrame([(Vectors.dense(centres[i % classes] + rng.normal(0, 0.5, 4)), float(i % classes)) for i in range(n)], ["features", "label"])


@pytest.mark.parametrize("kw", [{}, {"lossFunc": "SVM"}, {"lossFunc": "SSVM", "posWeight": 2.0}, {"lossFunc": "UPULR", "posWeight": 0.5, "stepSize": 0.01}, {"fitIntercept": False, "regParam": 0.01}])
def test_linear_scope(spark, kw):
    df = vectors(spark, 2).repartition(3)
    m = scope.LinearScope(**({"stepSize": 0.05, "maxIter": 3} | kw)).fit(df)
    assert m.loss_history[-1] < m.loss_history[0]
    assert wrappers.accuracy(m.transform(df), "prediction", "label").head()[0] > 0.9


@pytest.mark.parametrize("cls", [scope.MultiLinearScope, scope.OVRLinearScope])
def test_multi_scope_and_persistence(spark, tmp_path, cls):
    df = vectors(spark, 3)
    m = cls(stepSize=0.05, maxIter=4, numClasses=3).fit(df)
    out = m.transform(df)
    assert wrappers.accuracy(out, "prediction", "label").head()[0] > 0.9
    m.write().overwrite().save(str(tmp_path / "m"))
    assert type(m).load(str(tmp_path / "m")).transform(df).collect() == out.collect()


def test_scope_is_reproducible_and_checks(spark):
    df = vectors(spark, 2).coalesce(1).cache()
    a, b = (scope.LinearScope(stepSize=0.1, maxIter=2, seed=5).fit(df).weights for _ in range(2))
    assert np.allclose(a, b)
    warm = scope.LinearScope(stepSize=0.1, maxIter=1).fit_from(df, a)
    assert warm.loss_history[0] < 0.6
    with pytest.raises(EngineError):
        scope.LinearScope(lossFunc="nope")
    with pytest.raises(EngineError):
        scope.LinearScope().fit(df.limit(0))
    assert scope.restart_every(0, 1) == 10**8 and scope.restart_every(0.1, 1) == round(-4 / np.log10(0.9))


def dense_frame(spark, n=200):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(n):
        x = float(rng.normal())
        rows.append((x if i % 11 else None, ["a", "b", None][i % 3], ["p", "q", "r"][int(x > -0.5) + int(x > 0.5)], x * 2))
    return spark.createDataFrame(rows, "x double, c string, y string, t double")


def test_wrappers(spark, tmp_path):
    df = dense_frame(spark)
    two = df.where("y <> 'r'")
    for spec, data in ((wrappers.Glm(["x", "c"], "y"), two), (wrappers.Glm(["x", "c"], "y", family="multinomial", missing="Skip"), df), (wrappers.Gbm(["x", "c"], "y", n_trees=3), two), (wrappers.Gbm(["x", "c"], "y", family="multinomial", n_trees=2, max_depth=2), df), (wrappers.Drf(["x", "c"], "y", n_trees=3, max_depth=4, family="multinomial"), df), (wrappers.Mlp(["x", "c"], "y", hidden=[4], epochs=1, family="multinomial"), df), (wrappers.Svm(["x", "c"], "y", family="multinomial", max_iter=5), df)):
        m = spec.fit(data, data)
        out = m.transform(data)
        k = data.select("y").distinct().count()
        assert out.columns == ["predict", *[f"p{i}" for i in range(k)]] and out.where(F.abs(sum(F.col(f"p{i}") for i in range(k)) - 1) > 1e-6).count() == 0
        assert m.validation_metric > 0.5
    g = wrappers.Drf(["x"], "t", family="gaussian", n_trees=5).fit(df)
    assert g.transform(df).columns == ["predict"]
    g.save(str(tmp_path / "m"))
    assert wrappers.DenseModel.load(str(tmp_path / "m"), g.spec).transform(df).count() == df.count()
    with pytest.raises(EngineError):
        wrappers.Glm(["x"], "y", family="nope").fit(df)


@pytest.mark.parametrize("kw", [{}, {"activation": "TanhWithDropout", "dropout": 0.1}, {"activation": "Maxout", "adadelta": False, "learn_rate": 0.01, "l2": 1e-4, "elastic_rate": 0.01}])
def test_network(spark, kw):
    df = vectors(spark, 3).repartition(2)
    m = network.Network(hidden=[8], n_classes=3, epochs=12 if kw.get("adadelta", True) else 4, eps=1e-4, **kw).fit(df)
    assert m.loss_history[-1] < m.loss_history[0]
    again = network.NetworkModel.load(m.save())
    assert again.transform(df).select("prediction").collect() == m.transform(df).select("prediction").collect()
    assert json.loads(m.save())["sizes"] == [4, 8, 3]


def test_network_gradient():
    rng = np.random.default_rng(0)
    net = network.Network(hidden=[3], n_classes=2, activation="Tanh", l1=0.0, l2=0.0)
    sizes = [2, 3, 2]
    flat, x, y = network.initial(sizes, 1), rng.normal(0, 1, (5, 2)), np.array([0, 1, 1, 0, 1.0])
    g, _ = net._gradient(x, y, flat, sizes, None)
    for i in range(len(flat)):
        d = np.zeros_like(flat)
        d[i] = 1e-6
        num = (net._gradient(x, y, flat + d, sizes, None)[1] - net._gradient(x, y, flat - d, sizes, None)[1]) / 2e-6 / 5
        assert num == pytest.approx(g[i], abs=1e-5)


def test_jobs(spark, tmp_path):
    (tmp_path / "in.txt").write_text("\n".join(f"{int(i % 2)} {1 if i % 2 else 2}:1.0 7:0.5" for i in range(40)))
    base = dict(jobs.SETTINGS) | {"data.path": str(tmp_path / "in.txt"), "output.path": str(tmp_path / "model"), "learner": "sgd", "learning.rate": "1.0", "train.epochs": "2"}
    info = jobs.run_job(spark, jobs.JobSettings(base))
    assert info.losses[1] < info.losses[0]
    more = jobs.run_job(spark, jobs.JobSettings(base | {"job.type": "increment_train", "model.path": str(tmp_path / "model"), "output.path": str(tmp_path / "model2")}))
    assert more.losses[0] < info.losses[0]
    out = jobs.run_job(spark, jobs.JobSettings(base | {"job.type": "predict", "model.path": str(tmp_path / "model2"), "output.path": ""}))
    assert wrappers.right_rate(out, "probability", "label").head()[0] == 1.0
    assert jobs.JobSettings.read(spark).text("learner") == "ftrl"
    with pytest.raises(EngineError):
        jobs.learner_of(jobs.JobSettings(base | {"learner": "x"}))


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("\n".join(f"{int(i % 2)} {1 if i % 2 else 2}:1.0" for i in range(40)))
    learner = learning.LogisticLearner.sgd(1.0)
    s = store.ParamStore(spark, learner.config())
    incremental.train_on_stream(spark.readStream.text(str(tmp_path / "in")), learner, s, str(tmp_path / "cp"), once=True).awaitTermination()
    assert s.count() == 2
    ev = spark.createDataFrame([("2023-01-01 00:10:00", "a"), ("2023-01-01 00:50:00", "a")], "ts string, k string").withColumn("ts", F.to_timestamp("ts"))
    assert incremental.windowed_counts(ev, "ts", ["k"]).head()["n"] == 2
    raw = spark.createDataFrame([(1, "libsvm", "1 1:1"), (2, "libsvm", "x")], "line_no bigint, feed string, line string")
    good, bad = incremental.split_stream(raw)
    assert good.count() == 1 and bad.count() == 1


@pytest.mark.parametrize("name", ["glm_fit", "gbm_fit", "drf_fit", "mlp_fit"])
def test_dense_models_take_every_spelling_of_a_label_and_score_every_row(spark, tmp_path, name):
    cols = "sample_id bigint, load_id int, age double, income double, dwell_sec double, bid double, user_key string, label string, city string, os_name string, device_code string, ad_slot string, tags string"
    labels = ["0", "1.0", "0.0", " 1e0 ", "T", None, "\\N", "2"]
    rows = [(i, 1, float(i % 8 % 2 * 50 + i % 5), 1.0 + i % 3, None, float(i % 7), None, labels[i % 8], None, ["a", "b", None][i % 3], None, None, None) for i in range(160)]
    spark.createDataFrame(rows, cols).write.parquet(str(tmp_path / "dense_samples.parquet"))
    df = learning_queries._any_spelling(spark, str(tmp_path))
    got = learning_queries.DENSE_MODELS[name].fit(df).transform(df).select("predict", "p0", "p1").collect()
    assert len(got) == 160 and {x["predict"] for x in got} <= {"0", "1"}
    if name != "mlp_fit":  # a few epochs learn little
        assert sum(x["predict"] == "1" for x in got) == 80


def test_scope_on_a_million_sparse_features(spark):
    rng, d = np.random.default_rng(2), 1_000_000
    rows = []
    for i in range(400):
        at = sorted({int(rng.integers(10, d)) for _ in range(5)} | {i % 2})
        rows.append((Vectors.sparse(d, at, [1.0] * len(at)), float(i % 2)))
    df = spark.createDataFrame(rows, ["features", "label"]).repartition(2)
    m = scope.LinearScope(stepSize=0.5, maxIter=3).fit(df)
    assert m.loss_history[-1] < m.loss_history[0] and m.weights.shape == (1, d + 1)
    out = m.transform(df)
    assert wrappers.accuracy(out, "prediction", "label").head()[0] > 0.99
    assert len(m.getOrDefault("content")) < 500_000


def test_sparse_and_dense_rows_train_alike(spark):
    df = vectors(spark, 2).coalesce(1)
    arrays = df.select(F.col("label"), vector_to_array("features").alias("features"))
    sparse = spark.createDataFrame([(Vectors.sparse(4, range(4), r["features"].toArray()), r["label"]) for r in df.collect()], ["features", "label"]).coalesce(1)
    a, b, c = (scope.LinearScope(stepSize=0.05, maxIter=2, seed=3).fit(x).weights for x in (df, arrays, sparse))
    assert np.allclose(a, b) and np.allclose(a, c)
    with pytest.raises(Exception, match="features"):
        scope.LinearScope(maxIter=1).fit(spark.createDataFrame([(Vectors.dense([1.0]), 1.0), (Vectors.dense([1.0, 2.0]), 0.0)], ["features", "label"]).coalesce(1))


def test_row_forms_multiply_alike(monkeypatch):
    from grainmill.functions import vectors as V

    rng = np.random.default_rng(4)
    dense = np.where(rng.random((30, 12)) < 0.5, rng.normal(size=(30, 12)), 0.0)
    at = np.argwhere(dense)
    rows = V.Rows(np.append(0, np.cumsum((dense != 0).sum(axis=1))), at[:, 1], dense[tuple(at.T)])
    assert isinstance(V.packed(rows, 12), V.DenseRows) and isinstance(V.packed(rows, 5000), V.Rows)
    w, f, pick = rng.normal(size=(3, 12)), rng.normal(size=(30, 3)), np.array([4, 4, 29, 0])
    for small in (0, 10**6):
        monkeypatch.setattr(V, "SMALL_BLOCK", small)
        for x in (rows, V.packed(rows, 12)):
            got = w.copy()
            x.add_to(got, f)
            assert np.allclose(x.dot(w), dense @ w.T) and np.allclose(got, w + f.T @ dense)
            assert np.allclose(x.take(pick).dot(w), dense[pick] @ w.T)


def test_margins_beyond_the_plan_limit_agree(spark, monkeypatch):
    df = vectors(spark, 3)
    m = scope.OVRLinearScope(stepSize=0.05, maxIter=1, numClasses=3).fit(df)
    a = m.transform(df).select("rawPrediction").collect()
    monkeypatch.setattr(scope, "PLAN_FEATURES", 2)
    b = m.transform(df).select("rawPrediction").collect()
    assert np.allclose([r[0] for r in a], [r[0] for r in b])


@pytest.mark.parametrize("activation", ["Rectifier", "TanhWithDropout", "Maxout", "Sigmoid"])
def test_network_wrapper_uses_its_activation(spark, tmp_path, activation):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(float(rng.normal(3 * (i % 2), 1)), "ab"[i % 2] if i % 5 else None, str(i % 2), float(i % 2 * 10)) for i in range(300)], "x double, c string, y string, z double").coalesce(1).cache()
    kw = {"hidden": [8], "activation": activation, "adadelta": False, "learn_rate": 0.02, "batch": 10}
    spec = wrappers.Mlp(["x", "c"], "y", epochs=2, dropout=0.1, **kw)
    m = spec.fit(df)
    out = m.transform(df, ["y"])
    assert out.where("predict = y").count() > 270 and out.where("abs(p0 + p1 - 1) > 1e-9").count() == 0
    m.save(str(tmp_path / "m"))
    assert wrappers.DenseModel.load(str(tmp_path / "m"), spec).transform(df).collect() == m.transform(df).collect()
    number = wrappers.Mlp(["x", "c"], "z", family="gaussian", epochs=3, dropout=0.0, **(kw | {"learn_rate": 0.005})).fit(df)
    assert number.evaluate(df) < 4.0


def test_boosting_with_a_falling_rate(spark, tmp_path):
    df = dense_frame(spark)
    two = df.where("y <> 'r'")
    spec = wrappers.Gbm(["x", "c"], "y", n_trees=12, max_depth=3, learn_rate=0.3, learn_rate_annealing=0.9)
    m = spec.fit(two, two)
    assert m.validation_metric > 0.9
    m.save(str(tmp_path / "m"))
    out = wrappers.DenseModel.load(str(tmp_path / "m"), spec).transform(two, ["y"])
    assert out.columns == ["y", "predict", "p0", "p1"] and out.where("abs(p0 + p1 - 1) > 1e-9").count() == 0
    assert out.where("predict = y").count() > 0.9 * two.count()
    number = wrappers.Gbm(["x", "c"], "t", family="gaussian", n_trees=12, learn_rate=0.3, learn_rate_annealing=0.95).fit(df)
    assert number.evaluate(df) < 0.7 * df.agg(F.stddev_pop("t")).head()[0]
    # one tree of rate 1 is a plain tree on the residuals of the mean
    one = wrappers.Gbm(["x"], "t", family="gaussian", n_trees=1, learn_rate=1.0, learn_rate_annealing=0.5, max_depth=2).fit(df)
    assert len({round(r["predict"], 9) for r in one.transform(df).collect()}) <= 4
    with pytest.raises(EngineError):
        wrappers.Gbm(["x", "c"], "y", family="multinomial", learn_rate_annealing=0.5).fit(df)
