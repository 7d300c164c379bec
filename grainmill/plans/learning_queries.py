"""Losses, scoring, parameter store, trainers and scalar functions, with their SQL."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.functions import bits, cityhash, linalg
from grainmill.functions import losses as L
from grainmill.models import network, scope, wrappers
from grainmill.params import jobs, learning, store, updaters
from grainmill.plans.common import DENSE, dense, r
from grainmill.session import shared_dir, table
from grainmill.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


# ---- losses: mean loss and gradient at fixed weights ---------------------------------------------------------------------

_W = (0.03, 0.2, -0.4)  # age, bid, intercept
_LOSS_ROWS = f"WITH {DENSE}, x AS (SELECT (age - 40) / 10 AS x1, bid / 5 AS x2, CAST(CASE WHEN try_cast(label AS DOUBLE) > 0.5 THEN 1 ELSE 0 END AS DOUBLE) AS y, CASE WHEN try_cast(label AS DOUBLE) > 0.5 THEN 1.0 ELSE -1.0 END AS s FROM dense WHERE age IS NOT NULL AND bid IS NOT NULL AND try_cast(label AS DOUBLE) IS NOT NULL), m AS (SELECT *, {_W[0]} * x1 + {_W[1]} * x2 + {{b}} AS m FROM x)"
_LP = lambda x: f"(greatest({x}, 0) + ln(1 + exp(-abs({x}))))"
_SG = "(1 / (1 + exp(-m)))"
_H = "greatest(0.0, 1 - s * m)"
_C = "(CASE WHEN y > 0.5 THEN 2.5 ELSE 1.0 END)"


def _loss_rows(spark: SparkSession, d: str) -> DataFrame:
    df = dense(spark, d).where("age IS NOT NULL AND bid IS NOT NULL").select(((F.col("age") - 40) / 10).alias("x1"), (F.col("bid") / 5).alias("x2"), F.nanvl(F.col("label").try_cast("double"), F.lit(None).cast("double")).alias("l"))
    return df.where("l IS NOT NULL").select("x1", "x2", F.when(F.col("l") > 0.5, 1.0).otherwise(0.0).alias("y"))


def _binary(loss: L.Loss, intercept: bool) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = _loss_rows(spark, d)
        m = _W[0] * F.col("x1") + _W[1] * F.col("x2") + F.lit(_W[2] if intercept else 0.0)
        value, g = loss.column(m, F.col("y"))
        return rows.select(value.alias("v"), g.alias("g"), "x1", "x2").agg(F.count(F.lit(1)).alias("n"), r(F.avg("v")).alias("loss"), r(F.avg(F.col("g") * F.col("x1"))).alias("g1"), r(F.avg(F.col("g") * F.col("x2"))).alias("g2"), r(F.avg("g") if intercept else F.lit(0.0)).alias("g0"))

    return run


def _binary_sql(value: str, g: str, intercept: bool) -> str:
    return _LOSS_ROWS.replace("{b}", str(_W[2] if intercept else 0.0)) + f", v AS (SELECT {value} AS v, {g} AS g, x1, x2 FROM m) SELECT count(*) AS n, round(avg(v), 6) + 0.0 AS loss, round(avg(g * x1), 6) + 0.0 AS g1, round(avg(g * x2), 6) + 0.0 AS g2, {'round(avg(g), 6)' if intercept else '0.0'} + 0.0 AS g0 FROM v"


_PRIOR, _RATIO = 0.4, 0.2
_LOGIT = f"(CASE WHEN y > 0.5 THEN {_LP('-m')} ELSE {_LP('m')} END)"
_SMOOTH = f"(CASE WHEN s * m < 0 THEN {_H} - 0.5 ELSE {_H} * {_H} / 2 END)", f"(CASE WHEN s * m < 0 THEN -s ELSE -s * {_H} END)"
_BINARY = {
    "logit": (L.logit(), _LOGIT, f"({_SG} - y)"),
    "weighted_logit": (L.logit(2.5), f"{_C} * {_LOGIT}", f"{_C} * ({_SG} - y)"),
    "upu_logit": (L.upu_logit(_PRIOR, _RATIO), f"(CASE WHEN y > 0.5 THEN -{_PRIOR / _RATIO} * m ELSE {_LP('m')} / {1 - _RATIO} END)", f"(CASE WHEN y > 0.5 THEN -{_PRIOR / _RATIO} ELSE {_SG} / {1 - _RATIO} END)"),
    "hinge": (L.hinge(), _H, "(CASE WHEN s * m < 1 THEN -s ELSE 0.0 END)"),
    "weighted_hinge": (L.hinge(2.5), f"{_C} * {_H}", f"{_C} * (CASE WHEN s * m < 1 THEN -s ELSE 0.0 END)"),
    "smooth_hinge": (L.smooth_hinge(), *_SMOOTH),
    "weighted_smooth_hinge": (L.smooth_hinge(2.5), f"{_C} * {_SMOOTH[0]}", f"{_C} * {_SMOOTH[1]}"),
    "squared": (L.squared(), "((m - y) * (m - y) / 2)", "(m - y)"),
    "poisson": (L.poisson(), "(exp(m) - y * m)", "(exp(m) - y)"),
}
for _n, (_loss, _v, _g) in _BINARY.items():
    query(_binary_sql(_v, _g, True), f"loss_{_n}")(_binary(_loss, True))
    query(_binary_sql(_v, _g, False), f"loss_{_n}_nointercept")(_binary(_loss, False))

# three classes: return flag A, N, R; margins from quantity and discount
_MW = [(0.5, -1.0, 0.1), (-0.3, 2.0, -0.2), (0.2, 0.4, 0.05)]
_MROWS = "WITH x AS (SELECT (l_quantity - 25) / 10 AS x1, l_discount * 10 AS x2, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS y FROM lineitem), m AS (SELECT *, " + ", ".join(f"{a} * x1 + {b} * x2 + {c} AS m{k}" for k, (a, b, c) in enumerate(_MW)) + " FROM x)"


def _multi(loss: L.MultiLoss) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        x1, x2 = (F.col("l_quantity") - 25) / 10, F.col("l_discount") * 10
        y = F.when(F.col("l_returnflag") == "A", 0.0).when(F.col("l_returnflag") == "N", 1.0).otherwise(2.0)
        ws = _MW[1:] if loss.pivot else _MW
        rows = table(spark, d, "lineitem").select(x1.alias("x1"), y.alias("y"), F.array(*[a * x1 + b * x2 + c for a, b, c in ws]).alias("m"))
        value, g = loss.column(F.col("m"), F.col("y"))
        return rows.select(value.alias("v"), g.alias("g"), "x1").agg(F.count(F.lit(1)).alias("n"), r(F.avg("v")).alias("loss"), *[r(F.avg(F.get("g", k) * F.col("x1"))).alias(f"g{k}") for k in range(len(ws))])

    return run


def _multi_hinge_sql(smooth: bool) -> str:
    def one(k: int) -> tuple[str, str]:
        s = f"(CASE WHEN y = {k} THEN 1.0 ELSE -1.0 END)"
        h = f"greatest(0.0, 1 - {s} * m{k})"
        if not smooth:
            return h, f"(CASE WHEN {s} * m{k} < 1 THEN -{s} ELSE 0.0 END)"
        return f"(CASE WHEN {s} * m{k} < 0 THEN {h} - 0.5 ELSE {h} * {h} / 2 END)", f"(CASE WHEN {s} * m{k} < 0 THEN -{s} ELSE -{s} * {h} END)"

    parts = [one(k) for k in range(3)]
    return _MROWS + f" SELECT count(*) AS n, round(avg({' + '.join(p[0] for p in parts)}), 6) + 0.0 AS loss, " + ", ".join(f"round(avg({p[1]} * x1), 6) + 0.0 AS g{k}" for k, p in enumerate(parts)) + " FROM m"


query(_MROWS + " SELECT count(*) AS n, round(avg(ln(1 + exp(m1) + exp(m2)) - CASE y WHEN 1 THEN m1 WHEN 2 THEN m2 ELSE 0 END), 6) + 0.0 AS loss, round(avg((exp(m1) / (1 + exp(m1) + exp(m2)) - CASE WHEN y = 1 THEN 1 ELSE 0 END) * x1), 6) + 0.0 AS g0, round(avg((exp(m2) / (1 + exp(m1) + exp(m2)) - CASE WHEN y = 2 THEN 1 ELSE 0 END) * x1), 6) + 0.0 AS g1 FROM m", "loss_multi_logit")(_multi(L.multi_logit()))
query(_multi_hinge_sql(False), "loss_multi_hinge")(_multi(L.multi_hinge()))
query(_multi_hinge_sql(True), "loss_multi_smooth_hinge")(_multi(L.multi_smooth_hinge()))


# ---- scoring with fixed weights ------------------------------------------------------------------------------------------

_D = 64


def _fixed(k: int) -> list[float]:
    return [((i * (k + 1)) % 5 - 2) / 10 for i in range(_D)] + [0.1 * k - 0.05]


def _margin_sql(k: int) -> str:
    return "list_dot_product(CAST(embedding AS DOUBLE[]), [" + ", ".join(map(str, _fixed(k)[:-1])) + f"]::DOUBLE[]) + {_fixed(k)[-1]}"


def _with(model: scope._ScopeModel, ks: list[int]) -> scope._ScopeModel:
    import json

    return model._set(content=json.dumps([_fixed(k) for k in ks]), featuresCol="embedding", labelCol="label")


@query(f"WITH m AS (SELECT vec_id, {_margin_sql(0)} AS m FROM embeddings) SELECT vec_id, round(m, 6) + 0.0 AS raw, round(1 / (1 + exp(-m)), 6) + 0.0 AS probability FROM m")
def linear_score(spark: SparkSession, d: str) -> DataFrame:
    out = _with(scope.LinearScopeModel(), [0]).transform(table(spark, d, "embeddings"))
    return out.select("vec_id", r("rawPrediction").alias("raw"), r("probability").alias("probability"))


@query(f"WITH m AS (SELECT vec_id, {_margin_sql(0)} AS a, {_margin_sql(1)} AS b FROM embeddings), p AS (SELECT vec_id, 1 / (1 + exp(a) + exp(b)) AS p0, exp(a) / (1 + exp(a) + exp(b)) AS p1, exp(b) / (1 + exp(a) + exp(b)) AS p2 FROM m) SELECT vec_id, round(p0, 6) + 0.0 AS p0, round(p1, 6) + 0.0 AS p1, round(p2, 6) + 0.0 AS p2, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0.0 WHEN p1 >= p2 THEN 1.0 ELSE 2.0 END AS prediction FROM p")
def softmax_score(spark: SparkSession, d: str) -> DataFrame:
    out = _with(scope.MultiLinearScopeModel(), [0, 1]).transform(table(spark, d, "embeddings"))
    return out.select("vec_id", *[r(F.get("probability", i)).alias(f"p{i}") for i in range(3)], "prediction")


@query(f"WITH m AS (SELECT vec_id, {_margin_sql(0)} AS a, {_margin_sql(1)} AS b, {_margin_sql(2)} AS c FROM embeddings) SELECT vec_id, round(a, 6) + 0.0 AS m0, round(b, 6) + 0.0 AS m1, round(c, 6) + 0.0 AS m2, CASE WHEN a >= b AND a >= c THEN 0.0 WHEN b >= c THEN 1.0 ELSE 2.0 END AS prediction FROM m")
def ovr_score(spark: SparkSession, d: str) -> DataFrame:
    out = _with(scope.OVRLinearScopeModel(), [0, 1, 2]).transform(table(spark, d, "embeddings"))
    return out.select("vec_id", *[r(F.get("rawPrediction", i)).alias(f"m{i}") for i in range(3)], "prediction")


@query(SQL["linear_score"])
def scope_saved_model(spark: SparkSession, d: str) -> DataFrame:
    """Saved, loaded, applied."""
    _with(scope.LinearScopeModel(), [0]).write().overwrite().save(p := os.path.join(shared_dir(spark), f"scope-{uuid.uuid4().hex[:8]}"))
    out = scope.LinearScopeModel.load(p).transform(table(spark, d, "embeddings"))
    return out.select("vec_id", r("rawPrediction").alias("raw"), r("probability").alias("probability"))


_SCORED = f"s AS (SELECT vec_id, {_margin_sql(0)} AS m, CASE WHEN label % 2 = 1 THEN 1 ELSE 0 END AS y FROM embeddings)"


def _scored(spark: SparkSession, d: str) -> DataFrame:
    out = _with(scope.LinearScopeModel(), [0]).transform(table(spark, d, "embeddings").withColumn("y", (F.col("label") % 2).cast("double")))
    return out.select("y", "rawPrediction", "probability", "prediction")


@query(f"WITH {_SCORED}, k AS (SELECT y, rank() OVER (ORDER BY m) + (count(*) OVER (PARTITION BY m) - 1) / 2.0 AS rk FROM s) SELECT round((sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 6) + 0.0 AS auroc FROM k")
def auroc(spark: SparkSession, d: str) -> DataFrame:
    return wrappers.auroc(_scored(spark, d), "rawPrediction", "y").select(r("auroc").alias("auroc"))


@query(f"WITH {_SCORED} SELECT round(avg(CASE WHEN (m > 0) = (y = 1) THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS accuracy FROM s")
def accuracy(spark: SparkSession, d: str) -> DataFrame:
    return wrappers.accuracy(_scored(spark, d), "prediction", "y").select(r("accuracy").alias("accuracy"))


@query(f"WITH {_SCORED} SELECT round(avg(CASE WHEN (m > 0) = (y > 0) THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS right_rate FROM s")
def right_rate(spark: SparkSession, d: str) -> DataFrame:
    return wrappers.right_rate(_scored(spark, d), "probability", "y").select(r("right_rate").alias("right_rate"))


@query(f"WITH {DENSE} SELECT round(avg(CASE WHEN try_cast(label AS DOUBLE) > 0.5 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS positive_ratio FROM dense WHERE try_cast(label AS DOUBLE) IS NOT NULL")
def upu_ratio(spark: SparkSession, d: str) -> DataFrame:
    y = F.nanvl(F.col("label").try_cast("double"), F.lit(None).cast("double"))
    return dense(spark, d).select(y.alias("y")).where("y IS NOT NULL").agg(r(F.avg((F.col("y") > 0.5).cast("double"))).alias("positive_ratio"))


# ---- parameter store -----------------------------------------------------------------------------------------------------

_CONF = store.StoreConfig(dtype="double_array", length=3)


def _params(spark: SparkSession, d: str) -> DataFrame:
    p = store.dedupe_snapshot(table(spark, d, "model_weights"), _CONF)
    return p.select("id", F.col("w").cast("array<double>").alias("w"))


_PARAMS = "params AS (SELECT id, CAST(w AS DOUBLE[]) AS w FROM (SELECT id, w, row_number() OVER (PARTITION BY id ORDER BY saved_at DESC, w DESC) AS rn FROM model_weights WHERE len(w) = 3 AND len(list_filter(w, lambda x: x IS NULL OR isnan(x))) = 0 AND id IS NOT NULL) WHERE rn = 1)"


def _samples(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "sample_features").where("label IS NOT NULL AND NOT isnan(label) AND val IS NOT NULL AND NOT isnan(val) AND feat IS NOT NULL")
    return df.select("sample_id", "label", F.col("field_no").alias("field"), "feat", F.col("val").cast("double").alias("val"))


_SAMPLES = "sm AS (SELECT sample_id, label, field_no AS field, feat, CAST(val AS DOUBLE) AS val FROM sample_features WHERE label IS NOT NULL AND NOT isnan(label) AND val IS NOT NULL AND NOT isnan(val) AND feat IS NOT NULL)"


@query(f"WITH {_PARAMS} SELECT id, round(w[1], 6) + 0.0 AS z, round(w[2], 6) + 0.0 AS n, round(w[3], 6) + 0.0 AS w FROM params")
def ps_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return _params(spark, d).select("id", *[r(F.get("w", i)).alias(c) for i, c in enumerate("znw")])


@query(f"WITH {_PARAMS}, k AS (SELECT DISTINCT feat FROM sample_features WHERE feat IS NOT NULL) SELECT feat, round(coalesce(w[1], 0.0), 6) + 0.0 AS z, round(coalesce(w[2], 0.0), 6) + 0.0 AS n, round(coalesce(w[3], 0.0), 6) + 0.0 AS w FROM k LEFT JOIN params ON id = feat")
def ps_pull(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "sample_features").where("feat IS NOT NULL").select("feat").distinct()
    return store.pull(_params(spark, d), keys, _CONF).select("feat", *[r(F.get("w", i)).alias(c) for i, c in enumerate("znw")])


@query(f"WITH {_PARAMS}, k AS (SELECT DISTINCT feat FROM sample_features WHERE feat IS NOT NULL) SELECT feat, round(coalesce(w[3], 0.0), 6) + 0.0 AS w FROM k LEFT JOIN params ON id = feat")
def ps_pull_slice(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "sample_features").where("feat IS NOT NULL").select("feat").distinct()
    out = store.pull(_params(spark, d), keys, _CONF, start=2, end=3)
    return out.select("feat", r(F.get("w", 0)).alias("w"))


@query(f"WITH {_PARAMS} SELECT count(*) AS n, count(*) FILTER (id >= 0 AND id < 4611686018427387904) AS in_range FROM params")
def ps_count_range(spark: SparkSession, d: str) -> DataFrame:
    s = store.ParamStore(spark, _CONF)
    s.replace(_params(spark, d))
    return spark.createDataFrame([(s.count(), s.scan_range(0, 1 << 62).count())], "n bigint, in_range bigint")


_GRAD = f"{_SAMPLES}, gr AS (SELECT feat AS id, sum(val * (label - 0.5)) / 100 AS g FROM sm GROUP BY 1), j AS (SELECT coalesce(p.id, gr.id) AS id, coalesce(w[1], 0.0) AS a, coalesce(w[2], 0.0) AS b, coalesce(w[3], 0.0) AS c, g FROM params p FULL JOIN gr ON gr.id = p.id)"


def _grads(spark: SparkSession, d: str) -> DataFrame:
    return _samples(spark, d).groupBy(F.col("feat").alias("id")).agg((F.sum(F.col("val") * (F.col("label") - 0.5)) / 100).alias("g")).select("id", F.array("g").alias("g"))


def _pushed(spark: SparkSession, d: str, updater: updaters.Updater, length: int) -> DataFrame:
    conf = store.StoreConfig(dtype="double_array", length=length)
    p = _params(spark, d).select("id", F.slice("w", 1, length).alias("w"))
    return store.push(p, _grads(spark, d), updater, conf).select("id", *[r(F.get("w", i), 8).alias(f"w{i}") for i in range(length)])


def _push_sql(cols: list[str], old: list[str]) -> str:
    return f"WITH {_PARAMS}, {_GRAD} SELECT id, " + ", ".join(f"round(CASE WHEN g IS NULL THEN {o} ELSE {c} END, 8) + 0.0 AS w{i}" for i, (c, o) in enumerate(zip(cols, old, strict=True))) + " FROM j"


@query(_push_sql(["a - 0.1 * g"], ["a"]))
def ps_push_sgd(spark: SparkSession, d: str) -> DataFrame:
    return _pushed(spark, d, updaters.Sgd(0.1), 1)


@query(_push_sql(["a + (-0.1 * g + 0.5 * b)", "-0.1 * g + 0.5 * b"], ["a", "b"]))
def ps_push_momentum(spark: SparkSession, d: str) -> DataFrame:
    return _pushed(spark, d, updaters.Momentum(0.1, 0.5), 2)


@query(_push_sql(["a + (-0.1 * g - 0.5 * g * g * (a - b))", "a"], ["a", "b"]))
def ps_push_dcasgd(spark: SparkSession, d: str) -> DataFrame:
    return _pushed(spark, d, updaters.DelayCompensated(0.1, 0.5), 2)


_FTRL = f"WITH {_PARAMS}, {_GRAD}, f AS (SELECT *, abs(b) AS n0 FROM j), h AS (SELECT *, n0 + g * g AS n1, a + g - (sqrt(n0 + g * g) - sqrt(n0)) / 0.5 * c AS z1 FROM f) SELECT id, round(coalesce(z1, a), 8) + 0.0 AS w0, round(coalesce(n1, n0), 8) + 0.0 AS w1, round(CASE WHEN g IS NULL THEN c WHEN abs(z1) <= 0.1 THEN 0.0 ELSE -(z1 - sign(z1) * 0.1) / (0.2 + (1 + sqrt(n1)) / 0.5) END, 8) + 0.0 AS w2 FROM h"


@query(_FTRL)
def ps_push_ftrl(spark: SparkSession, d: str) -> DataFrame:
    p = _params(spark, d).select("id", F.array(F.get("w", 0), F.abs(F.get("w", 1)), F.get("w", 2)).alias("w"))
    out = store.push(p, _grads(spark, d), updaters.Ftrl(0.5, 1.0, 0.1, 0.2), _CONF)
    return out.select("id", *[r(F.get("w", i), 8).alias(f"w{i}") for i in range(3)])


@query(_push_sql(["a - 0.1 * g", "b - 0.1 * 2 * g", "c - 0.1 * 3 * g"], ["a", "b", "c"]))
def ps_push_ffm(spark: SparkSession, d: str) -> DataFrame:
    g = _grads(spark, d).select("id", F.transform(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)), lambda k: k * F.get("g", 0)).alias("g"))
    out = store.push(_params(spark, d), g, updaters.Elementwise(0.1), _CONF)
    return out.select("id", *[r(F.get("w", i), 8).alias(f"w{i}") for i in range(3)])


@query(f"WITH {_PARAMS} SELECT id, round(w[1], 4) + 0.0 AS z, round(w[2], 4) + 0.0 AS n, round(w[3], 4) + 0.0 AS w FROM params")
def model_tsv_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    files.write_model(_params(spark, d).select("id", F.col("w").cast("array<float>").alias("w")), p := os.path.join(shared_dir(spark), f"model-{uuid.uuid4().hex[:8]}"))
    return files.read_model(spark, p).select("id", *[r(F.get("w", i).cast("double"), 4).alias(c) for i, c in enumerate("znw")])


# ---- learners ------------------------------------------------------------------------------------------------------------

_MARGIN = f"{_PARAMS}, {_SAMPLES}, mg AS (SELECT sample_id, max(label) AS label, sum(coalesce(w[3], 0.0) * val) AS m FROM sm LEFT JOIN params ON id = feat GROUP BY 1)"


@query(f"WITH {_MARGIN} SELECT sample_id, label, round(1 / (1 + exp(-greatest(m, -700))), 6) + 0.0 AS probability FROM mg")
def lr_predict(spark: SparkSession, d: str) -> DataFrame:
    return learning.predict(_samples(spark, d), _params(spark, d), _CONF, 2).select("sample_id", "label", r("probability").alias("probability"))


@query(f"WITH {_MARGIN}, f AS (SELECT sample_id, 1 / (1 + exp(-greatest(m, -700))) - CASE WHEN label > 0 THEN 1 ELSE 0 END AS f FROM mg), gr AS (SELECT feat AS id, sum(f * val) / (SELECT count(*) FROM mg) AS g FROM sm JOIN f USING (sample_id) GROUP BY 1) SELECT gr.id, round(coalesce(w[3], 0.0) - 0.5 * g, 6) + 0.0 AS w FROM gr LEFT JOIN params p ON p.id = gr.id")
def lr_epoch_fullbatch(spark: SparkSession, d: str) -> DataFrame:
    conf = store.StoreConfig(dtype="double_array", length=1)
    p = _params(spark, d).select("id", F.slice("w", 3, 1).alias("w"))
    g, _ = learning.gradients(_samples(spark, d), p, conf)
    new = store.push(p, g, updaters.Sgd(0.5), conf)
    return new.join(g.select(F.col("id").alias("i")), F.col("id") == F.col("i"), "left_semi").select("id", r(F.get("w", 0)).alias("w"))


@query(f"WITH {_MARGIN} SELECT count(*) AS n, CAST(sum(CASE WHEN label > 0 THEN 1 ELSE 0 END) AS DOUBLE) AS positives, round(avg(CASE WHEN label > 0 THEN ln(1 + exp(-greatest(least(m, 13), -13))) ELSE ln(1 + exp(greatest(least(m, 13), -13))) END), 6) + 0.0 AS loss FROM mg")
def lr_training_info(spark: SparkSession, d: str) -> DataFrame:
    _, info = learning.gradients(_samples(spark, d), _params(spark, d), _CONF, 2)
    return info.select("n", "positives", r(F.col("loss") / F.col("n")).alias("loss"))


_FM = f"{_PARAMS}, {_SAMPLES}, e AS (SELECT sample_id, label, feat, val, coalesce(w[1], 0.0) AS w, coalesce(w[2], 0.0) * val AS a, coalesce(w[3], 0.0) * val AS b FROM sm LEFT JOIN params ON id = feat), fm AS (SELECT sample_id, max(label) AS label, sum(w * val) + 0.5 * (sum(a) ** 2 - sum(a * a) + sum(b) ** 2 - sum(b * b)) AS m, sum(a) AS sa, sum(b) AS sb FROM e GROUP BY 1)"


@query(f"WITH {_FM} SELECT sample_id, label, round(m, 5) + 0.0 AS margin FROM fm")
def fm_predict(spark: SparkSession, d: str) -> DataFrame:
    return learning.fm_predict(_samples(spark, d), _params(spark, d), _CONF).select("sample_id", "label", r("margin", 5).alias("margin"))


@query(f"WITH {_FM}, f AS (SELECT sample_id, sa, sb, CASE WHEN label > 0 THEN -1 / (1 + exp(greatest(least(m, 700), -700))) ELSE 1 / (1 + exp(-greatest(least(m, 700), -700))) END AS f FROM fm) SELECT feat AS id, round(sum(f * val) / (SELECT count(*) FROM fm), 6) + 0.0 AS g0, round(sum(f * (val * sa - a * val)) / (SELECT count(*) FROM fm), 6) + 0.0 AS g1, round(sum(f * (val * sb - b * val)) / (SELECT count(*) FROM fm), 6) + 0.0 AS g2 FROM e JOIN f USING (sample_id) GROUP BY 1")
def fm_gradient(spark: SparkSession, d: str) -> DataFrame:
    g, _ = learning.fm_gradients(_samples(spark, d), _params(spark, d), _CONF)
    return g.select("id", *[r(F.get("g", i)).alias(f"g{i}") for i in range(3)])


_FM_STEP = f"WITH {_FM}, f AS (SELECT sample_id, sa, sb, CASE WHEN label > 0 THEN -1 / (1 + exp(greatest(least(m, 700), -700))) ELSE 2 / (1 + exp(-greatest(least(m, 700), -700))) END AS f FROM fm), g AS (SELECT feat AS id, sum(f * val) / (SELECT count(*) FROM fm) AS g0, sum(f * (val * sa - a * val)) / (SELECT count(*) FROM fm) AS g1, sum(f * (val * sb - b * val)) / (SELECT count(*) FROM fm) AS g2 FROM e JOIN f USING (sample_id) GROUP BY 1)"


@query(_FM_STEP + " SELECT coalesce(p.id, g.id) AS id, " + ", ".join(f"round(coalesce(w[{i + 1}], 0.0) - 0.1 * coalesce(g{i}, 0.0), 6) + 0.0 AS w{i}" for i in range(3)) + " FROM params p FULL JOIN g ON g.id = p.id")
def fm_train(spark: SparkSession, d: str) -> DataFrame:
    """One epoch over all samples from the saved weights; the label 0 was kept at a rate of one half."""
    learner = learning.FmLearner(updaters.Elementwise(0.1), 2, subsample_label=0.0, rate=0.5)
    s = store.ParamStore(spark, learner.config(dtype="double_array", low=None, high=None))
    s.replace(_params(spark, d))
    learner.fit(_samples(spark, d), s)
    return s.params.select("id", *[r(F.get("w", i)).alias(f"w{i}") for i in range(3)])


_RANK, _FIELDS = 2, 16
_FFM_CONF = store.StoreConfig(dtype="double_array", length=_RANK * _FIELDS)


def _factors(spark: SparkSession, d: str) -> DataFrame:
    ids = _samples(spark, d).select(F.col("feat").alias("id")).distinct()
    return ids.select("id", F.transform(F.sequence(F.lit(0), F.lit(_RANK * _FIELDS - 1)), lambda i: (F.pmod(F.col("id"), F.lit(7)) + i - 10) * F.lit(0.01)).alias("w"))


_FFM = f"{_SAMPLES}, e AS (SELECT *, ((feat % 7) + 7) % 7 - 10 AS base FROM sm), p AS (SELECT a.sample_id, a.label, a.val * b.val * (({' + '.join(f'(a.base + b.field * {_RANK} + {i}) * (b.base + a.field * {_RANK} + {i})' for i in range(_RANK))}) * 0.0001) AS t FROM e a JOIN e b ON a.sample_id = b.sample_id AND (a.field < b.field OR (a.field = b.field AND a.feat < b.feat)))"


@query(f"WITH {_FFM}, h AS (SELECT sample_id, max(label) AS label FROM sm GROUP BY 1), s AS (SELECT sample_id, sum(t) AS t FROM p GROUP BY 1) SELECT sample_id, label, round(coalesce(t, 0.0), 6) + 0.0 AS margin FROM h LEFT JOIN s USING (sample_id)")
def ffm_phi(spark: SparkSession, d: str) -> DataFrame:
    return learning.ffm_margin(_samples(spark, d), _factors(spark, d), _FFM_CONF, _RANK).select("sample_id", "label", r("margin").alias("margin"))


@query(f"WITH {_FFM}, h AS (SELECT sample_id, max(label) AS label FROM sm GROUP BY 1), s AS (SELECT sample_id, sum(t) AS t FROM p GROUP BY 1) SELECT sample_id, label, round(1 / (1 + exp(-coalesce(t, 0.0))), 6) + 0.0 AS probability FROM h LEFT JOIN s USING (sample_id)")
def ffm_predict(spark: SparkSession, d: str) -> DataFrame:
    m = learning.ffm_margin(_samples(spark, d), _factors(spark, d), _FFM_CONF, _RANK)
    return m.select("sample_id", "label", r(L.sigmoid(F.col("margin"))).alias("probability"))


@query(f"WITH {_SAMPLES} SELECT feat, count(*) AS n FROM sm GROUP BY 1 HAVING count(*) >= 2")
def ffm_freq_filter(spark: SparkSession, d: str) -> DataFrame:
    return learning.frequent_features(_samples(spark, d), 2).groupBy("feat").agg(F.count(F.lit(1)).alias("n"))


# Two epochs over all samples from empty weights: the state [w, a, b] of each feature after the first gradient and after the second.
_TWO_EPOCHS = f"""WITH {_SAMPLES}, y AS (SELECT sample_id, CASE WHEN max(label) > 0 THEN 1 ELSE 0 END AS y FROM sm GROUP BY 1),
g1 AS (SELECT feat AS id, sum((0.5 - y) * val) / (SELECT count(*) FROM y) AS g FROM sm JOIN y USING (sample_id) GROUP BY 1),
s1 AS (SELECT id, {{first}} FROM g1),
f2 AS (SELECT sample_id, 1 / (1 + exp(-greatest(sum(w * val), -700))) - any_value(y) AS f FROM sm JOIN s1 ON id = feat JOIN y USING (sample_id) GROUP BY 1),
g2 AS (SELECT feat AS id, sum(f * val) / (SELECT count(*) FROM y) AS g FROM sm JOIN f2 USING (sample_id) GROUP BY 1)
SELECT id, round({{second}}, 6) + 0.0 AS w FROM s1 JOIN g2 USING (id)"""


def _trained(spark: SparkSession, d: str, learner: learning.LogisticLearner) -> DataFrame:
    """The weights after training."""
    s = store.ParamStore(spark, learner.config(dtype="double_array"))
    learner.fit(_samples(spark, d), s)
    return s.params.select("id", r(F.get("w", learner.index)).alias("w"))


@query(_TWO_EPOCHS.format(first="-0.5 * g AS w", second="w - 0.5 * g"))
def lr_train_sgd(spark: SparkSession, d: str) -> DataFrame:
    return _trained(spark, d, learning.LogisticLearner.sgd(0.5, epochs=2))


@query(_TWO_EPOCHS.format(first="-0.5 * g AS w", second="w + (-0.5 * g + 0.5 * w)"))
def lr_train_momentum(spark: SparkSession, d: str) -> DataFrame:
    return _trained(spark, d, learning.LogisticLearner.momentum(0.5, 0.5, epochs=2))


@query(_TWO_EPOCHS.format(first="-0.5 * g AS w", second="w + (-0.5 * g - 0.1 * g * g * w)"))
def lr_train_dcasgd(spark: SparkSession, d: str) -> DataFrame:
    return _trained(spark, d, learning.LogisticLearner.delay_compensated(0.5, 0.1, epochs=2))


@query(f"WITH {_SAMPLES}, y AS (SELECT sample_id, CASE WHEN max(label) > 0 THEN 1 ELSE 0 END AS y FROM sm GROUP BY 1) SELECT feat AS id, round(-0.5 * sum((0.5 - y) * val) / (SELECT count(*) FROM y), 5) + 0.0 AS w FROM sm JOIN y USING (sample_id) GROUP BY 1")
def job_train(spark: SparkSession, d: str) -> DataFrame:
    """A whole job: lines from files, one epoch, the model as text."""
    folder = os.path.join(shared_dir(spark), f"job-{uuid.uuid4().hex[:8]}")
    lines = _samples(spark, d).groupBy("sample_id").agg(F.max("label").alias("y"), F.collect_list(F.concat_ws(":", F.col("feat").cast("string"), F.col("val").cast("string"))).alias("p"))
    lines.select(F.concat_ws(" ", F.col("y").cast("string"), F.array_join("p", " "))).write.text(f"{folder}/lines")
    jobs.run_job(spark, jobs.JobSettings(jobs.SETTINGS | {"data.path": f"{folder}/lines", "output.path": f"{folder}/model", "learner": "sgd", "learning.rate": "0.5"}))
    return files.read_model(spark, f"{folder}/model").select("id", r(F.get("w", 0).cast("double"), 5).alias("w"))


def _ftrl_weight(z: str, n: str) -> str:
    return f"CASE WHEN abs({z}) <= 0.001 THEN 0.0 ELSE -(({z}) - sign({z}) * 0.001) / (0.1 + (1 + sqrt({n})) / 0.5) END"


@query(_TWO_EPOCHS.format(first=f"g AS z, g * g AS n, {_ftrl_weight('g', 'g * g')} AS w", second=_ftrl_weight("z + g - (sqrt(n + g * g) - sqrt(n)) / 0.5 * w", "n + g * g")))
def lr_train_ftrl(spark: SparkSession, d: str) -> DataFrame:
    return _trained(spark, d, learning.LogisticLearner.ftrl(0.5, 1.0, 0.001, 0.1, epochs=2))


# Gradient cells (id, fld, i) of one epoch over the samples whose features occur twice at least, from the factors of _factors.
_FFM_CELLS = f"""WITH {_SAMPLES}, often AS (SELECT feat FROM sm GROUP BY 1 HAVING count(*) >= 2),
e AS (SELECT sample_id, field, feat, sum(val) AS val, ((feat % 7) + 7) % 7 - 10 AS base FROM sm WHERE feat IN (SELECT feat FROM often) GROUP BY 1, 2, 3),
y AS (SELECT sample_id, CASE WHEN max(label) > 0 THEN 1.0 ELSE -1.0 END AS y FROM sm WHERE feat IN (SELECT feat FROM often) GROUP BY 1),
p AS (SELECT a.sample_id, a.feat AS ia, a.field AS fa, a.base AS ba, b.feat AS ib, b.field AS fb, b.base AS bb, a.val * b.val AS xx FROM e a JOIN e b ON a.sample_id = b.sample_id AND (a.field < b.field OR (a.field = b.field AND a.feat < b.feat))),
phi AS (SELECT sample_id, sum(xx * ({' + '.join(f'(ba + fb * {_RANK} + {i}) * (bb + fa * {_RANK} + {i})' for i in range(_RANK))}) * 0.0001) AS m FROM p GROUP BY 1),
f AS (SELECT sample_id, -y / (1 + exp(least(y * m, 700))) / (SELECT count(*) FROM y) AS f FROM phi JOIN y USING (sample_id)),
c AS (SELECT id, fld, i, sum(x) AS g FROM ({' UNION ALL '.join(f'SELECT ia AS id, fb AS fld, {i} AS i, f * xx * (bb + fa * {_RANK} + {i}) * 0.01 AS x FROM p JOIN f USING (sample_id) UNION ALL SELECT ib, fa, {i}, f * xx * (ba + fb * {_RANK} + {i}) * 0.01 FROM p JOIN f USING (sample_id)' for i in range(_RANK))}) GROUP BY 1, 2, 3),
h AS (SELECT DISTINCT feat AS id, ((feat % 7) + 7) % 7 - 10 AS base FROM sm)"""
_FFM_SUM = " SELECT id, round(any_value({n} * base + {n} * ({n} - 1) // 2) * 0.01 - coalesce(sum({step}), 0.0), 6) + 0.0 AS total FROM h LEFT JOIN c USING (id) GROUP BY 1"


def _ffm_trained(spark: SparkSession, d: str, updater: updaters.Updater) -> DataFrame:
    """Sum of the factors of each feature after one epoch."""
    n = _RANK * _FIELDS
    learner = learning.FfmLearner(updater, _RANK, _FIELDS)
    s = store.ParamStore(spark, learner.config(dtype="double_array", low=None, high=None))
    start = _factors(spark, d)
    s.replace(start.select("id", F.concat("w", F.array_repeat(F.lit(1.0), n)).alias("w")) if s.config.length > n else start)
    learner.fit(_samples(spark, d), s)
    return s.params.select("id", r(F.aggregate(F.slice("w", 1, n), F.lit(0.0), lambda a, x: a + x)).alias("total"))


@query(_FFM_CELLS + _FFM_SUM.format(n=_RANK * _FIELDS, step="0.5 * g"))
def ffm_train(spark: SparkSession, d: str) -> DataFrame:
    return _ffm_trained(spark, d, updaters.Elementwise(0.5))


@query(_FFM_CELLS + _FFM_SUM.format(n=_RANK * _FIELDS, step="0.2 * g / (sqrt(1 + g * g) + 1e-8)"))
def ffm_train_adagrad(spark: SparkSession, d: str) -> DataFrame:
    return _ffm_trained(spark, d, updaters.AdaGrad(0.2))


# ---- models --------------------------------------------------------------------------------------------------------------


def _emb(spark: SparkSession, d: str, classes: int = 2) -> DataFrame:
    return table(spark, d, "embeddings").select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"), (F.col("label") % classes).cast("double").alias("label"))


def _grad_sql(factors: list[str], margins: list[int], classes: int) -> str:
    """Full gradient at the fixed weights by class and feature: factors name the margins m0, m1, ... and the label y."""
    ms = ", ".join(f"{_margin_sql(k)} AS m{k}" for k in margins)
    parts = " UNION ALL ".join(f"SELECT {k} AS cls, x, {f} AS f FROM v" for k, f in enumerate(factors))
    return f"""WITH v AS (SELECT embedding AS x, CAST(label % {classes} AS DOUBLE) AS y, {ms} FROM embeddings), f AS ({parts}),
c AS (SELECT cls, unnest(range({_D + 1})) AS i, unnest(list_append(CAST(x AS DOUBLE[]), 1.0)) * f AS t FROM f)
SELECT CAST(cls AS INTEGER) AS cls, CAST(i AS INTEGER) AS idx, round(avg(t), 6) + 0.0 AS g FROM c GROUP BY 1, 2"""


def _full_gradient(spark: SparkSession, d: str, loss: L.Loss | L.MultiLoss, ks: list[int], classes: int) -> DataFrame:
    rows = scope.sample_rows(_emb(spark, d, classes), "features", "label")
    g, _, _ = scope.full_gradient(rows, np.array([_fixed(k) for k in ks]), scope.Kernel(loss, len(ks), True))
    return spark.createDataFrame([(k, i, round(float(x), 6) + 0.0) for k, row in enumerate(g) for i, x in enumerate(row)], "cls int, idx int, g double")


@query(_grad_sql(["1 / (1 + exp(-m0)) - y"], [0], 2))
def scope_gradient_logit(spark: SparkSession, d: str) -> DataFrame:
    return _full_gradient(spark, d, L.logit(), [0], 2)


@query(_grad_sql(["CASE WHEN y > 0.5 THEN 2.0 ELSE 1.0 END * CASE WHEN (2 * y - 1) * m0 < 1 THEN 1 - 2 * y ELSE 0.0 END"], [0], 2))
def scope_gradient_hinge(spark: SparkSession, d: str) -> DataFrame:
    return _full_gradient(spark, d, L.hinge(2.0), [0], 2)


@query(_grad_sql([f"exp(m{k}) / (1 + exp(m0) + exp(m1)) - CASE WHEN y = {k + 1} THEN 1 ELSE 0 END" for k in range(2)], [0, 1], 3))
def scope_gradient_softmax(spark: SparkSession, d: str) -> DataFrame:
    return _full_gradient(spark, d, L.multi_logit(), [0, 1], 3)


@query(_grad_sql([f"CASE WHEN y = {k} THEN CASE WHEN m{k} < 1 THEN -1.0 ELSE 0.0 END ELSE CASE WHEN m{k} > -1 THEN 1.0 ELSE 0.0 END END" for k in range(3)], [0, 1, 2], 3))
def scope_gradient_ovr(spark: SparkSession, d: str) -> DataFrame:
    return _full_gradient(spark, d, L.multi_hinge(), [0, 1, 2], 3)


def _progress(spark: SparkSession, d: str, est: scope._Scope, classes: int = 2) -> DataFrame:
    """Rows trained on, the loss at zero weights, whether training lowered it, and whether the model is as good as the most frequent class at least."""
    df = _emb(spark, d, classes)
    m = est.fit(df)
    h = m.loss_history
    got = wrappers.accuracy(m.transform(df), "prediction", "label").head()[0]
    most = df.groupBy("label").count().agg(F.max("count") / F.sum("count")).head()[0]
    return spark.createDataFrame([(df.count(), round(h[0], 6), h[-1] < h[0], got >= most)], "n bigint, first_loss double, lower boolean, as_good_as_majority boolean")


def _progress_sql(loss: str, classes: int = 2) -> str:
    return f"SELECT count(*) AS n, round(avg({loss}), 6) + 0.0 AS first_loss, true AS lower, true AS as_good_as_majority FROM (SELECT CAST(label % {classes} AS DOUBLE) AS y FROM embeddings)"


@query(_progress_sql("ln(2.0)"))
def scope_lr_train(spark: SparkSession, d: str) -> DataFrame:
    return _progress(spark, d, scope.LinearScope(stepSize=0.1, maxIter=4))


@query(_progress_sql("CASE WHEN y > 0.5 THEN 2.0 ELSE 1.0 END").replace(", true AS as_good_as_majority", ""))
def scope_svm_train(spark: SparkSession, d: str) -> DataFrame:
    """Positives weigh twice as much, so the share of right predictions isn't what is minimised."""
    return _progress(spark, d, scope.LinearScope(stepSize=0.05, maxIter=4, lossFunc="SVM", posWeight=2.0, regParam=0.01)).drop("as_good_as_majority")


@query(_progress_sql("CASE WHEN y > 0.5 THEN 0.0 ELSE ln(2.0) / (1 - (SELECT avg(label % 2) FROM embeddings)) END"))
def scope_upu_train(spark: SparkSession, d: str) -> DataFrame:
    return _progress(spark, d, scope.LinearScope(stepSize=0.01, maxIter=3, lossFunc="UPULR", posWeight=0.5))


@query(_progress_sql("ln(10.0)", 10))
def softmax_train(spark: SparkSession, d: str) -> DataFrame:
    return _progress(spark, d, scope.MultiLinearScope(stepSize=0.1, maxIter=4, numClasses=10), 10)


@query(_progress_sql("10.0", 10))
def ovr_train(spark: SparkSession, d: str) -> DataFrame:
    return _progress(spark, d, scope.OVRLinearScope(stepSize=0.05, maxIter=4, numClasses=10), 10)


def _any_spelling(spark: SparkSession, d: str) -> DataFrame:
    """dense_samples with the label as 0 or 1 in any spelling, else NULL, and the label as a number."""
    y = F.col("label").try_cast("double")
    return dense(spark, d).withColumn("label", F.when(y == 0, "0").when(y == 1, "1")).withColumn("y", F.col("label").cast("double"))


_Y = f"WITH {DENSE}, s AS (SELECT os_name, CASE WHEN try_cast(label AS DOUBLE) IN (0, 1) THEN try_cast(label AS DOUBLE) END AS y FROM dense)"


@query(_Y + " SELECT coalesce(os_name, '') AS os_name, count(*) AS n, count(y) AS trained, round(avg(y), 3) + 0.0 AS mean_p FROM s GROUP BY 1")
def glm_fit(spark: SparkSession, d: str) -> DataFrame:
    """At the maximum of the likelihood the mean probability of the trained rows of each level is the share of positives among them."""
    df = _any_spelling(spark, d)
    out = DENSE_MODELS["glm_fit"].fit(df).transform(df, ["os_name", "y"])
    return out.groupBy(F.coalesce("os_name", F.lit("")).alias("os_name")).agg(F.count(F.lit(1)).alias("n"), F.count("y").alias("trained"), r(F.avg(F.when(F.col("y").isNotNull(), F.col("p1"))), 3).alias("mean_p"))


@query("SELECT l_returnflag, count(*) AS n, round(avg(l_extendedprice), 2) + 0.0 AS mean_predict FROM lineitem GROUP BY 1")
def glm_gaussian_fit(spark: SparkSession, d: str) -> DataFrame:
    """Least squares with an intercept and a term a level: the mean prediction of each level is its mean."""
    df = table(spark, d, "lineitem")
    out = wrappers.Glm(["l_quantity", "l_discount", "l_returnflag"], "l_extendedprice", family="gaussian").fit(df).transform(df, ["l_returnflag"])
    return out.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), r(F.avg("predict"), 2).alias("mean_predict"))


@query("WITH c AS (SELECT covar_pop(l_quantity, l_extendedprice) AS c1, covar_pop(l_discount, l_extendedprice) AS c2, var_pop(l_quantity) AS v1, var_pop(l_discount) AS v2, covar_pop(l_quantity, l_discount) AS v12, avg(l_extendedprice) AS my, avg(l_quantity) AS m1, avg(l_discount) AS m2 FROM lineitem), b AS (SELECT *, (v2 * c1 - v12 * c2) / (v1 * v2 - v12 * v12) AS b1, (v1 * c2 - v12 * c1) / (v1 * v2 - v12 * v12) AS b2 FROM c) SELECT l_orderkey, l_linenumber, round(my + b1 * (l_quantity - m1) + b2 * (l_discount - m2), 2) + 0.0 AS predict FROM lineitem, b")
def glm_least_squares(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "lineitem")
    out = wrappers.Glm(["l_quantity", "l_discount"], "l_extendedprice", family="gaussian").fit(df).transform(df, ["l_orderkey", "l_linenumber"])
    return out.select("l_orderkey", "l_linenumber", r("predict", 2).alias("predict"))


@query(SQL["glm_least_squares"])
def glm_saved_model(spark: SparkSession, d: str) -> DataFrame:
    """Fitted, saved, loaded, applied."""
    df, spec = table(spark, d, "lineitem"), wrappers.Glm(["l_quantity", "l_discount"], "l_extendedprice", family="gaussian")
    spec.fit(df).save(p := os.path.join(shared_dir(spark), f"glm-{uuid.uuid4().hex[:8]}"))
    out = wrappers.DenseModel.load(p, spec).transform(df, ["l_orderkey", "l_linenumber"])
    return out.select("l_orderkey", "l_linenumber", r("predict", 2).alias("predict"))


_FEATURES = ["age", "income", "bid", "os_name"]
DENSE_MODELS = {
    "glm_fit": wrappers.Glm(_FEATURES, "label"),
    "gbm_fit": wrappers.Gbm(_FEATURES, "label", n_trees=20, max_depth=3),
    "gbm_annealed_fit": wrappers.Gbm(_FEATURES, "label", n_trees=8, max_depth=3, learn_rate=0.3, learn_rate_annealing=0.9),
    "drf_fit": wrappers.Drf(_FEATURES, "label", n_trees=5, max_depth=5),
    "mlp_fit": wrappers.Mlp(_FEATURES, "label", hidden=[8], epochs=5, activation="Sigmoid"),
    "mlp_rectifier_fit": wrappers.Mlp(_FEATURES, "label", hidden=[8], epochs=1, adadelta=False, learn_rate=0.01),
}
_FITTED = _Y + " SELECT count(*) AS n, count(*) AS n_probabilities, count(*) AS n_classes, true AS beats_base_rate FROM s"


def _fitted(spark: SparkSession, d: str, spec: wrappers._Dense) -> DataFrame:
    """Rows scored, with probabilities that add up to 1, with a class as prediction; whether the log loss is below that of the base rate."""
    df = _any_spelling(spark, d)
    out = spec.fit(df).transform(df, ["y"])
    p, y = F.greatest(F.least("p1", F.lit(1 - 1e-9)), F.lit(1e-9)), F.col("y")
    base = F.avg("y")
    row = out.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum((F.col("p0").between(0, 1) & (F.abs(F.col("p0") + F.col("p1") - 1) < 1e-6)).cast("bigint")).alias("n_probabilities"),
        F.sum(F.col("predict").isin("0", "1").cast("bigint")).alias("n_classes"),
        (F.avg(-y * F.log(p) - (1 - y) * F.log(1 - p)) < -base * F.log(base) - (1 - base) * F.log(1 - base) + 1e-6).alias("beats_base_rate"),
    )
    return row


@query(_FITTED)
def gbm_fit(spark: SparkSession, d: str) -> DataFrame:
    return _fitted(spark, d, DENSE_MODELS["gbm_fit"])


@query(_FITTED)
def gbm_annealed_fit(spark: SparkSession, d: str) -> DataFrame:
    return _fitted(spark, d, DENSE_MODELS["gbm_annealed_fit"])


@query(_FITTED)
def drf_fit(spark: SparkSession, d: str) -> DataFrame:
    return _fitted(spark, d, DENSE_MODELS["drf_fit"])


@query(_FITTED)
def mlp_fit(spark: SparkSession, d: str) -> DataFrame:
    return _fitted(spark, d, DENSE_MODELS["mlp_fit"])


@query(_FITTED)
def mlp_rectifier_fit(spark: SparkSession, d: str) -> DataFrame:
    return _fitted(spark, d, DENSE_MODELS["mlp_rectifier_fit"])


@query("SELECT 3 AS epochs, true AS falling")
def network_fit(spark: SparkSession, d: str) -> DataFrame:
    m = network.Network(hidden=[16], n_classes=10, activation="TanhWithDropout", dropout=0.1, epochs=3, features="features").fit(_emb(spark, d, 10))
    h = m.loss_history
    return spark.createDataFrame([(len(h), h[-1] < h[0])], "epochs int, falling boolean")


# ---- scalar functions ----------------------------------------------------------------------------------------------------


def _ids(spark: SparkSession, d: str) -> Column:
    return table(spark, d, "orders").select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, lower(to_hex(o_custkey)) AS h, to_binary(o_custkey) AS b, lpad(lower(to_hex(o_custkey)), 8, '0') AS h8, CAST(o_custkey AS BIGINT) AS back FROM orders")
def radix(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("o_custkey")
    return _ids(spark, d).select("o_orderkey", bits.hex_string(c).alias("h"), bits.binary_string(c).alias("b"), bits.hex_string(c, 8).alias("h8"), bits.from_radix(bits.to_radix(c, 7), 7).alias("back"))


@query("SELECT o_orderkey, CAST((o_custkey >> 2) & 15 AS BIGINT) AS b26, CAST(o_custkey & 255 AS BIGINT) AS low FROM orders")
def bits_extract(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("o_custkey")
    return _ids(spark, d).select("o_orderkey", bits.extract_bits(c, 2, 6).alias("b26"), bits.unsigned(c, 8).alias("low"))


@query("SELECT o_orderkey, CAST((o_custkey >> 3) & 1 AS INTEGER) AS bit3 FROM orders")
def bit_at(spark: SparkSession, d: str) -> DataFrame:
    return _ids(spark, d).select("o_orderkey", bits.bit_at(F.col("o_custkey"), 3).alias("bit3"))


@query("SELECT o_orderkey, CAST(o_custkey AS INTEGER) AS back FROM orders")
def int_bytes_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return _ids(spark, d).select("o_orderkey", bits.bytes_int(bits.int_bytes(F.col("o_custkey"))).alias("back"))


@query()
def cityhash64(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", cityhash.city_column(F.col("text")).alias("hash"))


@query("SELECT vec_id, round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 5) + 0.0 AS norm2 FROM embeddings")
def vector_algebra(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", r(linalg.array_dot(e, e), 5).alias("norm2"))


@query("SELECT sample_id, round(sum(val * val), 4) + 0.0 AS norm2 FROM (SELECT sample_id, feat, CAST(max(val) AS DOUBLE) AS val FROM sample_features WHERE val IS NOT NULL AND NOT isnan(val) AND feat IS NOT NULL GROUP BY 1, 2) GROUP BY 1")
def sparse_algebra(spark: SparkSession, d: str) -> DataFrame:
    one = table(spark, d, "sample_features").where("val IS NOT NULL AND NOT isnan(val) AND feat IS NOT NULL").groupBy("sample_id", "feat").agg(F.max("val").cast("double").alias("val"))
    maps = one.groupBy("sample_id").agg(F.map_from_entries(F.collect_list(F.struct("feat", "val"))).alias("m"))
    return maps.select("sample_id", r(linalg.map_dot(F.col("m"), F.col("m")), 4).alias("norm2"))


