"""Learners over keyed parameters as synchronous join-and-aggregate dataflows: logistic regression, FM, field-aware FM.

Samples are rows (sample, label, feat, val). One step joins them to the parameters, sums margins by sample, gradients by
feature, and updates the table. The gradients of a hot feature (the bias) are pre-aggregated before their shuffle by the partial
aggregation; the join that pulls its weight is an inner or left join with a new distribution after it, so Spark's skew handling
splits its partition. No state is kept between steps but the snapshot of the parameters.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.functions.losses import log1p_exp, sigmoid
from grainmill.params.store import ParamStore, StoreConfig, pull
from grainmill.params.updaters import AdaGrad, DelayCompensated, Ftrl, Momentum, Sgd, Updater
from grainmill.session import cut

#: Margins beyond this are cut when the loss is computed.
CLIP = 13.0


def margins(samples: DataFrame, params: DataFrame, config: StoreConfig, index: int = 0, sample: str = "sample_id") -> DataFrame:
    """(sample, label, margin): the inner product of each sample's values with element `index` of the parameters."""
    w = pull(params, samples, config, "feat", index, index + 1)
    return w.groupBy(sample).agg(F.max("label").alias("label"), F.sum(F.get("w", 0).cast("double") * F.col("val")).alias("margin"))


def binary_loss(margin: Column, label: Column) -> Column:
    """Logistic loss of labels <= 0 and > 0, with the margin cut at +-CLIP."""
    m = F.greatest(F.least(margin, F.lit(CLIP)), F.lit(-CLIP))
    return F.when(label > 0, log1p_exp(-m)).otherwise(log1p_exp(m))


def predict(samples: DataFrame, params: DataFrame, config: StoreConfig, index: int = 0, sample: str = "sample_id") -> DataFrame:
    """(sample, label, probability)."""
    return margins(samples, params, config, index, sample).select(sample, "label", sigmoid(F.col("margin")).alias("probability"))


def gradients(samples: DataFrame, params: DataFrame, config: StoreConfig, index: int = 0, sample: str = "sample_id", subsample_label: float | None = None, rate: float = 1.0, scale: Column | float | None = None) -> tuple[DataFrame, DataFrame]:
    """((id, g array) summed over the samples, (n, loss, positives, negatives)).

    Rows of the label that was sampled at `rate` weigh 1 / rate. Gradients are divided by the number of samples, or by `scale`.
    """
    m = cut(margins(samples, params, config, index, sample))
    weight = F.when(F.col("label") == subsample_label, 1.0 / rate).otherwise(1.0) if subsample_label is not None else F.lit(1.0)
    y = (F.col("label") > 0).cast("double")
    info = m.agg(F.count(F.lit(1)).alias("n"), F.sum(binary_loss(F.col("margin"), F.col("label"))).alias("loss"), F.sum(y).alias("positives"), F.sum(1 - y).alias("negatives"))
    factor = m.select(F.col(sample).alias("__s"), ((sigmoid(F.col("margin")) - y) * weight).alias("f"))
    n = scale if scale is not None else max(1, info.head()["n"])
    g = samples.join(factor, F.col(sample) == F.col("__s")).groupBy(F.col("feat").alias("id")).agg((F.sum(F.col("f") * F.col("val")) / n).alias("g"))
    return g.where("id IS NOT NULL").select("id", F.array("g").alias("g")), info


@dataclass
class TrainingInfo:
    """Mean loss per epoch, and the numbers of positive and negative samples."""

    losses: list[float] = field(default_factory=list)
    positives: int = 0
    negatives: int = 0


def _batches(samples: DataFrame, sample: str, batch_size: int | None, batches: int | None, folder: str) -> list[DataFrame]:
    """The samples of each mini-batch, by the hash of the sample's key: no order is needed and a retry gives the same batches.

    More than one batch is written once, a folder a batch, so that a step reads its own samples only and not the whole table.
    """
    if batch_size is None and batches is None:
        return [samples]
    k = batches or max(1, round(samples.select(sample).distinct().count() / batch_size))
    if k == 1:
        return [samples]
    path = f"{folder}/batches-{uuid.uuid4().hex[:8]}"
    samples.withColumn("__b", F.pmod(F.xxhash64(sample, F.lit("batch")), F.lit(k)).cast("int")).write.partitionBy("__b").parquet(path)
    kept = samples.sparkSession.read.parquet(path)
    return [kept.where(F.col("__b") == b).drop("__b") for b in range(k)]


def _readable(samples: DataFrame, *more: str) -> DataFrame:
    """Samples with a label, an id and a value (and `more`)."""
    return samples.where(" AND ".join(f"{c} IS NOT NULL" for c in ("label", "feat", "val", *more)) + " AND NOT isnan(val) AND NOT isnan(label)")


def _run_epochs(learner, samples: DataFrame, store: ParamStore, step: Callable[[DataFrame], tuple[DataFrame, DataFrame]], tag: str | None = None) -> TrainingInfo:  # noqa: ANN001
    """One pull, gradient and push a batch; the mean loss of each epoch. The last snapshot gets `tag`, those before keep the store's."""
    parts = _batches(samples, learner.sample, getattr(learner, "batch_size", None), learner.batches, store.folder)
    info = TrainingInfo()
    for epoch in range(learner.epochs):
        total, n = 0.0, 0
        for i, part in enumerate(parts):
            g, stats = step(part)
            r = stats.head()
            store.push(g, learner.updater, tag if epoch + 1 == learner.epochs and i + 1 == len(parts) else store.tag)
            total, n = total + (r["loss"] or 0.0), n + (r["n"] or 0)
            if epoch == 0 and "positives" in stats.columns:
                info.positives += int(r["positives"] or 0)
                info.negatives += int(r["negatives"] or 0)
        info.losses.append(total / max(1, n))
    return info


@dataclass
class LogisticLearner:
    """Mini-batch logistic regression; the updater decides the optimiser and the state of each weight."""

    updater: Updater
    length: int = 1
    index: int = 0
    epochs: int = 1
    batch_size: int | None = None
    batches: int | None = None
    sample: str = "sample_id"

    @classmethod
    def sgd(cls, lr: float = 0.01, **kw: object) -> LogisticLearner:
        return cls(Sgd(lr), 1, 0, **kw)

    @classmethod
    def momentum(cls, lr: float = 0.01, coff: float = 0.1, **kw: object) -> LogisticLearner:
        return cls(Momentum(lr, coff), 2, 0, **kw)

    @classmethod
    def delay_compensated(cls, lr: float = 0.01, coff: float = 0.1, **kw: object) -> LogisticLearner:
        return cls(DelayCompensated(lr, coff), 2, 0, **kw)

    @classmethod
    def ftrl(cls, alpha: float = 1.0, beta: float = 1.0, lambda1: float = 1.0, lambda2: float = 1.0, **kw: object) -> LogisticLearner:
        return cls(Ftrl(alpha, beta, lambda1, lambda2), 3, 2, **kw)

    def config(self, **kw: object) -> StoreConfig:
        return StoreConfig(**({"dtype": "float_array", "length": self.length} | kw))

    def fit(self, samples: DataFrame, store: ParamStore, tag: str | None = None) -> TrainingInfo:
        """Trains into `store`. Samples without a label, id or value are left out."""
        return _run_epochs(self, _readable(samples), store, lambda part: gradients(part, store.params, store.config, self.index, self.sample), tag)

    def predict(self, samples: DataFrame, store: ParamStore) -> DataFrame:
        return predict(samples, store.params, store.config, self.index, self.sample)


# ---- factorization machines ---------------------------------------------------------------------------------------------


def fm_predict(samples: DataFrame, params: DataFrame, config: StoreConfig, sample: str = "sample_id", bias_id: int = 0) -> DataFrame:
    """(sample, label, margin): w0 + sum w x + 1/2 sum_f ((sum v x)^2 - sum (v x)^2); parameters are [w, v_1 .. v_k], id `bias_id` holds w0."""
    k = config.length - 1
    w = pull(params, samples, config, "feat")
    x = F.col("val").cast("double")
    v = lambda f: F.get("w", f + 1).cast("double") * x
    inner = F.col("feat") != bias_id
    aggs = [F.sum(F.get("w", 0).cast("double") * x).alias("lin")]
    for f in range(k):
        aggs += [F.sum(F.when(inner, v(f)).otherwise(0.0)).alias(f"s{f}"), F.sum(F.when(inner, v(f) * v(f)).otherwise(0.0)).alias(f"q{f}")]
    sums = w.groupBy(sample).agg(F.max("label").alias("label"), *aggs)
    pair = sum((F.col(f"s{f}") * F.col(f"s{f}") - F.col(f"q{f}") for f in range(k)), F.lit(0.0))
    return sums.select(sample, "label", (F.col("lin") + 0.5 * pair).alias("margin"), *[f"s{f}" for f in range(k)])


def fm_gradients(samples: DataFrame, params: DataFrame, config: StoreConfig, sample: str = "sample_id", bias_id: int = 0, subsample_label: float | None = None, rate: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """((id, g array), (n, loss)): mean gradients [w, v_1 .. v_k] of log(1 + exp(-y m)) with labels mapped to -1 and 1.

    Samples of the label that was kept at `rate` only weigh 1 / rate, in the loss too.
    """
    k = config.length - 1
    weight = F.when(F.col("label") == subsample_label, 1.0 / rate).otherwise(1.0) if subsample_label is not None else F.lit(1.0)
    m = cut(fm_predict(samples, params, config, sample, bias_id).withColumn("c", weight))
    y = F.when(F.col("label") > 0, 1.0).otherwise(-1.0)
    info = m.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("c") * log1p_exp(-y * F.col("margin"))).alias("loss"))
    n = max(1, m.count())
    f = m.select(F.col(sample).alias("__s"), (-y * sigmoid(-y * F.col("margin")) * F.col("c")).alias("f"), *[f"s{i}" for i in range(k)])
    w = pull(params, samples, config, "feat").join(f, F.col(sample) == F.col("__s"))
    x = F.col("val").cast("double")
    gs = [F.sum(F.col("f") * x) / n]
    for i in range(k):
        gi = F.col("f") * (x * F.col(f"s{i}") - F.get("w", i + 1).cast("double") * x * x)
        gs.append(F.sum(F.when(F.col("feat") != bias_id, gi).otherwise(0.0)) / n)
    named = [g.alias(f"g{i}") for i, g in enumerate(gs)]
    return w.groupBy(F.col("feat").alias("id")).agg(*named).select("id", F.array(*[f"g{i}" for i in range(k + 1)]).alias("g")), info


@dataclass
class FmLearner:
    """Factorization machine: [w, v_1 .. v_rank] a feature, small seeded start values, the pull of rank factors and a weight in one row."""

    updater: Updater
    rank: int
    epochs: int = 1
    batches: int | None = None
    bias_id: int = 0
    subsample_label: float | None = None
    rate: float = 1.0
    sample: str = "sample_id"

    def config(self, **kw: object) -> StoreConfig:
        return StoreConfig(**({"dtype": "float_array", "length": self.rank + 1, "low": -0.01, "high": 0.01} | kw))

    def fit(self, samples: DataFrame, store: ParamStore, tag: str | None = None) -> TrainingInfo:
        return _run_epochs(self, _readable(samples), store, lambda part: fm_gradients(part, store.params, store.config, self.sample, self.bias_id, self.subsample_label, self.rate), tag)

    def predict(self, samples: DataFrame, store: ParamStore) -> DataFrame:
        m = fm_predict(samples, store.params, store.config, self.sample, self.bias_id)
        return m.select(self.sample, "label", sigmoid(F.col("margin")).alias("probability"))


# ---- field-aware factorization machines -----------------------------------------------------------------------------------


def _ffm_rows(samples: DataFrame, params: DataFrame, config: StoreConfig, width: int, sample: str) -> DataFrame:
    """(sample, label, fs): one row a sample with its features as (field, feat, val, w). Repeats of a feature in a field are added up."""
    one = samples.groupBy(sample, "field", "feat").agg(F.max("label").alias("label"), F.sum(F.col("val").cast("double")).alias("val"))
    w = pull(params, one, config, "feat", 0, width)
    part = F.struct("field", "feat", "val", F.col("w").cast("array<double>").alias("w"))
    return w.groupBy(sample).agg(F.max("label").alias("label"), F.collect_list(part).alias("fs"))


#: Samples whose field sums are held at a time: fields x fields x rank doubles each.
FFM_CHUNK = 512


def _ffm_chunks(b: pa.RecordBatch, rank: int, fields: int) -> Iterator[tuple[slice, np.ndarray, ...]]:
    """Parts of a batch with, per feature, its sample within the part, field, id, value and factors, and per sample the margin and field sums.

    The field sum S[f, g] adds up x v_g over the features of field f. The margin - the sum over pairs of <v_i for j's field,
    v_j for i's field> x_i x_j - is half of the sum of <S[f, g], S[g, f]> less what features have with themselves, so no pair is formed.
    """
    for lo in range(0, b.num_rows, FFM_CHUNK):
        fs = b.column("fs").slice(lo, FFM_CHUNK)
        lens = pc.list_value_length(fs).to_numpy()
        flat = fs.flatten()
        field, val = flat.field("field").to_numpy(zero_copy_only=False).astype(np.int64), flat.field("val").to_numpy(zero_copy_only=False)
        w = flat.field("w").flatten().to_numpy(zero_copy_only=False).reshape(len(field), fields, rank)
        s = np.repeat(np.arange(len(lens)), lens)
        known = (field >= 0) & (field < fields)
        s, field, val, w, ids = s[known], field[known], val[known], w[known], flat.field("feat").to_numpy(zero_copy_only=False)[known]
        vx = w * val[:, None, None]
        sums = np.zeros((len(lens), fields, fields, rank))
        np.add.at(sums, (s, field), vx)
        own = vx[np.arange(len(s)), field]
        margin = 0.5 * (np.einsum("sfgr,sgfr->s", sums, sums) - np.bincount(s, weights=(own * own).sum(axis=1), minlength=len(lens)))
        yield slice(lo, lo + len(lens)), s, field, ids, val, own, margin, sums


def ffm_margin(samples: DataFrame, params: DataFrame, config: StoreConfig, rank: int, sample: str = "sample_id", fields: int | None = None) -> DataFrame:
    """(sample, label, margin): sum over pairs of <v_i for j's field, v_j for i's field> x_i x_j; 0 for a sample of one feature.

    Features of fields beyond `fields` (as many as the parameters have, if not given) count for nothing.
    """
    fields = fields or config.length // rank
    rows = _ffm_rows(samples, params, config, rank * fields, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.zeros(b.num_rows)
            for part, *_, margin, _sums in _ffm_chunks(b, rank, fields):
                out[part] = margin
            yield pa.RecordBatch.from_arrays([b.column(0), b.column("label"), pa.array(out)], names=["s", "label", "margin"])

    ddl = f"`{sample}` {samples.schema[sample].dataType.simpleString()}, label {rows.schema['label'].dataType.simpleString()}, margin double"
    return rows.mapInArrow(run, ddl)


def ffm_gradients(samples: DataFrame, params: DataFrame, config: StoreConfig, rank: int, fields: int, sample: str = "sample_id") -> tuple[DataFrame, DataFrame]:
    """((id, g array of rank * fields), (n, loss)): mean gradients of log(1 + exp(-y m)), labels mapped to -1 and 1.

    One pass: samples are joined to their factors and gathered by sample once; margins, loss and gradients come from the same
    field sums, and a task adds up the gradients of equal ids before they are shuffled.
    """
    rows, width = _ffm_rows(samples, params, config, rank * fields, sample), rank * fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = np.where(b.column("label").to_numpy(zero_copy_only=False) > 0, 1.0, -1.0)
            for part, s, field, ids, val, own, margin, sums in _ffm_chunks(b, rank, fields):
                ym = y[part] * margin
                factor = -y[part] / (1 + np.exp(np.minimum(ym, 700)))
                g = sums[s, :, field, :] * val[:, None, None]
                g[np.arange(len(s)), field] -= own * val[:, None]
                g *= factor[s][:, None, None]
                keys, at = np.unique(ids, return_inverse=True)
                total = np.zeros((len(keys), width))
                np.add.at(total, at, g.reshape(len(s), width))
                stats = np.zeros((1, width + 2))
                stats[0, -2:] = len(ym), np.logaddexp(0, -ym).sum()
                flat = np.concatenate([np.concatenate([total, np.zeros((len(keys), 2))], axis=1), stats])
                offs = pa.array(np.arange(0, flat.size + 1, width + 2), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([*keys.tolist(), None], pa.int64()), pa.ListArray.from_arrays(offs, pa.array(flat.ravel()))], names=["id", "g"])

    parts = rows.mapInArrow(run, "id bigint, g array<double>")
    sums = cut(parts.groupBy("id").agg(*[F.sum(F.get("g", i)).alias(f"g{i}") for i in range(width + 2)]))
    info = sums.where("id IS NULL").select(F.col(f"g{width}").cast("bigint").alias("n"), F.col(f"g{width + 1}").alias("loss"))
    stats = info.head()
    if stats is None:  # no samples
        return sums.where("id IS NOT NULL").select("id", F.array(*[f"g{i}" for i in range(width)]).alias("g")), sums.agg(F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("loss"))
    n = max(1, stats["n"])
    return sums.where("id IS NOT NULL").select("id", F.array(*[F.col(f"g{i}") / n for i in range(width)]).alias("g")), info


def frequent_features(samples: DataFrame, min_count: int = 2) -> DataFrame:
    """`samples` without features that occur fewer than `min_count` times: an exact count in place of a filter that guesses."""
    often = samples.groupBy(F.col("feat").alias("__f")).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= min_count)
    return samples.join(often.select("__f"), F.col("feat") == F.col("__f"), "left_semi")


@dataclass
class FfmLearner:
    """Field-aware factorization machine: factors of `rank` per field, small seeded start values, features seen at least twice.

    With the updater AdaGrad a parameter holds the factors and as many sums of squared gradients, which start at `init_sum`.
    """

    updater: Updater
    rank: int
    fields: int
    epochs: int = 1
    batches: int | None = None
    min_count: int = 2
    sample: str = "sample_id"
    init_sum: float = 1.0

    def config(self, **kw: object) -> StoreConfig:
        n = self.rank * self.fields
        states = 2 if isinstance(self.updater, AdaGrad) else 1
        return StoreConfig(**({"dtype": "float_array", "length": n * states, "low": 0.0, "high": 0.02, "drawn": n, "init": self.init_sum if states == 2 else 0.0} | kw))

    def fit(self, samples: DataFrame, store: ParamStore, tag: str | None = None) -> TrainingInfo:
        rows = frequent_features(_readable(samples, "field"), self.min_count)
        return _run_epochs(self, rows, store, lambda part: ffm_gradients(part, store.params, store.config, self.rank, self.fields, self.sample), tag)

    def predict(self, samples: DataFrame, store: ParamStore) -> DataFrame:
        m = ffm_margin(samples, store.params, store.config, self.rank, self.sample, self.fields)
        return m.select(self.sample, "label", sigmoid(F.col("margin")).alias("probability"))
