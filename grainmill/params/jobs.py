"""Job settings from the session's configuration, and the train / predict / increment drivers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.params.learning import FfmLearner, FmLearner, LogisticLearner, TrainingInfo
from grainmill.params.store import ParamStore, StoreConfig
from grainmill.params.updaters import AdaGrad, Elementwise
from grainmill.schema import EngineError
from grainmill.sources.files import explode_samples, parse_field_lines, parse_id_lines

PREFIX = "spark.grainmill."
# Settings a job reads, with their defaults.
SETTINGS = {
    "job.type": "train", "data.path": "", "model.path": "", "output.path": "", "data.partitions": "0", "data.separator": " ", "learner": "ftrl",
    "train.epochs": "1", "train.batch": "0", "train.batches": "0", "learning.rate": "0.01", "momentum.coff": "0.1", "dcasgd.coff": "0.1",
    "ftrl.alpha": "1", "ftrl.beta": "1", "ftrl.lambda1": "1", "ftrl.lambda2": "1", "ftrl.force.sparse": "false", "fm.rank": "8", "fm.bias.id": "0",
    "ffm.rank": "4", "ffm.fields": "16", "ffm.min.count": "2", "adagrad.eps": "1e-8", "adagrad.init.sum": "1", "subsample.label": "", "subsample.rate": "1",
    "init.value": "0", "init.low": "", "init.high": "", "init.seed": "17", "table": "params", "store.buckets": "0", "store.folder": "",
}


@dataclass(frozen=True)
class JobSettings:
    values: dict[str, str]

    @classmethod
    def read(cls, spark: SparkSession) -> JobSettings:
        return cls({k: spark.conf.get(PREFIX + k, v) for k, v in SETTINGS.items()})

    def text(self, key: str) -> str:
        return self.values[key]

    def number(self, key: str) -> float:
        return float(self.values[key])


Learner = LogisticLearner | FmLearner | FfmLearner


def learner_of(s: JobSettings) -> Learner:
    """sgd, momentum, dcasgd and ftrl are logistic regressions; fm, ffm and ffm-adagrad factorization machines."""
    size, batches, lr = int(s.number("train.batch")) or None, int(s.number("train.batches")) or None, s.number("learning.rate")
    common = {"epochs": int(s.number("train.epochs")), "batches": batches}
    kind = s.text("learner")
    if kind == "sgd":
        return LogisticLearner.sgd(lr, batch_size=size, **common)
    if kind == "momentum":
        return LogisticLearner.momentum(lr, s.number("momentum.coff"), batch_size=size, **common)
    if kind == "dcasgd":
        return LogisticLearner.delay_compensated(lr, s.number("dcasgd.coff"), batch_size=size, **common)
    if kind == "ftrl":
        out = LogisticLearner.ftrl(s.number("ftrl.alpha"), s.number("ftrl.beta"), s.number("ftrl.lambda1"), s.number("ftrl.lambda2"), batch_size=size, **common)
        return replace(out, updater=replace(out.updater, force_sparse=s.text("ftrl.force.sparse").lower() == "true"))
    if kind == "fm":
        label = float(s.text("subsample.label")) if s.text("subsample.label") else None
        return FmLearner(Elementwise(lr), int(s.number("fm.rank")), bias_id=int(s.number("fm.bias.id")), subsample_label=label, rate=s.number("subsample.rate"), **common)
    if kind in ("ffm", "ffm-adagrad"):
        updater = Elementwise(lr) if kind == "ffm" else AdaGrad(lr, s.number("adagrad.eps"))
        return FfmLearner(updater, int(s.number("ffm.rank")), int(s.number("ffm.fields")), min_count=int(s.number("ffm.min.count")), init_sum=s.number("adagrad.init.sum"), **common)
    raise EngineError(f"learner is sgd, momentum, dcasgd, ftrl, fm, ffm or ffm-adagrad, not {kind}")


#: A user's own way from lines (sample_id, value) to samples (sample_id, label, [field,] feat, val).
Parse = Callable[[DataFrame], DataFrame]


def read_samples(spark: SparkSession, s: JobSettings, parse: Parse | None = None) -> DataFrame:
    """Samples from the lines at data.path: by `parse`, or as id lines, or as field lines for field-aware machines."""
    lines = spark.read.text(s.text("data.path")).withColumn("sample_id", F.monotonically_increasing_id())
    own = parse_field_lines if s.text("learner").startswith("ffm") else parse_id_lines
    rows = parse(lines) if parse else explode_samples(own(lines, sep=s.text("data.separator")))
    n = int(s.number("data.partitions"))
    return rows.repartition(n) if n > 1 else rows


def run_job(spark: SparkSession, s: JobSettings | None = None, parse: Parse | None = None) -> TrainingInfo | DataFrame:
    """train and increment_train write the model to output.path and return the losses; predict writes and returns the predictions."""
    s = s or JobSettings.read(spark)
    learner = learner_of(s)
    init = {"low": s.number("init.low"), "high": s.number("init.high")} if s.text("init.low") and s.text("init.high") else {}
    if isinstance(learner, LogisticLearner):
        init["init"] = s.number("init.value")
    config: StoreConfig = learner.config(table=s.text("table"), seed=int(s.number("init.seed")), buckets=int(s.number("store.buckets")), **init)
    store = ParamStore(spark, config, s.text("job.type"), s.text("model.path") or None, s.text("store.folder") or None)
    samples = read_samples(spark, s, parse)
    if s.text("job.type") == "predict":
        out = learner.predict(samples, store)
        if s.text("output.path"):
            out.write.mode("overwrite").csv(s.text("output.path"))
        return out
    info = learner.fit(samples, store)
    if s.text("output.path"):
        store.save(s.text("output.path"))
    return info
