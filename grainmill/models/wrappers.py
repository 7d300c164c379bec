"""Models over dense tables with string categories: generalised linear, boosted trees, random forest, multi-layer perceptron.

All take (feature columns, label column, family) and give the rows' `predict` and p0 .. p{K-1} in place of the frame.
They are trained by Spark ML; README lists what it has no equal for.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import Imputer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainmill.models.boosting import AnnealedTrees
from grainmill.models.network import ACTIVATIONS, Network, NetworkTrainer
from grainmill.schema import EngineError

# Families, treatments of missing numbers, encodings of categories, kinds of histograms.
FAMILIES = ("binomial", "bernoulli", "multinomial", "gaussian")
MISSING = ("MeanImputation", "Skip")
ENCODINGS = ("AUTO", "Enum", "OneHotInternal", "OneHotExplicit", "Binary", "Eigen", "LabelEncoder", "SortByResponse", "EnumLimited")
HISTOGRAMS = ("AUTO", "UniformAdaptive", "QuantilesGlobal", "Random", "RoundRobin")
#: The level of a category that is NULL or empty.
NO_LEVEL = "<none>"


@dataclass
class _Dense:
    """What all wrappers share: which columns, how categories and missing numbers become a vector."""

    features: list[str]
    label: str
    family: str = "binomial"
    missing: str = "MeanImputation"
    one_hot: bool = False
    seed: int = 42

    def _check(self, df: DataFrame) -> tuple[list[str], list[str]]:
        if self.family not in FAMILIES:
            raise EngineError(f"family is one of {FAMILIES}")
        if self.missing not in MISSING:
            raise EngineError(f"missing is one of {MISSING}")
        cats = [c for c in self.features if isinstance(df.schema[c].dataType, T.StringType)]
        nums = [c for c in self.features if isinstance(df.schema[c].dataType, T.NumericType)]
        if len(cats) + len(nums) != len(self.features):
            raise EngineError("features are numbers or strings")
        return cats, nums

    def _prepare(self, df: DataFrame, labelled: bool = True, keep: list[str] = ()) -> DataFrame:
        y = [F.col(self.label).cast("double" if self.family == "gaussian" else "string").alias("__y")] if labelled else []
        x = lambda c: F.when(F.abs(F.col(c).cast("double")) < float("inf"), F.col(c).cast("double"))  # noqa: E731 - NaN and infinities count as missing
        level = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) == "", NO_LEVEL).otherwise(F.col(c))
        out = df.select(*[(x if isinstance(df.schema[c].dataType, T.NumericType) else level)(c).alias(c) for c in self.features], *y, *[F.col(c).alias(f"__k_{c}") for c in keep])
        out = out.where("__y IS NOT NULL") if labelled else out
        return out.na.drop(subset=self._check(df)[1]) if self.missing == "Skip" else out

    def _stages(self, df: DataFrame, one_hot: bool, scale: bool = False) -> list:
        from pyspark.ml.feature import OneHotEncoder

        cats, nums = self._check(df)
        stages: list = []
        if cats:
            stages.append(StringIndexer(inputCols=cats, outputCols=[f"__i_{c}" for c in cats], handleInvalid="keep"))
            if one_hot:
                stages.append(OneHotEncoder(inputCols=[f"__i_{c}" for c in cats], outputCols=[f"__h_{c}" for c in cats], handleInvalid="keep"))
        if nums:
            stages.append(Imputer(inputCols=nums, outputCols=[f"__n_{c}" for c in nums]))
        vec = [f"__n_{c}" for c in nums] + [f"__{'h' if one_hot else 'i'}_{c}" for c in cats]
        stages.append(VectorAssembler(inputCols=vec, outputCol="__raw" if scale else "__x", handleInvalid="keep"))
        if scale:
            stages.append(StandardScaler(inputCol="__raw", outputCol="__x", withMean=True))
        if self.family != "gaussian":
            stages.append(StringIndexer(inputCol="__y", outputCol="__l", stringOrderType="alphabetAsc"))
        return stages

    @property
    def _target(self) -> str:
        return "__y" if self.family == "gaussian" else "__l"

    def _model(self, n_classes: int, width: int):  # noqa: ANN202
        raise NotImplementedError

    def fit(self, df: DataFrame, validation: DataFrame | None = None) -> DenseModel:
        """A fitted model; with a validation frame its metric is in `validation_metric`."""
        rows = self._prepare(df)
        if rows.select("__y").limit(1).count() == 0:
            raise EngineError("no labelled rows")
        prep = Pipeline(stages=self._stages(df, self.one_hot, self._scale())).fit(rows)
        ready = prep.transform(rows)
        classes = prep.stages[-1].labels if self.family != "gaussian" else []
        width = ready.select(F.size(vector_to_array("__x"))).first()[0]
        cats = [s for s in prep.stages if s.__class__.__name__ == "StringIndexerModel"]
        self._bins = max([32, *[len(x) + 2 for s in cats for x in s.labelsArray]])
        fitted = self._model(len(classes), width).fit(ready)
        model = DenseModel(PipelineModel(stages=[*prep.stages, fitted]), self.family, len(classes), self)
        if validation is not None:
            model.validation_metric = model.evaluate(validation)
        return model

    def _scale(self) -> bool:
        return False


@dataclass
class DenseModel:
    """A pipeline with its family. `transform` gives predict and class probabilities, of rows without a label too; `save`/`load` keep everything."""

    pipeline: PipelineModel
    family: str
    n_classes: int
    spec: _Dense | None = None
    validation_metric: float | None = None

    def _scored(self, df: DataFrame, labelled: bool = True, keep: list[str] = ()) -> DataFrame:
        if self.spec is None:
            return self.pipeline.transform(df.select("*", *[F.col(c).alias(f"__k_{c}") for c in keep]))
        of_label = lambda s: s.__class__.__name__ == "StringIndexerModel" and s.isSet("inputCol") and s.getInputCol() == "__y"
        stages = [s for s in self.pipeline.stages if labelled or not of_label(s)]
        return PipelineModel(stages=stages).transform(self.spec._prepare(df, labelled, keep))

    def transform(self, df: DataFrame, keep: list[str] = ()) -> DataFrame:
        """predict and (but for gaussian) p0, p1, ...; `keep` are columns of `df` to carry along."""
        out = self._scored(df, labelled=False, keep=keep)
        kept = [F.col(f"__k_{c}").alias(c) for c in keep]
        if self.family == "gaussian":
            return out.select(*kept, F.col("prediction").alias("predict"))
        labels = [s for s in self.pipeline.stages if s.__class__.__name__ == "StringIndexerModel"][-1].labels
        name = F.element_at(F.array(*[F.lit(x) for x in labels]), F.col("prediction").cast("int") + 1)
        if "probability" in out.columns:
            ps = vector_to_array("probability")
        else:  # margins only: one against the rest
            raw = vector_to_array("rawPrediction")
            e = F.transform(raw, lambda x: 1 / (1 + F.exp(-x)))
            ps = F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))
        return out.select(*kept, name.alias("predict"), *[F.get(ps, i).alias(f"p{i}") for i in range(self.n_classes)])

    def evaluate(self, df: DataFrame) -> float:
        """RMSE for gaussian, AUROC for two classes, accuracy for more."""
        out = self._scored(df)
        if self.family == "gaussian":
            return out.agg(F.sqrt(F.avg((F.col("prediction") - F.col("__y")) ** 2))).head()[0]
        if self.n_classes == 2 and "rawPrediction" in out.columns:
            return BinaryClassificationEvaluator(labelCol="__l", rawPredictionCol="rawPrediction").evaluate(out)
        return MulticlassClassificationEvaluator(labelCol="__l", metricName="accuracy").evaluate(out)

    def save(self, path: str) -> None:
        self.pipeline.write().overwrite().save(path)

    @classmethod
    def load(cls, path: str, spec: _Dense) -> DenseModel:
        p = PipelineModel.load(path)
        labels = [s for s in p.stages if s.__class__.__name__ == "StringIndexerModel"]
        return cls(p, spec.family, len(labels[-1].labels) if spec.family != "gaussian" else 0, spec)


@dataclass
class Glm(_Dense):
    """Generalised linear model by L-BFGS with an elastic net: `alpha` mixes, `lam` weighs the penalty."""

    alpha: float = 0.0
    lam: float = 0.0
    standardization: bool = True
    max_iter: int = 100
    intercept: bool = True
    one_hot: bool = True

    def _model(self, n_classes: int, width: int):  # noqa: ANN202
        common = {"featuresCol": "__x", "labelCol": self._target, "elasticNetParam": self.alpha, "regParam": self.lam, "standardization": self.standardization, "maxIter": self.max_iter, "fitIntercept": self.intercept}
        if self.family == "gaussian":
            return LinearRegression(**common)
        return LogisticRegression(family="multinomial" if self.family == "multinomial" else "binomial", **common)


@dataclass
class _Trees(_Dense):
    max_depth: int = 5
    n_trees: int = 50
    n_bins_cats: int = 256
    n_bins: int = 20
    min_rows: int = 10
    encoding: str = "AUTO"
    histogram: str = "QuantilesGlobal"
    score_interval: int = 0

    def _common(self) -> dict:
        if self.encoding not in ENCODINGS or self.histogram not in HISTOGRAMS:
            raise EngineError(f"encoding is one of {ENCODINGS}, histogram one of {HISTOGRAMS}")
        return {"featuresCol": "__x", "labelCol": self._target, "maxDepth": min(self.max_depth, 30), "maxBins": max(self.n_bins, self._bins), "minInstancesPerNode": self.min_rows, "seed": self.seed}


@dataclass
class Gbm(_Trees):
    """Gradient-boosted trees; more than two classes are boosted one against the rest.

    `learn_rate_annealing` below 1 multiplies the rate of each tree by that of the tree before.
    """

    family: str = "bernoulli"
    learn_rate: float = 0.1
    learn_rate_annealing: float = 1.0

    def _model(self, n_classes: int, width: int):  # noqa: ANN202
        if not 0 < self.learn_rate_annealing <= 1:
            raise EngineError("learn_rate_annealing is above 0 and at most 1")
        if self.learn_rate_annealing < 1:
            if n_classes > 2:
                raise EngineError("a falling learning rate is for two classes or a number")
            tree = {k: v for k, v in self._common().items() if k not in ("featuresCol", "labelCol")}
            return AnnealedTrees(self.n_trees, self.learn_rate, self.learn_rate_annealing, self.family != "gaussian", tree, label=self._target)
        common = self._common() | {"maxIter": self.n_trees, "stepSize": self.learn_rate}
        if self.family == "gaussian":
            return GBTRegressor(**common)
        one = GBTClassifier(**common)
        return OneVsRest(classifier=one, featuresCol="__x", labelCol="__l") if n_classes > 2 else one


@dataclass
class Drf(_Trees):
    """Random forest."""

    max_depth: int = 20
    min_rows: int = 1

    def _model(self, n_classes: int, width: int):  # noqa: ANN202
        common = self._common() | {"numTrees": self.n_trees}
        return RandomForestRegressor(**common) if self.family == "gaussian" else RandomForestClassifier(**common)


@dataclass
class Svm(_Dense):
    """Linear support vector machine, one against the rest for more classes: the baseline of the one-against-rest learner."""

    max_iter: int = 100
    lam: float = 0.0

    def _model(self, n_classes: int, width: int):  # noqa: ANN202
        one = LinearSVC(featuresCol="__x", labelCol="__l", maxIter=self.max_iter, regParam=self.lam)
        return OneVsRest(classifier=one, featuresCol="__x", labelCol="__l") if n_classes > 2 else one


@dataclass
class Mlp(_Dense):
    """Multi-layer perceptron over standardised features, of classes or (gaussian) of one number.

    Sigmoid layers are trained by Spark ML (ten L-BFGS iterations an epoch), all others by `network` (ten passes an epoch of
    averaged mini-batch steps), which `batch` to `momentum` are for; `dropout` acts on the WithDropout activations.
    """

    hidden: list[int] = field(default_factory=lambda: [200, 200])
    epochs: int = 10
    activation: str = "Rectifier"
    one_hot: bool = True
    batch: int = 32
    dropout: float = 0.5
    input_dropout: float = 0.0
    l1: float = 0.0
    l2: float = 0.0
    adadelta: bool = True
    rho: float = 0.99
    eps: float = 1e-6
    learn_rate: float = 0.1
    momentum: float = 0.5

    def _scale(self) -> bool:
        return True

    def _model(self, n_classes: int, width: int):  # noqa: ANN202
        if self.activation not in ACTIVATIONS:
            raise EngineError(f"activation is one of {ACTIVATIONS}")
        if self.activation == "Sigmoid" and self.family != "gaussian":
            return MultilayerPerceptronClassifier(featuresCol="__x", labelCol="__l", layers=[width, *self.hidden, n_classes], maxIter=self.epochs * 10, seed=self.seed)
        own = {k: getattr(self, k) for k in ("hidden", "activation", "batch", "dropout", "input_dropout", "l1", "l2", "adadelta", "rho", "eps", "learn_rate", "momentum", "seed")}
        return NetworkTrainer(Network(n_classes=0 if self.family == "gaussian" else n_classes, features="__x", label=self._target, epochs=self.epochs * 10, **own))


def auroc(scored: DataFrame, score: str, label: str) -> DataFrame:
    """(auroc): rank-sum over the whole frame, ties half; NULL if a class is absent."""
    from grainmill.operators.profile import numeric_auc

    return numeric_auc(scored, [score], label).select(F.col("auc").alias("auroc"))


def accuracy(scored: DataFrame, prediction: str, label: str) -> DataFrame:
    """(accuracy): share of rows whose prediction equals the label; rows without either are left out."""
    both = scored.where(F.col(prediction).isNotNull() & F.col(label).isNotNull())
    return both.agg(F.avg((F.col(prediction) == F.col(label)).cast("double")).alias("accuracy"))


def right_rate(scored: DataFrame, probability: str, label: str) -> DataFrame:
    """(right_rate): share of rows with (p > 0.5) == (label > 0)."""
    return scored.agg(F.avg(((F.col(probability) > 0.5) == (F.col(label) > 0)).cast("double")).alias("right_rate"))
