"""Boosted trees whose learning rate falls from tree to tree, which Spark ML's boosting can't do.

Trees are fitted one after the other on the residuals of what the trees before give together. The result is an ordinary
pipeline model - the trees, a sum, a sigmoid - so it is saved, loaded and applied by Spark alone.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.functions.losses import sigmoid
from grainmill.schema import EngineError
from grainmill.session import cut

#: Trees after which the residuals are written and their lineage is cut.
CUT_EVERY = 10


@dataclass
class AnnealedTrees:
    """Tree i has the rate learn_rate * annealing ** i. Two classes (labels 0 and 1, log loss) or a number (squared loss)."""

    trees: int
    learn_rate: float
    annealing: float
    classes: bool
    tree: dict
    features: str = "__x"
    label: str = "__l"

    def fit(self, df: DataFrame) -> PipelineModel:
        y, now = F.col("__y_"), F.col("__f")
        mean = df.agg(F.avg(F.col(self.label).cast("double"))).head()[0]
        if mean is None:
            raise EngineError("no rows to train on")
        # the best constant: the log odds, within bounds where there is one class only
        share = min(max(mean, 1e-6), 1 - 1e-6)
        start = math.log(share / (1 - share)) if self.classes else float(mean)
        rows = cut(df.select(F.col(self.features), F.col(self.label).cast("double").alias("__y_"), F.lit(start).alias("__f")))
        stages, terms = [], [repr(start)]
        for i in range(self.trees):
            rate, name = self.learn_rate * self.annealing**i, f"__t{i}"
            residual = y - (sigmoid(now) if self.classes else now)
            one = DecisionTreeRegressor(featuresCol=self.features, labelCol="__r", predictionCol=name, **self.tree).fit(rows.withColumn("__r", residual))
            rows = one.transform(rows).withColumn("__f", now + F.lit(rate) * F.col(name)).drop(name)
            if (i + 1) % CUT_EVERY == 0:
                rows = cut(rows)
            stages.append(one)
            terms.append(f"{rate!r} * {name}")
        total = " + ".join(terms)
        if not self.classes:
            return PipelineModel(stages=[*stages, SQLTransformer(statement=f"SELECT *, {total} AS prediction FROM __THIS__")])
        margin = SQLTransformer(statement=f"SELECT *, {total} AS __m1, -({total}) AS __m0 FROM __THIS__")
        shares = SQLTransformer(statement="SELECT *, 1 / (1 + exp(__m0)) AS __p1, 1 / (1 + exp(__m1)) AS __p0, CASE WHEN __m1 > 0 THEN 1D ELSE 0D END AS prediction FROM __THIS__")
        vectors = [VectorAssembler(inputCols=["__m0", "__m1"], outputCol="rawPrediction"), VectorAssembler(inputCols=["__p0", "__p1"], outputCol="probability")]
        return PipelineModel(stages=[*stages, margin, shares, *vectors])
