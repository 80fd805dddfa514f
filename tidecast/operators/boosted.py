"""One boosted model over rows of any number of series, on Spark ML.

``GBTRegressor`` distributes the split search over the cluster, at the price of several Spark jobs a round whatever the data size; ``boosting`` fits one model per
series instead. Missing values at prediction time are sent to the lowest bin, as a learner does that treats missing as the minimum.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, functions as F

from tidecast.fixed_values import ALL_FEATURES

MISSING = -1e15


@dataclass(frozen=True)
class BoostParams:
    max_iter: int = 300
    step_size: float = 0.099
    max_depth: int = 3
    min_instances: int = 1
    subsample: float = 1.0
    feature_subset: str = "all"
    seed: int = 42
    validation_tol: float = 1e-4          # stop once a round improves the held-out error by less than this share


# the two settings in use: shallow trees on everything, and the sampled variant
SHALLOW = BoostParams()
SAMPLED = BoostParams(min_instances=30, subsample=0.8, feature_subset="0.8")


def training_rows(features: DataFrame, label: str, columns=ALL_FEATURES) -> DataFrame:
    """Rows with every feature and the label present."""
    return features.dropna(subset=[*columns, label])


def gbt_fit(features: DataFrame, label: str, columns=ALL_FEATURES, params: BoostParams = SHALLOW,
            validation: str | None = None) -> PipelineModel:
    """Fit on complete rows. ``validation`` names a boolean column of held-out rows that stop training early."""
    rows = training_rows(features, label, columns)
    kept = [F.col(c).cast("double").alias(c) for c in columns] + [F.col(label).cast("double").alias("label")]
    if validation:
        kept.append(F.col(validation))
    assembler = VectorAssembler(inputCols=list(columns), outputCol="features")
    wanted = ["features", "label"] + ([validation] if validation else [])
    train = assembler.transform(rows.select(*kept)).select(*wanted).persist()
    learner = GBTRegressor(featuresCol="features", labelCol="label", predictionCol="residual_pred",
                           maxIter=params.max_iter, stepSize=params.step_size, maxDepth=params.max_depth,
                           minInstancesPerNode=params.min_instances, subsamplingRate=params.subsample,
                           featureSubsetStrategy=params.feature_subset, seed=params.seed)
    if validation:
        learner = learner.setValidationIndicatorCol(validation).setParams(validationTol=params.validation_tol)
    try:
        model = learner.fit(train)
    finally:
        train.unpersist()
    return PipelineModel(stages=[assembler, model])


def gbt_predict(model: PipelineModel, features: DataFrame, columns=ALL_FEATURES) -> DataFrame:
    """Adds ``residual_pred``; missing features are routed as the minimum."""
    columns = model.stages[0].getInputCols()
    filled = features.select(
        *[c for c in features.columns if c not in columns],
        *[F.coalesce(F.col(c).cast("double"), F.lit(MISSING)).alias(c) for c in columns])
    scored = model.transform(filled).select(
        *[c for c in features.columns if c not in columns], *columns, "residual_pred")
    back = [F.nullif(F.col(c), F.lit(MISSING)).alias(c) if c in columns else F.col(c) for c in features.columns]
    return scored.select(*back, "residual_pred")
