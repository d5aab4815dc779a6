"""Boosted trees: Spark ML's, or those of ``gradient_trees``, which know penalties and stop on the validation AUC.
The settings given choose; scoring, saving and loading take either."""

from __future__ import annotations

from dataclasses import dataclass, field

import os

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from txrisk.constants import FEATURES, SAMPLE_SEED
from txrisk.operators import gradient_trees

VECTOR = "_features"

# Settings by their common names -> parameter of the Spark ML learner. The two
# penalties reg_alpha and reg_lambda have no counterpart there; gamma is a gain on
# the scale of its impurity.
PARAMETERS = {
    "n_estimators": "maxIter",
    "max_depth": "maxDepth",
    "learning_rate": "stepSize",
    "subsample": "subsamplingRate",
    "colsample": "featureSubsetStrategy",
    "min_child_weight": "minInstancesPerNode",
    "gamma": "minInfoGain",
}


@dataclass(frozen=True)
class Settings:
    n_estimators: int = 200
    max_depth: int = 6
    learning_rate: float = 0.1
    subsample: float = 0.8
    colsample: float = 0.8
    min_child_weight: int = 1
    gamma: float = 0.0
    scale_pos_weight: float | None = 10.0  # None: negatives per positive
    seed: int = SAMPLE_SEED
    features: list[str] = field(default_factory=lambda: list(FEATURES))


def _numeric(df: DataFrame, features: list[str]) -> DataFrame:
    return df.withColumns({name: F.coalesce(F.col(name).cast("double"), F.lit(0.0)) for name in features})


Model = PipelineModel | gradient_trees.Boosted


def fit(train: DataFrame, settings: Settings | gradient_trees.Settings = Settings(), val: DataFrame | None = None,
        label: str = "isFraud", key: str = "event_id") -> Model:
    """Train; with ``val`` boosting stops once it no longer helps there."""
    if isinstance(settings, gradient_trees.Settings):
        return gradient_trees.fit(train, settings, val, label, key)
    weight = settings.scale_pos_weight
    if weight is None:
        counts = train.agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("n")).first()
        weight = counts["n"] / counts["p"] if counts["p"] else 1.0
    assembler = VectorAssembler(inputCols=settings.features, outputCol=VECTOR)

    def vectors(part: DataFrame, held_out: bool) -> DataFrame:
        # Marked last: the learner's choice by the mark cannot pass the making of vectors, so marked
        # earlier each part would be read, put into vectors and carried as empty partitions by the other.
        made = _numeric(part.select(*settings.features, label), settings.features).withColumns({
            "_weight": F.when(F.col(label) == 1, F.lit(float(weight))).otherwise(F.lit(1.0)),
            label: F.col(label).cast("double"),
        })
        return assembler.transform(made).select(VECTOR, label, "_weight").withColumn("_val", F.lit(held_out))

    rows = vectors(train, False)
    if val is not None:
        rows = rows.unionByName(vectors(val, True))
    learner = GBTClassifier(
        featuresCol=VECTOR, labelCol=label, weightCol="_weight", seed=settings.seed,
        maxIter=settings.n_estimators, maxDepth=settings.max_depth, stepSize=settings.learning_rate,
        subsamplingRate=settings.subsample, featureSubsetStrategy=str(settings.colsample),
        minInstancesPerNode=settings.min_child_weight, minInfoGain=settings.gamma,
    )
    if val is not None:
        learner = learner.setValidationIndicatorCol("_val")
    return PipelineModel(stages=[assembler, learner.fit(rows)])


def features_of(model: Model) -> list[str]:
    if isinstance(model, gradient_trees.Boosted):
        return model.features
    return model.stages[0].getInputCols()


def scored(df: DataFrame, model: Model, name: str = "boosted_probability") -> DataFrame:
    """Add the probability of fraud and the verdict ``<name>_verdict``."""
    if isinstance(model, gradient_trees.Boosted):
        return gradient_trees.scored(df, model, name)
    features = features_of(model)
    shadow = {f: f"_in_{f}" for f in features}
    # The model gets its own copies, so the caller's columns keep their types.
    copies = df.withColumns({shadow[f]: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features})
    assembler = model.stages[0].copy()
    assembler.setInputCols([shadow[f] for f in features])
    trees = model.stages[1].copy()
    trees.setRawPredictionCol("_raw").setProbabilityCol("_probability").setPredictionCol("_prediction")
    out = trees.transform(assembler.transform(copies))
    return (
        out.withColumn(name, vector_to_array("_probability")[1])
        .withColumn(f"{name}_verdict", F.col("_prediction").cast("int"))
        .select(*df.columns, name, f"{name}_verdict")
    )


def importance(model: Model, spark: SparkSession) -> DataFrame:
    """Features by falling importance: one row per feature of the model."""
    if isinstance(model, gradient_trees.Boosted):
        return gradient_trees.importance(model, spark)
    values = model.stages[1].featureImportances.toArray()
    rows = [(name, float(value)) for name, value in zip(features_of(model), values)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def save(model: Model, path: str) -> None:
    if isinstance(model, gradient_trees.Boosted):
        model.save(SparkSession.active(), path)
    else:
        model.write().overwrite().save(path)


def load(path: str) -> Model:
    spark = SparkSession.active()
    try:
        spark.read.parquet(os.path.join(path, "settings"))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return PipelineModel.load(path)
    return gradient_trees.load(spark, path)
