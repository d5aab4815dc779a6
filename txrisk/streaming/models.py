"""Scoring a stream with models that are replaced while it runs.

Models are saved under a version of their own; a version counts once a row naming it is appended to the table of
published versions, which is the last step. Every micro-batch looks up the newest published version and is scored by it
as a whole. What a batch writes lies under its number and replaces what an earlier run of the same batch wrote.
"""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from txrisk.plans.scoring import Models, dispatch
from txrisk.plans.training import load_models, save_models

PUBLISHED = "version int, published timestamp"


def versions(spark: SparkSession, root: str) -> DataFrame:
    """Published versions; none if there is no table yet."""
    try:
        return spark.read.schema(PUBLISHED).parquet(os.path.join(root, "published"))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], PUBLISHED)


def newest(spark: SparkSession, root: str) -> int | None:
    return versions(spark, root).agg(F.max("version")).first()[0]


def folder(root: str, version: int) -> str:
    return os.path.join(root, f"version={version}")


def publish(spark: SparkSession, models: Models, root: str) -> int:
    """Save models as the next version; streams take it from their next micro-batch on. One caller publishes at a time."""
    version = (newest(spark, root) or 0) + 1
    save_models(spark, models, folder(root, version))
    row = spark.range(1).select(F.lit(version).alias("version"), F.current_timestamp().alias("published"))
    row.coalesce(1).write.mode("append").parquet(os.path.join(root, "published"))
    return version


def score_available(transactions: DataFrame, root: str, path: str) -> DataFrame:
    """Score what is there, stop, and return the verdicts with their ``model_version``."""
    spark = transactions.sparkSession
    rows, loaded = os.path.join(path, "rows"), {}

    def score(batch: DataFrame, number: int) -> None:
        version = newest(spark, root)
        if version not in loaded:
            loaded.clear()  # one version at a time
            loaded[version] = Models() if version is None else load_models(spark, folder(root, version))
        judged = dispatch(batch, loaded[version]).withColumn("model_version", F.lit(version).cast("int"))
        judged.write.mode("overwrite").parquet(os.path.join(rows, f"batch={number}"))

    query = (
        transactions.writeStream.foreachBatch(score).option("checkpointLocation", os.path.join(path, "checkpoint"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    schema = dispatch(transactions).withColumn("model_version", F.lit(0)).schema
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.IntegerType())])).parquet(rows)
