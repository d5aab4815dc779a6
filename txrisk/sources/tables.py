"""Append-only result tables: predictions and training runs."""

from __future__ import annotations

import datetime as dt
import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

RUN_SCHEMA = (
    "run_id string, parent_id string, model string, params map<string,string>, "
    "metrics map<string,double>, ts timestamp"
)


def append_predictions(scored: DataFrame, path: str, row_id: str = "event_id", time: str = "ts") -> None:
    """Store verdicts under the id of their transaction as state entries of kind
    ``prediction``; the id is unique, so no two verdicts share a key."""
    predictions = prediction_entries(scored, row_id, time)
    predictions.write.mode("append").parquet(path)


STORED = "batch string, attempt string, stored timestamp"


def store_once(rows: DataFrame, path: str, batch: str) -> None:
    """Store the rows of a batch so that a batch that runs again counts once.

    An attempt writes to a folder of its own and is entered in the ledger once all its files are there. Readers take the
    first attempt that the ledger names for a batch, so neither half a write nor a second one is ever seen.
    """
    spark, attempt = rows.sparkSession, uuid.uuid4().hex
    rows.write.parquet(os.path.join(path, "rows", f"batch={batch}", f"attempt={attempt}"))
    entry = spark.range(1).select(F.lit(str(batch)).alias("batch"), F.lit(attempt).alias("attempt"), F.current_timestamp().alias("stored"))
    entry.coalesce(1).write.mode("append").parquet(os.path.join(path, "ledger"))


def stored_once(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of all batches in the ledger, each batch once, with their ``batch``."""
    ledger = spark.read.schema(STORED).parquet(os.path.join(path, "ledger"))
    first = ledger.groupBy("batch").agg(F.min(F.struct("stored", "attempt"))["attempt"].alias("attempt"))
    full = T.StructType([*schema.fields, T.StructField("batch", T.StringType()), T.StructField("attempt", T.StringType())])
    rows = spark.read.schema(full).parquet(os.path.join(path, "rows"))
    return rows.join(first, ["batch", "attempt"], "left_semi").drop("attempt")


def prediction_entries(scored: DataFrame, row_id: str = "event_id", time: str = "ts") -> DataFrame:
    from txrisk.operators.state import entries

    payload = F.to_json(F.struct(
        F.col("is_fraud").cast("int").alias("prediction"), F.col("fraud_probability").alias("probability"),
        "risk_score", "model_used"))
    return entries(scored, "prediction", F.col(row_id).cast("string"), payload, F.col(time))


def log_run(spark: SparkSession, path: str, run_id: str, model: str, params: dict, metrics: dict,
            parent_id: str | None = None) -> None:
    """Append one run; nested runs name their parent. Every run gets a folder of
    its own, because two jobs that append to one folder at the same time clear
    away each other's unfinished files."""
    row = (
        run_id, parent_id, model, {k: json.dumps(v) for k, v in params.items()},
        {k: float(v) for k, v in metrics.items() if v is not None}, dt.datetime.now(dt.timezone.utc),
    )
    own = os.path.join(path, f"{run_id}-{uuid.uuid4().hex[:8]}")
    spark.createDataFrame([row], RUN_SCHEMA).coalesce(1).write.parquet(own)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN_SCHEMA).option("recursiveFileLookup", True).parquet(path)


def best_run(runs: DataFrame, metric: str = "f1_score") -> DataFrame:
    """The run with the highest metric; the first run id among equals."""
    value = F.col("metrics")[metric]
    return runs.filter(value.isNotNull()).orderBy(F.desc(value), "run_id").limit(1)
