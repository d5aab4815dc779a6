"""Transactions as JSON messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from txrisk.constants import TX_COLUMNS, TX_SCHEMA
from txrisk.operators.clean import nan_to_null
from txrisk.operators.ranks import head_by

CORRUPT = "_corrupt_record"
ENVELOPE_COLUMNS = ["step", "type", "amount", "nameOrig", "nameDest", "prediction"]


def decode(messages: DataFrame, schema: T.StructType = TX_SCHEMA, column: str = "value") -> DataFrame:
    """Rows from JSON text; a message that cannot be read keeps its text in
    ``_corrupt_record`` and has NULL elsewhere. Other columns are kept."""
    full = T.StructType(schema.fields + [T.StructField(CORRUPT, T.StringType())])
    others = [name for name in messages.columns if name != column]
    parsed = F.from_json(F.col(column).cast("string"), full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    return nan_to_null(messages.select(*others, parsed.alias("_data")).select(*others, "_data.*"))


def readable(decoded: DataFrame) -> DataFrame:
    return decoded.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)


def quarantined(decoded: DataFrame) -> DataFrame:
    return decoded.filter(F.col(CORRUPT).isNotNull()).select(CORRUPT)


def encode(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One message per row: the transaction as JSON in ``value``, keyed by account."""
    names = columns or [name for name in TX_COLUMNS if name in df.columns]
    return df.select(F.col("nameOrig").alias("key"), F.to_json(F.struct(*names)).alias("value"))


def envelope(scored: DataFrame) -> DataFrame:
    """Selected columns plus the whole row as JSON (missing fields are left out)."""
    return scored.select(*ENVELOPE_COLUMNS, F.to_json(F.struct(*scored.columns)).alias("value"))


def publish_folder(df: DataFrame, path: str, rows_per_file: int = 100_000, max_rows: int | None = None,
                   key: str | None = None) -> None:
    """Write messages as text files that a file stream can replay in small batches."""
    rows = df if max_rows is None else head_by(df, key, max_rows)
    encode(rows).select("value").write.option("maxRecordsPerFile", rows_per_file).mode("append").text(path)


def replay_folder(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of ``value`` over published files."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)
