"""Reading transaction files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from txrisk.constants import NUMERIC_COLUMNS, SAMPLE_SEED, TX_SCHEMA
from txrisk.functions.columns import no_nan
from txrisk.operators.clean import nan_to_null
from txrisk.operators.ranks import seeded_sample


def read_transactions(spark: SparkSession, path: str, kind: str = "csv", schema: T.StructType = TX_SCHEMA,
                      sample_rows: int | None = None, key: str | None = None, seed: int = SAMPLE_SEED) -> DataFrame:
    """Transactions from CSV (with header) or parquet, with the fixed schema: the
    files are not read to infer it. NaN is read as NULL. ``sample_rows`` draws a
    seeded sample and needs a unique ``key`` column."""
    if kind == "csv":
        rows = spark.read.schema(schema).option("header", True).csv(path)
    else:
        rows = spark.read.schema(schema).parquet(path)
    rows = nan_to_null(rows)
    if sample_rows is None:
        return rows
    if key is None:
        raise ValueError("a sample needs a unique key column")
    return seeded_sample(rows, key, sample_rows, seed)


def read_tolerant(spark: SparkSession, path: str) -> DataFrame:
    """A CSV whose columns are unknown and may hold anything: everything is read
    as text, known numeric columns are converted, what is not a number is NULL."""
    return coerced(spark.read.option("header", True).option("inferSchema", False).csv(path))


def coerced(df: DataFrame, columns: list[str] = NUMERIC_COLUMNS) -> DataFrame:
    present = [name for name in columns if name in df.columns]
    return df.withColumns({name: no_nan(F.col(name).try_cast("double")) for name in present})
