"""Cleaning and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F, types as T

from txrisk.constants import BALANCES, BATCH_MAX, REQUEST_COLUMNS, TYPES
from txrisk.functions.columns import holds, no_nan


def nan_to_null(df: DataFrame) -> DataFrame:
    """Every NaN of a float or double column as NULL."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({name: no_nan(F.col(name)) for name in names})


def distinct_rows(df: DataFrame) -> DataFrame:
    """Drop exact repetitions. The hash aggregate drops most copies before the
    shuffle, so a row with very many copies does not load one task."""
    return df.dropDuplicates()


def complete_rows(df: DataFrame) -> DataFrame:
    """Drop rows with any missing value (NaN counts as missing)."""
    return df.na.drop("any")


def nonnegative(df: DataFrame, columns: list[str]) -> DataFrame:
    condition = F.lit(True)
    for name in columns:
        condition = condition & (F.col(name) >= 0)
    return df.filter(condition)


def clean(df: DataFrame, observed: dict[str, Observation] | None = None) -> DataFrame:
    """Distinct, complete, non-negative rows.

    Filters commute with dropping copies, so they run first and shrink what is
    shuffled. ``observed`` takes observations named ``read`` and ``kept``; they
    count rows while the job runs, without a second pass.
    """
    observed = observed or {}
    if "read" in observed:
        df = df.observe(observed["read"], F.count(F.lit(1)).alias("rows"))
    kept = distinct_rows(nonnegative(complete_rows(df), ["amount"] + BALANCES))
    if "kept" in observed:
        kept = kept.observe(observed["kept"], F.count(F.lit(1)).alias("rows"))
    return kept


def request_errors() -> Column:
    """Codes of what is wrong with a scoring request; empty when nothing is."""
    checks = [
        F.when(F.col(name).isNull(), F.lit(f"missing:{name}")) for name in REQUEST_COLUMNS
    ]
    checks += [
        F.when(F.col(name) < 0, F.lit(f"negative:{name}")) for name in ["amount"] + BALANCES
    ]
    checks.append(F.when(~F.upper("type").isin(TYPES), F.lit("domain:type")))
    return F.array_compact(F.array(*checks))


def checked(df: DataFrame) -> DataFrame:
    """Add ``errors`` and write the type in capitals where it is known.
    One pass serves both outputs of :func:`validate`."""
    known = holds(F.upper("type").isin(TYPES))
    return (
        nan_to_null(df)
        .withColumn("errors", request_errors())
        .withColumn("type", F.when(known, F.upper("type")).otherwise(F.col("type")))
    )


def validate(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted rows, and rejected rows with their errors."""
    marked = checked(df)
    return marked.filter(F.size("errors") == 0).drop("errors"), marked.filter(F.size("errors") > 0)


def batch_size_errors(df: DataFrame, batch: str, largest: int = BATCH_MAX) -> DataFrame:
    """Size of every batch and whether it is within 1..largest."""
    sizes = df.groupBy(batch).agg(F.count(F.lit(1)).alias("size"))
    return sizes.withColumn("allowed", F.col("size").between(1, largest))
