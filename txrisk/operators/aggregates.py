"""Summary tables. All are partial-then-final hash aggregates over few groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from txrisk.constants import AMOUNT_EDGES, AMOUNT_LABELS
from txrisk.functions.columns import no_nan


def fraud_rate(df: DataFrame, by: str = "type", label: str = "isFraud") -> DataFrame:
    return df.groupBy(by).agg(F.avg(F.col(label)).alias("fraud_rate"))


def kpis(df: DataFrame, verdict: str = "is_fraud") -> DataFrame:
    """One row: rows, verdicts, the rest, verdicts in percent (0 when empty)."""
    counts = df.agg(
        F.count(F.lit(1)).alias("total_count"),
        F.count_if(F.col(verdict)).alias("fraud_count"),
    )
    rate = F.coalesce(F.try_divide(F.col("fraud_count") * F.lit(100.0), F.col("total_count")), F.lit(0.0))
    return counts.select(
        "total_count", "fraud_count",
        (F.col("total_count") - F.col("fraud_count")).alias("legit_count"), rate.alias("fraud_rate"),
    )


def fraud_by_type(df: DataFrame, verdict: str = "is_fraud") -> DataFrame:
    """Known verdicts and fraud verdicts per type; rows without a type are left out."""
    return df.filter(F.col("type").isNotNull()).groupBy("type").agg(
        F.count(verdict).alias("total"),
        F.count_if(F.col(verdict)).alias("fraud_count"),
    )


def range_label(amount: Column, edges: list[float] = AMOUNT_EDGES, labels: list[str] = AMOUNT_LABELS) -> Column:
    """Label of the right-closed range; NULL at or below the first edge."""
    label = F
    for upper, name in zip(edges[1:], labels):
        label = label.when((amount > edges[0]) & (amount <= upper), name)
    return label.when(amount > edges[-1], labels[-1])


def amount_bins(df: DataFrame, verdict: str = "is_fraud") -> DataFrame:
    """Rows per amount range and verdict: every range, also those without a row.
    Amounts that are missing or NaN are in no range. One aggregate over the table."""
    amount = no_nan(F.col("amount"))
    label = range_label(amount)
    counts = df.agg(*[
        F.struct(F.lit(name).alias("amount_range"), F.count_if((label == name) & ~F.col(verdict)).alias("legit"),
                 F.count_if((label == name) & F.col(verdict)).alias("fraud")).alias(f"r{i}")
        for i, name in enumerate(AMOUNT_LABELS)])
    return counts.select(F.inline(F.array(*counts.columns)))


def result_word(verdict: Column) -> Column:
    return F.when(verdict, "fraud").otherwise("legitimate")


def prediction_counts(df: DataFrame, verdict: str = "is_fraud") -> DataFrame:
    return (
        df.withColumn("result", result_word(F.col(verdict)))
        .groupBy("model_used", "result")
        .agg(F.count(F.lit(1)).alias("predictions"))
    )


def fraud_total(df: DataFrame, verdict: str = "is_fraud") -> DataFrame:
    return df.agg(F.count_if(F.col(verdict)).alias("fraud_detected"))


def histogram(df: DataFrame, column: str, edges: list[float]) -> DataFrame:
    """Cumulative buckets (value <= edge) plus count, sum and mean of a column,
    as one row per edge. One aggregate; rows are not multiplied."""
    value = F.col(column)
    counted = df.filter(value.isNotNull()).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(value).alias("total"),
        *[F.count_if(value <= edge).alias(f"_b{i}") for i, edge in enumerate(edges)],
    )
    buckets = F.array(
        *[F.struct(F.lit(float(e)).alias("le"), F.col(f"_b{i}").alias("in_bucket")) for i, e in enumerate(edges)],
        F.struct(F.lit(float("inf")).alias("le"), F.col("n").alias("in_bucket")),
    )
    return counted.select(
        F.inline(buckets), F.col("n").alias("n"), F.col("total"), F.try_divide(F.col("total"), F.col("n")).alias("mean")
    )


def rate_per_window(df: DataFrame, time: str = "ts", length: str = "5 minutes", seconds: float = 300.0,
                    verdict: str = "is_fraud") -> DataFrame:
    """Verdicts per second in tumbling windows, per result; batch or stream."""
    return (
        df.withColumn("result", result_word(F.col(verdict)))
        .groupBy(F.window(F.col(time), length), "result")
        .agg(F.count(F.lit(1)).alias("predictions"))
        .select(
            F.col("window.start").alias("window_start"), "result", "predictions",
            (F.col("predictions") / F.lit(seconds)).alias("per_second"),
        )
    )


def batch_totals(df: DataFrame, batch: str, value: str) -> DataFrame:
    """Predictions, total and mean of a value per scoring batch."""
    return df.groupBy(batch).agg(
        F.count(F.lit(1)).alias("total_predictions"),
        F.sum(value).alias("total_value"),
    ).withColumn("avg_per_prediction", F.try_divide(F.col("total_value"), F.col("total_predictions")))
