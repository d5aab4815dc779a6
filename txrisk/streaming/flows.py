"""Streaming versions of the operators. The stateless ones are the batch
functions themselves; the others add a watermark."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from txrisk.constants import PROFILE_TTL_SECONDS
from txrisk.functions.columns import cents, instant, money
from txrisk.operators.aggregates import rate_per_window
from txrisk.plans.scoring import Models, dispatch, report
from txrisk.sources.messages import decode, envelope, readable

LATENESS = "10 minutes"


def timed(stream: DataFrame, time: str = "ts", lateness: str = LATENESS) -> DataFrame:
    """Event time as an instant, with a watermark."""
    return stream.withColumn(time, instant(stream, time)).withWatermark(time, lateness)


def score_messages(messages: DataFrame, models: Models = Models(), large_amount: float | None = None) -> DataFrame:
    """Messages in, messages out: decode, features, verdict, envelope.

    Models bring the threshold and ranges fitted in training, because a stream
    has no whole table to take them from.
    """
    if models.forest is not None or models.boosted is not None:
        if models.large_amount is None:
            raise ValueError("scoring a stream needs the threshold fitted with the models")
    judged = dispatch(readable(decode(messages)), models)
    return envelope(judged.withColumn("prediction", F.col("is_fraud").cast("int")))


def report_stream(transactions: DataFrame) -> DataFrame:
    """Rule report of a stream of transactions; the same projection as in batch."""
    return report(transactions)


def rates(judged: DataFrame, length: str = "5 minutes", seconds: float = 300.0, time: str = "ts",
          lateness: str = LATENESS) -> DataFrame:
    """Verdict rates per tumbling window, emitted once the watermark has passed."""
    return rate_per_window(timed(judged, time, lateness), time, length, seconds)


def without_repeats(transactions: DataFrame, columns: list[str], time: str = "ts",
                    lateness: str = LATENESS) -> DataFrame:
    """Drop repetitions that arrive within the watermark of the first one.

    Equal rows of one Arrow batch become one row before the shuffle, so very many
    copies of a row do not all travel to the task that keeps its state.
    """
    combined = transactions.mapInArrow(_first_of_equal(columns), transactions.schema)
    return timed(combined, time, lateness).dropDuplicatesWithinWatermark(columns)


def _first_of_equal(columns: list[str]):
    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbered = pa.table({c: batch.column(c) for c in columns} | {"_row": pa.array(range(batch.num_rows))})
            first = numbered.group_by(columns, use_threads=False).aggregate([("_row", "min")])
            yield batch.take(first["_row_min"].combine_chunks().sort())

    return combine


def sessions(transactions: DataFrame, key: str = "nameOrig", time: str = "ts", idle: int = PROFILE_TTL_SECONDS,
             lateness: str = LATENESS) -> DataFrame:
    """Totals of each closed stretch of activity of a customer. Partial totals are
    merged before and after the shuffle, so a busy account is not a busy task."""
    return (
        timed(transactions, time, lateness)
        .withColumn("_cents", cents(F.col("amount")))
        .groupBy(F.session_window(F.col(time), f"{idle} seconds").alias("_session"), F.col(key))
        .agg(F.count(F.lit(1)).alias("tx_count"), F.sum("_cents").alias("_total"), F.max("_cents").alias("_max"))
        .select(key, F.col("_session.start").alias("session_start"), F.col("_session.end").alias("session_end"),
                "tx_count", money(F.col("_total")).alias("total_amount"), money(F.col("_max")).alias("max_amount"))
    )
