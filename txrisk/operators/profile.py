"""Running profile of a customer, and the real-time features built on it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from txrisk.constants import HIGH_VELOCITY, PROFILE_TTL_SECONDS
from txrisk.functions.columns import cents, event_hour, first_of, flag, holds, micros, money
from txrisk.operators import counters
from txrisk.operators.scans import HEAVY_ROWS, Heavy, KeyedRows, Running, heavy_keys


def profile(df: DataFrame, key: str = "nameOrig", time: str = "ts", row_id: str = "event_id",
            include_current: bool = True, ttl: int = PROFILE_TTL_SECONDS, heavy_rows: int = HEAVY_ROWS,
            known: Heavy | None = None) -> DataFrame:
    """Add total_amount, tx_count, avg_amount, max_amount, last_us of the customer.

    Every transaction renews the life of the profile; after ``ttl`` idle seconds
    it starts anew. ``include_current=False`` shows the profile as it was before
    the row; it is empty (count 0, the rest NULL) for a new or expired customer.
    A row without a time has no profile (all NULL) and is in nobody's; a missing
    amount adds nothing, but its row counts.
    """
    us = micros(df, time)
    timed = df.withColumns({"_us": us, "_cents": F.when(us.isNotNull(), cents(F.col("amount")))})
    ordered = KeyedRows.of(timed, [key], ["_us", row_id], heavy_rows, known)
    ordered = ordered.running(Running("_prev_us", "last", "_us", before=True))
    idle = F.col("_us") - F.col("_prev_us") >= F.lit(ttl * 1000000)
    ordered = ordered.with_columns({"_restart": holds(idle)})
    before = not include_current
    scanned = ordered.running(
        Running("_total", "sum", "_cents", before),
        Running("tx_count", "count", "_us", before),
        Running("_max", "max", "_cents", before),
        Running("last_us", "last", "_us", before),
        reset="_restart",
    ).rows()
    return scanned.withColumns({
        "tx_count": F.when(F.col("_us").isNotNull(), F.coalesce(F.col("tx_count"), F.lit(0))),
        "total_amount": money(F.col("_total")),
        "max_amount": money(F.col("_max")),
    }).withColumn("avg_amount", F.try_divide(F.col("total_amount"), F.col("tx_count"))).drop(
        "_us", "_cents", "_prev_us", "_restart", "_total", "_max")


def velocity_features(df: DataFrame, time: str = "ts", limit: int = HIGH_VELOCITY) -> DataFrame:
    """Features of the pace of a customer. Needs the counters and avg_amount."""
    hour = event_hour(time)
    return df.withColumns({
        "tx_velocity_hour": F.col("tx_count_hour") / F.greatest(F.lit(1), hour + 1),
        "amount_ratio_to_avg": F.col("amount") / first_of(F.col("avg_amount"), 1.0),
        "is_high_velocity": flag(F.col("tx_count_hour") > limit),
        "is_unusual_time": flag((hour < 6) | (hour > 22)),
    })


def risk_features(df: DataFrame, time: str = "ts") -> DataFrame:
    """Features of the risk of a customer. Needs the profile and, as
    ``known_risk``, the stored risk score (NULL if none)."""
    now = micros(df, time)
    age = (now - F.col("last_us")) / F.lit(3600.0 * 1000000)
    usual = F.coalesce(F.col("avg_amount"), F.lit(0.0))
    return df.withColumns({
        "customer_risk_score": F.coalesce(F.col("known_risk"), F.lit(0.0)),
        "is_new_customer": flag(F.col("tx_count") == 0),
        "is_high_amount_customer": flag(F.col("amount") > F.coalesce(F.col("max_amount"), F.lit(0.0)) * 1.5),
        "customer_age_hours": F.coalesce(age, F.lit(0.0)),
        "avg_amount_deviation": F.abs(F.col("amount") - usual) / first_of(F.col("avg_amount"), 1.0),
    })


def realtime_features(df: DataFrame, key: str = "nameOrig", time: str = "ts", row_id: str = "event_id",
                      include_current: bool = False, mode: str = "anchored", known_risk: str | None = None,
                      heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """Counters, profile, velocity and risk features of every transaction.

    ``include_current=True`` updates the state first and reads it afterwards, so
    the row sees itself: no customer is new and the age is 0. ``False`` shows
    the state before the row.
    """
    heavy = heavy_keys(df, [key], heavy_rows)
    if mode == "anchored":
        counted = counters.anchored(df, key, time, row_id, inclusive=include_current, known=heavy)
    else:
        counted = counters.sliding(df, key, time, row_id, known=heavy)
        if not include_current:
            names = [f"tx_count_{n}" for n in counters.COUNTER_SECONDS]
            counted = counted.withColumns({n: F.col(n) - 1 for n in names})
    profiled = profile(counted, key, time, row_id, include_current, known=heavy)
    risk = F.lit(None).cast("double") if known_risk is None else F.col(known_risk)
    return risk_features(velocity_features(profiled.withColumn("known_risk", risk), time), time)
