"""Encodings and feature projections. Each profile is one projection without a
shuffle or a Python function, so it runs unchanged on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from txrisk.constants import FEATURES, SERVING_FEATURES
from txrisk.functions.columns import account_kind, holds, type_code
from txrisk.operators.ranks import percentile

LARGE_AMOUNT_SHARE = 0.95
RISK_AMOUNT = 1000000.0
SERVING_LARGE_AMOUNT = 10000.0


def encode(df: DataFrame) -> DataFrame:
    """Numeric codes of the type and of both account names; unknown is NULL."""
    return df.withColumns({
        "type_encoded": type_code(F.col("type")),
        "nameOrig_type": account_kind(F.col("nameOrig")),
        "nameDest_type": account_kind(F.col("nameDest")),
    })


def large_amount_threshold(df: DataFrame) -> float | None:
    """Exact 95th percentile of the amount, to be fitted on the training part
    (or on the whole table) and then used as a constant."""
    return percentile(df, "amount", LARGE_AMOUNT_SHARE)


def derive(df: DataFrame, large_amount: float | None) -> DataFrame:
    """Training features of encoded or raw transactions. The threshold is a
    number, so no pass over the table is hidden in the projection."""
    threshold = "cast(NULL AS double)" if large_amount is None else f"{float(large_amount)!r}D"
    derived = {
        "amount_log": "log1p(amount)",
        "balance_diff_orig": "oldbalanceOrg - newbalanceOrig",
        "balance_diff_dest": "newbalanceDest - oldbalanceDest",
        "amount_to_balance_orig": "CASE WHEN oldbalanceOrg > 0 THEN amount / oldbalanceOrg ELSE 0D END",
        "amount_to_balance_dest": "CASE WHEN oldbalanceDest > 0 THEN amount / oldbalanceDest ELSE 0D END",
        "is_zero_balance_orig": _flag("newbalanceOrig = 0"),
        "is_zero_balance_dest": _flag("newbalanceDest = 0"),
        "is_large_amount": _flag(f"amount > {threshold}"),
        "is_transfer": _flag("type = 'TRANSFER'"),
        "is_cash_out": _flag("type = 'CASH_OUT'"),
        "is_merchant_dest": _flag("startswith(nameDest, 'M')"),
        "hour_of_day": "pmod(step, 24)",
        "day_of_week": "cast(pmod(floor(step / 24), 7) AS int)",
        "risk_amount": _flag(f"amount > {RISK_AMOUNT!r}D"),
        "risk_zero_balance": _flag("oldbalanceOrg - newbalanceOrig = amount AND newbalanceDest = 0"),
    }
    return df.withColumns({name: F.expr(sql) for name, sql in derived.items()})


def _flag(condition: str) -> str:
    """1 where the condition holds, 0 where it fails or is unknown."""
    return f"CASE WHEN {condition} THEN 1 ELSE 0 END"


def training_features(df: DataFrame, large_amount: float | None = None) -> DataFrame:
    """Encoded and derived columns; the threshold is fitted on ``df`` if not given."""
    if large_amount is None:
        large_amount = large_amount_threshold(df)
    return derive(encode(df), large_amount)


def present_features(df: DataFrame, features: list[str] = FEATURES) -> list[str]:
    return [name for name in features if name in df.columns]


def select_features(df: DataFrame, features: list[str] = FEATURES) -> DataFrame:
    """Only the model features, in their fixed order."""
    return df.select(*present_features(df, features))


def serving_features(df: DataFrame) -> DataFrame:
    """Features of the online profile; its formulas differ from the training ones."""
    unknown = F.lit(0)
    merchant = account_kind(F.col("nameDest"), unknown)
    coded = {
        "type_encoded": type_code(F.col("type"), unknown),
        "nameOrig_type": account_kind(F.col("nameOrig"), unknown),
        "nameDest_type": merchant,
        "is_merchant_dest": merchant,
    }
    derived = {
        "amount_log": "log1p(amount)",
        "amount_to_balance_orig": "try_divide(amount, oldbalanceOrg + 1)",
        "amount_to_balance_dest": "try_divide(amount, oldbalanceDest + 1)",
        "balance_diff_orig": "oldbalanceOrg - newbalanceOrig",
        "balance_diff_dest": "newbalanceDest - oldbalanceDest",
        "is_zero_balance_orig": _flag("oldbalanceOrg = 0"),
        "is_zero_balance_dest": _flag("oldbalanceDest = 0"),
        "day_of_week": "pmod(step, 7)",
        "hour_of_day": "pmod(step, 24)",
        "is_cash_out": _flag("type = 'CASH_OUT'"),
        "is_large_amount": _flag(f"amount > {SERVING_LARGE_AMOUNT!r}D"),
    }
    return df.withColumns(coded | {name: F.expr(sql) for name, sql in derived.items()})


def select_serving_features(df: DataFrame) -> DataFrame:
    return select_features(df, SERVING_FEATURES)


def displayed(df: DataFrame, reasons: bool = True) -> DataFrame:
    """Report columns as text: money, percent, three decimals, verdict word."""
    shown = df.select(
        "event_id", "step", "type",
        F.when(F.col("amount").isNull(), "N/A")
        .otherwise(F.concat(F.lit("$"), F.format_number("amount", 2))).alias("amount"),
        "nameOrig", "nameDest",
        F.when(holds(F.col("is_fraud")), "FRAUD").otherwise("LEGITIMATE").alias("verdict"),
        F.format_string("%.2f%%", F.col("fraud_probability") * 100).alias("fraud_probability"),
        F.format_string("%.3f", F.col("risk_score")).alias("risk_score"),
        "fraud_reasons",
    )
    return shown if reasons else shown.drop("fraud_reasons")
