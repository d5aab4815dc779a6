"""Suppression of likely false alarms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from txrisk.constants import (
    FP_AMOUNT, FP_CONFIDENCE, FP_MIN_REASONS, FP_TARGET, FP_THRESHOLDS, LEGITIMACY_WEIGHTS, MISSING_SEVERITY,
    MISSING_WEIGHT, OTHER_SEVERITY_FACTOR, SEVERITY_FACTORS,
)
from txrisk.functions.columns import holds

CLEARED_SUFFIX = " | verdict withdrawn: usual conduct"


def reason_weight(column: str = "reasons") -> Column:
    """Severity-weighted evidence of an array of reasons, 0..1."""
    def part(reason):
        severity = F.coalesce(reason["severity"], F.lit(MISSING_SEVERITY))
        factor = F
        for word, value in SEVERITY_FACTORS.items():
            factor = factor.when(severity == word, F.lit(value))
        return F.coalesce(reason["weight"], F.lit(MISSING_WEIGHT)) * factor.otherwise(F.lit(OTHER_SEVERITY_FACTOR))

    total = F.aggregate(column, F.lit(0.0), lambda sum_, reason: sum_ + part(reason))
    return F.least(F.coalesce(total, F.lit(0.0)) / F.lit(2.0), F.lit(1.0))


# Signs of an ordinary transaction, each 1.0 or 0.0.
BEHAVIOUR = {
    "small_amount": "amount < 500",
    "is_payment": "type = 'PAYMENT'",
    "proportional": "CASE WHEN oldbalanceOrg > 0 THEN newbalanceOrig / oldbalanceOrg BETWEEN 0.1D AND 0.9D END",
    "regular_pattern": "try_divide(amount, oldbalanceOrg + 1) > 0.1D AND try_divide(amount, oldbalanceOrg + 1) < 0.9D",
}


def _sign(name: str, value: float = 1.0) -> str:
    return f"CASE WHEN {BEHAVIOUR[name]} THEN {value!r}D ELSE 0D END"


def behaviour() -> dict[str, Column]:
    return {name: F.expr(_sign(name)) for name in BEHAVIOUR}


def legitimacy() -> Column:
    return F.expr(" + ".join(_sign(name, weight) for name, weight in LEGITIMACY_WEIGHTS.items()))


def _other_grounds() -> Column:
    """Grounds for clearing that do not depend on the confidence threshold."""
    return F.expr(f"""
        coalesce(n_reasons < {FP_MIN_REASONS} AND legitimacy > 0.6D, false)
        OR coalesce(amount < {FP_AMOUNT!r}D AND weighted_score < 0.6D, false)
        OR coalesce(type = 'PAYMENT' AND score < 0.8D, false)""")


def _unsure(threshold: float) -> Column:
    return F.expr(f"coalesce(score < {threshold!r}D AND legitimacy > 0.5D, false)")


def _prepared(df: DataFrame, reasons: str) -> DataFrame:
    """Evidence, number of reasons and legitimacy. Rows of the rule scorer carry
    the first two already; other rows get them from their array of reasons."""
    columns = {"legitimacy": legitimacy()}
    if "weighted_score" not in df.columns:
        columns["weighted_score"] = reason_weight(reasons)
    if "n_reasons" not in df.columns:
        columns["n_reasons"] = F.coalesce(F.size(reasons), F.lit(0))
    return df.withColumns(columns)


def fp_reduce(df: DataFrame, threshold: float = FP_CONFIDENCE, reasons: str = "reasons") -> DataFrame:
    """Clear verdicts that look like false alarms.

    Needs score, confidence, reasons and the transaction columns. Adds
    original_is_fraud, fp_reduced, is_fraud, fraud_probability, risk_score and
    the adjusted confidence. A verdict is only ever cleared, never set.
    """
    ready = _prepared(df, reasons).withColumn("original_is_fraud", F.expr("coalesce(score > 0.5D, false)"))
    cleared = ready.withColumn("fp_reduced", F.col("original_is_fraud") & (_unsure(threshold) | _other_grounds()))
    return cleared.withColumns({
        "is_fraud": F.expr("original_is_fraud AND NOT fp_reduced"),
        "fraud_probability": F.expr("CASE WHEN fp_reduced THEN greatest(score * 0.7D, 0.3D) ELSE score END"),
        "risk_score": F.col("weighted_score"),
        "confidence": F.expr("CASE WHEN fp_reduced THEN 'low' ELSE confidence END"),
    })


def paired(rows: DataFrame, predictions: DataFrame, key: str = "event_id") -> DataFrame:
    """Transactions with predictions that are kept apart (score, confidence,
    reasons), matched by the unique key and never by position."""
    return rows.join(predictions, key)


def fp_stats(reduced: DataFrame, target: float = FP_TARGET) -> DataFrame:
    """One row: rows, verdicts before, verdicts cleared, rate, target, reached."""
    counts = reduced.agg(
        F.count(F.lit(1)).alias("total_predictions"),
        F.count_if(F.col("original_is_fraud")).alias("original_fraud_count"),
        F.count_if(F.col("original_is_fraud") & ~F.col("is_fraud")).alias("reduced_fraud_count"),
    )
    rate = F.coalesce(F.try_divide(F.col("reduced_fraud_count"), F.col("original_fraud_count")), F.lit(0.0))
    return counts.withColumns({"fp_reduction_rate": rate, "target_reduction": F.lit(target)}).withColumn(
        "target_achieved", F.col("fp_reduction_rate") >= F.col("target_reduction")
    )


def threshold_sweep(df: DataFrame, thresholds: list[float] | None = None, target: float = FP_TARGET,
                    reasons: str = "reasons") -> DataFrame:
    """Reduction rate per confidence threshold.

    All thresholds are counted side by side in one aggregate over one pass; the
    single row of counts is then turned into one row per threshold.
    """
    thresholds = thresholds or FP_THRESHOLDS
    ready = _prepared(df, reasons).withColumns({"_flagged": holds(F.col("score") > 0.5), "_other": _other_grounds()})
    counted = ready.agg(
        F.count_if(F.col("_flagged")).alias("flagged"),
        *[F.count_if(F.col("_flagged") & (F.col("_other") | _unsure(t))).alias(f"_c{i}")
          for i, t in enumerate(thresholds)],
    )
    per_threshold = F.array(*[
        F.struct(F.lit(t).alias("threshold"), F.col(f"_c{i}").alias("cleared")) for i, t in enumerate(thresholds)
    ])
    rate = F.coalesce(F.try_divide(F.col("cleared"), F.col("flagged")), F.lit(0.0))
    return (
        counted.select("flagged", F.inline(per_threshold))
        .withColumn("rate", rate)
        .withColumn("distance", F.abs(F.col("rate") - F.lit(target)))
        .select("threshold", "flagged", "cleared", "rate", "distance")
    )


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The threshold nearest to the target; the lowest one among equals."""
    return sweep.orderBy("distance", "threshold").limit(1)


def report_reduction(report: DataFrame) -> DataFrame:
    """Reduction as the report counts it: cleared plus standing verdicts."""
    counts = report.agg(
        F.count_if(F.col("is_fraud")).alias("remaining"),
        F.count_if(F.col("fp_reduced")).alias("reduced"),
    )
    original = F.col("remaining") + F.col("reduced")
    rate = F.coalesce(F.try_divide(F.col("reduced") * F.lit(100.0), original), F.lit(0.0))
    return counts.select(original.alias("original"), "remaining", "reduced", rate.alias("reduction_rate"))
