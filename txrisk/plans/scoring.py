"""Scoring of whole tables and of streams: rules, models, reports."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F

from txrisk.constants import VIEW_ROWS
from txrisk.operators import boosted, ensemble, forest
from txrisk.operators.false_positives import CLEARED_SUFFIX, fp_reduce
from txrisk.operators.features import training_features
from txrisk.operators.rules import fallback_rule, risk_score, rule_score
from txrisk.session import reliable


Detector = Callable[[DataFrame], DataFrame]

# Real-time features that a prediction record carries, when the rows have them.
RECORD_FEATURES = [
    "tx_count_minute", "tx_count_hour", "tx_count_day", "tx_velocity_hour", "amount_ratio_to_avg", "is_high_velocity",
    "is_unusual_time", "customer_risk_score", "is_new_customer", "is_high_amount_customer", "customer_age_hours",
    "avg_amount_deviation",
]


def detect(df: DataFrame, detector: Detector = rule_score) -> DataFrame:
    """A detector followed by suppression of false alarms. The detector adds
    score, confidence and reasons; with the rules all is one projection."""
    return df.transform(detector).transform(fp_reduce)


def report(df: DataFrame, reduce: bool = True) -> DataFrame:
    """One report row per transaction."""
    if reduce:
        judged = detect(df)
        text = F.concat("fraud_reasons", F.when(F.col("fp_reduced"), CLEARED_SUFFIX).otherwise(""))
    else:
        judged = rule_score(df).withColumns({
            "fraud_probability": F.col("score"), "risk_score": F.col("score"), "fp_reduced": F.lit(False)})
        text = F.col("fraud_reasons")
    return judged.select(
        "event_id", "step", "type", "amount", "nameOrig", "nameDest", "is_fraud", "fraud_probability",
        "risk_score", text.alias("fraud_reasons"), "confidence", "fp_reduced")


def labelled_report(df: DataFrame) -> DataFrame:
    """Rule verdicts next to the known label."""
    scored = rule_score(df)
    return scored.select(
        "event_id", "step", "type", "amount", "nameOrig", "nameDest", "is_fraud",
        F.col("score").alias("fraud_probability"), F.col("score").alias("risk_score"),
        F.lit("rule_based").alias("model_used"), F.col("isFraud").alias("actual_isFraud"),
        "fraud_reasons", "confidence")


@dataclass(frozen=True)
class Models:
    forest: forest.Forest | None = None
    boosted: PipelineModel | None = None
    large_amount: float | None = None  # fitted with the models


def model_scores(df: DataFrame, models: Models, batch_range: bool = False) -> DataFrame:
    """Add the probabilities of the loaded models to rows with training features.

    ``batch_range`` scales the forest score by the range of these very rows (one
    more pass over them); otherwise by the range seen in training.
    """
    if models.forest is not None:
        df = forest.scored(df, models.forest)
        low, high = models.forest.low, models.forest.high
        if batch_range:
            low, high = forest.batch_range(df)
        df = df.withColumn(
            "forest_probability", forest.probability("forest_score", low, high, clipped=not batch_range))
    if models.boosted is not None:
        df = boosted.scored(df, models.boosted)
    if models.forest is not None and models.boosted is not None:
        df = ensemble.combine(df)
    return df


def dispatch(df: DataFrame, models: Models = Models(), batch_range: bool = False) -> DataFrame:
    """Verdict of the best model at hand: both, boosted trees, forest, or the
    fallback rule. Adds is_fraud, fraud_probability, risk_score and model_used.

    The choice is made when the plan is built. An undefined probability becomes
    0.5 after the verdict, which then stays negative. The real-time features of
    ``profile.realtime_features`` raise the risk score if the rows carry them.
    """
    columns = df.columns
    if models.forest is None and models.boosted is None:
        verdict, probability, used = fallback_rule(), F.lit(0.5), "rule_based"
        rows = df
    else:
        rows = model_scores(training_features(df, models.large_amount), models, batch_range)
        if models.forest is not None and models.boosted is not None:
            verdict, probability, used = F.col("ensemble_verdict"), F.col("ensemble_probability"), "ensemble"
        elif models.boosted is not None:
            verdict, probability, used = (
                F.col("boosted_probability_verdict"), F.col("boosted_probability"), "xgboost")
        else:
            verdict = forest.is_outlier(models.forest)
            probability, used = F.col("forest_probability"), "isolation_forest"
    judged = rows.select(
        *columns,
        F.coalesce(verdict.cast("boolean"), F.lit(False)).alias("is_fraud"),
        F.coalesce(F.nanvl(probability, F.lit(None).cast("double")), F.lit(0.5)).alias("fraud_probability"),
        F.lit(used).alias("model_used"),
    )
    score = F.col("fraud_probability")
    if "is_high_velocity" in columns:
        score = risk_score(score, F.col("is_high_velocity"), F.col("is_unusual_time"), F.col("customer_risk_score"))
    return judged.withColumn("risk_score", score)


def verdict_views(judged: DataFrame, row_id: str = "event_id", rows: int = VIEW_ROWS) -> DataFrame:
    """The first rows of each view (fraud, legit, all), with the column ``view``.
    The rows are stored once; each view then filters a plain column."""
    stored = reliable(judged)
    views = {"fraud": stored.filter("is_fraud"), "legit": stored.filter(~F.col("is_fraud")), "all": stored}
    parts = [v.orderBy(row_id).limit(rows).withColumn("view", F.lit(name)) for name, v in views.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def records(judged: DataFrame, row_id: str = "event_id", time: str = "ts") -> DataFrame:
    """Prediction records: verdict, probability, risk, model, the real-time
    features as a map (NULL if the rows have none) and the time."""
    present = [name for name in RECORD_FEATURES if name in judged.columns]
    pairs = [x for name in present for x in (F.lit(name), F.col(name).cast("double"))]
    features = F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,double>")
    return judged.select(row_id, "is_fraud", "fraud_probability", "risk_score", "model_used",
                         features.alias("features"), F.col(time).alias("timestamp"))
