"""Weighted combination of forest and boosted trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from txrisk.constants import BOOSTED_WEIGHT, ENSEMBLE_CUT, FOREST_WEIGHT


def combine(df: DataFrame, forest: str = "forest_probability", boosted: str = "boosted_probability",
            forest_weight: float = FOREST_WEIGHT, boosted_weight: float = BOOSTED_WEIGHT,
            cut: float = ENSEMBLE_CUT) -> DataFrame:
    """Add ensemble_probability (NULL if a part is) and ensemble_verdict (0/1)."""
    mixed = F.col(forest) * F.lit(forest_weight) + F.col(boosted) * F.lit(boosted_weight)
    return df.withColumn("ensemble_probability", mixed).withColumn(
        "ensemble_verdict", F.coalesce(F.col("ensemble_probability") >= cut, F.lit(False)).cast("int"))
