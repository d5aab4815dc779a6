"""Quality of verdicts and scores against labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from txrisk.operators.scans import HEAVY_ROWS, KeyedRows, Running


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0))


def confusion(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """tn, fp, fn, tp as one row; always four numbers, also with a single class."""
    actual, said = F.col(label) == 1, F.col(prediction) == 1
    return df.agg(
        F.count_if(~actual & ~said).alias("true_negatives"),
        F.count_if(~actual & said).alias("false_positives"),
        F.count_if(actual & ~said).alias("false_negatives"),
        F.count_if(actual & said).alias("true_positives"),
    )


def quality(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """precision, recall and f1_score with the confusion counts; 0 where undefined."""
    tp, fp, fn = F.col("true_positives"), F.col("false_positives"), F.col("false_negatives")
    return confusion(df, label, prediction).withColumns({
        "precision": _ratio(tp, tp + fp),
        "recall": _ratio(tp, tp + fn),
        "f1_score": _ratio(2 * tp, 2 * tp + fp + fn),
    })


def auc(df: DataFrame, label: str, score: str, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """Exact area under the ROC curve, ties counted half; NULL with a single class.

    Rows are counted per distinct score first; the running count over the
    distinct scores is cut in chunks when there are many of them.
    """
    per_score = (
        df.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(score).alias("score"))
        .agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
        .withColumn("_all", F.lit(0))
    )
    below = KeyedRows.of(per_score, ["_all"], ["score"], heavy_rows).running(
        Running("neg_below", "sum", "neg", before=True)).rows()
    won = F.col("pos").cast("double") * (F.coalesce(F.col("neg_below"), F.lit(0)) + F.col("neg") / F.lit(2.0))
    totals = below.agg(F.sum(won).alias("won"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    pairs = F.col("p").cast("double") * F.col("n")
    return totals.select(F.try_divide(F.col("won"), pairs).alias("auc"))


def class_weight(df: DataFrame, label: str = "isFraud") -> DataFrame:
    """Negatives per positive, the weight that balances the classes."""
    positives = F.count_if(F.col(label) == 1)
    return df.agg(F.try_divide((F.count(label) - positives).cast("double"), positives).alias("scale_pos_weight"))
