import pytest
from helpers import COLUMNS, row
from pyspark.sql import functions as F

from txrisk.constants import REASONS_TYPE
from txrisk.operators import false_positives as fp
from txrisk.operators.rules import rule_score

SCHEMA = COLUMNS + f", score double, confidence string, reasons {REASONS_TYPE}"
HIGH, LOW = ("a", "high", 0.8), ("b", "low", 0.3)


def scored(spark, *rows):
    return spark.createDataFrame([(*tx, score, "high", reasons) for tx, score, reasons in rows], SCHEMA)


# Small, proportional and regular, so legitimacy is 0.75 without being a payment.
EASY = dict(kind="CASH_IN", amount=400.0, old=1000.0, new=600.0)
BIG = dict(kind="CASH_IN", amount=5000.0, old=20000.0, new=15000.0)  # legitimacy 0.45


def test_each_ground_for_clearing(spark):
    strong = [HIGH, HIGH, HIGH]  # evidence 1.0
    df = scored(
        spark,
        (row(1, **EASY), 0.55, strong),          # unsure and legitimate: cleared
        (row(2, **EASY), 0.70, strong),          # sure: stays
        (row(3, **EASY), 0.70, [HIGH]),          # one reason: cleared
        (row(4, **BIG), 0.55, [HIGH]),           # not legitimate enough: stays
        (row(5, "CASH_IN", 999.0), 0.9, [LOW, LOW]),   # small amount, weak evidence: cleared
        (row(6, "CASH_IN", 1000.0), 0.9, [LOW, LOW]),  # not small: stays
        (row(7, "PAYMENT", 5000.0, 0.0), 0.79, strong),  # payment below 0.8: cleared
        (row(8, "PAYMENT", 5000.0, 0.0), 0.81, strong),  # payment above: stays
        (row(9, "PAYMENT", 5000.0, 0.0), 0.50, strong),  # never flagged: neither
    )
    got = {r["event_id"]: r for r in fp.fp_reduce(df).collect()}
    assert {i for i, r in got.items() if r["fp_reduced"]} == {1, 3, 5, 7}
    assert {i for i, r in got.items() if r["is_fraud"]} == {2, 4, 6, 8}
    assert not got[9]["original_is_fraud"]
    assert got[7]["confidence"] == "low" and got[8]["confidence"] == "high"
    assert got[7]["fraud_probability"] == pytest.approx(0.553) and got[8]["fraud_probability"] == 0.81
    assert got[1]["fraud_probability"] == pytest.approx(0.385)


def test_reason_weight(spark):
    df = spark.createDataFrame(
        [(1, []), (2, [HIGH]), (3, [("a", None, None)]), (4, [("a", "odd", 1.0)]), (5, [HIGH] * 9), (6, None)],
        f"i int, reasons {REASONS_TYPE}")
    got = [r["w"] for r in df.select("i", fp.reason_weight().alias("w")).orderBy("i").collect()]
    assert got == pytest.approx([0.0, 0.4, 0.075, 0.25, 1.0, 0.0])


def test_never_sets_a_verdict(tx):
    reduced = fp.fp_reduce(rule_score(tx))
    assert reduced.filter("is_fraud and not original_is_fraud").count() == 0


def test_stats_and_sweep(spark):
    strong = [HIGH, HIGH, HIGH]
    df = scored(spark, *[(row(i, **EASY), 0.51 + 0.04 * i, strong) for i in range(10)])  # 0.51 .. 0.87
    stats = fp.fp_stats(fp.fp_reduce(df)).first()
    assert (stats["total_predictions"], stats["original_fraud_count"], stats["reduced_fraud_count"]) == (10, 10, 4)
    assert stats["fp_reduction_rate"] == 0.4 and stats["target_achieved"]
    sweep = {r["threshold"]: r["cleared"] for r in fp.threshold_sweep(df).collect()}
    assert [sweep[t] for t in sorted(sweep)] == [0, 0, 0, 1, 3, 4, 5, 6, 8, 9]
    assert fp.best_threshold(fp.threshold_sweep(df)).first()["threshold"] == 0.60
    for threshold, cleared in sweep.items():
        assert fp.fp_stats(fp.fp_reduce(df, threshold)).first()["reduced_fraud_count"] == cleared


def test_empty_table(spark):
    stats = fp.fp_stats(fp.fp_reduce(scored(spark, (row(), 0.1, [])).filter("false"))).first()
    assert stats["fp_reduction_rate"] == 0.0 and not stats["target_achieved"]
    assert fp.best_threshold(fp.threshold_sweep(scored(spark, (row(), 0.1, [])))).first()["threshold"] == 0.40


def test_report_reduction(spark):
    df = spark.createDataFrame([(True, False), (False, True), (False, False), (True, False)],
                               "is_fraud boolean, fp_reduced boolean")
    r = fp.report_reduction(df).first()
    assert (r["original"], r["remaining"], r["reduced"]) == (3, 2, 1)
    assert r["reduction_rate"] == pytest.approx(100 / 3)
    assert fp.report_reduction(df.filter(F.lit(False))).first()["reduction_rate"] == 0.0


def test_any_detector_can_be_reduced(spark, tx):
    from txrisk.plans import scoring

    def by_amount(df):
        return df.withColumns({
            "score": F.when(F.col("amount") < 1000, 0.9).otherwise(0.1), "confidence": F.lit("high"),
            "reasons": F.array().cast(REASONS_TYPE)})

    judged = scoring.detect(tx, by_amount)
    assert judged.filter("amount < 1000 and not fp_reduced").count() == 0
    assert judged.filter("is_fraud").count() == 0


def test_predictions_are_paired_by_key(tx):
    scored = rule_score(tx).select("event_id", "score", "confidence", "reasons")
    got = fp.fp_reduce(fp.paired(tx, scored.orderBy(F.desc("event_id")))).select("event_id", "is_fraud")
    want = fp.fp_reduce(rule_score(tx)).select("event_id", "is_fraud")
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()
