import pytest
from helpers import frame, row
from pyspark.sql import functions as F

from txrisk.operators import false_positives as fp, rules
from txrisk.plans import scoring
from txrisk.sources.fixture import transactions

# Hand-computed cases: transaction, raw score, score, reasons, evidence, legitimacy, verdict.
CASES = [
    (row(1, "TRANSFER", 181.0, 181.0, 0.0, "C553264065"), 1.8, 0.999998, "R2 R3a R6", 0.8, 0.3, True),
    (row(2, "PAYMENT", 9839.64, 170136.0, 160296.36, "M1979787155"), 0.3, 0.119203, "R4b", 0.045, 0.25, False),
    (row(3, "PAYMENT", 1000.0, 5000.0, 4000.0, "M456"), 0.0, 0.006693, "", 0.0, 0.7, False),
    (row(4, "TRANSFER", 500.0, 2000.0, 1500.0, "C012"), 0.0, 0.006693, "", 0.0, 0.45, False),
    (row(5, "TRANSFER", 5000.0, 10000.0, 5000.0, "C789"), 0.4, 0.268941, "R9a", 0.12, 0.45, False),
]


def test_hand_cases(spark):
    judged = scoring.detect(frame(spark, *[c[0] for c in CASES])).withColumn("codes", rules.reason_codes())
    got = {r["event_id"]: r for r in judged.collect()}
    for tx, raw, score, codes, weighted, legit, verdict in CASES:
        r = got[tx[0]]
        assert r["raw_score"] == pytest.approx(raw)
        assert r["score"] == pytest.approx(score, abs=1e-6)
        assert r["codes"] == codes
        assert r["weighted_score"] == pytest.approx(weighted)
        assert r["legitimacy"] == pytest.approx(legit)
        assert r["is_fraud"] is verdict


def test_golden_counts(spark):
    scored = rules.rule_score(transactions(spark, "/root/testdata/sf0.01"))
    got = {
        r["type"]: (r["n"], r["labelled"], r["flagged"], r["half"])
        for r in scored.groupBy("type").agg(
            F.count("*").alias("n"), F.sum("isFraud").alias("labelled"), F.count_if("is_fraud").alias("flagged"),
            F.count_if(F.col("raw_score") == 0.5).alias("half")).collect()
    }
    assert got == {
        "CASH_IN": (1982, 0, 959, 802), "CASH_OUT": (2006, 417, 1530, 356), "DEBIT": (2014, 0, 1022, 765),
        "PAYMENT": (1981, 0, 966, 784), "TRANSFER": (2017, 363, 1534, 387),
    }


def test_raw_score_of_exactly_half_is_no_fraud(spark):
    scored = rules.rule_score(frame(spark, row(amount=20001.0))).first()
    assert (scored["raw_score"], scored["score"], scored["is_fraud"]) == (0.5, 0.5, False)


@pytest.mark.parametrize("amount,code", [
    (9999.0, "R9a"), (10000.0, "R9a"), (5000.0, "R9a"), (20000.0, "R9b"), (19999.0, "R9b"), (15000.0, "R9b"),
    (1000.0, None), (9999.5, None), (12345.0, None), (1e18, "R9b"), (1e25, None),
])
def test_round_amounts(spark, amount, code):
    flags = rules.rule_flags(frame(spark, row(amount=amount))).first()
    assert {c for c in ("R9a", "R9b") if flags[c]} == ({code} if code else set())


def test_unknown_values_match_no_rule(spark):
    df = frame(spark, row(1, None, None, None, None, None), row(2, "TRANSFER", None, 10.0, 0.0, None))
    got = rules.rule_score(df).orderBy("event_id").collect()
    assert [r["raw_score"] for r in got] == [0.0, 0.7]
    assert got[0]["reasons"] == [] and got[0]["is_fraud"] is False


def test_larger_amounts_never_lower_the_amount_rule(spark):
    df = frame(spark, *[row(i, amount=float(a)) for i, a in enumerate([1, 4999, 5000, 5001, 9999, 10001, 10**7])])
    flags = rules.rule_flags(df).orderBy("event_id").collect()
    points = [0.5 if r["R4a"] else 0.3 if r["R4b"] else 0.0 for r in flags]
    assert points == sorted(points)


def test_shortcuts_equal_the_array_of_reasons(tx):
    scored = rules.rule_score(tx).select(
        (F.col("weighted_score") == fp.reason_weight()).alias("same_weight"),
        (F.col("n_reasons") == F.size("reasons")).alias("same_count"),
        (F.col("fraud_reasons") == rules.reason_text()).alias("same_text"))
    assert scored.filter("not (same_weight and same_count and same_text)").count() == 0


def test_fallback_rule(spark):
    df = frame(
        spark, row(1, "TRANSFER", 1000001.0, 5.0, 0.0), row(2, "TRANSFER", 1000000.0, 5.0, 0.0),
        row(3, "PAYMENT", 1000001.0, 5.0, 0.0), row(4, "PAYMENT", 5000001.0, 5.0, 5.0), row(5, None, None, None, None))
    got = df.select("event_id", rules.fallback_rule().alias("p")).orderBy("event_id").collect()
    assert [r["p"] for r in got] == [1, 0, 0, 1, 0]


def test_risk_score_is_clamped(spark):
    df = spark.createDataFrame(
        [(0.5, 0, 0, 0.0), (0.5, 1, 1, 0.71), (0.97, 1, 0, None), (0.5, None, None, 0.7)],
        "p double, fast int, odd int, risk double")
    got = df.select(rules.risk_score(F.col("p"), F.col("fast"), F.col("odd"), F.col("risk")).alias("r")).collect()
    assert [round(r["r"], 6) for r in got] == [0.5, 0.75, 1.0, 0.5]


def test_reports(tx):
    full, plain = scoring.report(tx), scoring.report(tx, reduce=False)
    assert full.columns == ["event_id", "step", "type", "amount", "nameOrig", "nameDest", "is_fraud",
                            "fraud_probability", "risk_score", "fraud_reasons", "confidence", "fp_reduced"]
    assert full.columns == plain.columns
    assert full.filter("is_fraud").count() <= plain.filter("is_fraud").count()
    assert full.filter("fraud_probability not between 0 and 1 or risk_score not between 0 and 1").count() == 0
    assert "actual_isFraud" in scoring.labelled_report(tx).columns
