"""Cleaning, features, aggregates, metrics and files."""

import math
import random

import pytest
from helpers import frame, row
from pyspark.sql import Observation, functions as F

from txrisk import constants as C
from txrisk.operators import aggregates, clean, features, metrics
from txrisk.session import scratch_path
from txrisk.sources import files, messages

NAN = float("nan")


def ids(df):
    return sorted(r["event_id"] for r in df.collect())


def dirty(spark):
    return frame(
        spark, row(1), row(1), row(2, amount=None), row(3, amount=NAN), row(4, amount=-0.01), row(5, old_dest=-1.0),
        row(6, dest=None), row(7, amount=0.0), row(8, kind="WIRE"), row(9, kind="transfer"))


def test_clean(spark):
    read, kept = Observation(), Observation()
    cleaned = clean.clean(dirty(spark), {"read": read, "kept": kept})
    assert ids(cleaned) == [1, 7, 8, 9]
    assert (read.get["rows"], kept.get["rows"]) == (10, 4)


def test_cleaning_steps(spark):
    df = dirty(spark)
    assert ids(clean.distinct_rows(df)) == [1, 2, 3, 4, 5, 6, 7, 8, 9]
    assert ids(clean.complete_rows(df)) == [1, 1, 4, 5, 7, 8, 9]
    assert ids(clean.nonnegative(clean.nan_to_null(df), ["amount"])) == [1, 1, 5, 6, 7, 8, 9]


def test_validate(spark):
    accepted, rejected = clean.validate(dirty(spark))
    assert ids(accepted) == [1, 1, 7, 9]
    assert [r["type"] for r in accepted.filter("event_id = 9").collect()] == ["TRANSFER"]
    assert {r["event_id"]: r["errors"] for r in rejected.collect()} == {
        2: ["missing:amount"], 3: ["missing:amount"], 4: ["negative:amount"], 5: ["negative:oldbalanceDest"],
        6: ["missing:nameDest"], 8: ["domain:type"]}


def test_batch_sizes(spark):
    df = spark.range(205).select((F.col("id") >= 104).cast("int").alias("batch"))
    got = {r["batch"]: (r["size"], r["allowed"]) for r in clean.batch_size_errors(df, "batch").collect()}
    assert got == {0: (104, False), 1: (101, False)}
    assert clean.batch_size_errors(df.limit(100), "batch").first()["allowed"]


def test_encodings(spark):
    df = frame(spark, row(1, "PAYMENT", orig="C123", dest="M123"), row(2, "TRANSFER", orig="M456", dest="C456"),
               row(3, "CASH_OUT", orig="C789", dest="X1"), row(4, "WIRE", orig=None))
    got = [tuple(r) for r in features.encode(df).orderBy("event_id").select(
        "type_encoded", "nameOrig_type", "nameDest_type").collect()]
    assert got == [(3, 0, 1), (4, 1, 0), (1, 0, None), (None, None, 0)]
    serving = [tuple(r) for r in features.serving_features(df).orderBy("event_id").select(
        "type_encoded", "nameOrig_type", "nameDest_type").collect()]
    assert serving == [(3, 0, 1), (4, 1, 0), (1, 0, 0), (0, 0, 0)]


def test_training_features(spark):
    df = frame(spark, row(1, "TRANSFER", 2000000.0, 2000000.0, 0.0, "M1", step=49, old_dest=100.0, new_dest=0.0),
               row(2, "CASH_OUT", 50.0, 0.0, 10.0, "C1", step=25), row(3, None, None, None, None, None))
    got = features.training_features(df, 1000.0).orderBy("event_id").collect()
    one, two, three = got
    assert one["amount_log"] == pytest.approx(math.log1p(2000000.0))
    assert (one["balance_diff_orig"], one["balance_diff_dest"]) == (2000000.0, -100.0)
    assert (one["amount_to_balance_orig"], one["amount_to_balance_dest"]) == (1.0, 20000.0)
    assert [one[n] for n in ("is_zero_balance_orig", "is_zero_balance_dest", "is_large_amount", "is_transfer",
                             "is_cash_out", "is_merchant_dest", "hour_of_day", "day_of_week", "risk_amount",
                             "risk_zero_balance")] == [1, 1, 1, 1, 0, 1, 1, 2, 1, 1]
    assert (two["amount_to_balance_orig"], two["is_large_amount"], two["day_of_week"]) == (0.0, 0, 1)
    assert (three["is_large_amount"], three["risk_zero_balance"], three["amount_log"]) == (0, 0, None)


def test_feature_lists(spark, tx):
    made = features.training_features(tx, 1.0)
    assert len(C.FEATURES) == 24 and len(C.SERVING_FEATURES) == 21
    assert features.select_features(made).columns == C.FEATURES
    assert features.select_features(tx).columns == ["step", "amount", *C.BALANCES]
    assert features.select_serving_features(features.serving_features(tx)).columns == C.SERVING_FEATURES


def test_display(spark):
    df = spark.createDataFrame(
        [(1, 1, "PAYMENT", 1234567.891, "C1", "M1", True, 0.123456, 0.5, "why"),
         (2, 1, "PAYMENT", None, "C1", "M1", False, 1.0, 0.0004, "")],
        "event_id int, step int, type string, amount double, nameOrig string, nameDest string, is_fraud boolean, "
        "fraud_probability double, risk_score double, fraud_reasons string")
    got = features.displayed(df).orderBy("event_id").collect()
    assert (got[0]["amount"], got[0]["verdict"], got[0]["fraud_probability"], got[0]["risk_score"]) == (
        "$1,234,567.89", "FRAUD", "12.35%", "0.500")
    assert (got[1]["amount"], got[1]["verdict"], got[1]["risk_score"]) == ("N/A", "LEGITIMATE", "0.000")


def test_amount_ranges_are_closed_on_the_right(spark):
    amounts = [0.0, 0.01, 100.0, 100.01, 500.0, 1000.0, 5000.0, 10000.0, 10000.01, None, -5.0]
    df = spark.createDataFrame([(a, i % 2 == 0) for i, a in enumerate(amounts)], "amount double, is_fraud boolean")
    got = {r["amount_range"]: (r["legit"], r["fraud"]) for r in aggregates.amount_bins(df).collect()}
    assert got == {"0-100": (1, 1), "100-500": (1, 1), "500-1000": (1, 0), "1000-5000": (0, 1), "5000-10000": (1, 0),
                   "10000+": (0, 1)}


def test_kpis_and_types(spark):
    df = spark.createDataFrame([("A", True), ("A", False), (None, True), ("B", None)], "type string, is_fraud boolean")
    k = aggregates.kpis(df).first()
    assert (k["total_count"], k["fraud_count"], k["legit_count"], k["fraud_rate"]) == (4, 2, 2, 50.0)
    assert aggregates.kpis(df.filter("false")).first()["fraud_rate"] == 0.0
    assert {r["type"]: (r["total"], r["fraud_count"]) for r in aggregates.fraud_by_type(df).collect()} == {
        "A": (2, 1), "B": (0, 0)}


def test_histogram(spark):
    df = spark.createDataFrame([(0.1,), (0.5,), (0.5,), (2.0,), (None,)], "s double")
    got = [(r["le"], r["in_bucket"], r["n"], r["mean"]) for r in aggregates.histogram(df, "s", [0.1, 0.5, 1.0]).collect()]
    assert [(a, b) for a, b, _, _ in got] == [(0.1, 1), (0.5, 3), (1.0, 3), (math.inf, 4)]
    assert got[0][2] == 4 and got[0][3] == pytest.approx(0.775)


def labelled(spark, pairs):
    return spark.createDataFrame(pairs, "y int, p int")


def test_quality(spark):
    got = metrics.quality(labelled(spark, [(1, 1), (1, 0), (0, 1), (0, 0), (1, 1)]), "y", "p").first().asDict()
    assert got == {"true_negatives": 1, "false_positives": 1, "false_negatives": 1, "true_positives": 2,
                   "precision": pytest.approx(2 / 3), "recall": pytest.approx(2 / 3), "f1_score": pytest.approx(2 / 3)}


def test_single_class(spark):
    df = labelled(spark, [(0, 0), (0, 0)])
    got = metrics.quality(df, "y", "p").first()
    assert (got["true_negatives"], got["precision"], got["recall"], got["f1_score"]) == (2, 0.0, 0.0, 0.0)
    assert metrics.auc(df, "y", "p").first()["auc"] is None
    assert metrics.class_weight(df, "y").first()["scale_pos_weight"] is None


@pytest.mark.parametrize("heavy_rows", [10**6, 30])
def test_auc_against_brute_force(spark, heavy_rows):
    rng = random.Random(8)
    rows = [(rng.randint(0, 1), rng.choice([0.5, rng.random()])) for _ in range(300)]
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    df = spark.createDataFrame([*rows, (1, None)], "y int, s double")
    assert metrics.auc(df, "y", "s", heavy_rows).first()["auc"] == pytest.approx(want)


def test_files(spark):
    path = scratch_path(spark, "csv")
    lines = ["event_id,step,amount,type", "1,1,abc,PAYMENT", "2,x,12.5,DEBIT", "3,3,NaN,", "4,4,,CASH_IN"]
    spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1).write.text(path)
    got = files.read_tolerant(spark, path).orderBy("event_id").collect()
    assert [r["amount"] for r in got] == [None, 12.5, None, None]
    assert [r["step"] for r in got] == [1.0, None, 3.0, 4.0]


def test_sample_while_reading(spark, tx):
    path = scratch_path(spark, "parquet")
    tx.drop("ts").write.parquet(path)
    schema = tx.drop("ts").schema
    one = files.read_transactions(spark, path, "parquet", schema, 50, "event_id")
    two = files.read_transactions(spark, path, "parquet", schema, 50, "event_id")
    assert ids(one) == ids(two) and one.count() == 50
    with pytest.raises(ValueError):
        files.read_transactions(spark, path, "parquet", schema, 50)


def test_messages(spark, tx):
    sent = messages.encode(tx)
    assert sent.columns == ["key", "value"]
    bad = spark.createDataFrame([("k", '{"step": 1, "type"'), ("k", "no json")], "key string, value string")
    decoded = messages.decode(sent.unionByName(bad))
    assert messages.quarantined(decoded).count() == 2
    back = messages.readable(decoded).select(*C.TX_COLUMNS)
    assert back.exceptAll(tx.select(*C.TX_COLUMNS)).count() == 0 and back.count() == tx.count()
