import pytest
from pyspark.sql import functions as F

from txrisk.constants import TX_COLUMNS
from txrisk.operators import aggregates, counters, profile
from txrisk.plans import scoring
from txrisk.session import scratch_path, tuned
from txrisk.sources import messages
from txrisk.streaming import flows, run, velocity

SCHEMA = "event_id bigint, nameOrig string, ts timestamp, amount double"


@pytest.fixture(autouse=True)
def settings(spark):
    tuned(spark)


def replay(spark, batches, schema=SCHEMA):
    """A stream whose micro-batches are the given lists of rows, in this order."""
    path = scratch_path(spark, "replay")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def at(second):
    import datetime as dt

    return dt.datetime.fromtimestamp(1_700_000_000 + second)


def test_late_rows_do_not_open_windows_again(spark):
    schema = "ts timestamp, is_fraud boolean"
    batches = [[(at(0), True)], [(at(3600), True)], [(at(3650), False)], [(at(10), True), (at(3700), False)],
               [(at(9000), True)]]
    stream = replay(spark, batches, schema)
    got = run.run_available(flows.rates(stream), scratch_path(spark, "out"))
    assert got.agg(F.sum("predictions")).first()[0] == 4  # neither the late row nor the open window


def test_repeats_across_micro_batches(spark):
    batches = [[(1, "C1", at(0), 1.0)] * 50 + [(2, "C1", at(1), 1.0)], [(1, "C1", at(0), 1.0), (3, "C2", at(2), 2.0)]]
    out = run.run_available(flows.without_repeats(replay(spark, batches), ["event_id", "nameOrig", "amount"]),
                            scratch_path(spark, "out"))
    assert sorted(r["event_id"] for r in out.collect()) == [1, 2, 3]


def test_sessions_close_after_a_day(spark):
    day = 86400
    batches = [[(1, "C1", at(0), 1.5), (2, "C1", at(day - 1), 2.5)], [(3, "C1", at(3 * day), 4.0)],
               [(4, "C2", at(9 * day), 1.0)]]
    got = run.run_available(flows.sessions(replay(spark, batches)), scratch_path(spark, "out"))
    columns = ["nameOrig", "tx_count", "total_amount", "max_amount"]
    rows = [tuple(r) for r in got.orderBy("session_start").select(columns).collect()]
    assert rows == [("C1", 2, 4.0, 2.5), ("C1", 1, 4.0, 4.0)]


def test_customer_state_is_carried_over_micro_batches(spark):
    events = [(i, f"C{i % 3}", at(i * 700 % 4000 + 90000 * (i // 60)), float(i % 11 + 1)) for i in range(120)]
    events.sort(key=lambda e: e[2])
    batches = [events[:30], events[30:31], events[31:80], events[80:]]
    got = run.run_available(velocity.velocity_stream(replay(spark, batches)), scratch_path(spark, "out"))
    df = spark.createDataFrame(events, SCHEMA)
    want = profile.profile(counters.anchored(df, "nameOrig", "ts", "event_id")).select(
        "event_id", "tx_count_minute", "tx_count_hour", "tx_count_day", "tx_count",
        F.round(F.col("total_amount") * 100).cast("bigint").alias("total_cents"), "last_us")
    assert got.count() == 120
    assert got.select(want.columns).exceptAll(want).count() == 0


def test_scored_messages(spark, tx):
    path = scratch_path(spark, "messages")
    messages.publish_folder(tx, path, rows_per_file=50)
    out = run.run_available(flows.score_messages(messages.replay_folder(spark, path, 5)), scratch_path(spark, "out"))
    want = scoring.dispatch(tx).select("nameOrig", "amount", F.col("is_fraud").cast("int").alias("prediction"))
    assert out.select(want.columns).exceptAll(want).count() == 0 and out.count() == tx.count()
    value = out.select(F.from_json("value", "model_used string, prediction int, step int").alias("v")).first()["v"]
    assert value["model_used"] == "rule_based" and value["step"] is not None


def test_models_score_streams_like_tables(spark, tx):
    from txrisk.operators import boosted
    from txrisk.plans import prepare as preparing, training

    models = training.train(preparing.prepare(tx), training.Sizes(5, boosted.Settings(2, 2)))
    path = scratch_path(spark, "messages")
    messages.publish_folder(tx, path)
    out = run.run_available(flows.score_messages(messages.replay_folder(spark, path), models), scratch_path(spark, "out"))
    want = scoring.dispatch(tx, models).select("nameOrig", "amount", F.col("is_fraud").cast("int").alias("prediction"))
    assert out.select(want.columns).exceptAll(want).count() == 0 and out.count() == tx.count()
    with pytest.raises(ValueError):
        flows.score_messages(messages.replay_folder(spark, path), scoring.Models(models.forest, models.boosted))


def test_publishing_at_most_some_rows(spark, tx):
    path = scratch_path(spark, "messages")
    messages.publish_folder(tx, path, max_rows=17, key="event_id")
    assert spark.read.text(path).count() == 17


def test_continuous_query_starts_and_stops(spark):
    stream = replay(spark, [[(1, "C1", at(0), 1.0)], [(2, "C1", at(1), 2.0)]])
    path = scratch_path(spark, "out")
    query = run.start(stream, f"{path}/rows", f"{path}/checkpoint", seconds=1, name="kept")
    try:
        query.processAllAvailable()
        durations = run.batch_durations(spark, query)
        assert durations.agg(F.sum("rows")).first()[0] == 2
        assert aggregates.histogram(durations, "seconds", [0.1, 1.0, 10.0]).count() == 4
    finally:
        query.stop()
    assert spark.read.parquet(f"{path}/rows").count() == 2 and not query.isActive


def test_models_are_replaced_between_batches(spark, tx):
    """A new version changes who scores the later batches, and nothing else."""
    from txrisk.operators import forest
    from txrisk.operators.features import training_features
    from txrisk.plans import scoring
    from txrisk.streaming import models as published

    path = scratch_path(spark, "replaced")
    rows = tx.select("event_id", *TX_COLUMNS, "ts")
    rows.filter("event_id % 2 = 0").write.parquet(f"{path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{path}/in")
    grown = forest.fit(training_features(rows, 1.0), "event_id", trees=3)
    first, second = scoring.Models(None, None, None), scoring.Models(grown, None, 1.0)
    assert published.newest(spark, f"{path}/models") is None
    made = published.score_available(stream, f"{path}/models", path)
    assert {(r.model_version, r.model_used) for r in made.collect()} == {(None, "rule_based")} and first.forest is None
    monkey = published.save_models, published.load_models
    try:
        published.save_models = lambda s, m, p: m.forest.save(s, p)
        published.load_models = lambda s, p: scoring.Models(forest.Forest.load(s, p), None, 1.0)
        assert published.publish(spark, second, f"{path}/models") == 1
        rows.filter("event_id % 4 = 1").write.mode("append").parquet(f"{path}/in")
        published.score_available(stream, f"{path}/models", path)
        assert published.publish(spark, second, f"{path}/models") == 2
        rows.filter("event_id % 4 = 3").write.mode("append").parquet(f"{path}/in")
        made = published.score_available(stream, f"{path}/models", path)
    finally:
        published.save_models, published.load_models = monkey
    said = {r.event_id: r for r in made.collect()}
    want = {r.event_id: r for r in scoring.dispatch(rows, second).collect()}
    assert len(said) == len(want) == made.count()
    for i, r in said.items():
        assert r.model_version == {0: None, 2: None, 1: 1, 3: 2}[i % 4]
        assert r.model_version is None or (r.is_fraud, r.fraud_probability, r.model_used) == (
            want[i].is_fraud, want[i].fraud_probability, want[i].model_used)


def test_durations_of_all_batches(spark, tx):
    """Every micro-batch is kept, also those that the query's own progress has forgotten."""
    import time

    path = scratch_path(spark, "durations")
    tx.select("event_id").repartition(130).write.parquet(f"{path}/in")
    before = spark.conf.get("spark.sql.streaming.numRecentProgressUpdates")
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "5")
    kept = run.Durations(spark, f"{path}/durations", keep=50)
    spark.streams.addListener(kept)
    try:
        stream = spark.readStream.schema("event_id bigint").option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
        query = stream.writeStream.format("noop").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        until = time.time() + 20
        while time.time() < until and len(kept.held) + spark.read.schema(run.DURATIONS).parquet(f"{path}/durations").count() < 130:
            time.sleep(0.5)
    finally:
        spark.streams.removeListener(kept)
        spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", before)
    rows = kept.table().collect()
    assert len(query.recentProgress) <= 5 and sorted(r.batch_id for r in rows) == list(range(130))
    assert sum(r.rows for r in rows) == tx.count()
