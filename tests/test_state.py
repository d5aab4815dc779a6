import random

import pytest
from helpers import timed
from pyspark.sql import functions as F

from txrisk.operators import counters, profile, state

S = 1_000_000


def entry_frame(spark, rows):
    return spark.createDataFrame(rows, "kind string, key string, payload string, s bigint, ttl_s int").withColumn(
        "write_ts", F.timestamp_seconds("s"))


def alive(spark, rows, at):
    return {r["key"]: r["payload"] for r in state.latest_alive(entry_frame(spark, rows), at * S).collect()}


def test_newest_write_decides_even_if_it_dies_earlier(spark):
    rows = [("risk", "C1", "old", 100, 1000), ("risk", "C1", "new", 200, 10)]
    assert alive(spark, rows, 99) == {}
    assert alive(spark, rows, 100) == {"C1": "old"}
    assert alive(spark, rows, 209) == {"C1": "new"}
    assert alive(spark, rows, 210) == {}


def test_kinds_are_separate(spark):
    rows = [("risk", "C1", "r", 100, 600), ("customer", "C1", "c", 100, 3600)]
    got = state.latest_alive(entry_frame(spark, rows), 800 * S).collect()
    assert [(r["kind"], r["payload"]) for r in got] == [("customer", "c")]


@pytest.mark.parametrize("heavy_rows", [10**6, 20])
def test_as_of_lookup_against_brute_force(spark, heavy_rows):
    rng = random.Random(2)
    rows = [(i, rng.choice(["hot"] * 6 + ["a", "b"]), rng.randint(0, 400)) for i in range(300)]
    writes = [(rng.choice(["hot", "a", "x"]), f"p{j}", t, rng.randint(1, 90))
              for j, t in enumerate(rng.sample(range(400), 80))]
    asked = timed(spark, [(i, c, t, 1.0) for i, c, t in rows])
    written = entry_frame(spark, [("risk", k, p, t, ttl) for k, p, t, ttl in writes])
    got = state.as_of_lookup(asked, "nameOrig", "ts", "event_id", written, "found", heavy_rows)
    want = {}
    for i, c, t in rows:
        last = max((w for w in writes if w[0] == c and w[2] <= t), key=lambda w: w[2], default=None)
        want[i] = last[1] if last and t < last[2] + last[3] else None
    assert {r["event_id"]: r["found"] for r in got.collect()} == want


def test_erase_and_clear(spark):
    rows = [("customer", "C1", "", 1, 9), ("count", "C1:hour", "", 1, 9), ("risk", "C2", "", 1, 9),
            ("fraud", "C1", "", 1, 9), ("pattern", "C1", "", 1, 9), ("count", "C12:day", "", 1, 9)]
    gone = spark.createDataFrame([("C1",), ("C1",)], "customer string")
    left = state.erase(entry_frame(spark, rows), gone)
    assert {(r["kind"], r["key"]) for r in left.collect()} == {("risk", "C2"), ("fraud", "C1"), ("count", "C12:day")}
    cleared = state.clear(left)
    assert cleared.count() == 0 and cleared.schema == left.schema


def test_bounded_marks_small_frames_only(spark):
    small, large = spark.range(5), spark.range(50)
    assert "broadcast" in state.bounded(small, 10)._jdf.queryExecution().analyzed().toString().lower()
    assert state.bounded(large, 10) is large


# ------------------------------------------------------------------- counters

def walk(seconds, ttl):
    out, anchor, n = [], None, 0
    for s in seconds:
        if anchor is None or s >= anchor + ttl:
            anchor, n = s, 0
        out.append(n)
        n += 1
    return out


@pytest.fixture(scope="module")
def events():
    rng = random.Random(9)
    made = []
    for i in range(1200):
        customer = rng.choice(["hot"] * 8 + ["a", "b", "c"])
        second = rng.choice([1000, 1001]) if customer == "hot" and i % 3 == 0 else rng.randint(0, 9000)
        made.append((i, customer, second + rng.random() * 0.9, 10.0 + i % 7))
    return made


def by_customer(events):
    for customer in {e[1] for e in events}:
        yield customer, sorted((int(e[2]), e[0]) for e in events if e[1] == customer)


@pytest.mark.parametrize("heavy_rows", [10**6, 50])
@pytest.mark.parametrize("inclusive", [True, False])
def test_anchored_counters(spark, events, heavy_rows, inclusive):
    df = timed(spark, events).repartition(4)
    got = counters.anchored(df, "nameOrig", "ts", "event_id", inclusive=inclusive, heavy_rows=heavy_rows)
    got = {r["event_id"]: r for r in got.collect()}
    assert len(got) == len(events)
    for _, rows in by_customer(events):
        for name, ttl in counters.COUNTER_SECONDS.items():
            want = [n + inclusive for n in walk([s for s, _ in rows], ttl)]
            assert [got[i][f"tx_count_{name}"] for _, i in rows] == want


@pytest.mark.parametrize("heavy_rows", [10**6, 50])
def test_sliding_counters(spark, events, heavy_rows):
    got = counters.sliding(timed(spark, events), "nameOrig", "ts", "event_id", heavy_rows=heavy_rows)
    got = {r["event_id"]: r for r in got.collect()}
    for _, rows in by_customer(events):
        for name, ttl in counters.COUNTER_SECONDS.items():
            for s, i in rows:
                assert got[i][f"tx_count_{name}"] == sum(s - ttl < other <= s for other, _ in rows)


def test_walk_carries_over_batches(spark, events):
    """Arrow batches of seven rows: windows and customers cross their borders."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        test_anchored_counters(spark, events, 10**6, True)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_window_opens_again_exactly_at_its_end(spark):
    burst = [(i, "C1", 1000 + i, 5) for i in range(12)] + [(12, "C1", 4600, 5), (13, "C1", 87399, 5),
                                                        (14, "C1", 87400, 5)]
    got = counters.anchored(timed(spark, burst), "nameOrig", "ts", "event_id").orderBy("event_id").collect()
    assert [r["tx_count_hour"] for r in got] == [*range(1, 13), 1, 1, 2]
    assert [r["tx_count_day"] for r in got] == [*range(1, 15), 1]
    assert counters.window_seconds("minute") == 60 and counters.window_seconds("week") == 3600


def test_rows_without_a_customer_are_counted_apart(spark):
    df = timed(spark, [(1, None, 10, 1), (2, None, 11, 1), (3, "", 12, 1), (4, "a", 13, 1)])
    for made in (counters.anchored(df, "nameOrig", "ts", "event_id"), counters.sliding(df, "nameOrig", "ts", "event_id"),
                 counters.sliding(df, "nameOrig", "ts", "event_id", heavy_rows=1)):
        assert [r["tx_count_hour"] for r in made.orderBy("event_id").collect()] == [1, 2, 1, 1]


# -------------------------------------------------------------------- profile

@pytest.mark.parametrize("heavy_rows", [10**6, 50])
@pytest.mark.parametrize("include_current", [True, False])
def test_profile_against_brute_force(spark, heavy_rows, include_current):
    rng = random.Random(4)
    events = [(i, rng.choice(["hot"] * 5 + ["a", "b"]), rng.randint(0, 60) * 43200 + rng.random(), rng.randint(1, 9999) / 100)
              for i in range(500)]
    got = profile.profile(timed(spark, events), include_current=include_current, heavy_rows=heavy_rows)
    got = {r["event_id"]: r for r in got.collect()}
    for customer in {e[1] for e in events}:
        seen, last = [], None
        for i, _, s, a in sorted((e for e in events if e[1] == customer), key=lambda e: (int(e[2] * S), e[0])):
            us = int(s * S)
            if last is not None and us - last >= 86400 * S:
                seen = []
            shown = [*seen, (us, a)] if include_current else list(seen)
            r = got[i]
            assert r["tx_count"] == len(shown)
            if shown:
                assert r["total_amount"] == pytest.approx(sum(x for _, x in shown))
                assert r["max_amount"] == max(x for _, x in shown)
                assert r["last_us"] == shown[-1][0]
            else:
                assert r["total_amount"] is None and r["avg_amount"] is None
            seen.append((us, a))
            last = us


def test_profile_restarts_after_exactly_a_day(spark):
    events = [(1, "C1", 0, 5), (2, "C1", 86399, 5), (3, "C1", 86399 + 86400, 5)]
    got = profile.profile(timed(spark, events)).orderBy("event_id").collect()
    assert [r["tx_count"] for r in got] == [1, 2, 1]


def test_features_that_include_the_row_know_every_customer(spark, events):
    made = profile.realtime_features(timed(spark, events), include_current=True)
    assert made.filter("is_new_customer = 1 or is_high_amount_customer = 1 or customer_age_hours <> 0").count() == 0


def test_features_of_the_state_before_the_row(spark):
    burst = [(i, "C1", 1000 + i, 100 if i < 12 else 400) for i in range(13)]
    got = profile.realtime_features(timed(spark, burst)).orderBy("event_id").collect()
    first, last = got[0], got[-1]
    assert (first["is_new_customer"], first["is_high_amount_customer"], first["amount_ratio_to_avg"]) == (1, 1, 100.0)
    assert (last["is_new_customer"], last["is_high_amount_customer"], last["amount_ratio_to_avg"]) == (0, 1, 4.0)
    assert [r["is_high_velocity"] for r in got] == [0] * 11 + [1, 1]
    assert last["avg_amount_deviation"] == 3.0 and last["customer_age_hours"] == pytest.approx(1 / 3600)
    assert last["is_unusual_time"] == 1 and last["tx_velocity_hour"] == 12.0


@pytest.mark.parametrize("mode", ["anchored", "sliding"])
def test_heavy_customers_get_the_same_features(spark, events, mode):
    df = timed(spark, events)
    plain = profile.realtime_features(df, mode=mode)
    cut = profile.realtime_features(df, mode=mode, heavy_rows=50).select(plain.columns)
    assert sorted(map(str, plain.collect())) == sorted(map(str, cut.collect()))


@pytest.mark.parametrize("heavy_rows", [10**6, 1])
@pytest.mark.parametrize("count", [counters.anchored, counters.sliding])
def test_rows_without_a_time_are_in_no_window(spark, count, heavy_rows):
    df = spark.createDataFrame([(1, "a", 0), (2, "a", None), (3, "a", 30), (4, "a", None), (5, None, 10), (6, None, None)],
                               "event_id bigint, nameOrig string, s int")
    df = df.selectExpr("event_id", "nameOrig", "cast(timestamp_seconds(s) as timestamp_ntz) AS ts")
    got = {r["event_id"]: r["tx_count_minute"] for r in count(df, "nameOrig", "ts", "event_id", heavy_rows=heavy_rows).collect()}
    assert got == {1: 1, 2: None, 3: 2, 4: None, 5: 1, 6: None}


def test_writes_at_one_time_have_a_fixed_order(spark):
    rows = [("risk", "a", p, 100, 3600) for p in ("0.9", "0.1", "0.5")]
    found = set()
    for order in (rows, rows[::-1], [rows[1], rows[2], rows[0]]):
        df = spark.createDataFrame(order, "kind string, key string, payload string, s int, ttl_s int").selectExpr(
            "kind", "key", "payload", "cast(timestamp_seconds(s) as timestamp_ntz) AS write_ts", "ttl_s").repartition(3)
        found.add(state.latest_alive(df, 200 * 1000000).first()["payload"])
    assert len(found) == 1
