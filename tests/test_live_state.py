"""State on streams: written, expired, erased and asked while a query runs."""

import os

import pytest
from pyspark.sql import functions as F

from test_streaming import at, replay
from txrisk.session import scratch_path, tuned
from txrisk.streaming import live_state, run

SCHEMA = "what string, key string, ts timestamp, id bigint, payload string, ttl int"


@pytest.fixture(autouse=True)
def settings(spark):
    tuned(spark)


def answers(spark, batches, path=None, lateness="10 seconds"):
    stream = replay(spark, batches, SCHEMA)
    parts = [
        live_state.writes(stream.filter("what = 'write'"), F.col("key"), F.col("payload"), "ts", F.col("ttl"), F.col("id")),
        live_state.erasures(stream.filter("what = 'erase'"), F.col("key"), "ts"),
        live_state.questions(stream.filter("what = 'ask'"), F.col("key"), "ts", F.col("id")),
    ]
    path = path or scratch_path(spark, "out")
    out = run.run_available(live_state.live_answers(parts, lateness), path)
    return {r.id: r.payload for r in out.collect()}


def write(key, second, number, payload, ttl=100):
    return ("write", key, at(second), number, payload, ttl)


def ask(key, second, number):
    return ("ask", key, at(second), number, None, None)


def erase(key, second):
    return ("erase", key, at(second), None, None, None)


def test_entries_are_written_expired_and_erased(spark):
    path = scratch_path(spark, "out")
    got = answers(spark, [
        [ask("a", 0, 1), write("a", 1, 1, "one"), ask("a", 1, 2), write("a", 1, 2, "two"), write("c", 3, 1, "kept", 100_000)],
        [ask("a", 100, 3), ask("a", 101, 4), write("a", 150, 3, "three"), write("b", 150, 1, "other")],
        [erase("a", 160), ask("a", 159, 5), ask("a", 160, 6), ask("b", 160, 7), ask("a", 165, 8), write("a", 162, 4, "four")],
        [ask("z", 400, 99)],
    ], path)
    # An entry of the time of a question counts, the larger tie is newer, life ends after 100 s, erasure follows writes.
    assert got == {1: None, 2: "two", 3: "two", 4: None, 5: "three", 6: None, 7: "other", 8: "four"}
    held = live_state.entries_held(spark, os.path.join(path, "checkpoint")).collect()
    assert [(r.key, r.payload) for r in held] == [("c", "kept")]


def test_order_of_arrival_does_not_matter_and_late_updates_have_no_effect(spark):
    got = answers(spark, [
        [ask("a", 8, 1), ask("a", 3, 2)],
        [write("a", 5, 1, "in time"), write("a", 2, 2, "earlier")],
        [ask("a", 100, 3)],
        [write("a", 50, 3, "late"), ask("a", 101, 4)],
        [ask("z", 1000, 99), (None, None, at(1000), 5, None, None), ask(None, 7, 6)],
    ])
    assert got == {1: "in time", 2: "earlier", 3: "in time", 4: "in time"}
