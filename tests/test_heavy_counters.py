"""Counters of a key with most of the rows: slice by slice, equal to a walk through its events."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import timed
from txrisk.operators import counters

WINDOWS = {"short": 5, "long": 13}


def walked(events, windows):
    """event -> counts before it in the window that is open, for (id, key, second, amount) rows."""
    out, opened = {}, {}
    for i, key, second, _ in sorted(events, key=lambda e: (e[1], e[2], e[0])):
        for name, ttl in windows.items():
            begin, n = opened.get((key, name), (None, 0))
            begin, n = (begin, n) if begin is not None and second < begin + ttl else (second, 0)
            out[i, name] = n
            opened[key, name] = begin, n + 1
    return out


def uneven(rng, n, key, first):
    """Stretches of every second, of gaps shorter and longer than a window, and of many events in one second."""
    steps = rng.choice([0, 0, 1, 1, 1, 2, 3, 4, 5, 12, 13, 14, 26, 27, 60], n)
    seconds = first + np.cumsum(steps)
    return [(int(i), key, int(s), 1.0) for i, s in enumerate(seconds)]


@pytest.fixture(scope="module")
def events():
    rng = np.random.default_rng(11)
    heavy = uneven(rng, 900, "C1", -150)
    regular = [(10_000 + i, "C3", i, 1.0) for i in range(400)]  # windows never fall into step with slices
    light = [(20_000 + i, f"C{10 + i % 20}", int(s), 1.0) for i, s in enumerate(rng.integers(0, 500, 100))]
    return heavy + regular + light


@pytest.mark.parametrize("inclusive", [True, False])
def test_anchored(spark, events, inclusive):
    df = timed(spark, events).repartition(5)
    made = counters.anchored(df, "nameOrig", "ts", "event_id", WINDOWS, inclusive, heavy_rows=100)
    want = walked(events, WINDOWS)
    got = {(r.event_id, n): r[f"tx_count_{n}"] - inclusive for r in made.collect() for n in WINDOWS}
    assert got == want


def test_sliding(spark, events):
    made = counters.sliding(timed(spark, events).repartition(5), "nameOrig", "ts", "event_id", WINDOWS, heavy_rows=100)
    by_key = {}
    for i, key, second, _ in events:
        by_key.setdefault(key, []).append(second)
    for r in made.collect():
        second = next(s for i, _, s, _ in events if i == r.event_id)
        for name, ttl in WINDOWS.items():
            assert r[f"tx_count_{name}"] == sum(second - ttl < s <= second for s in by_key[r.nameOrig])


def test_a_task_holds_two_slices_at_most(spark, events):
    """Entries of one key are cut into slices of the longest window, however many rows it has."""
    cells = timed(spark, events).groupBy(F.col("nameOrig").alias("_key"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("_sec")).agg(
        F.count(F.lit(1)).alias("_n"))
    sizes = [r["count"] for r in counters.sliced(cells, max(WINDOWS.values())).groupBy("_key", "_slice").count().collect()]
    assert max(sizes) <= max(WINDOWS.values()) and len(sizes) > 100


def test_way_through_a_slice_is_that_of_a_walk():
    rng = np.random.default_rng(2)
    for _ in range(200):
        length, ttl = 20, int(rng.integers(1, 21))
        begin = int(rng.integers(-3, 4)) * length
        second = np.unique(begin + rng.integers(0, length, rng.integers(1, 15)))
        way = counters.way_through(second, begin, length, ttl)
        for lasts in range(ttl):
            until = begin + lasts
            for s in second:
                until = s + ttl if s >= until else until
            assert way[lasts] == max(0, until - begin - length)
