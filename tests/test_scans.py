import random

import pytest

from txrisk.operators import scans
from txrisk.operators.scans import KeyedRows, Running, heavy_keys

AGGREGATES = [
    Running("sum", "sum", "v"), Running("count", "count"), Running("max", "max", "v"), Running("last", "last", "maybe"),
    Running("sum_b", "sum", "v", True), Running("count_b", "count", None, True), Running("max_b", "max", "v", True),
    Running("last_b", "last", "maybe", True),
]


@pytest.fixture(scope="module")
def rows():
    """One key has two thirds of the rows, most of them at one time; one key is NULL."""
    rng = random.Random(5)
    made = []
    for i in range(1500):
        key = rng.choice(["hot"] * 8 + ["a", "b", None, "c"])
        time = 50 if key == "hot" and i % 2 else rng.randint(0, 99)
        made.append((key, time, i, rng.randint(-5, 9), rng.choice([None, i]), rng.random() < 0.01))
    return made


def expected(rows, resets):
    out = {}
    for key in {r[0] for r in rows}:
        v, last = [], None
        for _, _, i, value, maybe, reset in sorted((r for r in rows if r[0] == key), key=lambda r: r[1:3]):
            if resets and reset:
                v, last = [], None
            before = (sum(v) if v else None, len(v), max(v, default=None), last)
            v.append(value)
            last = maybe if maybe is not None else last
            out[i] = (sum(v), len(v), max(v), last, *before)
    return out


@pytest.mark.parametrize("heavy_rows", [10**6, 200, 7])
@pytest.mark.parametrize("resets", [False, True])
def test_chunks_equal_plain_windows(spark, rows, heavy_rows, resets):
    df = spark.createDataFrame(rows, "k string, t int, i bigint, v int, maybe bigint, reset boolean").repartition(6)
    keyed = KeyedRows.of(df, ["k"], ["t", "i"], heavy_rows)
    assert (keyed.heavy is None) == (heavy_rows == 10**6)
    got = keyed.running(*AGGREGATES, reset="reset" if resets else None).rows()
    assert {r["i"]: tuple(r[a.name] for a in AGGREGATES) for r in got.collect()} == expected(rows, resets)


def test_heavy_key_is_spread(spark, rows):
    df = spark.createDataFrame(rows, "k string, t int, i bigint, v int, maybe bigint, reset boolean")
    keyed = KeyedRows.of(df, ["k"], ["t", "i"], 100)
    chunks = [r["count"] for r in keyed.heavy.filter("k = 'hot'").groupBy("_chunk").count().collect()]
    assert len(chunks) >= 5 and max(chunks) <= 400


def test_heavy_keys(spark, rows):
    df = spark.createDataFrame(rows, "k string, t int, i bigint, v int, maybe bigint, reset boolean")
    heavy = heavy_keys(df, ["k"], 500)
    assert [r["k"] for r in heavy.keys.collect()] == ["hot"]
    assert heavy.rows == sum(r[0] == "hot" for r in rows)
    ordinary, hot = heavy.part(df)
    assert ordinary.count() + hot.count() == len(rows) and ordinary.filter("k is null").count() > 0


def test_heavy_keys_beyond_the_bound_are_scanned_as_ordinary_ones(spark, monkeypatch):
    monkeypatch.setattr(scans, "MOST_HEAVY", 1)
    df = spark.createDataFrame([(i, i % 3, i) for i in range(60)], "id bigint, k int, v bigint")
    known = heavy_keys(df, ["k"], 5)
    assert known.keys.count() == 1
    made = KeyedRows.of(df, ["k"], ["id"], 5, known).running(Running("upto", "sum", "v")).rows()
    assert {r["id"]: r["upto"] for r in made.collect()} == {i: sum(range(i % 3, i + 1, 3)) for i in range(60)}
