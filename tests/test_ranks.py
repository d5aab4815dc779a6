import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from txrisk.operators import ranks


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the values are equal, the rest are spread."""
    rng = random.Random(1)
    values = [7.5 if i % 3 == 0 else round(rng.uniform(-100, 100), 2) for i in range(6000)]
    return values, spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id bigint, v double").repartition(5)


@pytest.mark.parametrize("bracket_rows", [10, 500, 10**6])
def test_kth_smallest(skewed, bracket_rows):
    values, df = skewed
    wanted = [0, 1, 2999, 3100, 3333, 5998, 5999]
    assert ranks.kth_smallest(df, "v", wanted, bracket_rows) == [sorted(values)[r] for r in wanted]


@pytest.mark.parametrize("bracket_rows", [10, 10**6])
def test_kth_smallest_of_large_integers(spark, bracket_rows):
    """Neighbouring integers beyond the precision of a double."""
    df = spark.range(5000).select((F.lit(2**60) + F.col("id")).alias("v"))
    assert ranks.kth_smallest(df, "v", [0, 1234, 4999], bracket_rows) == [2**60, 2**60 + 1234, 2**60 + 4999]


def test_rank_out_of_range(skewed):
    with pytest.raises(ValueError):
        ranks.kth_smallest(skewed[1], "v", [6000])


@pytest.mark.parametrize("share", [0.0, 0.05, 0.5, 0.95, 1.0])
def test_percentile_interpolates(skewed, share):
    values, df = skewed
    for bracket_rows in (20, 10**6):
        assert ranks.percentile(df, "v", share, bracket_rows) == pytest.approx(np.quantile(values, share), abs=1e-12)


def test_percentile_ignores_missing(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (3.0,)], "v double")
    assert ranks.percentile(df, "v", 0.5) == 2.0
    assert ranks.percentile(df.filter("false"), "v", 0.5) is None


def test_golden_percentile(spark):
    from txrisk.sources.fixture import transactions

    assert ranks.percentile(transactions(spark, "/root/testdata/sf0.01"), "amount", 0.95) == 1055771.6084999996


def test_head(skewed):
    _, df = skewed
    for bracket_rows in (10, 10**6):
        got = sorted(r["id"] for r in ranks.head_by(df, "id", 100, bracket_rows).collect())
        assert got == list(range(100))
    assert ranks.head_by(df, "id", 10**6).count() == 6000


def test_sample_is_exact_and_repeatable(skewed):
    _, df = skewed
    one = {r["id"] for r in ranks.seeded_sample(df, "id", 700).collect()}
    two = {r["id"] for r in ranks.seeded_sample(df.repartition(3), "id", 700, bracket_rows=50).collect()}
    other = {r["id"] for r in ranks.seeded_sample(df, "id", 700, seed=7).collect()}
    assert len(one) == 700 and one == two and one != other
    assert ranks.seeded_sample(df, "id", 7000).count() == 6000


@pytest.mark.parametrize("bracket_rows", [10, 10**6])
def test_split_with_a_step_that_holds_most_rows(spark, bracket_rows):
    """The cut lies inside a step with 80 % of the rows."""
    rows = [(i, 1 if i < 100 else 2 if i < 900 else 3) for i in range(1000)]
    random.Random(3).shuffle(rows)
    parts = ranks.temporal_split(spark.createDataFrame(rows, "event_id bigint, step int"), bracket_rows=bracket_rows)
    got = {r["event_id"]: r["part"] for r in parts.collect()}
    ordered = [i for _, i in sorted((s, i) for i, s in rows)]
    train, val = ranks.split_sizes(1000)
    assert [got[i] for i in ordered] == ["train"] * train + ["val"] * (val - train) + ["test"] * (1000 - val)


@pytest.mark.parametrize("bracket_rows", [10, 10**6])
@pytest.mark.parametrize("untimed", [25, 50, 100])
def test_split_puts_rows_without_a_time_last(spark, bracket_rows, untimed):
    rows = [(i, None if i < untimed else i) for i in range(100)]
    random.Random(5).shuffle(rows)
    parts = ranks.temporal_split(spark.createDataFrame(rows, "event_id bigint, step int"), bracket_rows=bracket_rows)
    got = {r["event_id"]: r["part"] for r in parts.collect()}
    ordered = [*range(untimed, 100), *range(untimed)]
    assert [got[i] for i in ordered] == ["train"] * 70 + ["val"] * 10 + ["test"] * 20


@pytest.mark.parametrize("bracket_rows", [5, 10**6])
def test_head_puts_rows_without_a_key_last(spark, bracket_rows):
    df = spark.createDataFrame([(i if i % 4 else None,) for i in range(40)], "id bigint")
    assert sorted(r["id"] for r in ranks.head_by(df, "id", 10, bracket_rows).collect()) == [1, 2, 3, 5, 6, 7, 9, 10, 11, 13]
    assert ranks.head_by(df, "id", 35, bracket_rows).filter("id IS NULL").count() == 5


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10])
def test_split_of_few_rows(spark, n):
    df = spark.range(n).select(F.col("id").alias("event_id"), F.lit(1).alias("step"))
    counts = {r["part"]: r["count"] for r in ranks.temporal_split(df).groupBy("part").count().collect()}
    train, val = ranks.split_sizes(n)
    assert counts == {k: v for k, v in {"train": train, "val": val - train, "test": n - val}.items() if v}


def test_split_sizes_keep_double_arithmetic():
    assert ranks.split_sizes(10) == (7, 8)
    assert ranks.split_sizes(100000) == (70000, 80000)


def test_a_percentile_takes_few_passes(spark):
    """Both neighbours come out of one bracket: a count, a sketch, a count, and the rows of the bracket."""
    df = spark.range(50_000).select((F.col("id") * 7919 % 50_021).cast("double").alias("v"))
    context = spark.sparkContext
    context.setJobGroup("percentile", "")
    try:
        ranks.percentile(df, "v", 0.95, bracket_rows=500)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert len(context.statusTracker().getJobIdsForGroup("percentile")) <= 9
