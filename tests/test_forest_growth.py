"""Trees over large shares: grown by passes over the rows, equal to those one task grows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from txrisk.operators import forest


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 3))
    x[:900] = [0.5, -0.5, 2.0]  # a third of the rows are equal and stay together
    x[-3:] = [[500, 0, 0], [0, -900, 0], [0, 0, 4000]]  # lopsided splits
    rows = pd.DataFrame({"id": range(3000), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2]})
    return spark.createDataFrame(rows)


def trees(spark, model):
    """Nodes of every tree, numbered without gaps."""
    out = {}
    for tree, nodes in model.nodes(spark).toPandas().groupby("tree"):
        out[tree] = forest.numbered([tuple(r)[1:] for r in nodes.itertuples(index=False)])
    return out


@pytest.mark.parametrize("share, max_features, at_once", [(1.0, 1.0, 10**6), (0.3, 0.7, 10**6), (0.6, 1.0, 500)])
def test_both_ways_grow_the_same_forest(spark, table, monkeypatch, share, max_features, at_once):
    monkeypatch.setattr(forest, "MOST_UPPER", at_once)
    grown = dict(features=["a", "b", "c"], trees=3, max_samples=share, max_features=max_features)
    whole = forest.fit(table, "id", **grown)
    levels = forest.fit(table.repartition(7), "id", **grown, group_rows=150)
    assert trees(spark, whole) == trees(spark, levels)
    assert whole.tree_rows == levels.tree_rows == (3000 if share == 1.0 else int(share * 3000))
    both = forest.scored(forest.scored(table, whole, "one"), levels, "other")
    assert both.filter(F.abs(F.col("one") - F.col("other")) > 1e-12).count() == 0


def test_what_one_task_holds_is_bounded(spark, table, monkeypatch):
    """A task grows a node of at most group_rows rows; more rows that are equal are a leaf that needs no task."""
    handed = []
    real = forest.Upper.settle

    def settle(self, stats, *rest):
        before = set(self.small)
        real(self, stats, *rest)
        handed.extend(stats[n][0] for n in self.small - before)

    monkeypatch.setattr(forest.Upper, "settle", settle)
    model = forest.fit(table, "id", ["a", "b", "c"], trees=3, max_samples=1.0, group_rows=100)
    assert handed and max(handed) <= 100
    for _, tree in model.nodes(spark).toPandas().groupby("tree"):
        leaves = tree[tree["feature"] < 0]
        rest = leaves["length"] - leaves["node"].map(lambda n: int(n).bit_length() - 1)
        assert rest.max() >= forest.mean_path(900) - 1e-9


def test_cuts_are_those_of_the_sorted_draws(spark, table):
    draw = lambda tree: F.shiftrightunsigned(F.xxhash64(F.lit(1), tree, F.col("_id")), 11) / F.lit(float(2**53))
    ids = table.select(F.col("id").alias("_id"))
    got = forest.cuts(ids, draw, 1200, 3000, range(3))
    for tree in range(3):
        rows = sorted((r.u, r["_id"]) for r in ids.select(draw(F.lit(tree)).alias("u"), "_id").collect())
        assert got[tree] == rows[1199]


def test_draws_are_even_and_differ():
    made = np.array([forest.draws(7, t, n) for t in range(20) for n in range(1, 200)])
    assert made.min() >= 0 and made.max() < 1 and abs(made.mean() - 0.5) < 0.02 and len(np.unique(made)) == made.size
