"""Trees over many rows: split side by side, their rows handed on as packed columns."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from txrisk.operators import forest


def one_by_one(rows, columns, seed, tree, limit, node=1):
    """The nodes by definition."""
    here, low, high = [forest.leaf(node, len(rows))], rows[:, columns].min(axis=0), rows[:, columns].max(axis=0)
    found = forest.split(low, high, columns, seed, tree, node) if forest.depth_of(node) < limit and len(rows) > 1 else None
    if found is None:
        return here
    left = rows[:, found[0]] <= found[1]
    return [(node, *found, 2 * node, 2 * node + 1, 0.0)] + one_by_one(rows[left], columns, seed, tree, limit, 2 * node) + one_by_one(
        rows[~left], columns, seed, tree, limit, 2 * node + 1)


@pytest.mark.parametrize("alone, beside", [(16_384, 262_144), (40, 100), (3, 1)])
def test_nodes_are_those_of_the_definition(monkeypatch, alone, beside):
    monkeypatch.setattr(forest, "ALONE_ROWS", alone)
    monkeypatch.setattr(forest, "BESIDE_ROWS", beside)
    rng = np.random.default_rng(3)
    rows = np.column_stack([rng.normal(size=700), rng.integers(0, 3, 700), np.full(700, 7.0), rng.random(700) < 0.003, rng.pareto(0.5, 700)])
    rows[:200] = rows[0]
    for tree in range(6):
        columns = forest.columns_of(5, tree, 5, 4)
        values = [forest.narrowed(rows[:, f]) for f in columns]
        got = forest.grow(values, columns, 5, tree, 10).tuples()
        assert sorted(got) == sorted(one_by_one(rows, columns, 5, tree, 10))


def test_draws_of_many_nodes_are_those_of_each():
    nodes = np.array([1, 2, 77, 2**40 + 5])
    assert list(zip(*(d.tolist() for d in forest.draws_of(42, 9, nodes)))) == [forest.draws(42, 9, n) for n in nodes.tolist()]


def test_packed_columns_come_back_as_they_were():
    kinds = [np.array([1.0, 2, 300]), np.array([0.1, 1e300, -5]), np.array([0.5, 0.25, np.inf]), np.array([1.0, 0, 1])]
    narrow = [forest.narrowed(v) for v in kinds]
    assert [v.dtype.char for v in narrow] == ["h", "d", "f", "b"]
    got = forest.Gathered(2)  # more rows come than expected
    for part in (narrow, [forest.narrowed(v[::-1] / 3) for v in kinds]):
        got.add(3, "".join(v.dtype.char for v in part), b"".join(v.tobytes() for v in part))
    for v, back in zip(kinds, got.columns()):
        assert back.tolist() == [*v, *(v[::-1] / 3)]


@pytest.fixture(scope="module")
def table(spark):
    x = np.random.default_rng(6).normal(size=(2000, 3))
    return spark.createDataFrame(pd.DataFrame({"id": range(2000), "a": x[:, 0], "b": np.round(x[:, 1]), "c": x[:, 2] > 1}))


def test_rows_are_handed_on_without_passes_in_few_pieces(spark, table, monkeypatch):
    plain = forest.fit(table, "id", ["a", "b", "c"], trees=4, max_samples=0.5)
    monkeypatch.setattr(forest, "PLAIN_ROWS", 100)
    settled = []
    monkeypatch.setattr(forest.Upper, "settle", lambda *args: settled.append(args))
    handed = forest.fit(table.repartition(3), "id", ["a", "b", "c"], trees=4, max_samples=0.5)
    assert not settled
    paths = [forest.scored(table, m).select("id", F.round("forest_score", 12).alias("s")) for m in (plain, handed)]
    assert paths[0].exceptAll(paths[1]).count() == 0


def test_members_are_drawn_in_generated_code(spark, table):
    drawn = lambda tree: F.shiftrightunsigned(F.xxhash64(F.lit(1), tree, F.col("_id")), 11) / F.lit(float(2**53))
    made = table.select(F.col("id").alias("_id")).select(forest._members(drawn, {0: (0.5, 3), 1: (0.1, 7)}, range(2)).alias("m"))
    assert "lambda" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_trees_are_put_in_order_by_tasks(spark, table):
    """The root first, both children of a split side by side; whatever numbers the nodes have."""
    model = forest.fit(table, "id", ["a", "b", "c"], trees=3, max_samples=64)
    _, shared = forest._walk(model, spark, 0, 2)
    roots, feature, value, children = shared.value
    left, right = children[0::2], children[1::2]
    ends = left == np.arange(len(left))
    assert (left[ends] == right[ends]).all() and (right[~ends] == left[~ends] + 1).all()
    assert sorted([*roots, *left[~ends], *right[~ends]]) == list(range(len(left)))
