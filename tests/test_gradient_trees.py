"""Second-order boosting against a plain version, and its stop on the AUC."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from txrisk.operators import forest, gradient_trees as gt, metrics
from txrisk.session import scratch_path

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(8)
    x = np.column_stack([rng.normal(size=1000).round(1), rng.integers(0, 5, 1000), rng.normal(size=1000).round(2)])
    odds = 2 * x[:, 0] - (x[:, 1] == 3) * 2 + x[:, 0] * x[:, 2]
    y = (rng.random(1000) < 1 / (1 + np.exp(-odds + 2))).astype(int)
    return x, y


@pytest.fixture(scope="module")
def table(spark, data):
    x, y = data
    return spark.createDataFrame(pd.DataFrame({"event_id": range(1000), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "isFraud": y}))


def plain_tree(x, g, h, edges, s, depth=0):
    """(feature, threshold, gain, left, right), or the value of a leaf; by trying every split."""
    shrink = lambda v: math.copysign(max(abs(v) - s.reg_alpha, 0), v)
    part = lambda m: shrink(g[m].sum()) ** 2 / (h[m].sum() + s.reg_lambda)
    best = None
    if depth < s.max_depth:
        for f in range(x.shape[1]):
            for t in edges[f]:
                left = x[:, f] <= t
                if h[left].sum() < s.min_child_weight or h[~left].sum() < s.min_child_weight or left.all() or not left.any():
                    continue
                gain = part(left) + part(~left) - part(np.ones(len(x), bool))
                if gain > max(s.gamma, 1e-6) and (best is None or gain > best[2] + 1e-9):
                    best = (f, t, gain, left)
    if best is None:
        return -s.learning_rate * shrink(g.sum()) / (h.sum() + s.reg_lambda)
    f, t, gain, left = best
    sides = [plain_tree(x[m], g[m], h[m], edges, s, depth + 1) for m in (left, ~left)]
    return f, t, gain, *sides


def walk(tree, row):
    while isinstance(tree, tuple):
        tree = tree[3] if row[tree[0]] <= tree[1] else tree[4]
    return tree


@pytest.mark.parametrize("changed", [{}, {"reg_alpha": 4.0, "reg_lambda": 3.0}, {"gamma": 6.0}, {"min_child_weight": 25.0, "scale_pos_weight": 4.0}])
def test_trees_are_those_of_trying_every_split(spark, table, data, changed):
    s = gt.Settings(**{"n_estimators": 3, "max_depth": 3, "learning_rate": 0.3, "subsample": 1.0, "colsample": 1.0, "scale_pos_weight": 1.0,
                       "features": NAMES, **changed})
    x, y = data
    model = gt.fit(table.repartition(5), s)
    edges = gt.edges_of(table, NAMES)
    w = np.where(y == 1, s.scale_pos_weight, 1.0)
    margin = np.zeros(len(y))
    splits = 0
    for _ in range(3):
        p = 1 / (1 + np.exp(-margin))
        tree = plain_tree(x, w * (p - y), w * p * (1 - p), edges, s)
        splits += isinstance(tree, tuple)
        margin += np.array([walk(tree, r) for r in x])
    got = np.array([r.p for r in gt.scored(table, model, "p").orderBy("event_id").collect()])
    assert splits and np.abs(got - 1 / (1 + np.exp(-margin))).max() < 1e-6


def test_penalties_make_smaller_trees(spark, table):
    def splits(**changed):
        s = gt.Settings(n_estimators=2, max_depth=4, features=NAMES, subsample=1.0, colsample=1.0, **changed)
        return gt.fit(table, s).walked().nodes(spark).filter("feature >= 0").count()

    free = splits()
    assert splits(gamma=20.0) < free and splits(min_child_weight=60.0) < free and splits(reg_alpha=1e6) == 0


def test_stop_on_the_auc(spark, table, data):
    """The AUC of labels that cannot be learnt ends boosting early, while the loss on easy ones would go on falling."""
    x, y = data
    rng = np.random.default_rng(1)
    val = spark.createDataFrame(pd.DataFrame({"event_id": range(1000, 1300), "a": x[:300, 0], "b": x[:300, 1], "c": x[:300, 2],
                                              "isFraud": rng.integers(0, 2, 300)}))
    s = gt.Settings(n_estimators=60, max_depth=2, features=NAMES, patience=5)
    model = gt.fit(table, s, val)
    assert len(model.aucs) < 60 and model.trees == int(np.argmax(model.aucs)) + 1 == len(model.aucs) - 5
    exact = metrics.auc(gt.scored(val, model, "p"), "isFraud", "p").first()["auc"]
    assert exact == pytest.approx(max(model.aucs), abs=2e-4)


def test_best_number_of_trees():
    trees = [{1: gt.Node(value=float(i))} for i in range(9)]
    assert gt.kept(trees, [0.6, 0.7, 0.65, 0.69, 0.68, 0.9], 3) == (trees[:2], [0.6, 0.7, 0.65, 0.69, 0.68])
    assert gt.kept(trees, [0.5, 0.5, 0.6], 5)[0] == trees[:3] and gt.kept(trees[:1], [0.5], 5)[0] == trees[:1]


def test_same_trees_whatever_the_partitions_and_after_loading(spark, table):
    s = gt.Settings(n_estimators=12, max_depth=3, features=NAMES)
    one, other = gt.fit(table.coalesce(1), s), gt.fit(table.repartition(6), s)
    nodes = [bag for m in (one, other) for bag in [sorted(map(tuple, m.walked().nodes(spark).collect()))]]
    assert nodes[0] == nodes[1]
    path = scratch_path(spark, "boosted")
    one.save(spark, path)
    again = gt.load(spark, path)
    both = gt.scored(gt.scored(table, one, "p"), again, "q")
    assert both.filter("p <> q").count() == 0 and again.aucs == one.aucs
    found = gt.importance(again, spark).collect()
    assert [r.feature for r in found][0] == "a" and sum(r.importance for r in found) == pytest.approx(1)
    assert forest.Forest.nodes(again.walked(), spark).count() > 12


def test_odd_values(spark):
    rows = [(i, None if i % 5 == 0 else float(i % 7), float("nan") if i % 3 == 0 else 1.0, None if i % 11 == 0 else i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "event_id int, a double, b double, isFraud int")
    model = gt.fit(df, gt.Settings(n_estimators=2, max_depth=2, features=["a", "b"], scale_pos_weight=None))
    assert gt.scored(df, model).filter(~F.col("boosted_probability").between(0, 1)).count() == 0
    with pytest.raises(ValueError):
        gt.fit(df.limit(0), gt.Settings(features=["a"]))
