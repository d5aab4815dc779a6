"""Forests walked in blocks: what is stored, sent and drawn."""

import glob
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from txrisk.operators import forest
from txrisk.session import shared_folder


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 2))
    return spark.createDataFrame(pd.DataFrame({"id": range(600), "a": x[:, 0], "b": x[:, 1]}))


def test_scoring_in_blocks_keeps_one_stored_table_and_lets_go_of_nodes(spark, table, monkeypatch):
    model = forest.fit(table, "id", ["a", "b"], trees=12, max_samples=64)
    whole = forest.scored(table, model, "whole").select("id", "whole")
    monkeypatch.setattr(forest, "MOST_NODES", 200)
    assert len(forest._blocks(model, spark)) > 3
    sent, real = [], forest._walk

    def walk(*args):
        made = real(*args)
        sent.append(made[1])
        return made

    monkeypatch.setattr(forest, "_walk", walk)
    stored = lambda: set(glob.glob(os.path.join(shared_folder(spark).removeprefix("file:"), "txrisk", "table-*")))
    before = stored()
    both = forest.scored(table, model).join(whole, "id")
    assert len(stored() - before) == 1
    assert [shared._jbroadcast.isValid() for shared in sent] == [False] * (len(sent) - 1) + [True]
    assert both.count() == 600 and both.filter("abs(forest_score - whole) > 1e-12").count() == 0


def test_a_node_that_is_sent_takes_18_bytes(spark, table):
    model = forest.fit(table, "id", ["a", "b"], trees=5, max_samples=128)
    n = model.nodes(spark).count()
    _, shared = forest._walk(model, spark, 0, 4)
    roots, *rest = shared.value
    assert len(roots) == 5 and sum(part.nbytes for part in rest) == 18 * n


def test_draws_are_compared_in_generated_code(spark, table):
    drawn = lambda tree: F.shiftrightunsigned(F.xxhash64(F.lit(1), tree, F.col("_id")), 11) / F.lit(float(2**53))
    rows = table.withColumnRenamed("id", "_id")
    grown = forest._grown_in_groups(rows, ["a", "b"], drawn, 32, 600, 4, 2, 1)
    assert "lambda" not in grown._jdf.queryExecution().optimizedPlan().toString()
    assert grown.filter("node = 0").count() == 4
