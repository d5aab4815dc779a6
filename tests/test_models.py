import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from txrisk.operators import boosted, ensemble, features, forest, metrics, tuning
from txrisk.plans import prepare as preparing, scoring, training
from txrisk.session import scratch_path
from txrisk.sources.tables import RUN_SCHEMA, best_run, log_run, read_runs

SMALL = boosted.Settings(n_estimators=3, max_depth=3)


@pytest.fixture(scope="module")
def planted(spark):
    """1,000 ordinary rows and ten far away."""
    rng = np.random.default_rng(0)
    values = np.vstack([rng.normal(size=(1000, 2)), rng.normal(12, 0.5, size=(10, 2))])
    table = pd.DataFrame({"id": range(1010), "a": values[:, 0], "b": values[:, 1]})
    return spark.createDataFrame(table)


@pytest.fixture(scope="module")
def fitted(planted):
    return forest.fit(planted, "id", ["a", "b"], trees=50)


@pytest.fixture(scope="module")
def prepared(tx):
    return preparing.prepare(tx)


@pytest.fixture(scope="module")
def models(prepared):
    return training.train(prepared, training.Sizes(10, SMALL))


def test_outliers_come_first(planted, fitted):
    scored = forest.scored(planted, fitted)
    lowest = [r["id"] for r in scored.orderBy("forest_score").limit(10).collect()]
    assert set(lowest) == set(range(1000, 1010))
    assert scored.filter("forest_score not between -1 and 0").count() == 0
    # About one percent lies strictly below the fitted cut, all of it planted.
    outliers = [r["id"] for r in scored.filter(forest.is_outlier(fitted)).collect()]
    assert 8 <= len(outliers) <= 11 and len(set(outliers) & set(lowest)) >= 8


def test_forest_is_the_same_for_the_same_seed(planted, fitted):
    again = forest.fit(planted.repartition(7), "id", ["a", "b"], trees=50)
    other = forest.fit(planted, "id", ["a", "b"], trees=50, seed=1)
    assert again.cut == pytest.approx(fitted.cut, abs=1e-12) and other.cut != pytest.approx(fitted.cut, abs=1e-9)


def test_trees_are_trees_over_all_their_rows(spark, fitted):
    nodes = fitted.nodes(spark).toPandas()
    assert nodes["tree"].nunique() == 50
    for _, tree in nodes.groupby("tree"):
        inner = tree[tree["feature"] >= 0]
        children = sorted(inner["left"].tolist() + inner["right"].tolist())
        assert children == list(range(1, len(tree)))
    assert forest.mean_path(256) == pytest.approx(10.244770920116851)


def test_walk_equals_a_walk_by_hand(spark, planted, fitted):
    nodes = {(r["tree"], r["node"]): r for r in fitted.nodes(spark).collect()}
    rows = {r["id"]: r for r in forest.scored(planted, fitted).collect()}
    for i in (0, 17, 500, 1005):
        total = 0.0
        for tree in range(50):
            at = nodes[tree, 0]
            while at["feature"] >= 0:
                value = rows[i][["a", "b"][at["feature"]]]
                at = nodes[tree, at["left"] if value <= at["threshold"] else at["right"]]
            total += at["length"]
        assert rows[i]["forest_score"] == pytest.approx(-2 ** (-total / 50 / forest.mean_path(256)))


def test_forest_save_and_load(spark, planted, fitted):
    path = scratch_path(spark, "forest")
    fitted.save(spark, path)
    loaded = forest.Forest.load(spark, path)
    both = forest.scored(forest.scored(planted, fitted), loaded, "again")
    assert both.filter("forest_score <> again").count() == 0
    assert (loaded.cut, loaded.low, loaded.high) == (fitted.cut, fitted.low, fitted.high)


def test_constant_and_tiny_tables(spark):
    df = spark.createDataFrame([(i, 1.0) for i in range(5)], "id int, a double")
    model = forest.fit(df, "id", ["a"], trees=3)
    scored = forest.scored(df, model)
    assert scored.select("forest_score").distinct().count() == 1
    assert scored.filter(forest.is_outlier(model)).count() == 0


def test_large_forests_are_walked_in_blocks(planted, fitted, monkeypatch):
    whole = forest.scored(planted, fitted, "whole")
    monkeypatch.setattr(forest, "MOST_NODES", 1000)
    assert len(forest._blocks(fitted, planted.sparkSession)) > 3
    both = forest.scored(whole, fitted)
    assert both.filter("abs(forest_score - whole) > 1e-12").count() == 0 and both.count() == 1010


@pytest.mark.parametrize("scores", [[-0.5], [-0.4, -0.4, -0.4]])
def test_range_of_no_width(spark, scores):
    df = spark.createDataFrame([(s, 0.9) for s in scores], "s double, boosted_probability double")
    made = df.withColumn("forest_probability", forest.probability("s", *forest.batch_range(df, "s")))
    row = ensemble.combine(made).first()
    assert row["forest_probability"] is None and row["ensemble_probability"] is None and row["ensemble_verdict"] == 0


def test_probability_within_range(spark):
    df = spark.createDataFrame([(-0.8,), (-0.6,), (-0.4,), (-0.9,), (-0.1,), (None,)], "s double")
    got = [r["p"] for r in df.select(forest.probability("s", -0.8, -0.4, clipped=True).alias("p")).collect()]
    assert got == [1.0, pytest.approx(0.5), 0.0, 1.0, 0.0, None]


def test_boosted_trees(spark, tx, prepared, models):
    val = prepared.part("val")
    scored = boosted.scored(val, models.boosted)
    assert scored.columns == [*val.columns, "boosted_probability", "boosted_probability_verdict"]
    assert scored.schema["step"].dataType == val.schema["step"].dataType
    assert scored.filter("boosted_probability not between 0 and 1").count() == 0
    assert scored.filter("(boosted_probability > 0.5) <> (boosted_probability_verdict = 1)").count() == 0
    assert metrics.auc(scored, "isFraud", "boosted_probability").first()["auc"] > 0.8
    weights = [r["importance"] for r in boosted.importance(models.boosted, spark).collect()]
    assert len(weights) == 24 and weights == sorted(weights, reverse=True) and sum(weights) == pytest.approx(1.0)


def test_weight_from_the_classes(prepared):
    model = boosted.fit(prepared.part("train"), boosted.Settings(2, 2, scale_pos_weight=None))
    assert boosted.features_of(model) == boosted.Settings().features


def test_dispatch_prefers_the_better_model(tx, models):
    only = scoring.Models
    expected = [
        (models, "ensemble"), (only(None, models.boosted, models.large_amount), "xgboost"),
        (only(models.forest, None, models.large_amount), "isolation_forest"), (only(), "rule_based")]
    for given, name in expected:
        judged = scoring.dispatch(tx, given)
        assert [r["model_used"] for r in judged.select("model_used").distinct().collect()] == [name]
        assert judged.filter("fraud_probability is null or is_fraud is null or risk_score is null").count() == 0
        assert judged.count() == tx.count()


def test_undefined_probability_is_half_and_no_fraud(tx, models):
    judged = scoring.dispatch(tx.filter("event_id = 1"), models, batch_range=True).first()
    assert (judged["is_fraud"], judged["fraud_probability"], judged["model_used"]) == (False, 0.5, "ensemble")


def test_models_save_and_load(spark, tx, models):
    path = scratch_path(spark, "models")
    training.save_models(spark, models, path)
    loaded = training.load_models(spark, path)
    columns = ["event_id", "is_fraud", "fraud_probability"]
    a, b = scoring.dispatch(tx, models).select(columns), scoring.dispatch(tx, loaded).select(columns)
    assert a.exceptAll(b).count() == 0 and a.count() == b.count()


def test_prepare_fits_the_threshold_on_training_rows(tx):
    on_train, on_all = preparing.prepare(tx), preparing.prepare(tx, scope="table")
    assert on_all.large_amount == features.large_amount_threshold(tx)
    assert on_train.large_amount == features.large_amount_threshold(on_train.part("train"))
    counts = {r["part"]: r["count"] for r in on_train.rows.groupBy("part").count().collect()}
    assert counts == {"train": 700, "val": 100, "test": 200}
    assert on_train.part("train").agg(F.max("step")).first()[0] <= on_train.part("val").agg(F.min("step")).first()[0]
    assert preparing.prepare(tx, sample_rows=300).rows.count() == 300


def test_pipeline_logs_and_saves(spark, tx):
    runs, saved = scratch_path(spark, "runs"), scratch_path(spark, "models")
    table = training.full_pipeline(tx, runs, saved, sizes=training.Sizes(10, SMALL))
    assert {r["model"] for r in table.collect()} == {"isolation_forest", "xgboost", "ensemble"}
    assert read_runs(spark, runs).filter("parent_id = 'pipeline'").count() == 3
    assert training.load_models(spark, saved).large_amount is not None


def test_search_resumes_and_picks_the_best(spark):
    calls = []

    def trial(params):
        calls.append(params["x"])
        return {"f1_score": {1: 0.2, 2: 0.9, 3: 0.9}.get(params["x"], 0.0)}, f"model {params['x']}"

    path, settings = scratch_path(spark, "runs"), [{"x": i} for i in range(3)]
    tuning.search(spark, settings, trial, "study", path)
    runs = tuning.search(spark, [*settings, {"x": 3}], trial, "study", path)
    assert sorted(calls) == [0, 1, 2, 3] and runs.count() == 4
    assert tuning.refit(runs, trial) == ({"x": 2}, 0.9, "model 2")


def test_no_run_no_best(spark):
    assert tuning.refit(spark.createDataFrame([], RUN_SCHEMA), lambda p: ({}, None)) is None


def test_first_of_equal_runs_wins(spark):
    path = scratch_path(spark, "runs")
    for name, score in [("b", 0.5), ("a", 0.5), ("c", 0.1), ("d", None)]:
        log_run(spark, path, name, "m", {}, {"f1_score": score})
    assert best_run(read_runs(spark, path)).first()["run_id"] == "a"


def test_spaces():
    assert len(tuning.grid(tuning.FOREST_GRID)) == 9 and len(tuning.grid(tuning.BOOSTED_GRID)) == 81
    for space in (tuning.BOOSTED_SPACE, tuning.FOREST_SPACE):
        for trial in range(50):
            drawn = tuning.draw(space, "s", trial)
            assert drawn == tuning.draw(space, "s", trial)
            assert all(space[n][1] <= v <= space[n][2] for n, v in drawn.items())


def test_grid_over_the_split(spark, prepared):
    space = {"contamination": [0.01, 0.05], "n_estimators": [5]}
    runs = training.grid_search(prepared, scratch_path(spark, "runs"), "forest", space)
    assert runs.count() == 2
    params, _ = tuning.best_settings(runs)
    assert set(params) == {"contamination", "n_estimators"}
