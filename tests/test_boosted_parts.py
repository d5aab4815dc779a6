"""The learner of boosted trees reads each part alone; a prepared table is not prepared again for the training."""

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from txrisk.operators import boosted
from txrisk.plans import prepare as preparing, queries, training
from txrisk.session import reliable

SETTINGS = boosted.Settings(n_estimators=4, max_depth=3, features=["a", "b"])


@pytest.fixture(scope="module")
def parts(spark):
    i = F.col("id")
    rows = spark.range(0, 3000, 1, 3).select(
        (i % 37 * 1.5).alias("a"), F.when(i % 11 > 0, i % 23).alias("b"), ((i % 37 > 20) & (i % 5 > 0)).cast("int").alias("isFraud"),
        F.when(i % 10 < 7, "train").otherwise("val").alias("part"))
    stored = reliable(rows)
    return stored.filter("part = 'train'"), stored.filter("part = 'val'")


def test_each_part_is_read_without_the_other(parts, monkeypatch):
    seen = []
    fit = GBTClassifier.fit
    monkeypatch.setattr(GBTClassifier, "fit", lambda self, rows: seen.append(rows) or fit(self, rows))
    boosted.fit(parts[0], SETTINGS, parts[1])
    for chosen, part in ((~F.col("_val"), parts[0]), (F.col("_val"), parts[1])):
        made = seen[0].filter(chosen)
        assert made.rdd.getNumPartitions() == part.rdd.getNumPartitions()
        assert made.count() == part.count()


def test_trees_are_those_of_a_pipeline_over_marked_rows(parts):
    train, val = (p.drop("part").withColumn("_val", F.lit(held)) for p, held in zip(parts, (False, True)))
    rows = train.unionByName(val).na.fill(0).withColumns({
        "_weight": F.when(F.col("isFraud") == 1, 10.0).otherwise(1.0), "isFraud": F.col("isFraud").cast("double")})
    learner = GBTClassifier(
        featuresCol="v", labelCol="isFraud", weightCol="_weight", validationIndicatorCol="_val", seed=SETTINGS.seed, maxIter=4,
        maxDepth=3, stepSize=0.1, subsamplingRate=0.8, featureSubsetStrategy="0.8")
    expected = Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="v"), learner]).fit(rows).stages[1]
    model = boosted.fit(parts[0], SETTINGS, parts[1])
    assert model.stages[1].toDebugString.split("\n")[1:] == expected.toDebugString.split("\n")[1:]
    assert boosted.features_of(model) == ["a", "b"]


def test_a_missing_number_in_vectors_is_still_an_error(parts):
    spoiled = parts[0].withColumn("a", F.when(F.col("a") > 50, float("nan")).otherwise(F.col("a")))
    with pytest.raises(Exception, match="NaN"):
        boosted.fit(spoiled, SETTINGS, parts[1])


@pytest.mark.parametrize("name", ["gbt_score", "ensemble_metrics", "ensemble_metrics_checked"])
def test_a_table_is_prepared_once_for_training_and_scoring(tx, monkeypatch, name):
    calls = []
    prepare, train = preparing.prepare, training.train
    monkeypatch.setattr(preparing, "prepare", lambda rows, *more, **named: calls.append(1) or prepare(rows, *more, **named))
    monkeypatch.setattr(training, "train", lambda rows: train(
        rows, training.Sizes(5, boosted.Settings(n_estimators=2, max_depth=2))))
    monkeypatch.setattr(queries, "_TRAINED", {})
    found = getattr(queries, name)
    assert found(tx).count() == {"gbt_score": prepare(tx).rows.count(), "ensemble_metrics": 3}.get(name, 1)
    assert len(calls) == 1
