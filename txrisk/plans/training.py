"""Training of all models and their comparison."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from txrisk.constants import BOOSTED_WEIGHT, FEATURES, FOREST_WEIGHT
from txrisk.operators import boosted, forest, gradient_trees, metrics, tuning
from txrisk.plans.prepare import Prepared, prepare
from txrisk.plans.scoring import Models, model_scores
from txrisk.sources.tables import log_run

# Changes with what a training run makes of the same settings and rows.
LEARNERS = 3
METRICS = ["precision", "recall", "f1_score", "auc"]


@dataclass(frozen=True)
class Sizes:
    """How much training to do; the defaults are the full settings."""

    trees: int = forest.TREES
    boosted: boosted.Settings | gradient_trees.Settings = boosted.Settings()


def train(prepared: Prepared, sizes: Sizes = Sizes(), key: str = "event_id") -> Models:
    """Forest and boosted trees on the training part."""
    rows = prepared.part("train")
    isolation = forest.fit(rows, key, trees=sizes.trees)
    trees = boosted.fit(rows, sizes.boosted, prepared.part("val"))
    return Models(isolation, trees, prepared.large_amount)


def evaluate(rows: DataFrame, models: Models) -> dict[str, dict[str, float]]:
    """Quality of each model and of their combination on labelled rows."""
    scored = model_scores(rows, models, batch_range=True)
    scored = scored.withColumn("forest_verdict", forest.is_outlier(models.forest).cast("int"))
    # Scores come from Python and from the trees: computed once, judged three times.
    scored = scored.select("isFraud", "forest_verdict", "forest_probability", "boosted_probability_verdict",
                           "boosted_probability", "ensemble_verdict", "ensemble_probability").persist()
    try:
        return _judged(scored)
    finally:
        scored.unpersist()


def _judged(scored: DataFrame) -> dict[str, dict[str, float]]:
    judged = {}
    for name, verdict, probability in [
        ("isolation_forest", "forest_verdict", "forest_probability"),
        ("xgboost", "boosted_probability_verdict", "boosted_probability"),
        ("ensemble", "ensemble_verdict", "ensemble_probability"),
    ]:
        numbers = metrics.quality(scored, "isFraud", verdict).first().asDict()
        numbers["auc"] = metrics.auc(scored, "isFraud", probability).first()["auc"]
        judged[name] = numbers
    return judged


def as_table(spark: SparkSession, judged: dict[str, dict[str, float]]) -> DataFrame:
    rows = [(model, *[None if numbers[m] is None else float(numbers[m]) for m in METRICS])
            for model, numbers in judged.items()]
    return spark.createDataFrame(rows, "model string, " + ", ".join(f"{m} double" for m in METRICS))


def full_pipeline(tx: DataFrame, runs_path: str | None = None, model_path: str | None = None,
                  sample_rows: int | None = None, sizes: Sizes = Sizes(),
                  key: str = "event_id", trials: int = 0) -> DataFrame:
    """Prepare, train, judge on the validation part, log and save.
    Returns one row of metrics per model.

    All rows are prepared, split and judged, unless the caller asks for a sample.
    With ``trials`` both models are those of the best of so many searched
    settings each, trained anew; the search logs its runs below ``runs_path``.
    """
    spark = tx.sparkSession
    prepared = prepare(tx, sample_rows, key=key)
    models = train(prepared, sizes, key) if not trials else searched(prepared, runs_path, trials)
    judged = evaluate(prepared.part("val"), models)
    if runs_path:
        for model, numbers in judged.items():
            params = {"forest_weight": FOREST_WEIGHT, "boosted_weight": BOOSTED_WEIGHT} if model == "ensemble" else {}
            log_run(spark, runs_path, f"pipeline-{model}", model, params, numbers, parent_id="pipeline")
    if model_path:
        save_models(spark, models, model_path)
    return as_table(spark, judged)


def searched(prepared: Prepared, runs_path: str, trials: int) -> Models:
    """Both models with the best of the searched settings."""
    if not runs_path:
        raise ValueError("a search needs a folder for its runs")
    best = {}
    for model in ("forest", "boosted"):
        runs = trial_search(prepared, runs_path, model, trials)
        best[model] = tuning.refit(runs, trial_of(prepared, model))[2]
    return Models(best["forest"], best["boosted"], prepared.large_amount)


def save_models(spark: SparkSession, models: Models, path: str) -> None:
    models.forest.save(spark, os.path.join(path, "forest"))
    boosted.save(models.boosted, os.path.join(path, "boosted"))
    spark.createDataFrame([(models.large_amount,)], "large_amount double").write.mode("overwrite").parquet(
        os.path.join(path, "threshold"))


def load_models(spark: SparkSession, path: str) -> Models:
    threshold = spark.read.parquet(os.path.join(path, "threshold")).first()["large_amount"]
    return Models(forest.Forest.load(spark, os.path.join(path, "forest")),
                  boosted.load(os.path.join(path, "boosted")), threshold)


def grid_search(prepared: Prepared, runs_path: str, model: str, space: dict[str, list] | None = None,
                parallelism: int = 2, model_path: str | None = None) -> DataFrame:
    """All settings of a grid, judged on the validation part. A model of the best
    ones is trained anew and saved at ``model_path``."""
    space = space or (tuning.FOREST_GRID if model == "forest" else tuning.BOOSTED_GRID)
    return _search(prepared, runs_path, model, f"{model}-grid", tuning.grid(space), parallelism, model_path)


def trial_search(prepared: Prepared, runs_path: str, model: str, trials: int = 50,
                 space: dict[str, tuple] | None = None, parallelism: int = 2,
                 model_path: str | None = None) -> DataFrame:
    """Randomly drawn settings; a repeated call continues the same study. A model
    of the best ones is trained anew and saved at ``model_path``."""
    space = space or (tuning.FOREST_SPACE if model == "forest" else tuning.BOOSTED_SPACE)
    study = f"{model}-trials"
    settings = [tuning.draw(space, study, i) for i in range(trials)]
    return _search(prepared, runs_path, model, study, settings, parallelism, model_path)


def trial_of(prepared: Prepared, model: str):
    train_rows, val_rows = prepared.part("train"), prepared.part("val")
    if model == "forest":
        return lambda params: tuning.forest_trial(train_rows, val_rows, params)
    return lambda params: tuning.boosted_trial(train_rows, val_rows, params)


def marked(prepared: Prepared) -> str:
    """What tells one prepared table from another: the rows, keys and labels of each part, the features and the threshold."""
    counts = prepared.rows.groupBy("part").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64("event_id", "isFraud").cast("decimal(20,0)")).alias("sum")).orderBy("part").collect()
    parts = [(r["part"], r["rows"], str(r["sum"])) for r in counts]
    return f"{parts}:{FEATURES}:{prepared.large_amount!r}:{LEARNERS}"


def _search(prepared, runs_path, model, study, settings, parallelism, model_path) -> DataFrame:
    spark = prepared.rows.sparkSession
    trial = trial_of(prepared, model)
    data = f"{model}:{marked(prepared)}"
    runs = tuning.search(spark, settings, trial, study, runs_path, parallelism, data)
    if model_path and (best := tuning.refit(runs, trial)):
        if model == "forest":
            best[2].save(spark, model_path)
        else:
            boosted.save(best[2], model_path)
    return runs
