"""Search for model settings over a fixed split by time.

Every setting is one training run on the cluster; runs share the driver through
a few threads, so their jobs overlap. Each finished run is appended to the table
of runs, and a search continues where that table ends.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import math
import random
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from txrisk.constants import FEATURES, SAMPLE_SEED
from txrisk.operators import boosted, forest, gradient_trees, metrics
from txrisk.sources.tables import best_run, log_run, read_runs

# ---------------------------------------------------------------- fixed values
FOREST_GRID = {"contamination": [0.005, 0.01, 0.02], "n_estimators": [50, 100, 200]}
BOOSTED_GRID = {
    "n_estimators": [100, 200, 300],
    "max_depth": [4, 6, 8],
    "learning_rate": [0.05, 0.1, 0.2],
    "scale_pos_weight": [5, 10, 20],
}
# (kind, low, high) of each dimension of the random searches.
BOOSTED_SPACE = {
    "n_estimators": ("int", 100, 500),
    "max_depth": ("int", 3, 10),
    "learning_rate": ("log", 0.01, 0.3),
    "subsample": ("float", 0.6, 1.0),
    "colsample": ("float", 0.6, 1.0),
    "min_child_weight": ("int", 1, 10),
    "gamma": ("float", 0.0, 5.0),
    "reg_alpha": ("float", 0.0, 5.0),
    "reg_lambda": ("float", 0.0, 5.0),
    "scale_pos_weight": ("int", 1, 50),
}
FOREST_SPACE = {
    "n_estimators": ("int", 50, 300),
    "contamination": ("float", 0.001, 0.05),
    "max_samples": ("float", 0.1, 1.0),
    "max_features": ("float", 0.1, 1.0),
}
# ----------------------------------------------------------- end fixed values

PENALTIES = {"reg_alpha", "reg_lambda"}


def grid(space: dict[str, list]) -> list[dict]:
    """Every combination, names in alphabetical order."""
    names = sorted(space)
    return [dict(zip(names, values)) for values in itertools.product(*(space[n] for n in names))]


def draw(space: dict[str, tuple], study: str, trial: int, seed: int = SAMPLE_SEED) -> dict:
    """Settings of one trial; the same for the same seed, study and number."""
    rng = random.Random(f"{seed}:{study}:{trial}")
    drawn = {}
    for name, (kind, low, high) in space.items():
        if kind == "int":
            drawn[name] = rng.randint(low, high)
        elif kind == "log":
            drawn[name] = math.exp(rng.uniform(math.log(low), math.log(high)))
        else:
            drawn[name] = rng.uniform(low, high)
    return drawn


def forest_trial(train: DataFrame, val: DataFrame, params: dict, key: str = "event_id",
                 features: list[str] = FEATURES) -> tuple[dict, object]:
    """Fit a forest on ``train``, judge its verdicts on ``val``."""
    model = forest.fit(
        train, key, features, contamination=params.get("contamination", forest.CONTAMINATION),
        trees=params.get("n_estimators", forest.TREES), max_samples=params.get("max_samples", "auto"),
        max_features=params.get("max_features", 1.0))
    judged = forest.scored(val.select("isFraud", *features), model)  # what is judged, as deep forests store it between blocks
    judged = judged.withColumn("_said", forest.is_outlier(model).cast("int"))
    return metrics.quality(judged, "isFraud", "_said").first().asDict(), model


def boosted_trial(train: DataFrame, val: DataFrame, params: dict,
                  features: list[str] = FEATURES) -> tuple[dict, object]:
    """Settings with penalties are for the learner that knows them; it is judged with all its trees."""
    if PENALTIES & params.keys():
        model = boosted.fit(train, gradient_trees.of_params(params, features))
    else:
        known = {k: v for k, v in params.items() if k in boosted.PARAMETERS or k == "scale_pos_weight"}
        model = boosted.fit(train, boosted.Settings(features=list(features), **known), val)
    judged = boosted.scored(val, model)
    return metrics.quality(judged, "isFraud", "boosted_probability_verdict").first().asDict(), model


def search(spark: SparkSession, settings: list[dict], trial: Callable[[dict], tuple[dict, object]], study: str,
           runs_path: str, parallelism: int = 2, data: str = "") -> DataFrame:
    """Run every setting that the table of runs does not hold yet; return the runs
    of these settings. The first one with the highest F1 score is the best.

    A run is named by its study, its place and a hash of its settings and of
    ``data``, which stands for whatever else decides the outcome; so another
    search in the same folder starts runs of its own.
    """
    names = [run_id(study, i, params, data) for i, params in enumerate(settings)]
    known = _logged(spark, runs_path)
    if study not in known:
        log_run(spark, runs_path, study, study, {"trials": len(settings)}, {})

    def one(name: str, params: dict) -> None:
        scores, _ = trial(params)
        log_run(spark, runs_path, name, study, params, scores, parent_id=study)

    waiting = [(name, params) for name, params in zip(names, settings) if name not in known]
    with ThreadPoolExecutor(parallelism) as pool:
        list(pool.map(lambda task: one(*task), waiting))
    wanted = spark.createDataFrame([(name,) for name in names], "run_id string")
    return read_runs(spark, runs_path).join(F.broadcast(wanted), "run_id", "left_semi")  # a row per setting


def _logged(spark: SparkSession, runs_path: str) -> set[str]:
    """Names of the runs that a folder holds; none if there is no folder yet."""
    try:
        return {r["run_id"] for r in read_runs(spark, runs_path).select("run_id").distinct().collect()}
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return set()


def run_id(study: str, number: int, params: dict, data: str = "") -> str:
    mark = hashlib.sha256(json.dumps([params, data], sort_keys=True).encode()).hexdigest()[:10]
    return f"{study}-{number:05d}-{mark}"


def best_settings(runs: DataFrame) -> tuple[dict, float] | None:
    row = best_run(runs).first()
    if row is None:
        return None
    return {k: json.loads(v) for k, v in row["params"].items()}, row["metrics"]["f1_score"]


def refit(runs: DataFrame, trial: Callable[[dict], tuple[dict, object]]) -> tuple[dict, float, object] | None:
    """Best settings, their score, and a model trained anew with them."""
    best = best_settings(runs)
    if best is None:
        return None
    params, score = best
    return params, score, trial(params)[1]
