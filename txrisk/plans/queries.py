"""Every operator as a query over the test tables: name -> (spark, folder) -> rows.

All of them read whole tables. Numbers that pass through exp or log are rounded,
so that engines can be compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from txrisk import constants as C
from txrisk.functions.columns import cents, event_hour, flag, micros, money
from txrisk.operators import (
    aggregates, boosted, clean, counters, ensemble, false_positives as fp, features, forest, gradient_trees, metrics, profile,
    ranks, rules, state,
)
from txrisk.plans import prepare as preparing, scoring, training
from txrisk.session import scratch_path, tuned
from txrisk.sources import files, messages, tables
from txrisk.sources.fixture import transaction_stream, transactions, untidy
from txrisk.streaming import flows, live_state, models as published, run, velocity

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

TX = ["event_id", *C.TX_COLUMNS]
# The forest searches use the library's grid and space; the searches of boosted
# trees look at fewer and smaller models (README has the times of full ones).
TRIED = 4
# Models already trained: (application, table) -> folder.
_TRAINED: dict[tuple[str, tuple], str] = {}
# A moment inside the test data, 2024-01-20 00:00 UTC, in microseconds.
AS_OF = 1705708800 * 1000000


def query(make):
    """Register a function of the transaction table."""
    QUERIES[make.__name__] = lambda spark, sf_dir: make(transactions(tuned(spark), sf_dir))
    return make


def folder_query(make):
    """Register a function of the session and the folder."""
    QUERIES[make.__name__] = lambda spark, sf_dir: make(tuned(spark), sf_dir)
    return make


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({name: F.round(name, digits) for name in names})


# --------------------------------------------------------------- sources, sinks

@query
def tx_view(tx):
    return tx.select(*TX)


@query
def csv_scan(tx):
    spark = tx.sparkSession
    path = scratch_path(spark, "csv")
    rows = tx.select(*TX)
    rows.write.option("header", True).csv(path)
    return files.read_transactions(spark, path, schema=rows.schema)


@query
def parquet_scan(tx):
    spark = tx.sparkSession
    path = scratch_path(spark, "parquet")
    rows = tx.select(*TX)
    rows.write.parquet(path)
    return files.read_transactions(spark, path, "parquet", rows.schema)


@query
def hash_sample(tx):
    return ranks.seeded_sample(tx, "event_id", 2000).select("event_id", "amount")


@query
def bounded_head(tx):
    return ranks.head_by(tx, "event_id", 5000).select("event_id", "amount")


@query
def coerce_csv(tx):
    spark, path = tx.sparkSession, scratch_path(tx.sparkSession, "csv")
    eid = F.col("event_id")
    spoiled = tx.select("event_id", "step", "type", "nameOrig",
                        F.when(eid % 13 == 0, "n/a").when(eid % 17 == 0, "12,5")
                        .otherwise(F.col("amount").cast("decimal(18,2)").cast("string")).alias("amount"))
    spoiled.write.option("header", True).csv(path)
    read = files.read_tolerant(spark, path)
    return read.select(F.col("event_id").cast("bigint").alias("event_id"), "step", "type", "nameOrig", "amount")


@folder_query
def json_decode(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    cut = F.when(F.col("event_id") % 19 == 0, F.substring("props", 1, 4)).otherwise(F.col("props"))
    decoded = messages.decode(events.select("event_id", cut.alias("value")), _props_schema())
    return decoded.select("event_id", "k", F.col(messages.CORRUPT).alias("unreadable"))


def _props_schema():
    return T.StructType([T.StructField("k", T.IntegerType())])


@query
def json_roundtrip(tx):
    schema = tx.select(*TX).schema
    sent = messages.encode(tx, TX).select("value")
    return messages.readable(messages.decode(sent, schema)).select(*TX)


@query
def json_envelope(tx):
    judged = scoring.dispatch(tx.select(*TX))
    out = messages.envelope(judged.withColumn("prediction", F.col("is_fraud").cast("int")))
    fields = F.from_json("value", "event_id bigint, amount double, model_used string")
    return out.select(*messages.ENVELOPE_COLUMNS, fields["event_id"].alias("event_id"),
                      fields["amount"].alias("amount_sent"), fields["model_used"].alias("model_used"))


@query
def published_messages(tx):
    spark, path = tx.sparkSession, scratch_path(tx.sparkSession, "messages")
    messages.publish_folder(tx, path)
    return messages.readable(messages.decode(spark.read.text(path))).select(*C.TX_COLUMNS)


@query
def stored_predictions(tx):
    spark, path = tx.sparkSession, scratch_path(tx.sparkSession, "predictions")
    tables.append_predictions(scoring.dispatch(tx), path)
    alive = state.latest_alive(spark.read.parquet(path), AS_OF + 1800 * 1000000)
    body = F.from_json("payload", "prediction int, probability double, risk_score double, model_used string")
    return alive.select("key", body["prediction"].alias("prediction"), body["probability"].alias("probability"),
                        body["model_used"].alias("model_used"))


@query
def stored_once(tx):
    """Predictions stored by batch; every batch runs twice, one of its runs ends before it is entered in the ledger."""
    spark, path = tx.sparkSession, scratch_path(tx.sparkSession, "stored")
    entries = tables.prediction_entries(scoring.dispatch(tx))
    for number in range(3):
        part = entries.filter(F.pmod(F.col("key").cast("bigint"), F.lit(3)) == number)
        part.write.parquet(f"{path}/rows/batch={number}/attempt=cut")
        for _ in range(2):
            tables.store_once(part, path, str(number))
    body = F.from_json("payload", "prediction int, probability double, risk_score double, model_used string")
    return tables.stored_once(spark, path, entries.schema).select(
        "key", F.col("batch").cast("int").alias("batch"), body["prediction"].alias("prediction"), body["model_used"].alias("model_used"))


def _score_runs(tx: DataFrame) -> DataFrame:
    """Quality of the rule score as a verdict at several cuts, as a table of runs."""
    scored = rules.rule_score(tx)
    said = [(t, F.col("score") > t) for t in C.FP_THRESHOLDS]
    real = F.col("isFraud") == 1
    counted = scored.agg(*[
        F.struct(F.count_if(real & s).alias("tp"), F.count_if(~real & s).alias("fp"),
                 F.count_if(real & ~s).alias("fn")).alias(f"_c{i}") for i, (_, s) in enumerate(said)])
    runs = F.array(*[
        F.struct(F.lit(f"cut-{t:.2f}").alias("run_id"), F.lit(t).alias("cut"), F.col(f"_c{i}.tp").alias("tp"),
                 F.col(f"_c{i}.fp").alias("fp"), F.col(f"_c{i}.fn").alias("fn")) for i, (t, _) in enumerate(said)])
    f1 = F.coalesce(F.try_divide((2 * F.col("tp")).cast("double"), 2 * F.col("tp") + F.col("fp") + F.col("fn")),
                    F.lit(0.0))
    return counted.select(F.inline(runs)).select(
        "run_id", F.lit("rules").alias("parent_id"), F.lit("rules").alias("model"),
        F.create_map(F.lit("cut"), F.col("cut").cast("string")).alias("params"),
        F.create_map(F.lit("f1_score"), f1).alias("metrics"), F.current_timestamp().alias("ts"))


@query
def run_log(tx):
    spark, path = tx.sparkSession, scratch_path(tx.sparkSession, "runs")
    for run_ in _score_runs(tx).collect():  # one row per cut
        tables.log_run(spark, path, run_["run_id"], run_["model"], {k: float(v) for k, v in run_["params"].items()},
                       run_["metrics"], run_["parent_id"])
    return tables.read_runs(spark, path).select(
        "run_id", "parent_id", F.col("params")["cut"].cast("double").alias("cut"),
        F.col("metrics")["f1_score"].alias("f1_score"))


@query
def best_run(tx):
    return tables.best_run(_score_runs(tx)).select("run_id", F.col("metrics")["f1_score"].alias("f1_score"))


# ------------------------------------------------------------ filters, cleaning

@query
def distinct_rows(tx):
    return clean.distinct_rows(clean.nan_to_null(untidy(tx.select(*TX))))


@query
def complete_rows(tx):
    return clean.complete_rows(untidy(tx.select(*TX)))


@query
def nonnegative_amount(tx):
    return clean.nonnegative(clean.nan_to_null(untidy(tx.select(*TX))), ["amount"])


@query
def nonnegative_balances(tx):
    return clean.nonnegative(clean.nan_to_null(untidy(tx.select(*TX))), C.BALANCES)


@query
def clean_table(tx):
    return clean.clean(untidy(tx.select(*TX)))


@query
def validate(tx):
    accepted, rejected = clean.validate(untidy(tx.select(*TX)))
    return accepted.select("event_id", "type", "amount", F.lit("").alias("errors")).unionByName(
        rejected.select("event_id", "type", "amount", F.array_join("errors", " ").alias("errors")))


@query
def batch_sizes(tx):
    return clean.batch_size_errors(tx, "step")


@query
def account_search(tx):
    return ranks.search(tx, "nameOrig", "C42", "event_id").select(
        "event_id", "step", "type", "amount", "nameDest", "count")


@query
def account_lookup(tx):
    wanted = tx.filter(F.col("isFlaggedFraud") == 1).select("nameOrig").distinct()
    return tx.join(state.bounded(wanted), "nameOrig", "left_semi").select("event_id", "nameOrig", "amount")


@query
def verdict_views(tx):
    return scoring.verdict_views(scoring.detect(tx).select("event_id", "type", "is_fraud"))


# --------------------------------------------------------- encodings, features

@query
def encode(tx):
    return features.encode(untidy(tx)).select("event_id", "type_encoded", "nameOrig_type", "nameDest_type")


@query
def features_train(tx):
    return rounded(features.training_features(tx).select("event_id", *C.FEATURES), "amount_log")


@query
def model_features(tx):
    return rounded(features.select_features(features.training_features(tx)), "amount_log")


@query
def features_serving(tx):
    made = features.serving_features(tx)
    return rounded(made.select("event_id", *C.SERVING_FEATURES), "amount_log")


@query
def large_amount_p95(tx):
    threshold = features.large_amount_threshold(tx)
    return tx.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("amount") > threshold).alias("large")).withColumn(
        "threshold", F.round(F.lit(threshold), 6))


@query
def display(tx):
    return features.displayed(scoring.report(tx))


# ------------------------------------------------------------------------ rules

@query
def rule_hits(tx):
    flags = rules.rule_flags(tx)
    counted = flags.agg(*[F.count_if(F.col(r.code)).alias(r.code) for r in rules.RULES])
    pairs = F.array(*[F.struct(F.lit(r.code).alias("rule"), F.col(r.code).alias("hits")) for r in rules.RULES])
    return counted.select(F.inline(pairs))


@query
def rule_score(tx):
    scored = rules.rule_score(tx).select("event_id", "raw_score", "score", "confidence", "is_fraud")
    return rounded(scored, "raw_score", "score")


@query
def rule_reasons(tx):
    return rules.rule_score(tx).select(
        "event_id", rules.reason_codes().alias("codes"), rules.reason_text().alias("text"), "n_reasons")


@query
def report(tx):
    made = scoring.report(tx).drop("fraud_reasons")
    return rounded(made, "fraud_probability", "risk_score")


@query
def report_unreduced(tx):
    made = scoring.report(tx, reduce=False).drop("fraud_reasons")
    return rounded(made, "fraud_probability", "risk_score")


@query
def labelled_report(tx):
    made = scoring.labelled_report(tx).drop("fraud_reasons")
    return rounded(made, "fraud_probability", "risk_score")


@query
def fallback_rule(tx):
    return tx.select("event_id", rules.fallback_rule().alias("prediction"), F.lit(0.5).alias("probability"))


@query
def risk_score(tx):
    scored = counters.sliding(rules.rule_score(tx), "nameOrig", "ts", "event_id", {"day": 86400})
    hour = event_hour("ts")
    return rounded(scored.select("event_id", rules.risk_score(
        F.col("score"), flag(F.col("tx_count_day") > 4), flag((hour < 6) | (hour > 22)), F.col("weighted_score"),
    ).alias("risk_score")), "risk_score")


# ------------------------------------------------------------- false positives

def _model_scored(tx: DataFrame) -> DataFrame:
    """Rows with a score that takes every value from 0.50 to 0.99, as a model's
    would, so that each ground for clearing occurs."""
    score = F.lit(0.5) + (F.col("event_id") % 50) / F.lit(100.0)
    kept = F.slice("reasons", F.lit(1), (F.col("event_id") % 3 + 1).cast("int"))
    return rules.rule_score(tx).withColumns({"score": score, "reasons": kept}).drop("weighted_score", "n_reasons").withColumn(
        "confidence", rules.confidence("score"))


@query
def reason_weight(tx):
    scored = _model_scored(tx)
    return rounded(scored.select("event_id", fp.reason_weight().alias("weighted_score")), "weighted_score")


@query
def behaviour(tx):
    signs = fp.behaviour()
    made = tx.select("event_id", *[c.alias(n) for n, c in signs.items()], fp.legitimacy().alias("legitimacy"))
    return rounded(made, "legitimacy")


FP_COLUMNS = [
    "event_id", "original_is_fraud", "is_fraud", "fp_reduced", "fraud_probability", "risk_score", "confidence"]


@query
def fp_reduce(tx):
    return rounded(scoring.detect(tx).select(*FP_COLUMNS), "fraud_probability", "risk_score")


@query
def fp_model_scores(tx):
    return rounded(fp.fp_reduce(_model_scored(tx)).select(*FP_COLUMNS), "fraud_probability", "risk_score")


@query
def fp_paired(tx):
    """Predictions kept apart from their transactions."""
    spark, path = tx.sparkSession, scratch_path(tx.sparkSession, "predictions")
    _model_scored(tx).select("event_id", "score", "confidence", "reasons").write.parquet(path)
    both = fp.paired(tx, spark.read.parquet(path))
    return rounded(fp.fp_reduce(both).select(*FP_COLUMNS), "fraud_probability", "risk_score")


@query
def fp_stats(tx):
    return fp.fp_stats(fp.fp_reduce(_model_scored(tx)))


@query
def fp_threshold_sweep(tx):
    return rounded(fp.threshold_sweep(_model_scored(tx)), "distance", digits=9)


@query
def fp_best_threshold(tx):
    return fp.best_threshold(fp.threshold_sweep(_model_scored(tx))).select("threshold", "cleared")


@query
def report_reduction(tx):
    return fp.report_reduction(scoring.report(tx))


# ------------------------------------------------------------------ aggregates

@query
def fraud_rate(tx):
    return aggregates.fraud_rate(tx)


@query
def kpis(tx):
    return aggregates.kpis(scoring.report(tx))


@query
def fraud_by_type(tx):
    return aggregates.fraud_by_type(rules.rule_score(tx))


@query
def amount_bins(tx):
    return aggregates.amount_bins(rules.rule_score(clean.nan_to_null(untidy(tx))))


@query
def confusion(tx):
    return metrics.confusion(rules.rule_score(tx).withColumn("said", F.col("is_fraud").cast("int")), "isFraud", "said")


@query
def quality(tx):
    judged = rules.rule_score(tx).withColumn("said", F.col("is_fraud").cast("int"))
    return metrics.quality(judged, "isFraud", "said").select("precision", "recall", "f1_score")


@query
def auc(tx):
    return rounded(metrics.auc(rules.rule_score(tx), "isFraud", "raw_score"), "auc", digits=9)


@query
def auc_amount(tx):
    return rounded(metrics.auc(tx, "isFraud", "amount"), "auc", digits=9)


@query
def class_weight(tx):
    return metrics.class_weight(tx)


@query
def prediction_counts(tx):
    judged = scoring.dispatch(tx).select("model_used", "is_fraud").unionByName(
        scoring.labelled_report(tx).select(F.lit("rules").alias("model_used"), "is_fraud"))
    return aggregates.prediction_counts(judged)


@query
def fraud_total(tx):
    return aggregates.fraud_total(scoring.report(tx))


@query
def histogram(tx):
    spent = tx.withColumn("cents", cents(F.col("amount")))
    made = aggregates.histogram(spent, "cents", [10000, 100000, 1000000, 10000000])
    return made.select(F.when(F.col("le") < float("inf"), F.col("le")).alias("le"), "in_bucket", "n",
                       F.col("total").cast("double").alias("total"))


@query
def rate_5m(tx):
    made = aggregates.rate_per_window(rules.rule_score(tx))
    return made.select(micros(made, "window_start").alias("window_us"), "result", "predictions", "per_second")


@query
def batch_totals(tx):
    made = aggregates.batch_totals(tx.withColumn("cents", cents(F.col("amount")).cast("bigint")), "step", "cents")
    return made


@query
def distinct_accounts(tx):
    return tx.select("type", "nameDest").distinct()


# ------------------------------------------------------------------ keyed state

def _risk_state(tx: DataFrame) -> DataFrame:
    """Risk scores of customers as they would have been written: after every
    transaction above 10000, alive for the usual time of its kind."""
    risky = tx.filter(F.col("amount") > 10000).withColumn("risk", (F.col("event_id") % 100) / F.lit(100.0))
    return state.entries(risky, "risk", F.col("nameOrig"), F.col("risk"), F.col("ts"), 43200).withColumn(
        "seq", F.lit(0)).unionByName(state.entries(
            risky.filter(F.col("isFraud") == 1), "fraud", F.col("event_id").cast("string"), F.col("risk"),
            F.col("ts")).withColumn("seq", F.lit(0)))


@query
def state_latest(tx):
    return state.latest_alive(_risk_state(tx), AS_OF).select(
        "kind", "key", "payload", "ttl_s")


def _known_risk(tx: DataFrame) -> DataFrame:
    written = _risk_state(tx).filter(F.col("kind") == "risk")
    return state.as_of_lookup(tx, "nameOrig", "ts", "event_id", written, "known")


@query
def state_asof(tx):
    return _known_risk(tx).select("event_id", "nameOrig", "known")


COUNTS = [f"tx_count_{n}" for n in C.COUNTER_SECONDS]


@query
def counter_anchored(tx):
    return counters.anchored(tx.select("event_id", "nameOrig", "ts"), "nameOrig", "ts", "event_id").select("event_id", *COUNTS)


@query
def counter_anchored_dest(tx):
    """The same over receiving accounts, a few of which are busy."""
    return counters.anchored(tx.select("event_id", "nameDest", "ts"), "nameDest", "ts", "event_id").select("event_id", *COUNTS)


@query
def counter_sliding(tx):
    return counters.sliding(tx, "nameOrig", "ts", "event_id").select("event_id", *COUNTS)


PROFILE = ["event_id", "total_amount", "tx_count", "avg_amount", "max_amount", "last_us"]


@query
def customer_profile(tx):
    return profile.profile(tx).select(*PROFILE)


@query
def customer_profile_before(tx):
    return profile.profile(tx, include_current=False).select(*PROFILE)


def _untimed(tx: DataFrame) -> DataFrame:
    """Every eleventh row lacks its time, every thirteenth its amount."""
    eid = F.col("event_id")
    return tx.withColumns({"ts": F.when(eid % 11 != 0, F.col("ts")), "amount": F.when(eid % 13 != 0, F.col("amount"))})


@query
def counter_anchored_untimed(tx):
    return counters.anchored(_untimed(tx).select("event_id", "nameOrig", "ts"), "nameOrig", "ts", "event_id").select("event_id", *COUNTS)


@query
def counter_sliding_untimed(tx):
    return counters.sliding(_untimed(tx), "nameOrig", "ts", "event_id").select("event_id", *COUNTS)


@query
def customer_profile_untimed(tx):
    return profile.profile(_untimed(tx)).select(*PROFILE)


@query
def velocity_features(tx):
    made = profile.realtime_features(tx, mode="sliding")
    return made.select("event_id", *COUNTS, "tx_velocity_hour", "amount_ratio_to_avg", "is_high_velocity",
                       "is_unusual_time")


RISK = ["event_id", "customer_risk_score", "is_new_customer", "is_high_amount_customer", "customer_age_hours",
        "avg_amount_deviation"]


@query
def risk_features(tx):
    return profile.realtime_features(_known_risk(tx), mode="sliding", known_risk="known").select(*RISK)


@query
def realtime_features(tx):
    """State updated first and read afterwards, as the online service does."""
    made = profile.realtime_features(tx, include_current=True, mode="anchored")
    return made.select(*RISK, *COUNTS, "tx_count", "amount_ratio_to_avg")


@query
def erase_customer(tx):
    counted = state.entries(
        tx.withColumn("owner", F.concat("nameOrig", F.lit(":day"))), "count", F.col("owner"), F.lit(1.0), F.col("ts"),
        86400).withColumn("seq", F.lit(0))
    gone = tx.filter(F.col("isFlaggedFraud") == 1).select(F.col("nameOrig").alias("customer"))
    left = state.erase(_risk_state(tx).unionByName(counted), gone)
    return left.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("entries"))


@query
def stats_snapshot(tx):
    snapshot = aggregates.kpis(scoring.report(tx))
    when = F.timestamp_micros(F.lit(AS_OF))
    entry = state.entries(snapshot, "stats", F.lit("aggregate"), F.to_json(F.struct(
        "total_count", "fraud_count", "legit_count")), when)
    alive = state.latest_alive(entry, AS_OF + 299 * 1000000)
    body = F.from_json("payload", "total_count bigint, fraud_count bigint, legit_count bigint")
    return alive.select("kind", "key", body["total_count"].alias("total_count"),
                        body["fraud_count"].alias("fraud_count"), body["legit_count"].alias("legit_count"), "ttl_s")


@query
def clear_state(tx):
    """The state as a table, its entries before and after it was overwritten by nothing."""
    spark, path = tx.sparkSession, scratch_path(tx.sparkSession, "state")
    written = _risk_state(tx)
    written.write.parquet(path)
    stored = spark.read.schema(written.schema).parquet(path)
    before = stored.groupBy("kind").agg(F.count(F.lit(1)).alias("entries")).collect()  # a row per kind
    state.clear(stored).write.mode("overwrite").parquet(path)
    left = spark.read.schema(written.schema).parquet(path).groupBy("kind").agg(F.count(F.lit(1)).alias("entries_left"))
    counted = spark.createDataFrame(before, "kind string, entries bigint")
    return counted.join(left, "kind", "left").select("kind", "entries", F.coalesce("entries_left", F.lit(0)).cast("long").alias("entries_left"))


# -------------------------------------------------------- sorts, limits, splits

@query
def temporal_split_untimed(tx):
    """Rows without a step are the last."""
    holed = tx.withColumn("step", F.when(F.col("event_id") % 5 != 0, F.col("step")))
    return ranks.temporal_split(holed).select("event_id", "step", "part")


@query
def temporal_split(tx):
    return ranks.temporal_split(tx).select("event_id", "step", "part")


@query
def by_step(tx):
    return tx.orderBy("step", "event_id").select("step", "event_id", "amount")


@query
def top_risk(tx):
    scored = rules.rule_score(tx)
    return scored.orderBy(F.desc("raw_score"), "event_id").limit(C.SEARCH_SHOWN).select(
        "event_id", F.round("raw_score", 6).alias("raw_score"))


# --------------------------------------------------------------------- learning

@query
def prepare(tx):
    made = preparing.prepare(untidy(tx), scope="table")
    return rounded(made.rows.select("event_id", "part", *C.FEATURES), "amount_log")


@query
def prepare_train_scope(tx):
    made = preparing.prepare(tx, scope="train")
    return made.rows.select("event_id", "part", "is_large_amount")


def _forest(tx: DataFrame) -> tuple[DataFrame, forest.Forest]:
    rows = features.training_features(tx)
    return rows, forest.fit(rows, "event_id")


@query
def iforest_score(tx):
    rows, model = _forest(tx)
    return forest.scored(rows, model).select("event_id", "forest_score")


@query
def iforest_verdict(tx):
    rows, model = _forest(tx)
    judged = forest.scored(rows, model).select("event_id", "forest_score", forest.is_outlier(model).alias("is_outlier"))
    return judged


@query
def forest_saved(tx):
    """A forest that was saved and loaded scores like the one it was."""
    spark, path = tx.sparkSession, scratch_path(tx.sparkSession, "model")
    rows, model = _forest(tx)
    model.save(spark, path)
    both = forest.scored(forest.scored(rows, model), forest.Forest.load(spark, path), "loaded_score")
    return both.agg(F.count(F.lit(1)).alias("rows"),
                    F.count_if(F.col("forest_score") == F.col("loaded_score")).alias("equal"))


def _given_scores(tx: DataFrame) -> DataFrame:
    """Two scores that both engines can compute: one like a forest's, one like a
    probability."""
    return tx.select("event_id", "isFraud",
                     (F.lit(-0.3) - (F.col("event_id") % 97) / F.lit(200.0)).alias("forest_score"),
                     ((F.col("event_id") % 89) / F.lit(89.0)).alias("boosted_probability"))


@query
def forest_probability(tx):
    given = _given_scores(tx)
    made = given.withColumn("forest_probability", forest.probability("forest_score", *forest.batch_range(given)))
    return rounded(made.select("event_id", "forest_probability"), "forest_probability")


@query
def forest_cut(tx):
    """The cut below which the given share of scores lies, and the rows below it."""
    given = _given_scores(tx)
    cut = ranks.percentile(given, "forest_score", 0.05)
    return given.agg(F.count_if(F.col("forest_score") < cut).alias("outliers")).withColumn(
        "cut", F.round(F.lit(cut), 9))


@query
def ensemble_combine(tx):
    given = _given_scores(tx)
    made = given.withColumn("forest_probability", forest.probability("forest_score", *forest.batch_range(given)))
    made = ensemble.combine(made).select("event_id", "ensemble_probability", "ensemble_verdict")
    return rounded(made, "ensemble_probability")


def trained_models(tx: DataFrame, made: preparing.Prepared | None = None) -> scoring.Models:
    """Forest and boosted trees at full size, trained once per application and table, and loaded from what was saved.
    A caller that has prepared the table hands it over, so that it is not prepared again for the training."""
    spark = tx.sparkSession
    where = (spark.sparkContext.applicationId, tuple(sorted(tx.inputFiles())))
    if where not in _TRAINED:
        path = scratch_path(spark, "models")
        training.save_models(spark, training.train(made or preparing.prepare(tx)), path)
        _TRAINED[where] = path
    return training.load_models(spark, _TRAINED[where])


@query
def gbt_score(tx):
    made = preparing.prepare(tx)
    return boosted.scored(made.rows, trained_models(tx, made).boosted).select("event_id", "boosted_probability", "boosted_probability_verdict")


def _between(name: str, low=0.0, high=1.0):
    return F.count_if(F.col(name).between(low, high))


@query
def gbt_checked(tx):
    """What must hold of the boosted scores, whatever the trees."""
    said = F.col("boosted_probability_verdict") == (F.col("boosted_probability") > 0.5).cast("int")
    return gbt_score_rows(tx).agg(F.count(F.lit(1)).alias("rows"), _between("boosted_probability").alias("in_range"),
                                  F.count_if(said).alias("consistent"))


def gbt_score_rows(tx):
    return boosted.scored(features.training_features(tx), trained_models(tx).boosted)


@query
def feature_importance(tx):
    return boosted.importance(trained_models(tx).boosted, tx.sparkSession)


@query
def importance_checked(tx):
    found = boosted.importance(trained_models(tx).boosted, tx.sparkSession)
    return found.agg(F.count_if(F.col("feature").isin(C.FEATURES)).alias("features"),
                     F.round(F.sum("importance"), 6).alias("total"), _between("importance").alias("in_range"))


@query
def full_pipeline(tx):
    return training.full_pipeline(tx)


@query
def ensemble_metrics(tx):
    """Models trained, saved, loaded and judged on the held-out rows."""
    return ensemble_metrics_rows(tx)


@query
def ensemble_metrics_checked(tx):
    found = ensemble_metrics_rows(tx)
    return found.agg(F.count(F.lit(1)).alias("models"), *[_between(m).alias(m) for m in training.METRICS])


def ensemble_metrics_rows(tx):
    made = preparing.prepare(tx)
    return training.as_table(tx.sparkSession, training.evaluate(made.part("test"), trained_models(tx, made)))


# A small forest, written out: tree, node, feature, threshold, left, right, length.
WALKED = [
    (0, 0, 0, 1000.0, 1, 2, 0.0), (0, 1, -1, 0.0, 1, 1, 3.5), (0, 2, 1, 5000.0, 3, 4, 0.0), (0, 3, -1, 0.0, 3, 3, 2.0),
    (0, 4, -1, 0.0, 4, 4, 1.0), (1, 0, 1, 100.0, 1, 2, 0.0), (1, 1, -1, 0.0, 1, 1, 2.5), (1, 2, -1, 0.0, 2, 2, 4.25),
]


@query
def forest_walk(tx):
    """Paths, scores and verdicts of a given forest."""
    spark, path = tx.sparkSession, scratch_path(tx.sparkSession, "walked")
    spark.createDataFrame(WALKED, forest.NODE_SCHEMA).write.parquet(path)
    model = forest.Forest(path, ["amount", "oldbalanceOrg"], 2, 8, 0.01, cut=-0.55)
    made = forest.scored(tx, model).select("event_id", "forest_score", forest.is_outlier(model).alias("is_outlier"))
    return rounded(made, "forest_score", digits=9)


def _settings(runs: DataFrame, **kinds: str) -> DataFrame:
    """The settings of runs, and whether each has a score."""
    return runs.select(*[F.col("params")[n].cast(kind).alias(n) for n, kind in kinds.items()],
                       F.col("metrics")["f1_score"].between(0, 1).alias("scored"))


@query
def grid_forest(tx):
    """The library's grid of nine settings."""
    runs = training.grid_search(preparing.prepare(tx), scratch_path(tx.sparkSession, "runs"), "forest")
    return _settings(runs, contamination="double", n_estimators="int")


@query
def search_resume(tx):
    """Two searches in one folder; each returns runs of its own settings, the first one again without training."""
    runs, made = scratch_path(tx.sparkSession, "runs"), preparing.prepare(tx)
    first, second = {"n_estimators": [5], "contamination": [0.01, 0.02]}, {"n_estimators": [6], "contamination": [0.03]}
    found = [training.grid_search(made, runs, "forest", space) for space in (first, second, first)]
    parts = [rows.select(F.lit(i).alias("search"), F.col("params")["n_estimators"].cast("int").alias("trees"),
                         F.col("params")["contamination"].cast("double").alias("contamination"),
                         F.col("metrics")["f1_score"].between(0, 1).alias("scored")) for i, rows in enumerate(found)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def best_refit(tx):
    """The winner of a search, trained anew, saved, loaded, scoring every row."""
    spark, path = tx.sparkSession, scratch_path(tx.sparkSession, "best")
    made = preparing.prepare(tx)
    training.grid_search(made, scratch_path(spark, "runs"), "forest", {"n_estimators": [5], "contamination": [0.02, 0.05]},
                         model_path=path)
    model = forest.Forest.load(spark, path)
    scored = forest.scored(made.rows, model)
    return scored.agg(F.count(F.lit(1)).alias("rows"), _between("forest_score", -1.0, 0.0).alias("in_range"),
                      F.lit(model.trees).alias("trees"))


@query
def grid_boosted(tx):
    space = {"n_estimators": [3], "max_depth": [3, 4], "learning_rate": [0.1], "scale_pos_weight": [10]}
    runs = training.grid_search(preparing.prepare(tx), scratch_path(tx.sparkSession, "runs"), "boosted", space)
    return _settings(runs, n_estimators="int", max_depth="int", learning_rate="double", scale_pos_weight="int")


def _in_space(runs: DataFrame, space: dict[str, tuple]) -> DataFrame:
    """How many runs there are, have all settings within the space, and a score."""
    inside = F.lit(True)
    for name, (_, low, high) in space.items():
        inside = inside & F.col("params")[name].cast("double").between(low, high)
    return runs.agg(F.count(F.lit(1)).alias("trials"), F.count_if(inside).alias("in_space"),
                    F.count_if(F.col("metrics")["f1_score"].between(0, 1)).alias("scored"))


@query
def trials_forest(tx):
    """Settings from the library's space: up to 300 trees that see up to all training rows."""
    runs = training.trial_search(preparing.prepare(tx), scratch_path(tx.sparkSession, "runs"), "forest", TRIED)
    return _in_space(runs, training.tuning.FOREST_SPACE)


@query
def trials_boosted(tx):
    space = {**training.tuning.BOOSTED_SPACE, "n_estimators": ("int", 2, 4), "max_depth": ("int", 3, 4)}
    runs = training.trial_search(preparing.prepare(tx), scratch_path(tx.sparkSession, "runs"), "boosted", 2, space)
    return _in_space(runs, space)


@query
def gbt_penalised(tx):
    """Trees with penalties, stopped on the AUC of the validation rows."""
    made = preparing.prepare(tx)
    settings = gradient_trees.Settings(n_estimators=12, max_depth=4, reg_alpha=1.0, reg_lambda=2.0, gamma=0.5, patience=3)
    model = boosted.fit(made.part("train"), settings, made.part("val"))
    scored = boosted.scored(made.rows, model)
    said = F.col("boosted_probability_verdict") == (F.col("boosted_probability") > 0.5).cast("int")
    return scored.agg(F.count(F.lit(1)).alias("rows"), _between("boosted_probability").alias("in_range"), F.count_if(said).alias("consistent"),
                      F.lit(max(model.aucs) > 0.5 and model.trees == model.aucs.index(max(model.aucs)) + 1).alias("best_kept"))


@folder_query
def stream_ensemble(spark, sf_dir):
    """All models over a stream, and how many verdicts equal those of the batch."""
    tx, path = transactions(spark, sf_dir), scratch_path(spark, "stream_ensemble")
    both = trained_models(tx)
    published.publish(spark, both, f"{path}/models")
    columns = ["event_id", "is_fraud", "fraud_probability", "risk_score", "model_used"]
    judged = published.score_available(transaction_stream(spark, sf_dir), f"{path}/models", path).select(*columns, "model_version")
    batch = scoring.dispatch(tx, both).select(F.col("event_id").alias("id"), F.struct(*columns[1:]).alias("batch"))
    same = F.struct(*columns[1:]).eqNullSafe(F.col("batch"))
    return judged.join(batch, judged["event_id"] == batch["id"], "full").groupBy("model_version", "model_used").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(same).alias("as_in_batch"))


@query
def score_dispatch(tx):
    """No model at hand: the fallback rule, raised by the state of the customer."""
    state_rows = profile.realtime_features(_known_risk(tx), mode="sliding", known_risk="known")
    judged = scoring.dispatch(state_rows)
    return rounded(judged.select("event_id", "is_fraud", "fraud_probability", "risk_score", "model_used"), "risk_score")


@query
def prediction_records(tx):
    state_rows = profile.realtime_features(_known_risk(tx), mode="sliding", known_risk="known")
    made = scoring.records(scoring.dispatch(state_rows))
    of = F.col("features")
    return made.select("event_id", "is_fraud", "fraud_probability", "model_used", F.size("features").alias("n_features"),
                       *[of[n].alias(n) for n in ("tx_count_day", "amount_ratio_to_avg", "customer_risk_score")])


@query
def batch_score(tx):
    """All models over the whole table."""
    return scoring.dispatch(tx, trained_models(tx)).select("event_id", "is_fraud", "fraud_probability", "risk_score", "model_used")


@query
def batch_score_checked(tx):
    """Rows, probabilities and verdicts of each branch of the dispatch."""
    both = trained_models(tx)
    parts = []
    for models, cut in ((both, C.ENSEMBLE_CUT), (scoring.Models(None, both.boosted, both.large_amount), 0.5)):
        made = scoring.dispatch(tx, models)
        over = F.col("fraud_probability") > cut
        said = (F.col("is_fraud") == over) | (F.col("fraud_probability") == cut)
        parts.append(made.groupBy("model_used").agg(
            F.count(F.lit(1)).alias("rows"), _between("fraud_probability").alias("in_range"), F.count_if(said).alias("consistent")))
    return parts[0].unionByName(parts[1])


# -------------------------------------------------------------------- streaming

def stream_query(make):
    """Register a function of the transaction stream; it runs over what is there."""
    def run_it(spark: SparkSession, sf_dir: str) -> DataFrame:
        return make(transaction_stream(tuned(spark), sf_dir), scratch_path(spark, make.__name__))

    QUERIES[make.__name__] = run_it
    return make


@stream_query
def stream_report(stream, path):
    made = run.run_available(flows.report_stream(stream), path).drop("fraud_reasons")
    return rounded(made, "fraud_probability", "risk_score")


@stream_query
def stream_rate_5m(stream, path):
    made = run.run_to_the_end(flows.rates(rules.rule_score(stream)), path, ["window_start", "result"])
    return made.select(micros(made, "window_start").alias("window_us"), "result", "predictions", "per_second")


@stream_query
def stream_dedupe(stream, path):
    """Each transaction arrives twice and is kept once."""
    twice = stream.select(*TX, "ts").union(stream.select(*TX, "ts"))
    return run.run_available(flows.without_repeats(twice, TX), path).select(*TX)


@stream_query
def stream_sessions(stream, path):
    made = run.run_to_the_end(flows.sessions(stream), path, ["nameOrig", "session_start"], "complete")
    return made.select("nameOrig", micros(made, "session_start").alias("start_us"),
                       micros(made, "session_end").alias("end_us"), "tx_count", "total_amount", "max_amount")


def _live_events(stream: DataFrame) -> list[DataFrame]:
    """Risk scores as they are written, and a question for each transaction."""
    risky = stream.filter(F.col("amount") > 10000)
    risk = (F.col("event_id") % 100) / F.lit(100.0)
    return [live_state.writes(risky, F.col("nameOrig"), risk, "ts", 43200, F.col("event_id")),
            live_state.questions(stream, F.col("nameOrig"), "ts", F.col("event_id"))]


def _live_erasures(stream: DataFrame) -> DataFrame:
    """A flagged transaction erases what is known of its customer."""
    return live_state.erasures(stream.filter(F.col("isFlaggedFraud") == 1), F.col("nameOrig"), "ts")


def _answered(events: list[DataFrame], path: str) -> DataFrame:
    made = run.run_available(live_state.live_answers(events), path)
    return made.select(F.col("id").alias("event_id"), F.col("key").alias("nameOrig"), F.col("payload").cast("double").alias("known"))


@stream_query
def stream_state_asof(stream, path):
    """The risk alive at each transaction that the watermark has passed, updates and transactions as streams."""
    return _answered(_live_events(stream), path)


@stream_query
def stream_state_erased(stream, path):
    """The same while customers are erased."""
    return _answered([*_live_events(stream), _live_erasures(stream)], path)


@stream_query
def stream_state_held(stream, path):
    """What that stream still holds of each customer when it stops, read from its checkpoint."""
    events = [*_live_events(stream), _live_erasures(stream)]
    run.run_available(live_state.live_answers(events), path)
    held = live_state.entries_held(stream.sparkSession, f"{path}/checkpoint")
    return held.select("key", F.col("payload").cast("double").alias("payload"), "until_us")


@folder_query
def stream_velocity(spark, sf_dir):
    """Small micro-batches: a task holds the rows of one customer and micro-batch."""
    stream, path = transaction_stream(spark, sf_dir, 1 << 30), scratch_path(spark, "stream_velocity")
    made = run.run_available(velocity.velocity_stream(stream), path)
    return made.select("event_id", *COUNTS, "tx_count", money(F.col("total_cents")).alias("total_amount"),
                       money(F.col("max_cents")).alias("max_amount"), "last_us")


@folder_query
def stream_velocity_missing(spark, sf_dir):
    """The same where every thirteenth amount is missing."""
    stream, path = transaction_stream(spark, sf_dir, 1 << 30), scratch_path(spark, "stream_velocity")
    holed = stream.withColumn("amount", F.when(F.col("event_id") % 13 != 0, F.col("amount")))
    made = run.run_available(velocity.velocity_stream(holed), path)
    return made.select("event_id", "tx_count", money(F.col("total_cents")).alias("total_amount"),
                       money(F.col("max_cents")).alias("max_amount"))


@folder_query
def stream_score(spark, sf_dir):
    """Published messages in, scored messages out."""
    path = scratch_path(spark, "stream_score")
    messages.publish_folder(transactions(spark, sf_dir), f"{path}/in")
    out = flows.score_messages(messages.replay_folder(spark, f"{path}/in", 1000))
    return run.run_available(out, path).select(*messages.ENVELOPE_COLUMNS)


@folder_query
def stream_quarantine(spark, sf_dir):
    """Messages that cannot be read are set aside; here every cut one."""
    path = scratch_path(spark, "stream_quarantine")
    sent = messages.encode(transactions(spark, sf_dir), TX)
    number = F.get_json_object("value", "$.event_id").cast("bigint")
    cut = F.when(number % 23 == 0, F.substring("value", 1, 30)).otherwise(F.col("value"))
    sent.select(cut.alias("value")).write.text(f"{path}/in")
    decoded = messages.decode(messages.replay_folder(spark, f"{path}/in", 1000))
    return run.run_available(messages.quarantined(decoded), path).select(F.length(messages.CORRUPT).alias("length"))
