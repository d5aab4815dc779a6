"""The plans are what they should be at scale."""

from helpers import plan, shuffles
from pyspark.sql import functions as F

from txrisk.operators import aggregates, counters, features, metrics, profile, ranks, state
from txrisk.operators.rules import rule_score
from txrisk.plans import scoring
from txrisk.session import tuned
from txrisk.sources.fixture import transactions

SF_DIR = "/root/testdata/sf0.001"


def stored(spark):
    return transactions(tuned(spark), SF_DIR)


def test_stateless_operators_neither_shuffle_nor_leave_the_jvm(spark):
    tx = stored(spark)
    made = [rule_score(tx), scoring.report(tx), scoring.labelled_report(tx), features.training_features(tx, 1.0),
            features.serving_features(tx), scoring.dispatch(tx), ranks.temporal_split(tx), ranks.head_by(tx, "event_id", 5),
            ranks.seeded_sample(tx, "event_id", 5)]
    for df in made:
        text = plan(df)
        assert "Exchange" not in text and "Python" not in text and "Sort" not in text, text


def test_generated_methods_can_be_compiled(spark):
    """No generated method is above the 8000 bytes that the Java compiler takes."""
    tx = stored(spark)
    debug = getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$").__getattr__("MODULE$")
    for df in [scoring.report(tx), features.training_features(tx, 1.0)]:
        stages = debug.codegenStringSeq(df._jdf.queryExecution().executedPlan())
        sizes = [stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())]
        assert sizes and max(sizes) < 8000


def test_columns_are_pruned_and_filters_pushed_to_the_scan(spark):
    tx = stored(spark)
    text = plan(aggregates.fraud_rate(tx.filter(F.col("amount") > 10)))
    assert "ReadSchema: struct<type:string,amount:double,isFraud:int>" in text
    assert "PushedFilters: [IsNotNull(amount), GreaterThan(amount,10.0)]" in text
    assert "LessThanOrEqual(event_id" in plan(ranks.head_by(tx, "event_id", 5))


def test_one_shuffle_each(spark):
    tx = stored(spark)
    for df in [profile.profile(tx), counters.sliding(tx, "nameOrig", "ts", "event_id"),
               counters.anchored(tx, "nameOrig", "ts", "event_id"), aggregates.fraud_by_type(rule_score(tx)),
               metrics.quality(rule_score(tx).withColumn("p", F.col("is_fraud").cast("int")), "isFraud", "p")]:
        assert shuffles(df) + plan(df).count("Exchange SinglePartition") == 1, plan(df)


def test_sliding_counters_and_profile_share_a_shuffle(spark):
    df = profile.realtime_features(stored(spark), mode="sliding")
    assert shuffles(df) == 1


def test_no_operator_multiplies_rows(spark):
    tx = stored(spark)
    written = state.entries(tx, "risk", F.col("nameOrig"), F.col("amount"), F.col("ts"))
    for df in [state.as_of_lookup(tx, "nameOrig", "ts", "event_id", written, "known"), scoring.detect(tx)]:
        text = plan(df)
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
