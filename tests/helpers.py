"""Small frames for the tests."""

from txrisk.constants import TX_SCHEMA

COLUMNS = "event_id bigint, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in TX_SCHEMA.fields)


def row(event_id=1, kind="PAYMENT", amount=100.0, old=0.0, new=0.0, dest="C2", orig="C1", step=1, old_dest=0.0,
        new_dest=0.0, fraud=0, flagged=0):
    return (event_id, step, kind, amount, orig, old, new, dest, old_dest, new_dest, fraud, flagged)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), COLUMNS)


def timed(spark, events):
    """(event_id, customer, seconds, amount) -> rows with a timestamp without zone."""
    return spark.createDataFrame(
        [(i, c, float(s), float(a)) for i, c, s, a in events], "event_id bigint, nameOrig string, s double, amount double"
    ).selectExpr("event_id", "nameOrig", "cast(timestamp_micros(cast(s * 1000000 as bigint)) as timestamp_ntz) AS ts",
                 "amount")


def shuffles(df):
    return plan(df).count("Exchange hashpartitioning") + plan(df).count("Exchange rangepartitioning")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()
