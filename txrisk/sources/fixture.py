"""The transaction table derived from the ``events`` table of the test data.

Money is whole cents until the last step, so every engine gets the same doubles.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from txrisk.functions.columns import flag
from txrisk.session import scratch_path

EVENT_TYPES = {"view": "CASH_IN", "click": "CASH_OUT", "error": "DEBIT", "purchase": "PAYMENT"}


def from_events(events: DataFrame) -> DataFrame:
    """Transactions from an ``events`` frame; works on batch and streaming frames."""
    kind = F
    for event_type, name in EVENT_TYPES.items():
        kind = kind.when(F.col("event_type") == event_type, name)
    eid = F.col("event_id")
    v = F.round(F.col("value") * 100).cast("bigint")
    base = events.select("event_id", "ts", "user_id", kind.otherwise("TRANSFER").alias("type"), v.alias("v"))
    amounts = base.withColumn(
        "amt",
        F.when(eid % 41 == 0, F.lit(1000000).cast("bigint"))
        .when(eid % 43 == 0, F.lit(999900).cast("bigint"))
        .when(eid % 47 == 0, F.lit(2500000).cast("bigint"))
        .otherwise(F.col("v") * F.col("v") - F.floor(F.col("v") * F.col("v") / F.lit(2.0)).cast("bigint")),
    )
    amt, old_o, old_d = F.col("amt"), F.col("old_o"), F.col("old_d")
    balances = amounts.withColumns({
        "old_o": F.when(eid % 4 == 0, amt).when(eid % 4 == 1, amt * 2)
        .when(eid % 4 == 2, F.lit(0).cast("bigint")).otherwise(F.floor(amt / F.lit(2.0)).cast("bigint")),
        "old_d": (eid % 17) * 100000,
        "dest": F.when((F.col("type") == "PAYMENT") | (eid % 10 == 0), F.concat(F.lit("M"), (eid % 97).cast("string")))
        .otherwise(F.concat(F.lit("C"), (eid % 149).cast("string"))),
    })

    def dollars(c):
        return c.cast("double") / F.lit(100.0)

    risky = F.col("type").isin("TRANSFER", "CASH_OUT")
    return balances.select(
        "event_id",
        "ts",
        ((F.dayofmonth("ts") - 1) * 24 + F.hour("ts") + 1).cast("int").alias("step"),
        "type",
        dollars(amt).alias("amount"),
        F.concat(F.lit("C"), F.col("user_id").cast("string")).alias("nameOrig"),
        dollars(old_o).alias("oldbalanceOrg"),
        dollars(F.when(old_o > amt, old_o - amt).otherwise(F.lit(0))).alias("newbalanceOrig"),
        F.col("dest").alias("nameDest"),
        dollars(old_d).alias("oldbalanceDest"),
        dollars(F.when(eid % 3 == 0, old_d).otherwise(old_d + amt)).alias("newbalanceDest"),
        flag(risky & (eid % 4 == 0) & (eid % 5 != 0)).alias("isFraud"),
        flag((F.col("type") == "TRANSFER") & (amt > 20000000)).alias("isFlaggedFraud"),
    )


# Transaction tables already written: (application, folder of test data) -> path, schema.
_WRITTEN: dict[tuple[str, str], tuple[str, T.StructType]] = {}


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All transactions of a test-data folder, as a stored table.

    The table is derived from ``events`` once per application and written to the
    shared folder, so queries scan plain columns, as they would in production.
    """
    where = (spark.sparkContext.applicationId, sf_dir)
    if where in _WRITTEN:
        try:
            path, schema = _WRITTEN[where]
            return spark.read.schema(schema).parquet(path)
        except AnalysisException:
            pass  # the folder was cleared; write the table again
    derived = from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))
    cores = spark.sparkContext.defaultParallelism
    if derived.rdd.getNumPartitions() < cores:
        derived = derived.repartition(cores)  # a few small files: use all cores
    path = scratch_path(spark, "transactions")
    derived.write.parquet(path)
    _WRITTEN[where] = path, derived.schema
    return spark.read.schema(derived.schema).parquet(path)


def untidy(tx: DataFrame) -> DataFrame:
    """The whole table plus faults of every kind that cleaning has to remove:
    repeated rows, missing values, NaN, negative money and unknown types.
    How many there are grows with the table."""
    eid = F.col("event_id")
    spoiled = tx.withColumns({
        "amount": F.when(eid % 29 == 3, -F.col("amount"))
        .when(eid % 31 == 5, F.lit(None).cast("double"))
        .when(eid % 37 == 7, F.lit("NaN").cast("double"))
        .when(eid % 53 == 9, F.lit(0.0))
        .otherwise(F.col("amount")),
        "oldbalanceDest": F.when(eid % 59 == 11, F.lit(-1.0)).otherwise(F.col("oldbalanceDest")),
        "type": F.when(eid % 61 == 13, F.lower("type")).when(eid % 67 == 17, F.lit("WIRE")).otherwise(F.col("type")),
        "nameDest": F.when(eid % 71 == 19, F.lit(None).cast("string")).otherwise(F.col("nameDest")),
    })
    return spoiled.unionByName(spoiled.filter(eid % 7 == 2))


def transaction_stream(spark: SparkSession, sf_dir: str, bytes_per_trigger: int = 64 << 30) -> DataFrame:
    """The same transactions as a file stream, at a bounded pace. The bracket makes
    the path a pattern, which a file source accepts for one file and for a folder."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("maxBytesPerTrigger", bytes_per_trigger)
    return from_events(stream.parquet(f"{sf_dir}/[e]vents.parquet"))
