"""Kafka as source and sink. Thin wrappers: they need the Kafka connector on the
class path and a broker, so they are not covered by the tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from txrisk.constants import BATCH_EVENTS, INPUT_TOPIC, OUTPUT_TOPIC
from txrisk.sources.messages import encode


def kafka_messages(spark: SparkSession, servers: str, topic: str = INPUT_TOPIC, starting: str = "latest",
                   events_per_trigger: int = BATCH_EVENTS) -> DataFrame:
    return (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", starting)
        .option("maxOffsetsPerTrigger", events_per_trigger)
        .load()
    )


def kafka_sink(out: DataFrame, servers: str, checkpoint: str, topic: str = OUTPUT_TOPIC) -> DataStreamWriter:
    return (
        out.writeStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )


def kafka_publish(df: DataFrame, servers: str, topic: str = INPUT_TOPIC) -> None:
    """Send a table of transactions, one message per row."""
    encode(df).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()
