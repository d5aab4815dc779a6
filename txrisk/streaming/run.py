"""Starting streaming queries."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from txrisk.constants import BATCH_SECONDS


def start(out: DataFrame, path: str, checkpoint: str, mode: str = "append", seconds: int = BATCH_SECONDS,
          name: str | None = None) -> StreamingQuery:
    """Run continuously into a parquet table. Every query needs its own checkpoint."""
    writer = out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    writer = writer.outputMode(mode).trigger(processingTime=f"{seconds} seconds")
    return (writer.queryName(name) if name else writer).start()


def run_available(out: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Process what is there, stop, and return the written table."""
    query = (
        out.writeStream.format("parquet").option("path", os.path.join(path, "rows"))
        .option("checkpointLocation", os.path.join(path, "checkpoint"))
        .outputMode(mode).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return out.sparkSession.read.schema(out.schema).parquet(os.path.join(path, "rows"))


def run_to_the_end(out: DataFrame, path: str, keys: list[str], mode: str = "update") -> DataFrame:
    """Process what is there, stop, and return the last state of every key, so
    that windows still open at the end of a finite input come out as well.

    Each micro-batch is stored under its number, so a batch that runs again
    replaces what it wrote. ``complete`` is for aggregates that can't be updated
    (sessions); there the last batch holds everything.
    """
    rows = os.path.join(path, "rows")

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(rows, f"batch={number}"))

    query = (
        out.writeStream.foreachBatch(store).option("checkpointLocation", os.path.join(path, "checkpoint"))
        .outputMode(mode).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    schema = T.StructType([*out.schema.fields, T.StructField("batch", T.IntegerType())])
    stored = out.sparkSession.read.schema(schema).parquet(rows)
    if mode == "complete":
        last = stored.agg(F.max("batch")).first()[0]
        return stored.filter(F.col("batch") == F.lit(last)).drop("batch")
    values = [c for c in out.columns if c not in keys]
    newest = stored.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_v"))
    return newest.select(*[F.col(c) if c in keys else F.col(f"_v.{c}") for c in out.columns])


DURATIONS = "batch_id bigint, rows bigint, seconds double"


class Durations(StreamingQueryListener):
    """Keeps rows and seconds of every micro-batch of the queries that run while it is registered, and appends them to a table
    ``keep`` at a time; the rest follows when a query ends."""

    def __init__(self, spark: SparkSession, path: str, keep: int = 1000):
        self.spark, self.path, self.keep, self.held = spark, path, keep, []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.held.append((int(p.batchId), int(p.numInputRows), p.durationMs.get("triggerExecution", 0) / 1000.0))
        if len(self.held) >= self.keep:
            self.store()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.store()

    def store(self) -> None:
        rows, self.held = self.held, []
        if rows:
            self.spark.createDataFrame(rows, DURATIONS).coalesce(1).write.mode("append").parquet(self.path)

    def table(self) -> DataFrame:
        """All micro-batches so far."""
        self.store()
        return self.spark.read.schema(DURATIONS).parquet(self.path)


def batch_durations(spark: SparkSession, query: StreamingQuery) -> DataFrame:
    """Seconds and rows of the recent micro-batches, for ``aggregates.histogram``; :class:`Durations` keeps all of them."""
    rows = [
        (int(p["batchId"]), int(p["numInputRows"]), p["durationMs"].get("triggerExecution", 0) / 1000.0)
        for p in query.recentProgress
    ]
    return spark.createDataFrame(rows, DURATIONS)
