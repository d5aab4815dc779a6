"""Session settings and the shared folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("txrisk")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        # Collecting a stack trace per column expression doubles the time to build a plan.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def tuned(spark: SparkSession) -> SparkSession:
    """Settings the operators rely on for speed or state; all can be set on a
    running session.

    * The Java compiler leaves methods above 8000 bytes of code interpreted, which
      is about five times slower; beyond that Spark shall generate smaller ones.
    * Streaming sessions are merged before the shuffle, so that a busy account is
      a few rows there.
    * Keyed streaming state lives in RocksDB, which writes its changes per batch.
    """
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    spark.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's ``spark.checkpoint.dir``.

    Only where no such folder is named and driver and executors are one process
    (tests on one machine) a temporary one is made and set for the session; on a
    cluster the executors would each write to a disk of their own.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="txrisk-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return os.path.join(shared_folder(spark), "txrisk", f"{name}-{uuid.uuid4().hex}")


def reliable(df: DataFrame) -> DataFrame:
    """The rows as a table written below the shared folder.

    Lost executors cost a read instead of the whole lineage, the rows are the
    same for every later pass, and a pass reads only the columns it needs.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored._stored_at = path
    return stored


def discard(*stored: DataFrame) -> None:
    """Delete tables that :func:`reliable` wrote; nothing that reads them may follow."""
    for df in stored:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
