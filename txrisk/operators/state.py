"""Keyed state with a time to live, as an append-only table
(kind, key, payload, write_ts, ttl_s)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from txrisk.constants import ERASABLE_KINDS, TTL_SECONDS
from txrisk.functions.columns import micros
from txrisk.operators.scans import HEAVY_ROWS, KeyedRows, Running

STATE_COLUMNS = ["kind", "key", "payload", "write_ts", "ttl_s"]
# Rows up to which a list given by the caller may be broadcast.
SMALL_ROWS = 100_000


def entries(df: DataFrame, kind: str, key: Column, payload: Column, time: Column, ttl: int | None = None) -> DataFrame:
    """State entries from rows; payload is written as JSON text unless it is text."""
    return df.select(
        F.lit(kind).alias("kind"), key.alias("key"), payload.alias("payload"), time.alias("write_ts"),
        F.lit(TTL_SECONDS[kind] if ttl is None else ttl).alias("ttl_s"),
    )


def latest_alive(state: DataFrame, as_of, tie: str | None = None) -> DataFrame:
    """Newest entry per (kind, key) written up to ``as_of``, if it is still alive.
    Of writes at one time the one with the larger ``tie`` is newer (``seq``, if
    there is such a column); without one the order is fixed by the content, as in
    :func:`as_of_lookup`.

    The newest write decides even when an older one would live longer. Only one
    short row per key and task is shuffled, so a key with many writes is cheap.
    """
    written = micros(state, "write_ts")
    when = as_of if isinstance(as_of, Column) else F.lit(as_of)
    tie = tie or ("seq" if "seq" in state.columns else None)
    order = F.struct("write_ts", F.col(tie) if tie else F.xxhash64("payload", "ttl_s"))
    newest = (
        state.withColumn("_us", written)
        .filter(F.col("_us") <= when)
        .groupBy("kind", "key")
        .agg(F.max_by(F.struct("payload", "write_ts", "ttl_s", "_us"), order).alias("e"))
        .select("kind", "key", "e.*")
    )
    return newest.filter(when < F.col("_us") + F.col("ttl_s").cast("bigint") * 1000000).drop("_us")


def as_of_lookup(rows: DataFrame, key: str, time: str, row_id: str, state: DataFrame, value: str,
                 heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """Add to each row the payload of its key's latest entry written at or before
    the time of the row, NULL when there is none or it has expired.

    Rows and entries are stacked and scanned once in time order, so each row
    meets one entry instead of all entries of its key; heavy keys are cut in
    chunks by :class:`KeyedRows`. ``state`` needs key, payload, write_ts, ttl_s.
    """
    asked = rows.select("*", F.col(key).alias("_key"), micros(rows, time).alias("_us"), F.lit(1).alias("_kind"),
                        _number(rows, row_id).alias("_tie"))
    us = micros(state, "write_ts")
    entry = F.struct(F.col("payload"), (us + F.col("ttl_s").cast("bigint") * 1000000).alias("until"))
    # Of writes at one time the one with the larger ``seq`` is newer; without such
    # a column any fixed order will do.
    tie = _number(state, "seq") if "seq" in state.columns else F.xxhash64("payload", "ttl_s")
    # An entry written at the time of a row is seen by it: entries sort first.
    written = state.filter(us.isNotNull()).select(F.col("key").alias("_key"), us.alias("_us"), F.lit(0).alias("_kind"), tie.alias("_tie"),
                           entry.alias("_entry"))
    stacked = asked.unionByName(written, allowMissingColumns=True)
    scanned = KeyedRows.of(stacked, ["_key"], ["_us", "_kind", "_tie"], heavy_rows).running(
        Running("_last", "last", "_entry"))
    answered = scanned.rows().filter(F.col("_kind") == 1)
    alive = F.when(F.col("_us") < F.col("_last.until"), F.col("_last.payload"))
    return answered.select(*rows.columns, alive.alias(value))


def _number(df: DataFrame, name: str) -> Column:
    """An identifier as a number: itself, or a hash of other types."""
    integral = isinstance(df.schema[name].dataType, T.IntegralType)
    return F.col(name).cast("bigint") if integral else F.xxhash64(name)


def bounded(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """Marked for broadcast only if it is counted to hold at most ``rows`` rows;
    beyond that the join shuffles, and AQE splits its skewed partitions."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def erase(state: DataFrame, customers: DataFrame, key: str = "key") -> DataFrame:
    """State without the entries of the given customers (one column, ``customer``).
    Counter keys carry the window after a colon."""
    owner = F.when(F.col("kind") == "count", F.substring_index(key, ":", 1)).otherwise(F.col(key))
    erasable = F.col("kind").isin(ERASABLE_KINDS)
    gone = bounded(customers.select(F.col("customer").alias("_owner")).distinct())
    # Entries that stay in any case are not joined: they would all meet as one key.
    kept = state.filter(erasable).withColumn("_owner", owner).join(gone, "_owner", "left_anti").drop("_owner")
    return state.filter(~erasable).unionByName(kept)


def clear(state: DataFrame) -> DataFrame:
    """An empty table of the same schema. It does not read the state, so it can overwrite it."""
    return state.sparkSession.createDataFrame([], state.schema)
