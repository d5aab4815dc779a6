"""Running aggregates in order within a key, safe for heavy keys.

A window partition holds all rows of its key in one task. That is fine for
ordinary keys and wrong for an account that owns a large share of the table. So
keys are counted first (one partial aggregate):

* ordinary keys use a plain window, one shuffle;
* rows of heavy keys are range-partitioned by (key, order), which cuts a key in
  chunks of similar size wherever its rows lie, even if they share one time. The
  chunks are made durable, each is scanned by its own task, and what a chunk has
  to know about the earlier ones (one short row per chunk and key) is added.

Both ways give the same rows and values. The order has to be unique in a key.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window, functions as F

from txrisk.session import reliable

# Rows of one key that one task may hold.
HEAVY_ROWS = 1_000_000
# Most keys that are treated as heavy; any other key then holds at most
# 1/MOST_HEAVY of the table. Also the bound of what is broadcast.
MOST_HEAVY = 100_000


@dataclass(frozen=True)
class Heavy:
    """Keys with many rows (a small local frame, None if there are none) and how
    many rows they have together. Found once and shared by several operators."""

    key: list[str]
    keys: DataFrame | None
    rows: int
    limit: int

    def part(self, df: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """Rows of ordinary keys, and rows of heavy keys."""
        if self.keys is None:
            return df, None
        names = [f"_h{i}" for i in range(len(self.key))]
        small = F.broadcast(self.keys.toDF(*names))  # at most MOST_HEAVY rows
        same = F.lit(True)
        for name, other in zip(self.key, names):
            same = same & F.col(name).eqNullSafe(F.col(other))
        return df.join(small, same, "left_anti"), df.join(small, same, "left_semi")


def heavy_keys(df: DataFrame, key: list[str], heavy_rows: int = HEAVY_ROWS) -> Heavy:
    """Count the rows of each key, in one partial aggregate over the key alone."""
    counts = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > heavy_rows)
    found = counts.orderBy(F.desc("_n")).limit(MOST_HEAVY)
    rows = found.collect()
    if not rows:
        return Heavy(key, None, 0, heavy_rows)
    local = df.sparkSession.createDataFrame(rows, found.schema).drop("_n")
    return Heavy(key, local, sum(row["_n"] for row in rows), heavy_rows)


@dataclass(frozen=True)
class Running:
    """One running aggregate: ``kind`` is sum, count (of rows, or of those where
    the column is not null), max or last (non-null)."""

    name: str
    kind: str
    column: str | None = None
    before: bool = False  # leave the current row out

    def over(self, window) -> Column:
        end = -1 if self.before else 0
        frame = window.rowsBetween(Window.unboundedPreceding, end)
        if self.kind == "count":
            return F.count(F.lit(1) if self.column is None else self.column).over(frame)
        if self.kind == "last":
            return F.last(self.column, ignorenulls=True).over(frame)
        return {"sum": F.sum, "max": F.max}[self.kind](self.column).over(frame)

    def merge(self, earlier: Column, local: Column) -> Column:
        if self.kind in ("sum", "count"):
            return F.when(earlier.isNull() & local.isNull(), F.lit(None)).otherwise(
                F.coalesce(earlier, F.lit(0)) + F.coalesce(local, F.lit(0)))
        if self.kind == "max":
            return F.greatest(earlier, local)
        return F.coalesce(local, earlier)


@dataclass(frozen=True)
class KeyedRows:
    """Rows of a table, ready for running aggregates within a key."""

    key: list[str]
    order: list[str]
    ordinary: DataFrame
    heavy: DataFrame | None = field(default=None)

    @classmethod
    def of(cls, df: DataFrame, key: list[str], order: list[str], heavy_rows: int = HEAVY_ROWS,
           known: Heavy | None = None) -> KeyedRows:
        """``known`` saves counting the rows of each key again."""
        known = known or heavy_keys(df, key, heavy_rows)
        ordinary, heavy = known.part(df)
        if heavy is not None:
            chunks = max(2, math.ceil(known.rows / known.limit))
            cut = heavy.repartitionByRange(chunks, *key, *order)
            heavy = reliable(cut.withColumn("_chunk", F.spark_partition_id()))
        return cls(key, order, ordinary, heavy)

    def with_columns(self, columns: dict[str, Column]) -> KeyedRows:
        heavy = None if self.heavy is None else self.heavy.withColumns(columns)
        return replace(self, ordinary=self.ordinary.withColumns(columns), heavy=heavy)

    def running(self, *aggregates: Running, reset: str | None = None) -> KeyedRows:
        """Add running aggregates, starting anew at rows where ``reset`` is true."""
        ordinary = self._scan(self.ordinary, self.key, aggregates, reset).drop("_segment")
        heavy = None if self.heavy is None else self._scan_chunks(aggregates, reset)
        return replace(self, ordinary=ordinary, heavy=heavy)

    def rows(self) -> DataFrame:
        if self.heavy is None:
            return self.ordinary
        return self.ordinary.unionByName(self.heavy.drop("_chunk"))

    def _scan(self, df: DataFrame, group: list[str], aggregates, reset: str | None) -> DataFrame:
        if reset is None:
            df = df.withColumn("_segment", F.lit(0).cast("bigint"))
            window = Window.partitionBy(*group).orderBy(*self.order)
        else:
            starts = F.count_if(F.col(reset))
            whole = Window.partitionBy(*group).orderBy(*self.order)
            df = df.withColumn("_segment", starts.over(whole.rowsBetween(Window.unboundedPreceding, 0)))
            window = Window.partitionBy(*group, "_segment").orderBy(*self.order)
        return df.withColumns({a.name: a.over(window) for a in aggregates})

    def _scan_chunks(self, aggregates, reset: str | None) -> DataFrame:
        group = [*self.key, "_chunk"]
        # The values up to and including each row give what a chunk hands on.
        inclusive = [replace(a, name=f"_upto_{a.name}", before=False) for a in aggregates]
        local = self._scan(self.heavy, group, [*aggregates, *inclusive], reset)
        handed = local.groupBy(*group).agg(
            F.max("_segment").alias("_resets"),
            F.max_by(F.struct(*[a.name for a in inclusive]), F.struct(*self.order)).alias("_tail"),
        )
        # One row per chunk and heavy key; a chunk with a reset forgets the earlier ones.
        by_chunk = Window.partitionBy(*self.key).orderBy("_chunk")
        handed = handed.withColumn(
            "_run", F.sum(F.when(F.col("_resets") > 0, 1).otherwise(0)).over(
                by_chunk.rowsBetween(Window.unboundedPreceding, 0)))
        in_run = Window.partitionBy(*self.key, "_run").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, 0)
        states = {}
        for a in aggregates:
            tail = F.col(f"_tail._upto_{a.name}")
            total = {"sum": F.sum, "count": F.sum, "max": F.max}.get(a.kind)
            states[f"_out_{a.name}"] = (F.last(tail, ignorenulls=True) if total is None else total(tail)).over(in_run)
        handed = handed.withColumns(states)
        carried = handed.select(
            *group, *[F.lag(f"_out_{a.name}").over(by_chunk).alias(f"_in_{a.name}") for a in aggregates])
        names = {name: f"_c{i}" for i, name in enumerate(group)}
        carried = carried.withColumnsRenamed(names)
        same = F.lit(True)
        for name, other in names.items():
            same = same & F.col(name).eqNullSafe(F.col(other))
        merged = local.join(carried, same, "left")
        open_segment = F.col("_segment") == 0
        merged = merged.withColumns({
            a.name: F.when(open_segment, a.merge(F.col(f"_in_{a.name}"), F.col(a.name))).otherwise(F.col(a.name))
            for a in aggregates
        })
        return merged.select(*self.heavy.columns, *[a.name for a in aggregates])
