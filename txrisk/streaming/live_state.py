"""Keyed state on a running stream: written, erased and asked in the order of event time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from txrisk.functions.columns import micros
from txrisk.streaming.flows import LATENESS, timed

# Of events of one time, writes come first, then erasures, then questions: as in the batch lookup a question sees an entry of
# its own time, and an erasure takes what was written at its time.
WRITE, ERASE, ASK = 0, 1, 2
EVENT = "key string, ts timestamp, what int, id bigint, payload string, until_us bigint"
COLUMNS = ["us", "what", "id", "payload", "until_us"]
# Events that arrived together are one entry: each entry and each call costs a message to the state store.
WAITING = "us array<bigint>, what array<int>, id array<bigint>, payload array<string>, until_us array<bigint>"
ANSWER = "id bigint, key string, payload string"


def writes(df: DataFrame, key: Column, payload: Column, time: str, ttl_s: Column | int, tie: Column) -> DataFrame:
    """Entries of a stream of updates. Of two at one time the one with the larger ``tie`` is newer."""
    seconds = ttl_s if isinstance(ttl_s, Column) else F.lit(ttl_s)
    until = micros(df, time) + seconds.cast("bigint") * 1_000_000
    return df.select(key.alias("key"), F.col(time).alias("ts"), F.lit(WRITE).alias("what"), tie.cast("bigint").alias("id"),
                     payload.cast("string").alias("payload"), until.alias("until_us"))


def erasures(df: DataFrame, key: Column, time: str) -> DataFrame:
    """Commands that erase what is known of a key."""
    return df.select(key.alias("key"), F.col(time).alias("ts"), F.lit(ERASE).alias("what"), F.lit(0).cast("bigint").alias("id"),
                     F.lit(None).cast("string").alias("payload"), F.lit(0).cast("bigint").alias("until_us"))


def questions(df: DataFrame, key: Column, time: str, row_id: Column) -> DataFrame:
    """Rows that ask for the entry of their key that is alive at their time."""
    return df.select(key.alias("key"), F.col(time).alias("ts"), F.lit(ASK).alias("what"), row_id.cast("bigint").alias("id"),
                     F.lit(None).cast("string").alias("payload"), F.lit(0).cast("bigint").alias("until_us"))


class LiveState(StatefulProcessor):
    """Per key: the newest entry, and the events that the watermark has not passed yet.

    Events take effect when the watermark has passed them, in the order of their time, so answers do not depend on the order
    of arrival. An entry is dropped once the watermark has passed its life; a key without entry and events has no state.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._entry = handle.getValueState("entry", "payload string, until_us bigint")
        self._waiting = handle.getListState("waiting", WAITING)
        self._due = handle.getValueState("due", "ms bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """Keep what arrives until the watermark has passed it; the timer then applies it."""
        watermark, first = timerValues.getCurrentWatermarkInMs(), None
        for frame in rows:
            # Spark lets rows through that are late by one batch only; here they would change what is answered.
            ms = frame["us"].to_numpy() // 1000
            in_time = ms >= watermark
            if not in_time.all():
                frame, ms = frame[in_time], ms[in_time]
            if len(frame):
                self._waiting.appendValue(tuple(frame[c].tolist() for c in COLUMNS))
                first = int(ms.min()) if first is None else min(first, int(ms.min()))
        if first is not None:
            due = self._due.get()
            if due is None or first < due[0]:
                if due is not None:
                    self._handle.deleteTimer(due[0])
                self._wait(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        return self._pass(key[0], timerValues.getCurrentWatermarkInMs())

    def _pass(self, key: str, watermark: int) -> Iterator[pd.DataFrame]:
        """Apply and answer what the watermark has passed; wait for the rest."""
        events = [event for arrived in self._waiting.get() for event in zip(*arrived)]
        passed = sorted((e for e in events if e[0] // 1000 < watermark), key=lambda e: e[:3])
        held = entry = self._entry.get()
        if passed:
            left = [e for e in events if e[0] // 1000 >= watermark]
            self._waiting.put([tuple(map(list, zip(*left)))]) if left else self._waiting.clear()
            events = left
        numbers, answers = [], []
        for us, what, number, payload, until in passed:
            if what == ASK:
                numbers.append(number)
                answers.append(entry[0] if entry is not None and us < entry[1] else None)
            else:
                entry = (payload, until) if what == WRITE else None
        if entry is not None and entry[1] // 1000 < watermark:
            entry = None
        if entry is None and held is not None:
            self._entry.clear()
        elif entry is not held:
            self._entry.update(entry)
        self._wait(min([e[0] // 1000 for e in events] + ([entry[1] // 1000] if entry is not None else []), default=None))
        if answers:
            yield pd.DataFrame({"id": np.array(numbers, np.int64), "key": key, "payload": pd.Series(answers, dtype=object)})

    def _wait(self, first: int | None) -> None:
        """One timer, at the earliest time something is due."""
        if first is None:
            self._due.clear()
        else:
            self._handle.registerTimer(first)
            self._due.update((first,))

    def close(self) -> None:
        pass


def live_answers(events: list[DataFrame], lateness: str = LATENESS) -> DataFrame:
    """(id, key, payload) of every question, once the watermark has passed it; payload is NULL where nothing is alive.

    ``events`` are streams made by :func:`writes`, :func:`erasures` and :func:`questions`. The watermark follows the latest time of
    all of them; events behind it are late and have no effect and no answer. Events without a key or a time are left out. A task
    holds the events of one key within the lateness. Needs the RocksDB state store, which ``session.tuned`` sets.
    """
    merged = events[0]
    for more in events[1:]:
        merged = merged.unionByName(more)
    rows = timed(merged.filter(F.col("key").isNotNull() & F.col("ts").isNotNull()), "ts", lateness)
    rows = rows.select("key", "ts", micros(rows, "ts").alias("us"), "what", "id", "payload", "until_us")
    return rows.groupBy("key").transformWithStateInPandas(
        statefulProcessor=LiveState(), outputStructType=ANSWER, outputMode="Append", timeMode="EventTime")


def entries_held(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(key, payload, until_us): the entries that a stream held when it stopped, read from its checkpoint."""
    stored = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "entry").load()
    return stored.select(F.col("key.key").alias("key"), F.col("value.payload").alias("payload"), F.col("value.until_us").alias("until_us"))
