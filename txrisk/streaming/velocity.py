"""Counters and profile of each customer, kept while a stream runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from txrisk.constants import COUNTER_SECONDS, PROFILE_TTL_SECONDS
from txrisk.functions.columns import cents, micros
from txrisk.operators.counters import count_in_open_window
from txrisk.streaming.flows import LATENESS, timed

WINDOWS = list(COUNTER_SECONDS)
# Stands for the largest amount of a customer without any.
NOTHING = np.iinfo(np.int64).min
STATE = ", ".join(
    [f"start_{n} bigint, count_{n} bigint" for n in WINDOWS]
    + ["total bigint", "n bigint", "largest bigint", "last_us bigint"]
)
OUTPUT = (
    "event_id bigint, nameOrig string, " + ", ".join(f"tx_count_{n} bigint" for n in WINDOWS)
    + ", tx_count bigint, total_cents bigint, max_cents bigint, last_us bigint"
)


def end_of_life(last_us: int) -> int:
    """When the state of a customer ends, in milliseconds."""
    return int(last_us) // 1000 + PROFILE_TTL_SECONDS * 1000


class CustomerState(StatefulProcessor):
    """Per customer: the open window of each counter and the running profile.

    Rows of a micro-batch are put in time order first; the pace of the source
    bounds how many there are. State of a customer has a fixed size and is
    dropped once the watermark is past its life.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._state = handle.getValueState("customer", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames = list(rows)
        us, ids, amount = (np.concatenate([f[c].to_numpy() for f in frames]) for c in ("us", "event_id", "cents"))
        order = np.lexsort((ids, us))
        us, ids, amount = us[order], ids[order], amount[order]
        # A missing amount adds nothing and is no largest one; the row still counts.
        given = ~pd.isna(amount)
        amount = np.where(given, amount, 0).astype(np.int64)
        ranked = np.where(given, amount, NOTHING)
        second, n = us // 1_000_000, len(us)
        old = self._state.get()
        known = old is not None
        new_key = np.zeros(n, dtype=bool)
        new_key[0] = not known
        out = {"event_id": ids, "nameOrig": key[0]}
        state = []
        for i, name in enumerate(WINDOWS):
            carried = (old[2 * i], old[2 * i + 1]) if known else None
            before, left = count_in_open_window(
                new_key, second, np.ones(n, np.int64), COUNTER_SECONDS[name], carried)
            out[f"tx_count_{name}"] = before + 1
            state += [int(left[0]), int(left[1])]
        total, count, largest, last = old[2 * len(WINDOWS):] if known else (0, 0, NOTHING, None)
        gaps = np.diff(us, prepend=us[0] if last is None else last)
        starts = np.flatnonzero(gaps >= PROFILE_TTL_SECONDS * 1_000_000).tolist()
        totals, counts, maxima = np.empty(n, np.int64), np.empty(n, np.int64), np.empty(n, np.int64)
        edges = sorted({0, *starts, n})
        for low, high in zip(edges, edges[1:]):
            if low in starts:
                total, count, largest = 0, 0, NOTHING
            part = slice(low, high)
            totals[part] = total + np.cumsum(amount[part])
            counts[part] = count + np.arange(1, high - low + 1)
            maxima[part] = np.maximum(largest, np.maximum.accumulate(ranked[part]))
            total, count, largest = totals[high - 1], counts[high - 1], maxima[high - 1]
        some = maxima != NOTHING
        out |= {"tx_count": counts, "total_cents": pd.array(totals, dtype="Int64"), "last_us": us,
                "max_cents": pd.array(np.where(some, maxima, 0), dtype="Int64")}
        out["total_cents"][~some] = pd.NA
        out["max_cents"][~some] = pd.NA
        last_us = int(us[-1]) if last is None else max(int(us[-1]), int(last))
        self._state.update((*state, int(total), int(count), int(largest), last_us))
        if not known:  # one timer per customer; it is moved on when it fires too early
            self._handle.registerTimer(end_of_life(last_us))
        yield pd.DataFrame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        old = self._state.get()
        if old is not None:
            if end_of_life(old[-1]) <= expiredTimerInfo.getExpiryTimeInMs():
                self._state.clear()
            else:
                self._handle.registerTimer(end_of_life(old[-1]))
        return iter(())

    def close(self) -> None:
        pass


def velocity_stream(transactions: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Counters and profile after each transaction of a stream.
    Needs the RocksDB state store, which ``session.tuned`` sets."""
    rows = timed(transactions, "ts", lateness)
    narrow = rows.select("event_id", "nameOrig", "ts", micros(rows, "ts").alias("us"),
                         cents(F.col("amount")).cast("bigint").alias("cents"))
    return narrow.groupBy("nameOrig").transformWithStateInPandas(
        statefulProcessor=CustomerState(), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime")
