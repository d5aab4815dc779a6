"""Transaction counters per customer.

``anchored``: a window opens at the first event of a customer and closes a fixed
number of seconds later; the next event opens a new one. The clock of a counter
counts whole seconds, as its time to live does.

``sliding``: events of the last so many seconds, the current one included.

A row without a time is in no window: its counts are NULL and it counts nowhere.

Rows of heavy keys are first added up per key and second, and a key's time is cut
into slices as long as the longest window. A task then holds one slice of one key,
or two that follow each other, so what it holds is bounded by the length of a slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from txrisk.constants import COUNTER_SECONDS, OTHER_COUNTER_SECONDS
from txrisk.functions.columns import seconds
from txrisk.operators.scans import HEAVY_ROWS, Heavy, KeyedRows, Running, heavy_keys
from txrisk.session import discard, reliable


# Stands for a missing key where keys have to be compared.
NO_KEY = "\0"
NO_TIME = "\1"


def window_seconds(name: str) -> int:
    return COUNTER_SECONDS.get(name, OTHER_COUNTER_SECONDS)


def count_in_open_window(new_key: np.ndarray, second: np.ndarray, weight: np.ndarray, ttl: int,
                         carried: tuple[int, int] | None) -> tuple[np.ndarray, tuple[int, int]]:
    """Events of the open window before each entry, for entries sorted by key and second.

    ``new_key`` marks entries whose key differs from the previous one.
    ``carried`` is the window left open before the first entry: its first second
    and its count. Keys are laid out on one time axis, far enough apart that a
    window never reaches the next key, so one search serves all of them.
    """
    low = int(second.min())
    apart = int(second.max()) - low + ttl + 1
    place = np.cumsum(new_key) * apart + (second - low)
    following = np.searchsorted(place, place + ttl, side="left").tolist()
    n = len(place)
    at = 0
    if carried is not None and not new_key[0]:
        base = int(place[0]) - (int(second[0]) - low)
        at = int(np.searchsorted(place, base + carried[0] - low + ttl, side="left"))
    opened = []
    while at < n:
        opened.append(at)
        at = following[at]
    starts = np.asarray(opened, dtype=np.int64)
    upto = np.concatenate(([0], np.cumsum(weight)))
    window = np.searchsorted(starts, np.arange(n), side="right") - 1
    before = upto[:-1].copy()
    inside = window >= 0
    before[inside] -= upto[starts[window[inside]]]
    if carried is not None:
        before[~inside] += carried[1]
    if window[-1] >= 0:
        left = (int(second[starts[window[-1]]]), int(before[-1] + weight[-1]))
    else:
        left = (carried[0], int(before[-1] + weight[-1]))
    return before, left


def _walker(windows: dict[str, int]):
    """Walk through Arrow batches sorted by key and second; memory is one batch.
    Other columns pass through untouched."""
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, left = None, {name: None for name in windows}
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            keys = batch.column("_key")
            second = batch.column("_sec").to_numpy(zero_copy_only=False)
            new_key = np.empty(n, dtype=bool)
            new_key[1:] = pc.not_equal(keys.slice(1), keys.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            new_key[0] = keys[0].as_py() != last_key
            last_key = keys[n - 1].as_py()
            for name, ttl in windows.items():
                carried = None if new_key[0] else left[name]
                before, left[name] = count_in_open_window(new_key, second, np.ones(n, np.int64), ttl, carried)
                batch = batch.append_column(f"_before_{name}", pa.array(before, pa.int64()))
            yield batch

    return walk


def _walked(df: DataFrame, order: list[str], windows: dict[str, int]) -> DataFrame:
    schema = T.StructType(df.schema.fields + [T.StructField(f"_before_{n}", T.LongType()) for n in windows])
    return df.repartition("_key").sortWithinPartitions("_key", *order).mapInArrow(_walker(windows), schema)


# ------------------------------------------------------------ windows of heavy keys, slice by slice


def sliced(cells: DataFrame, length: int) -> DataFrame:
    return cells.withColumn("_slice", F.floor(F.col("_sec") / F.lit(length)))


def way_through(second: np.ndarray, begin: int, length: int, ttl: int) -> np.ndarray:
    """What a slice does to the window that is open when it begins: for every number of seconds (0 .. ttl - 1) for which that
    window still lasts, for how many seconds the last window lasts beyond the slice."""
    n = len(second)
    following = np.searchsorted(second, second + ttl)
    last = np.where(following < n, following, np.arange(n))
    while True:  # jump twice as far each time, up to the last window that opens in the slice
        further = last[last]
        if (further == last).all():
            break
        last = further
    beyond = np.append(np.maximum(second[last] + ttl - (begin + length), 0), 0)  # no entry is left: nothing lasts
    return beyond[np.searchsorted(second, begin + np.arange(ttl))].astype("<i4")


def opened_in(second: np.ndarray, events: np.ndarray, ttl: int, first: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Events of the open window before each entry of a slice, whether that window opened before the slice, and the events of
    the last window that opened in it. The first window opens at the first entry from second ``first`` on."""
    following = np.searchsorted(second, second + ttl).tolist()
    at, opened = int(np.searchsorted(second, first)), []
    while at < len(second):
        opened.append(at)
        at = following[at]
    starts = np.asarray(opened, dtype=np.int64)
    upto = np.concatenate(([0], np.cumsum(events)))
    window = np.searchsorted(starts, np.arange(len(second)), side="right") - 1
    before = upto[:-1].copy()
    before[window >= 0] -= upto[starts[window[window >= 0]]]
    return before, window < 0, int(upto[-1] - upto[starts[-1]]) if len(starts) else 0


def _entered(cells: DataFrame, windows: dict[str, int], length: int) -> DataFrame:
    """(_key, _slice, _lasts_<window>): for how many seconds a window still lasts when a slice begins.

    A slice is a function of that number; a slice without one before it begins with none. Functions of neighbouring stretches
    are put together, stretches of 1, 2, 4 .. slices, until each reaches back to a slice whose outcome is known. So the
    rounds are the logarithm of the slices in a row, and a row is never longer than a window has seconds.
    """

    def ways(table: pa.Table) -> pa.Table:
        table = table.sort_by("_sec")
        key, at, second = table["_key"][0].as_py(), table["_slice"][0].as_py(), table["_sec"].to_numpy()
        made = [way_through(second, at * length, length, ttl).tobytes() for ttl in windows.values()]
        n = len(windows)
        return pa.table({"_key": pa.array([key] * n, pa.string()), "_window": pa.array(list(windows), pa.string()),
                         "_slice": pa.array([at] * n, pa.int64()), "_way": pa.array(made, pa.binary())})

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ways_, outs = [], []
            for way, before, out, there in zip(*(batch.column(c).to_pylist() for c in ("_way", "_earlier", "_lasts", "_there"))):
                way = np.frombuffer(way, "<i4")
                known = out if out is not None else None if there else 0
                outs.append(None if known is None else int(way[known]))
                ways_.append(None if known is not None else way[np.frombuffer(before, "<i4")].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("_key"), batch.column("_window"), batch.column("_slice"),
                                              pa.array(ways_, pa.binary()), pa.array(outs, pa.int32())],
                                             names=["_key", "_window", "_slice", "_way", "_out"])

    same = ["_key", "_window", "_slice"]
    schema = "_key string, _window string, _slice bigint, _way binary, _out int"
    rows = cells.groupBy("_key", "_slice").applyInArrow(ways, "_key string, _window string, _slice bigint, _way binary")
    rows = reliable(rows.withColumn("_out", F.lit(None).cast("int")))
    step = 1
    while True:
        earlier = rows.select("_key", "_window", (F.col("_slice") + step).alias("_slice"), F.col("_way").alias("_earlier"),
                              F.col("_out").alias("_lasts"), F.lit(True).alias("_there"))
        still = rows.filter("_out IS NULL").join(earlier, same, "left").mapInArrow(joined, schema)
        now = reliable(rows.filter("_out IS NOT NULL").unionByName(still))
        discard(rows)
        rows = now
        if rows.filter("_out IS NULL").isEmpty():
            break
        step *= 2
    return rows.groupBy("_key", (F.col("_slice") + 1).alias("_slice")).agg(
        *[F.max(F.when(F.col("_window") == name, F.col("_out"))).alias(f"_lasts_{name}") for name in windows])


def opened_by_slice(cells: DataFrame, windows: dict[str, int]) -> DataFrame:
    """Add ``_before_<window>`` to entries (_key, _sec, _n): the events of the open window before the entry."""
    length = max(windows.values())
    cells = reliable(sliced(cells.select("_key", "_sec", "_n"), length))
    placed = cells.join(_entered(cells, windows, length), ["_key", "_slice"], "left")

    def count(table: pa.Table) -> pa.Table:
        table = table.sort_by("_sec")
        second, events, at = table["_sec"].to_numpy(), table["_n"].to_numpy(), table["_slice"][0].as_py()
        for name, ttl in windows.items():
            before, carried, tail = opened_in(second, events, ttl, at * length + (table[f"_lasts_{name}"][0].as_py() or 0))
            tails = [None] * (len(second) - 1) + [tail]
            table = table.drop_columns([f"_lasts_{name}"]).append_column(f"_before_{name}", pa.array(before, pa.int64())).append_column(
                f"_carried_{name}", pa.array(carried)).append_column(f"_tail_{name}", pa.array(tails, pa.int64()))
        return table

    schema = "_key string, _slice bigint, _sec bigint, _n bigint, " + ", ".join(
        f"_before_{n} bigint, _carried_{n} boolean, _tail_{n} bigint" for n in windows)
    counted = reliable(placed.groupBy("_key", "_slice").applyInArrow(count, schema))
    # A window that is open when a slice begins opened in the slice before, as none is longer than a slice.
    some = next(iter(windows))
    tails = counted.filter(F.col(f"_tail_{some}").isNotNull()).select(
        "_key", (F.col("_slice") + 1).alias("_slice"), *[F.col(f"_tail_{n}").alias(f"_earlier_{n}") for n in windows])
    return counted.join(tails, ["_key", "_slice"], "left").select("_key", "_sec", *[
        (F.col(f"_before_{n}") + F.when(F.col(f"_carried_{n}"), F.coalesce(f"_earlier_{n}", F.lit(0))).otherwise(0)).alias(f"_before_{n}")
        for n in windows])


def anchored(df: DataFrame, key: str, time: str, row_id: str, windows: dict[str, int] | None = None,
             inclusive: bool = True, heavy_rows: int = HEAVY_ROWS, known: Heavy | None = None) -> DataFrame:
    """Add ``tx_count_<window>``: events of the open window up to the row
    (``inclusive``) or before it (0 if the row opens a new window).

    Ordinary keys: one shuffle by key, rows walked in order. Heavy keys: rows are
    first added up per key and second and counted slice by slice; a row then adds
    its place within its second. Rows without a key count as one customer of their
    own.
    """
    windows = windows or COUNTER_SECONDS
    plus = 1 if inclusive else 0
    known = known or heavy_keys(df, [key], heavy_rows)
    # A row without a time is a customer of its own for the walk.
    alone = F.concat(F.lit(NO_TIME), F.coalesce(F.col(row_id).cast("string"), F.lit("")))
    timed = df.withColumns({
        "_key": F.when(F.col(time).isNull(), alone).otherwise(F.coalesce(F.col(key).cast("string"), F.lit(NO_KEY))),
        "_sec": F.coalesce(seconds(df, time), F.lit(0)),
    })

    def told(count: Column) -> Column:
        return F.when(F.col(time).isNotNull(), count)

    ordinary, heavy = known.part(timed)
    counted = _walked(ordinary, ["_sec", row_id], windows).select(
        *df.columns, *[told(F.col(f"_before_{n}") + plus).alias(f"tx_count_{n}") for n in windows])
    if heavy is not None:
        cells = heavy.groupBy("_key", "_sec").agg(F.count(F.lit(1)).alias("_n"))
        opened = opened_by_slice(cells, windows)
        placed = KeyedRows.of(heavy, ["_key", "_sec"], [row_id], known.limit).running(
            Running("_place", "count", before=True)).rows()
        joined = placed.join(opened, ["_key", "_sec"])
        counted = counted.unionByName(joined.select(
            *df.columns,
            *[told(F.col(f"_before_{n}") + F.col("_place") + plus).alias(f"tx_count_{n}") for n in windows]))
    return counted


def sliding(df: DataFrame, key: str, time: str, row_id: str, windows: dict[str, int] | None = None,
            heavy_rows: int = HEAVY_ROWS, known: Heavy | None = None) -> DataFrame:
    """Add ``tx_count_<window>``: events of the key in the last so many seconds,
    the current second included.

    A count is the events up to now less those up to the start of the window.
    Both grow from the beginning of the key, so Spark adds each row to them once;
    a moving frame would be counted again for every row.
    """
    windows = windows or COUNTER_SECONDS
    known = known or heavy_keys(df, [key], heavy_rows)
    timed = df.withColumn("_sec", seconds(df, time))
    ordinary, heavy = known.part(timed)

    def counts(weight, key=key, second="_sec"):
        by_time = Window.partitionBy(key).orderBy(second)  # a column, or several
        upto = F.sum(weight).over(by_time.rangeBetween(Window.unboundedPreceding, 0))
        return {
            f"tx_count_{n}": F.when(F.col(second).isNotNull(), upto - F.coalesce(
                F.sum(weight).over(by_time.rangeBetween(Window.unboundedPreceding, -s)), F.lit(0)))
            for n, s in windows.items()
        }

    result = ordinary.withColumns(counts(F.col("_sec").isNotNull().cast("bigint")))
    if heavy is not None:
        # One row per key and second. A slice sees the one before it, where its windows may begin.
        cells = heavy.groupBy(F.col(key).alias("_k"), F.col("_sec").alias("_s")).agg(F.count("_sec").alias("_n"))
        own = F.floor(F.col("_s") / F.lit(max(windows.values())))
        cells = cells.withColumn("_seen", F.explode(F.when(own.isNull(), F.array(own)).otherwise(F.array(own, own + 1)))).withColumn(
            "_own", F.col("_seen").eqNullSafe(own))
        numbers = {n: c.alias(n) for n, c in counts(F.col("_n"), ["_k", "_seen"], "_s").items()}
        cells = cells.select("_k", "_s", "_own", *numbers.values()).filter("_own").drop("_own")
        same = F.col(key).eqNullSafe(F.col("_k")) & F.col("_sec").eqNullSafe(F.col("_s"))
        result = result.unionByName(heavy.join(cells, same).drop("_k", "_s"))
    return result.drop("_sec")
