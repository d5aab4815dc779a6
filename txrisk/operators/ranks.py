"""Exact order statistics, and the operators that only need a cut point:
heads, seeded samples, percentiles and the split by time.

None of them sorts the table. A cut point is found by narrowing a bracket with
Spark's quantile sketch and counting exactly what lies below it; the rows are
then told apart by a plain comparison, which also reaches the file scan.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from txrisk.constants import SAMPLE_SEED, SEARCH_SHOWN
from txrisk.functions.columns import no_nan
from txrisk.operators.scans import KeyedRows, Running

# Distinct values that may be ranked by one task.
BRACKET_ROWS = 100_000
SKETCH_ACCURACY = 10_000


def kth_smallest(df: DataFrame, column: str, ranks: list[int], bracket_rows: int = BRACKET_ROWS,
                 rows: int | None = None, near: tuple | None = None) -> list:
    """Exact values at the given 0-based ranks of the non-null values.

    The values are narrowed to a bracket around each rank until at most
    ``bracket_rows`` rows are left in it or one value fills it. Values are
    grouped with a count before they are ranked, so a value that many rows
    share is one row. ``near`` is a first guess of a bracket, for values whose
    distribution is known; a wrong guess costs one pass.
    """
    values = df.select(F.col(column).alias("v")).filter(F.col("v").isNotNull())
    total = values.count() if rows is None else rows
    if any(not 0 <= rank < total for rank in ranks):
        raise ValueError(f"ranks {ranks} outside 0..{total - 1}")
    wanted = sorted(set(ranks))
    if total <= bracket_rows:
        found = _at_ranks(values, wanted, 0, True)
    else:
        found = {}
        for together in _neighbours(wanted):
            found |= _narrowed(values, together, total, bracket_rows, near)
    return [found[rank] for rank in ranks]


def _neighbours(ranks: list[int]) -> list[list[int]]:
    """Ranks that follow each other share a bracket."""
    groups: list[list[int]] = []
    for rank in ranks:
        if groups and rank == groups[-1][-1] + 1:
            groups[-1].append(rank)
        else:
            groups.append([rank])
    return groups


def _narrowed(values: DataFrame, ranks: list[int], total: int, bracket_rows: int, near: tuple | None) -> dict:
    below, inside, low, high = 0, total, None, None
    first, last = ranks[0], ranks[-1]
    margin = 2.0 / SKETCH_ACCURACY
    while inside > bracket_rows:
        current = _between(values, low, high)
        if near is not None:
            (new_low, new_high), near = near, None
            guessed = True
        else:
            shares = [(rank - below + 0.5) / inside for rank in (first, last)]
            around = [max(0.0, shares[0] - margin), min(1.0, shares[1] + margin)]
            new_low, new_high = current.agg(F.percentile_approx("v", around, SKETCH_ACCURACY).alias("q")).first()["q"]
            guessed = False
        counts = current.agg(
            F.count_if(F.col("v") < F.lit(new_low)).alias("under"),
            F.count_if(F.col("v").between(new_low, new_high)).alias("within"),
        ).first()
        start = below + counts["under"]
        if not start <= first <= last < start + counts["within"]:
            if guessed:
                continue
            if margin >= 1.0:
                break
            margin *= 10  # the sketch rounds very large integers; look further around
            continue
        if new_low == new_high:
            return {rank: new_low for rank in ranks}
        if counts["within"] >= inside:
            break  # a few values hold nearly all rows
        below, inside, low, high = start, counts["within"], new_low, new_high
    return _at_ranks(_between(values, low, high), ranks, below, inside <= bracket_rows)


def _at_ranks(values: DataFrame, ranks: list[int], below: int, few: bool) -> dict:
    """Values at ranks by a running count over the distinct values: by one task
    when they are few, else in chunks."""
    distinct = values.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    if few:
        upto = F.sum("n").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
        running = distinct.withColumn("upto", upto)
    else:
        keyed = KeyedRows.of(distinct.withColumn("_all", F.lit(0)), ["_all"], ["v"])
        running = keyed.running(Running("upto", "sum", "n")).rows()
    hit = F.lit(False)
    for rank in ranks:
        hit = hit | ((F.col("upto") > rank - below) & (F.col("upto") - F.col("n") <= rank - below))
    rows = running.filter(hit).select("v", "n", "upto").collect()  # one row per rank
    return {
        rank: next(r["v"] for r in rows if r["upto"] - r["n"] <= rank - below < r["upto"]) for rank in ranks
    }


def _between(values: DataFrame, low, high) -> DataFrame:
    return values if low is None else values.filter(F.col("v").between(low, high))


def percentile(df: DataFrame, column: str, share: float, bracket_rows: int = BRACKET_ROWS) -> float | None:
    """Exact percentile with linear interpolation between the two nearest values."""
    clean = df.select(no_nan(F.col(column).cast("double")).alias("v")).filter(F.col("v").isNotNull())
    total = clean.count()
    if total == 0:
        return None
    position = share * (total - 1)
    lower, upper = math.floor(position), math.ceil(position)
    low, high = kth_smallest(clean, "v", [lower, upper], bracket_rows, rows=total)
    return low if lower == upper else low + (high - low) * (position - lower)


def head_by(df: DataFrame, key: str, n: int, bracket_rows: int = BRACKET_ROWS) -> DataFrame:
    """The n rows with the smallest values of a unique key; all rows if there are
    fewer. Rows without a key come last. A filter on the key instead of a sort."""
    counts = df.agg(F.count(F.lit(1)).alias("all"), F.count(key).alias("keyed")).first()
    if counts["all"] <= n:
        return df
    if counts["keyed"] <= n:
        keyless = df.filter(F.col(key).isNull()).limit(n - counts["keyed"])
        return df.filter(F.col(key).isNotNull()).unionByName(keyless)
    (cut,) = kth_smallest(df, key, [n - 1], bracket_rows, rows=counts["keyed"])
    return df.filter(F.col(key) <= F.lit(cut))


def search(df: DataFrame, column: str, value, key: str, shown: int = SEARCH_SHOWN) -> DataFrame:
    """The first ``shown`` rows by key whose column has the value, each with
    ``count``, the number of all such rows of the table. The comparison reaches
    the file scan, and hits are counted before the shuffle."""
    hits = df.filter(F.col(column) == F.lit(value))
    total = hits.agg(F.count(F.lit(1)).alias("count"))  # one row
    return hits.orderBy(key).limit(shown).join(F.broadcast(total))


HASH_BITS = 52  # exact in a double, which the quantile sketch works with


def sample_hash(key: str, seed: int = SAMPLE_SEED) -> Column:
    """Uniform bits from the seed and the key, equal in every engine."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("bigint")


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = SAMPLE_SEED,
                  bracket_rows: int = BRACKET_ROWS) -> DataFrame:
    """n rows drawn without replacement, the same ones for the same seed; all rows
    if there are fewer. The rows with the n smallest hashes are kept."""
    total = df.count()
    if total <= n:
        return df
    hashed = df.withColumn("_hash", sample_hash(key, seed))
    # The n-th smallest of uniform hashes lies within a few deviations of n / total.
    deviations = 8.0 * math.sqrt(n) + 10.0
    near = tuple(
        max(0, min(1 << HASH_BITS, int((n + side * deviations) / total * (1 << HASH_BITS)))) for side in (-1, 1))
    cut = _cuts(hashed, "_hash", key, [n], total, bracket_rows, near)[n]
    return hashed.filter(_not_after("_hash", key, cut)).drop("_hash")


def split_sizes(n: int, test: float = 0.2, val: float = 0.1) -> tuple[int, int]:
    """Ends of the training and the validation part, in double arithmetic."""
    return int(n * (1 - test - val)), int(n * (1 - test))


def temporal_split(df: DataFrame, time: str = "step", key: str = "event_id", test: float = 0.2,
                   val: float = 0.1, bracket_rows: int = BRACKET_ROWS) -> DataFrame:
    """Add ``part``: train, val or test by time, ties by the unique key. Rows
    without a time are the last, in order of the key.

    Times are grouped with a count before they are ranked, and only the key of
    one row inside one time has to be found per cut. The rows themselves are
    neither sorted nor shuffled, whatever the share of a single time.
    """
    counts = df.agg(F.count(F.lit(1)).alias("all"), F.count(time).alias("timed")).first()
    timed = counts["timed"]
    ends = split_sizes(counts["all"], test, val)
    cuts = _cuts(df, time, key, [end for end in dict.fromkeys(ends) if 0 < end <= timed], timed, bracket_rows)
    late = [end for end in dict.fromkeys(ends) if end > timed]
    if late:
        untimed = df.filter(F.col(time).isNull())
        keys = kth_smallest(untimed, key, [end - 1 - timed for end in late], bracket_rows, rows=counts["all"] - timed)
        cuts |= {end: (None, last) for end, last in zip(late, keys)}
    train_cut, val_cut = (cuts.get(end) for end in ends)
    part = F.when(_not_after(time, key, train_cut), "train").when(_not_after(time, key, val_cut), "val")
    return df.withColumn("part", part.otherwise("test"))


def _cuts(df: DataFrame, first: str, key: str, ends: list[int], total: int, bracket_rows: int,
          near: tuple | None = None) -> dict:
    """For each number of rows: the values of the last of so many rows in the
    order of (first, key)."""
    if not ends:
        return {}
    values = kth_smallest(df, first, [end - 1 for end in ends], bracket_rows, rows=total, near=near)
    counts = df.agg(*[
        F.struct(F.count_if(F.col(first) < F.lit(v)).alias("under"), F.count_if(F.col(first) == F.lit(v)).alias("same"))
        .alias(f"c{i}") for i, v in enumerate(values)
    ]).first()
    cuts = {}
    for i, (end, value) in enumerate(zip(ends, values)):
        same = df.filter(F.col(first) == F.lit(value))
        rank = end - 1 - counts[f"c{i}"]["under"]
        (last,) = kth_smallest(same, key, [rank], bracket_rows, rows=counts[f"c{i}"]["same"])
        cuts[end] = (value, last)
    return cuts


def _not_after(first: str, key: str, cut) -> Column:
    if cut is None:
        return F.lit(False)
    value, last = cut
    if value is None:
        return F.col(first).isNotNull() | (F.col(key) <= F.lit(last))
    return (F.col(first) < F.lit(value)) | ((F.col(first) == F.lit(value)) & (F.col(key) <= F.lit(last)))
