"""Exact search for the highest inner products with a vector-approximation file.

Every vector is quantised: a component becomes the number of the cell it lies in, one byte. The bounds of the cells give an
upper and a lower bound of its inner product with a query. First the file of cells is scanned: the k-th highest lower bound
of a query is a mark that its results reach. Vectors whose upper bound is below the marks of all queries of a block are never
read. The others' exact vectors are read from the highest upper bound down, until the k-th result is certain: until no
vector that is left can reach it.

Queries meet the file in blocks: a pair of a block of queries and a block of the file is a group of bounded size, and returns
a few rows per query. Vectors that are equal score equally, so of each only the k + 1 smallest ids are in the file, and equal
queries are asked once; a group of copies, however large, is a few rows. Cells are fitted on a bounded sample; cells beyond
its range double in width, so every number lies in one whose bounds are known.

Components are ``floor(scale * x)``, held as doubles, which hold whole numbers exactly; scores are summed in doubles where
these can't round and in whole numbers of any size elsewhere. Scores beyond 64 bits are cut to the ends of that range.

Odd input: vectors that are missing or hold a missing or non-finite component (or one whose multiple is not finite) take no
part. Vectors only meet vectors of as many components; empty ones score 0. Repeated ids are rows of their own; a missing id
asks nothing and comes last among equal scores. An empty table gives no rows. Other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txrisk.session import discard, reliable

SCALE = 256
BEST = 5
EVERY = 50
#: Rows whose components the cells are fitted on, for each length of vectors.
FITTED_ON = 10_000
#: Share of the sample's components outside the cells of equal width, at either end, and how many quartile ranges such cells reach
#: beyond the quartiles at most; number of these cells.
TAIL, REACH, CELLS = 0.001, 4, 128
#: Cells of doubling width at either end, which reach 2 ** 62 widths far.
BEYOND = 63
#: Vectors of a block of the file, distinct queries of a block of queries.
FILE_BLOCK, QUERY_BLOCK = 16_384, 4_096
#: Cells of the matrix of bounds that is made at a time.
AT_ONCE = 2_000_000
#: Lengths of vectors a table may have; each has a fit of its own on the driver.
MOST_LENGTHS = 100
#: Sums of products below this are exact in doubles.
EXACT = 2.0 ** 53
#: The ends of the range of scores.
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def whole_vectors(df: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """(id, row, dims, exact): floor(scale * x) as little-endian doubles; rows are numbered as they are stored."""
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter("v IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors = batch.column(0), batch.column(1)
            flat = vectors.flatten().to_numpy(zero_copy_only=False)  # a missing component is NaN
            with np.errstate(over="ignore", invalid="ignore"):
                flat = np.floor(flat * scale) + 0.0  # no negative zero
            ends = np.cumsum(vectors.value_lengths().to_numpy())
            begins = np.concatenate(([0], ends[:-1])).astype(int)
            unsound = np.concatenate(([0], np.cumsum(~np.isfinite(flat))))
            fine = np.flatnonzero(unsound[ends] == unsound[begins])
            yield pa.RecordBatch.from_arrays([
                ids.take(pa.array(fine)), pa.array((ends - begins)[fine].astype(np.int32)),
                pa.array([flat[begins[i]:ends[i]].astype("<f8").tobytes() for i in fine], pa.binary())], names=["id", "dims", "exact"])

    return rows.mapInArrow(run, "id bigint, dims int, exact binary").withColumn("row", F.monotonically_increasing_id())


def matrix(column, dims: int) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), "<f8").reshape(len(rows), dims)


class Cells:
    """For each component its cells' lower and upper bounds; cell c of component d reaches from bounds[d, c] to bounds[d, c + 1]."""

    def __init__(self, low: np.ndarray, high: np.ndarray, cells: int = CELLS, beyond: int = BEYOND):
        with np.errstate(over="ignore"):
            width = np.maximum((high - low) / cells, 1.0)
            inner = low[:, None] + width[:, None] * np.arange(cells + 1)
            steps = width[:, None] * 2.0 ** np.arange(beyond)
            self.edges = np.concatenate([inner[:, :1] - steps[:, ::-1], inner, inner[:, -1:] + steps], 1)

    @classmethod
    def ends(cls, sample: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the cells of equal width begin and end."""
        low, q1, q3, high = np.quantile(sample, [TAIL, 0.25, 0.75, 1 - TAIL], axis=0)
        return np.maximum(low, q1 - REACH * (q3 - q1)), np.minimum(high, q3 + REACH * (q3 - q1))

    def codes(self, exact: np.ndarray) -> np.ndarray:
        out = np.empty(exact.shape, np.uint8)
        for d in range(exact.shape[1]):
            out[:, d] = np.clip(np.searchsorted(self.edges[d], exact[:, d], "right") - 1, 0, self.edges.shape[1] - 2)
        return out

    def reach(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The middle and half the width of each component's cell."""
        d = np.arange(codes.shape[1])
        low, high = self.edges[d, codes], self.edges[d, codes.astype(np.int32) + 1]
        # The outermost cells have no end: whole numbers of a double beyond them still count with an infinite reach.
        half = np.where((codes == 0) | (codes == self.edges.shape[1] - 2), np.inf, (high - low) / 2)
        return (low + high) / 2, half


def fitted(stored: DataFrame, sample: int = FITTED_ON) -> dict[int, Cells]:
    """Cells for each length, from the quantiles of at most ``sample`` rows of that length, drawn by a hash of the row."""
    counts = {r["dims"]: r["n"] for r in stored.groupBy("dims").agg(F.count(F.lit(1)).alias("n")).orderBy("dims").limit(MOST_LENGTHS + 1).collect()}
    if len(counts) > MOST_LENGTHS:
        raise ValueError(f"vectors of more than {MOST_LENGTHS} lengths")

    def quantiles(table: pa.Table) -> pa.Table:
        dims = table["dims"][0].as_py()
        low, high = Cells.ends(matrix(table["exact"], dims)) if dims else np.zeros((2, 0))
        return pa.table({"dims": pa.array([dims], pa.int32()), "low": [low.tolist()], "high": [high.tolist()]},
                        schema=pa.schema([("dims", pa.int32()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64()))]))

    share = F.create_map(*[F.lit(x) for d, n in counts.items() for x in (d, min(n, int(1.2 * sample) + 100) / n)]) if counts else None
    drawn = stored if share is None else stored.filter(
        F.pmod(F.xxhash64("row", F.lit("cells")), F.lit(1 << 40)) < (1 << 40) * F.element_at(share, F.col("dims")))
    of_length = Window.partitionBy("dims").orderBy(F.xxhash64("row", F.lit("cells")), "row")
    drawn = drawn.withColumn("nth", F.row_number().over(of_length)).filter(F.col("nth") <= sample).select("dims", "exact")
    rows = drawn.groupBy("dims").applyInArrow(quantiles, "dims int, low array<double>, high array<double>").collect()
    return {r["dims"]: Cells(np.array(r["low"]), np.array(r["high"])) for r in rows}


class Bounds:
    """Lower and upper bounds of the inner products with quantised vectors, rounding allowed for."""

    def __init__(self, cells: Cells, codes: np.ndarray):
        middle, half = cells.reach(codes)
        self.free = np.isinf(half).any(1)
        half = np.where(np.isinf(half), 0, half)
        self.middle = middle.T
        self.spread = (half + (np.abs(middle) + half) * (codes.shape[1] + 4) * 2.0 ** -52).T

    def of(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(over="ignore", invalid="ignore"):
            about, spread = queries @ self.middle, np.abs(queries) @ self.spread
            low, high = about - spread, about + spread
        endless = ~np.isfinite(about) | ~np.isfinite(spread) | self.free
        return np.where(endless, -np.inf, low), np.where(endless, np.inf, high)


def slices(queries: int, vectors: int) -> Iterator[slice]:
    step = max(1, AT_ONCE // max(vectors, 1))
    return (slice(i, min(i + step, queries)) for i in range(0, queries, step))


def products(query: np.ndarray, vectors: np.ndarray) -> list[int] | np.ndarray:
    """Exact inner products."""
    if not query.size:
        return np.zeros(len(vectors))
    with np.errstate(over="ignore"):
        exact = np.abs(query).max() * np.abs(vectors).max(initial=0) * len(query) < EXACT
    if exact:
        return vectors @ query
    numbers = [int(x) for x in query]
    return [sum(a * int(b) for a, b in zip(numbers, v)) for v in vectors]


def asked(stored: DataFrame, every: int) -> DataFrame:
    """(exact, dims, query): the distinct vectors that are queries, each with a number."""
    rows = stored.filter((F.col("id") % every) == 0)
    return rows.groupBy("exact", "dims").agg(F.min("row").alias("query"))


def filed(stored: DataFrame, best: int) -> DataFrame:
    """The rows that can be results: of equal vectors, the ``best`` + 1 with the smallest ids."""
    of_equal = Window.partitionBy("exact").orderBy(F.col("id").asc_nulls_last(), "row")
    return stored.withColumn("nth", F.row_number().over(of_equal)).filter(F.col("nth") <= best + 1).drop("nth")


def approximated(entries: DataFrame, cells: dict[int, Cells]) -> DataFrame:
    """(row, dims, cells): the vector-approximation file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, out = batch.column("dims").to_numpy(), np.empty(batch.num_rows, object)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                codes = cells[int(d)].codes(matrix(batch.column("exact").take(pa.array(at)), int(d)))
                for i, c in zip(at, codes):
                    out[i] = c.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("dims"), pa.array(out, pa.binary())],
                                             names=["row", "dims", "cells"])

    return entries.select("row", "dims", "exact").mapInArrow(run, "row bigint, dims int, cells binary")


def dealt(df: DataFrame, number: str, blocks: int, name: str) -> DataFrame:
    return df.withColumn(name, F.pmod(F.xxhash64(F.col(number), F.lit(name)), F.lit(blocks)).cast("int"))


def spread(df: DataFrame, blocks: int, name: str) -> DataFrame:
    """Every row once for each of the other side's blocks."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))


def code_matrix(table: pa.Table, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(table["cells"].to_pylist()), np.uint8).reshape(table.num_rows, dims)


def marks_of(queries: DataFrame, file: DataFrame, cells: dict[int, Cells], best: int) -> DataFrame:
    """(query, mark): the ``best``-th highest lower bound over the whole file; minus infinity where there are fewer vectors."""

    def run(asking: pa.Table, held: pa.Table) -> pa.Table:
        out = ([], [])
        if asking.num_rows and held.num_rows:
            dims = asking["dims"][0].as_py()
            exact, codes, numbers = matrix(asking["exact"], dims), code_matrix(held, dims), asking["query"].to_numpy()
            few = min(best, len(codes))
            within = Bounds(cells[dims], codes)
            for part in slices(len(exact), len(codes)):
                low, _ = within.of(exact[part])
                top = -np.partition(-low, few - 1, axis=1)[:, :few]
                out[0].append(np.repeat(numbers[part], few))
                out[1].append(top.ravel())
        return pa.table({"query": np.concatenate([np.zeros(0, np.int64), *out[0]]), "low": np.concatenate([np.zeros(0), *out[1]])})

    lows = queries.groupBy("dims", "qb", "fb").cogroup(file.groupBy("dims", "qb", "fb")).applyInArrow(run, "query bigint, low double")
    by_query = Window.partitionBy("query").orderBy(F.desc("low"))
    kept = lows.withColumn("nth", F.row_number().over(by_query)).filter(F.col("nth") <= best)
    # A mark beyond the range of scores is cut to it: what lies further out is equal there.
    low = F.min("low")
    mark = F.when((F.count(F.lit(1)) < best) | (low <= F.lit(float(LEAST))), F.lit(float("-inf"))).otherwise(F.least(low, F.lit(float(MOST))))
    return kept.groupBy("query").agg(mark.alias("mark"))


def needed(queries: DataFrame, file: DataFrame, cells: dict[int, Cells]) -> DataFrame:
    """(row, qb, fb): vectors whose upper bound reaches the mark of a query of the block."""

    def run(asking: pa.Table, held: pa.Table) -> pa.Table:
        use = np.zeros(held.num_rows, bool)
        if asking.num_rows and held.num_rows:
            dims = asking["dims"][0].as_py()
            exact, codes, marks = matrix(asking["exact"], dims), code_matrix(held, dims), asking["mark"].to_numpy()
            within = Bounds(cells[dims], codes)
            for part in slices(len(exact), len(codes)):
                _, high = within.of(exact[part])
                use |= (high >= marks[part, None]).any(0)
        return held.select(["row", "qb", "fb"]).filter(pa.array(use))

    return queries.groupBy("dims", "qb", "fb").cogroup(file.groupBy("dims", "qb", "fb")).applyInArrow(run, "row bigint, qb int, fb int")


def certain(query: np.ndarray, mark: float, high: np.ndarray, exact: np.ndarray, ids: np.ndarray, best: int) -> list[tuple]:
    """The query's ``best`` (score, place): vectors are read from the highest upper bound down, twice as many each time, until
    the last result beats every bound that is left."""
    order = np.flatnonzero(high >= mark)
    order = order[np.argsort(-high[order], kind="stable")]
    top, at, step = [], 0, 4 * best
    while at < len(order) and (len(top) < best or high[order[at]] >= top[-1][0]):
        places = order[at:at + step]
        top += [(min(max(int(s), LEAST), MOST), p) for s, p in zip(products(query, exact[places]), places.tolist())]
        top = sorted(top, key=lambda x: (-x[0], ids[x[1]], x[1]))[:best]
        at, step = at + step, 2 * step
    return top


NO_ID = MOST


def read_exactly(queries: DataFrame, vectors: DataFrame, cells: dict[int, Cells], best: int) -> DataFrame:
    """(query, row, id, score): the best of each pair of blocks."""

    def run(asking: pa.Table, held: pa.Table) -> pa.Table:
        out = []
        if asking.num_rows and held.num_rows:
            dims = asking["dims"][0].as_py()
            held = held.sort_by("row")
            exact, vectors = matrix(asking["exact"], dims), matrix(held["exact"], dims)
            marks, numbers = asking["mark"].to_numpy(), asking["query"].to_numpy()
            within = Bounds(cells[dims], cells[dims].codes(vectors))
            rows, ids = held["row"].to_numpy(), held["id"].fill_null(NO_ID).to_numpy()
            for part in slices(len(exact), len(vectors)):
                _, high = within.of(exact[part])
                for i, q in enumerate(range(part.start, part.stop)):
                    out += [(int(numbers[q]), int(rows[p]), p, score)
                            for score, p in certain(exact[q], marks[q], high[i], vectors, ids, best)]
        query, row, place, score = (np.array(x, np.int64) for x in zip(*out)) if out else [np.zeros(0, np.int64)] * 4
        return pa.table({"query": query, "row": row, "id": held["id"].take(pa.array(place)), "score": score})

    return queries.groupBy("dims", "qb", "fb").cogroup(vectors.groupBy("dims", "qb", "fb")).applyInArrow(
        run, "query bigint, row bigint, id bigint, score bigint")


def searched(df: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = EVERY, best: int = BEST,
             scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``best`` rows of highest inner product for each row whose key is divisible by
    ``every``, its own row left out; equal scores by the smaller key."""
    stored = reliable(whole_vectors(df, key, vector, scale))
    cells = fitted(stored)
    entries = reliable(filed(stored, best))
    distinct = reliable(asked(stored, every))
    file_blocks = max(1, ceil(entries.count() / FILE_BLOCK))
    query_blocks = max(1, ceil(distinct.count() / QUERY_BLOCK))
    file = reliable(dealt(approximated(entries, cells), "row", file_blocks, "fb"))
    queries = dealt(distinct, "query", query_blocks, "qb")
    # A query's equals are entries too and may be its own row, so one more is looked for than is returned.
    marks = marks_of(spread(queries, file_blocks, "fb"), spread(file, query_blocks, "qb"), cells, best + 1)
    marked = reliable(queries.join(marks, "query"))
    near = needed(spread(marked, file_blocks, "fb"), spread(file, query_blocks, "qb"), cells)
    vectors = near.join(entries.withColumnRenamed("row", "entry"), F.col("row") == F.col("entry")).drop("entry")
    # Only pairs of blocks with vectors to read meet again.
    pairs = reliable(vectors)
    with_work = pairs.select("dims", "qb", F.col("fb").alias("work")).distinct()
    meeting = marked.join(with_work, ["dims", "qb"]).withColumnRenamed("work", "fb")
    scored = read_exactly(meeting, pairs, cells, best + 1)
    by_query = Window.partitionBy("query").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "row")
    top = scored.withColumn("nth", F.row_number().over(by_query)).filter(F.col("nth") <= best + 1)
    results = reliable(top.groupBy("query").agg(F.collect_list(F.struct("nth", "row", "id", "score")).alias("found")))
    answers = distinct.select("exact", "query").join(results, "query").select("exact", "found")
    asking = stored.filter((F.col("id") % every) == 0).select(F.col("id").alias("query_id"), F.col("row").alias("own"), "exact")
    found = asking.join(answers, "exact").select("query_id", F.expr("filter(array_sort(found), f -> f.row <> own)").alias("found"))
    found = found.select("query_id", F.posexplode(F.slice("found", 1, best)).alias("place", "hit"))
    made = reliable(found.select("query_id", (F.col("place") + 1).alias("rank"), F.col("hit.id").alias(key), F.col("hit.score").alias("score")))
    discard(stored, entries, distinct, file, marked, pairs, results)
    return made
