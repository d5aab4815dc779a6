"""Isolation forest (Liu, Ting and Zhou, 2008) on Spark.

A tree sees a random sample. Small samples are grown side by side, one group per
tree. Rows of larger ones are handed on as packed columns. A tree that sees more
rows than a task may hold is grown breadth first: every pass over the rows counts
them per open node and takes the least and the largest value of each feature
there, nodes with more rows than a task holds are split, and once none is left
the rows of the others are handed to tasks and grown to the end. The draws of a
node depend on the seed, the tree and the node's place alone, so all ways grow
the same tree.

Nodes are placed as in a heap (root 1, children 2n and 2n + 1). The forest is a
table of nodes, of which the root has the smallest number; scoring walks it inside
the scan of the rows, without a shuffle.
"""

from __future__ import annotations

import gc
import json
import math
import os
import threading
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from txrisk.constants import FEATURES, SAMPLE_SEED
from txrisk.operators.ranks import BRACKET_ROWS, percentile, seeded_sample
from txrisk.session import discard, reliable, scratch_path

TREES = 100
TREE_ROWS = 256
CONTAMINATION = 0.01
POOL_PARTS = 16
# Nodes that scoring broadcasts at once (18 bytes each; the driver holds them twice while it puts them together).
MOST_NODES = 8_000_000
# Nodes that a task packs for that.
PACKED_ROWS = 500_000
# Rows that go through a tree together; their values stay in the cache.
SCORE_ROWS = 4096
# Rows that meet a tree before the next one is unpacked.
HELD_ROWS = 65_536
NODE_SCHEMA = "tree int, node bigint, feature int, threshold double, left bigint, right bigint, length double"
# Rows that one task may hold while it grows a tree or a part of one (a feature takes 1 to 8 bytes each).
GROUP_ROWS = 2_500_000
# Samples up to this size are grouped by tree as plain rows.
PLAIN_ROWS = 50_000
# Bytes of the samples of trees that grow at once, each value counted as 8.
MOST_HANDED = 24 << 30
# Nodes of more rows are split one by one, smaller ones side by side, some rows at a time.
ALONE_ROWS, BESIDE_ROWS = 16_384, 262_144
# Rows of a node that are looked at first to tell which features differ there.
PROBES = 8
# Nodes of the upper parts of the trees that the driver holds at once.
MOST_UPPER = 200_000
EULER = 0.5772156649015329


def mean_path(n: float) -> float:
    """Mean path length of an unsuccessful search in a tree of n rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + EULER) - 2.0 * (n - 1.0) / n


@dataclass(frozen=True)
class Forest:
    path: str  # parquet table of nodes
    features: list[str]
    trees: int
    tree_rows: int
    contamination: float
    cut: float | None = None  # score below which a row is an outlier
    low: float | None = None  # least and largest training score
    high: float | None = None

    def nodes(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(NODE_SCHEMA).parquet(self.path)

    def save(self, spark: SparkSession, path: str) -> None:
        """Nodes and settings below ``path``."""
        nodes = os.path.join(path, "nodes")
        self.nodes(spark).write.mode("overwrite").parquet(nodes)
        settings = json.dumps({**self.__dict__, "path": nodes})
        spark.createDataFrame([(settings,)], "settings string").write.mode("overwrite").parquet(
            os.path.join(path, "settings"))

    @staticmethod
    def load(spark: SparkSession, path: str) -> Forest:
        row = spark.read.parquet(os.path.join(path, "settings")).first()
        return Forest(**{**json.loads(row["settings"]), "path": os.path.join(path, "nodes")})


def _numbers(features: list[str]) -> list[Column]:
    return [F.coalesce(F.nanvl(F.col(name).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(name) for name in features]


def draws(seed: int, tree: int, node: int) -> tuple[float, float]:
    """Two numbers from 0 to below 1 that belong to a node of a tree."""
    state = (seed * 0x9E3779B97F4A7C15 + tree * 0xD1B54A32D192ED03 + node * 0x8CB92BA72F3D8DD7) & _MASK
    out = []
    for _ in range(2):
        state = (state + 0x9E3779B97F4A7C15) & _MASK
        mixed = ((state ^ (state >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
        mixed = ((mixed ^ (mixed >> 27)) * 0x94D049BB133111EB) & _MASK
        out.append(((mixed ^ (mixed >> 31)) >> 11) / 2.0 ** 53)
    return out[0], out[1]


_MASK = (1 << 64) - 1


def draws_of(seed: int, tree: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """:func:`draws` of many nodes."""
    own = (seed * 0x9E3779B97F4A7C15 + tree * 0xD1B54A32D192ED03) & _MASK
    state = np.uint64(own) + nodes.astype(np.uint64) * np.uint64(0x8CB92BA72F3D8DD7)
    out = []
    for _ in range(2):
        state = state + np.uint64(0x9E3779B97F4A7C15)
        mixed = (state ^ (state >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out.append(((mixed ^ (mixed >> np.uint64(31))) >> np.uint64(11)) / 2.0 ** 53)
    return out[0], out[1]


def columns_of(seed: int, tree: int, features: int, width: int) -> np.ndarray:
    """The features that a tree may use."""
    return np.sort(np.random.default_rng([seed, tree]).choice(features, width, replace=False))


def split(low: np.ndarray, high: np.ndarray, columns: np.ndarray, seed: int, tree: int, node: int) -> tuple[int, float] | None:
    """Feature and threshold for rows whose values of ``columns`` lie between ``low`` and ``high``; none if all are equal."""
    usable = np.flatnonzero(high > low)
    if len(usable) == 0:
        return None
    which, where = draws(seed, tree, node)
    pick = usable[int(which * len(usable))]
    # Strictly below the maximum, so that both sides get rows.
    threshold = float(low[pick] + (high[pick] - low[pick]) * where)
    if not threshold < high[pick]:
        threshold = float(low[pick])
    return int(columns[pick]), threshold


def depth_of(node: int) -> int:
    return node.bit_length() - 1


def deepest(size: int) -> int:
    """Levels of a tree that sees ``size`` rows."""
    return math.ceil(math.log2(max(size, 2)))


def leaf(node: int, rows: int) -> tuple:
    return node, -1, 0.0, node, node, depth_of(node) + mean_path(rows)


@dataclass
class Nodes:
    """Nodes of a tree; a split has no rows, a leaf the feature -1."""

    node: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    rows: np.ndarray

    @staticmethod
    def of(parts: list[tuple]) -> Nodes:
        return Nodes(*(np.concatenate(p) for p in zip(*parts)))

    def columns(self) -> tuple[np.ndarray, ...]:
        """Node, feature, threshold, left, right, length."""
        ends = self.feature < 0
        rows, place = np.unique(self.rows, return_inverse=True)
        mean = np.array([mean_path(n) for n in rows.tolist()])[place]
        length = np.where(ends, np.frexp(self.node.astype(np.float64))[1] - 1 + mean, 0.0)
        left = np.where(ends, self.node, 2 * self.node)
        return self.node, self.feature, self.threshold, left, left + ~ends, length

    def tuples(self) -> list[tuple]:
        return list(zip(*(c.tolist() for c in self.columns())))


def grow(values: list[np.ndarray], columns: np.ndarray, seed: int, tree: int, limit: int, root: int = 1) -> Nodes:
    """Nodes below and including ``root``, given the values of each of the ``columns``."""
    made, beside, held = [], [], 0
    open_nodes = [(root, np.arange(len(values[0]), dtype=np.int32), range(len(values)))]
    while open_nodes:
        node, members, differing = open_nodes.pop()
        found = None
        if len(members) > ALONE_ROWS and depth_of(node) < limit:
            first = members[::max(1, len(members) // PROBES)]
            # A feature that is equal in all rows stays so below.
            differing = [j for j in differing if _differ(values[j].take(first)) or _differ(values[j].take(members))]
            which, where = draws(seed, tree, node)
            if differing:
                found = differing[int(which * len(differing))]
        if found is None:  # a leaf, or small
            beside.append((node, members))
            held += len(members)
            if held >= BESIDE_ROWS:
                made.append(_grown_beside(values, columns, seed, tree, limit, beside))
                beside, held = [], 0
            continue
        here = values[found].take(members)
        threshold = _between(np.float64(here.min()), np.float64(here.max()), where)
        goes_left = here <= threshold
        made.append((np.array([node]), columns[[found]], np.array([threshold]), np.zeros(1, np.int64)))
        open_nodes += [(2 * node, members[goes_left], differing), (2 * node + 1, members[~goes_left], differing)]
    if beside:
        made.append(_grown_beside(values, columns, seed, tree, limit, beside))
    return Nodes.of(made)


def _differ(values: np.ndarray) -> bool:
    return bool((values != values[0]).any())


def _between(low, high, where):
    """The threshold; strictly below the maximum, so that both sides get rows."""
    with np.errstate(invalid="ignore", over="ignore"):
        threshold = low + (high - low) * where
    return np.where(threshold < high, threshold, low)


def _spans(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places from each start on, so many as its count, one after the other."""
    end = np.cumsum(count)
    return np.arange(end[-1] if len(end) else 0) + np.repeat(start - end + count, count)


def _grown_beside(values: list[np.ndarray], columns: np.ndarray, seed: int, tree: int, limit: int, given: list[tuple]) -> tuple:
    """Nodes below and including the given nodes with their rows, all of a level at once."""
    node, count = np.array([n for n, _ in given]), np.array([len(m) for _, m in given])
    rows, made = np.concatenate([m for _, m in given]), []
    depth = np.frexp(node.astype(np.float64))[1] - 1

    def ended(which):
        made.append((node[which], np.full(which.sum(), -1), np.zeros(which.sum()), count[which]))

    def kept(rows, which):
        return rows[_spans((np.cumsum(count) - count)[which], count[which])]

    splits = (depth < limit) & (count > 1)
    ended(~splits)
    rows, node, count, depth = kept(rows, splits), node[splits], count[splits], depth[splits]
    dense = np.empty((len(values), len(rows)))
    for j, of in enumerate(values):
        of.take(rows, out=dense[j]) if of.dtype == dense.dtype else np.copyto(dense[j], of.take(rows))
    flat, size = dense.ravel(), len(rows)
    rows, equal = np.arange(size), np.zeros((len(values), len(node)), bool)
    while len(node):
        start = np.cumsum(count) - count
        probed = rows[start[:, None] + (count - 1)[:, None] * np.arange(PROBES) // (PROBES - 1)]
        differs = np.empty(equal.shape, bool)
        for j, of in enumerate(dense):
            seen = of.take(probed)
            differs[j] = (seen != seen[:, :1]).any(axis=1)
        for j in range(len(dense)):
            unsure = np.flatnonzero(~differs[j] & ~equal[j] & (count > PROBES))
            if len(unsure):
                seen, at = dense[j].take(rows[_spans(start[unsure], count[unsure])]), np.cumsum(count[unsure]) - count[unsure]
                differs[j, unsure] = np.maximum.reduceat(seen, at) > np.minimum.reduceat(seen, at)
        equal, usable = ~differs, differs.sum(axis=0)
        which, where = draws_of(seed, tree, node)
        pick = (np.cumsum(differs, axis=0) > (which * usable).astype(np.int64)).argmax(axis=0)
        splits = usable > 0
        if not splits.all():
            ended(~splits)
            rows, node, count, depth = kept(rows, splits), node[splits], count[splits], depth[splits]
            equal, pick, where, start = equal[:, splits], pick[splits], where[splits], np.cumsum(count) - count
            if not len(node):
                break
        here = flat.take(np.repeat(pick * size, count) + rows)
        threshold = _between(np.minimum.reduceat(here, start), np.maximum.reduceat(here, start), where)
        made.append((node, columns[pick], threshold, np.zeros(len(node), np.int64)))
        goes_left = here <= np.repeat(threshold, count)
        lefts, so_far = np.add.reduceat(goes_left, start, dtype=np.int64), np.cumsum(goes_left)
        before = so_far[start] - goes_left[start]
        place = np.where(goes_left, so_far - 1 + np.repeat(start - before, count),
                         np.arange(len(rows)) - so_far + np.repeat(lefts + before, count))
        moved = np.empty_like(rows)
        moved[place] = rows
        node, count = np.column_stack((2 * node, 2 * node + 1)).ravel(), np.column_stack((lefts, count - lefts)).ravel()
        rows, depth, equal = moved, np.repeat(depth + 1, 2), np.repeat(equal, 2, axis=1)
        splits = (depth < limit) & (count > 1)
        if not splits.all():
            ended(~splits)
            rows, node, count, depth, equal = kept(rows, splits), node[splits], count[splits], depth[splits], equal[:, splits]
    return tuple(np.concatenate(p) for p in zip(*made))


class Upper:
    """The upper part of one tree while it is grown by passes: splits, finished leaves, open nodes and nodes that are small
    enough for one task."""

    def __init__(self):
        self.splits: dict[int, tuple[int, float]] = {}
        self.leaves: dict[int, int] = {}  # node -> rows
        self.open, self.small = {1}, set()
        self.rows: dict[int, int] = {}  # of small nodes

    def walk(self, values: np.ndarray) -> np.ndarray:
        """The node below all splits that each row comes to."""
        at = np.ones(len(values), np.int64)
        moving = np.arange(len(values)) if 1 in self.splits else np.zeros(0, np.int64)
        nodes = np.array(sorted(self.splits), np.int64)
        feature = np.array([self.splits[n][0] for n in nodes.tolist()], np.int64)
        threshold = np.array([self.splits[n][1] for n in nodes.tolist()])
        while len(moving):
            place = np.searchsorted(nodes, at[moving])
            at[moving] = 2 * at[moving] + (values[moving, feature[place]] > threshold[place])
            place = np.minimum(np.searchsorted(nodes, at[moving]), len(nodes) - 1)
            moving = moving[nodes[place] == at[moving]]
        return at

    def settle(self, stats: dict[int, tuple[int, np.ndarray, np.ndarray]], columns, seed: int, tree: int, limit: int,
               group_rows: int) -> None:
        """Split the open nodes, given their rows and the ends of each feature there."""
        now, self.open = self.open, set()
        for node in now:
            rows, low, high = stats[node]
            if rows <= group_rows:
                self.small.add(node)
                self.rows[node] = rows
                continue
            found = split(low, high, columns, seed, tree, node) if depth_of(node) < limit else None
            if found is None:
                self.leaves[node] = rows
            else:
                self.splits[node] = found
                self.open |= {2 * node, 2 * node + 1}

    def nodes(self) -> list[tuple]:
        made = [(n, f, t, 2 * n, 2 * n + 1, 0.0) for n, (f, t) in self.splits.items()]
        return made + [leaf(n, rows) for n, rows in self.leaves.items()]


def cuts(ids: DataFrame, drawn, size: int, total: int, trees: range) -> dict[int, tuple]:
    """For each tree the draw and the id of its last row: the ``size`` rows of smallest (draw, id) are its sample.

    Draws are uniform, so the last one lies in a narrow band around the share. Rows below the band are counted, and only
    those in it, about the square root of the sample, are put in order.
    """
    wide = 6.0
    while True:
        half = wide * math.sqrt(size * (1 - size / total) + 1) / total
        low, high = size / total - half, size / total + half
        u = ids.withColumn("tree", F.explode(F.array(*map(F.lit, trees)))).withColumn("_u", drawn(F.col("tree")))
        in_order = Window.partitionBy("tree").orderBy("_u", "_id")
        below = u.filter(F.col("_u") < high).groupBy("tree").agg(F.count_if(F.col("_u") < low).alias("n"))
        band = u.filter(F.col("_u").between(low, high) & (F.col("_u") < high)).withColumn("nth", F.row_number().over(in_order))
        found = band.join(F.broadcast(below), "tree").filter(F.col("nth") == size - F.col("n")).select("tree", "_u", "_id").collect()
        if len(found) == len(trees):  # a row for each tree
            return {r["tree"]: (r["_u"], r["_id"]) for r in found}
        wide *= 2


def _members(drawn, ends: dict[int, tuple] | None, trees: range) -> Column:
    """For each tree whether the row is in its sample."""
    if ends is None:
        return F.array(*[F.lit(True) for _ in trees])
    # One expression per tree: inside a lambda the draws would be interpreted.
    return F.array(*[(drawn(F.lit(t)) < ends[t][0]) | F.coalesce((drawn(F.lit(t)) == ends[t][0]) & (F.col("_id") <= ends[t][1]), F.lit(False))
                     for t in trees])


def _grown_by_level(numeric: DataFrame, features: list[str], drawn, size: int, total: int, trees: range, width: int, seed: int,
                    group_rows: int) -> DataFrame:
    """The nodes of trees whose samples are too large for one task."""
    spark, limit = numeric.sparkSession, deepest(size)
    columns = {t: columns_of(seed, t, len(features), width) for t in trees}
    ends = None if size == total else cuts(numeric.select("_id"), drawn, size, total, trees)
    rows = numeric.select(_members(drawn, ends, trees).alias("_in"), *features)
    upper = {t: Upper() for t in trees}
    if size <= group_rows:
        for u in upper.values():
            u.open, u.small, u.rows = set(), {1}, {1: size}

    def matrices(batches):
        for batch in batches:
            member = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(trees))
            values = np.column_stack([batch.column(i + 1).to_numpy() for i in range(len(features))])
            yield member, values

    def ends_of_nodes(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tops = shared.value
            held = {}  # (tree, node) -> rows, least, largest; at most the open nodes
            for member, values in matrices(batches):
                for i, t in enumerate(trees):
                    mine = values[member[:, i]]
                    if not tops[t].open or not len(mine):
                        continue
                    at = tops[t].walk(mine)
                    order = np.argsort(at, kind="stable")
                    at, mine = at[order], mine[order][:, columns[t]]
                    begin = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
                    n = np.diff(np.append(begin, len(at)))
                    least, largest = np.minimum.reduceat(mine, begin), np.maximum.reduceat(mine, begin)
                    for j, node in enumerate(at[begin].tolist()):
                        if node not in tops[t].open:
                            continue
                        old = held.get((t, node))
                        held[t, node] = (int(n[j]), least[j], largest[j]) if old is None else (
                            old[0] + int(n[j]), np.minimum(old[1], least[j]), np.maximum(old[2], largest[j]))
            for i in range(0, len(held), 1000):
                part = list(held.items())[i:i + 1000]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat([k[0] for k, _ in part], width).astype(np.int32)), pa.array(np.repeat([k[1] for k, _ in part], width)),
                    pa.array(np.tile(np.arange(width, dtype=np.int32), len(part))), pa.array(np.repeat([v[0] for _, v in part], width)),
                    pa.array(np.concatenate([v[1] for _, v in part])), pa.array(np.concatenate([v[2] for _, v in part]))],
                    names=["tree", "node", "at", "n", "low", "high"])

        return run

    while any(u.open for u in upper.values()):
        shared = spark.sparkContext.broadcast(upper)
        partial = rows.mapInArrow(ends_of_nodes(shared), "tree int, node bigint, at int, n bigint, low double, high double")
        found = partial.groupBy("tree", "node", "at").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
        stats = {t: {} for t in trees}
        for r in found.collect():  # the open nodes: each held more than group_rows rows of a sample, or is a child of one that did
            entry = stats[r["tree"]].setdefault(r["node"], (r["n"], np.empty(width), np.empty(width)))
            entry[1][r["at"]], entry[2][r["at"]] = r["low"], r["high"]
        upper = {t: copied(u) for t, u in upper.items()}
        for t, u in upper.items():
            u.settle(stats[t], columns[t], seed, t, limit, group_rows)
        shared.unpersist()

    tasks = _bins({(t, n): rows for t, u in upper.items() for n, rows in u.rows.items()}, group_rows)
    shared = spark.sparkContext.broadcast((upper, tasks))

    def handed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper, tasks = shared.value
        for member, values in matrices(batches):
            narrow, out = [narrowed(v) for v in values.T], []
            for i, t in enumerate(trees):
                mine = np.flatnonzero(member[:, i])
                if not len(mine):
                    continue
                at = upper[t].walk(values[mine]) if upper[t].splits else np.ones(len(mine), np.int64)
                order = np.argsort(at, kind="stable")
                for part in np.split(order, np.flatnonzero(np.diff(at[order])) + 1):
                    node = int(at[part[0]])
                    if node in upper[t].small:
                        packed = [narrow[f].take(mine[part]) for f in columns[t]]
                        out.append((tasks[t, node], t, node, len(part), "".join(p.dtype.char for p in packed), b"".join(p.tobytes() for p in packed)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), _HANDED.types)], schema=_HANDED)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper, held = shared.value[0], {}
        for batch in batches:
            for _, t, node, n, kinds, packed in zip(*(c.to_pylist() if c.type != pa.binary() else c for c in batch.columns)):
                if (t, node) not in held:
                    held[t, node] = Gathered(upper[t].rows[node])
                held[t, node].add(n, kinds, packed.as_buffer())
        for t, node in list(held):
            made = grow(held.pop((t, node)).columns(), columns[t], seed, t, limit, node).columns()
            for first in range(0, len(made[0]), 50_000):
                part = [c[first:first + 50_000] for c in made]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part[0]), t, np.int32)), *(pa.array(c, k) for c, k in zip(part, _NODE_TYPES))],
                                                 names=["tree", "node", "feature", "threshold", "left", "right", "length"])

    parts = rows.mapInArrow(handed, "task int, tree int, node bigint, n int, kinds string, packed binary")
    lower = parts.repartitionById(1 + max(tasks.values(), default=0), F.col("task")).mapInArrow(build, NODE_SCHEMA)
    made = [(t, *n) for t, u in upper.items() for n in u.nodes()]
    return spark.createDataFrame(made, NODE_SCHEMA).unionByName(lower) if made else lower


_HANDED = pa.schema([("task", pa.int32()), ("tree", pa.int32()), ("node", pa.int64()), ("n", pa.int32()), ("kinds", pa.string()),
                     ("packed", pa.binary())])
_NODE_TYPES = [pa.int64(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.float64()]


def _bins(rows: dict[tuple[int, int], int], most: int) -> dict[tuple[int, int], int]:
    """Small nodes to tasks; the nodes of a task have at most ``most`` rows in all."""
    tasks, task, held = {}, 0, 0
    for key, n in rows.items():
        if held and held + n > most:
            task, held = task + 1, 0
        tasks[key] = task
        held += n
    return tasks


def narrowed(values: np.ndarray) -> np.ndarray:
    """The same numbers in the smallest of some types that holds them all."""
    with np.errstate(invalid="ignore", over="ignore"):
        for kind in (np.int8, np.int16, np.float32):
            small = values.astype(kind)
            if (small == values).all():
                return small
    return values


class Gathered:
    """Columns of a node, put together from packed pieces."""

    def __init__(self, expected: int):
        self.n, self.room, self.arrays = 0, max(1, expected), []

    def add(self, n: int, kinds: str, packed: pa.Buffer) -> None:
        if self.n + n > self.room:  # more than expected where keys repeat
            self.room = max(self.n + n, self.room + self.room // 8)
            self.arrays = [np.resize(a, self.room) for a in self.arrays]
        self.arrays = self.arrays or [np.empty(self.room, k) for k in kinds]
        at = 0
        for j, k in enumerate(kinds):
            piece = np.frombuffer(packed, k, n, at)
            at += piece.nbytes
            wide = np.promote_types(self.arrays[j].dtype, piece.dtype)
            if wide != self.arrays[j].dtype:
                self.arrays[j] = self.arrays[j].astype(wide)
            self.arrays[j][self.n:self.n + n] = piece
        self.n += n

    def columns(self) -> list[np.ndarray]:
        return [a[:self.n] for a in self.arrays]


def copied(upper: Upper) -> Upper:
    """Another object, as tasks may still read the one that was sent."""
    out = Upper()
    out.splits, out.leaves, out.open, out.small = dict(upper.splits), dict(upper.leaves), set(upper.open), set(upper.small)
    out.rows = dict(upper.rows)
    return out


def numbered(nodes: list[tuple]) -> list[tuple]:
    """The nodes numbered from 0 without gaps, in the order of their places; the root is 0."""
    nodes = sorted(nodes)
    place = {n[0]: i for i, n in enumerate(nodes)}
    return [(place[n], feature, threshold, place[left], place[right], length) for n, feature, threshold, left, right, length in nodes]


def _table(tree: int, nodes: list[tuple]) -> pd.DataFrame:
    table = pd.DataFrame(nodes, columns=["node", "feature", "threshold", "left", "right", "length"])
    table.insert(0, "tree", tree)
    return table


def rows_per_tree(total: int, max_samples: float | str = "auto") -> int:
    """``auto`` is 256 rows; a number above 1 is a number of rows; a share is one of
    the whole table."""
    if max_samples == "auto":
        return min(TREE_ROWS, total)
    return min(total, max(2, int(max_samples if max_samples > 1 else max_samples * total)))


def fit(df: DataFrame, key: str, features: list[str] = FEATURES, contamination: float = CONTAMINATION,
        trees: int = TREES, max_samples: float | str = "auto", max_features: float = 1.0,
        seed: int = SAMPLE_SEED, path: str | None = None, bracket_rows: int = BRACKET_ROWS,
        pool: int | None = None, group_rows: int = GROUP_ROWS) -> Forest:
    """Grow a forest and fit its outlier cut on the scores of the same rows.

    Each tree draws its rows from the whole table, whatever share that is; no task
    holds more than ``group_rows`` of them. ``pool`` draws all trees from a sample
    of so many rows instead.
    """
    spark = df.sparkSession
    # The sampling hash and the rows have to be the same in every pass.
    numeric = df.select(F.col(key).alias("_id"), *_numbers(features))
    total = numeric.count()
    if total == 0:
        raise ValueError("a forest needs rows to grow on")
    size = rows_per_tree(total, max_samples)
    pool_rows = total if pool is None else min(total, max(size, pool))
    drawn_from = numeric if pool is None else seeded_sample(numeric, "_id", pool_rows, seed, bracket_rows)

    def drawn(tree: Column) -> Column:
        bits = F.xxhash64(F.lit(seed), tree, F.col("_id"))
        return F.shiftrightunsigned(bits, 11) / F.lit(float(2 ** 53))

    width = max(1, int(max_features * len(features)))
    path = path or os.path.join(scratch_path(spark, "forest"), "nodes")
    if size > min(group_rows, PLAIN_ROWS):
        rows = reliable(drawn_from)  # read once per level
        # Every open node of a level holds more than group_rows rows of the sample, so a tree's upper nodes are bounded.
        at_once = max(1, min(MOST_UPPER // (2 * deepest(size) * (size // group_rows + 1)), MOST_HANDED // (size * width * 8)))
        at_once = math.ceil(trees / math.ceil(trees / at_once))  # blocks of like size
        for first in range(0, trees, at_once):
            block = range(first, min(first + at_once, trees))
            grown = _grown_by_level(rows, features, drawn, size, pool_rows, block, width, seed, group_rows)
            grown.write.mode("append" if first else "overwrite").parquet(path)
            del grown
            gc.collect()
            spark.sparkContext._jvm.System.gc()  # frees the rows that were handed on before others are
    else:
        _grown_in_groups(drawn_from, features, drawn, size, pool_rows, trees, width, seed).write.mode("overwrite").parquet(path)
    forest = Forest(path, list(features), trees, size, contamination)
    return _with_cut(forest, df, bracket_rows)


def _grown_in_groups(drawn_from: DataFrame, features: list[str], drawn, size: int, total: int, trees: int, width: int,
                     seed: int) -> DataFrame:
    """The nodes of trees whose samples one task can hold."""
    if total <= POOL_PARTS * 10_000:
        drawn_from = drawn_from.repartition(POOL_PARTS)  # few rows: spread them, because each meets every tree
    # Each tree draws from the pool the rows with the smallest hash of (seed, tree,
    # row). A row is copied only for trees that may draw it: few more than needed.
    # The draws are compared in generated code; inside a lambda they would be interpreted.
    margin = (size + 6.0 * math.sqrt(size) + 10.0) / total
    numbers = F.sequence(F.lit(0), F.lit(trees - 1))
    candidates = (
        drawn_from.withColumn("tree", F.explode(numbers)).withColumn("_u", drawn(F.col("tree"))).filter(F.col("_u") < margin)
    )

    def build(group: pd.DataFrame) -> pd.DataFrame:
        tree = int(group["tree"].iloc[0])
        chosen = group.sort_values(["_u", "_id"]).head(size)
        columns = columns_of(seed, tree, len(features), width)
        values = [chosen[features[f]].to_numpy(dtype=np.float64) for f in columns]
        return _table(tree, numbered(grow(values, columns, seed, tree, deepest(size)).tuples()))

    return candidates.groupBy("tree").applyInPandas(build, NODE_SCHEMA)


def _with_cut(forest: Forest, df: DataFrame, bracket_rows: int) -> Forest:
    """Fit the cut and the range of scores on training rows. The scores are
    written once and read by the passes that look for the cut."""
    scores = reliable(scored(df.select(*forest.features), forest, "s").select("s"))
    ends = scores.agg(F.min("s").alias("low"), F.max("s").alias("high")).first()
    cut = percentile(scores, "s", forest.contamination, bracket_rows)
    return Forest(**{**forest.__dict__, "cut": cut, "low": ends["low"], "high": ends["high"]})


def scored(df: DataFrame, forest: Forest, name: str = "forest_score") -> DataFrame:
    """Add the score of each row, -1 (isolated at once) .. 0; lower is more unusual.

    A forest that is too large to broadcast at once is walked in blocks of trees:
    the sums of the paths are stored between the blocks, and a block's nodes are let go once they are.
    """
    spark = df.sparkSession
    *blocks, last = _blocks(forest, spark)
    rows, stored = df, None

    def walked(block):
        length, shared = _walk(forest, spark, *block)
        return rows.withColumn(name, length if rows is df else F.col(name) + length), shared

    for block in blocks:
        rows, shared = walked(block)
        if df.isStreaming:
            continue
        rows, old = reliable(rows), stored
        shared.destroy()
        if old is not None:
            discard(old)
        stored = rows
    rows, _ = walked(last)
    scale = forest.trees * mean_path(forest.tree_rows) or 1.0
    return rows.withColumn(name, -F.pow(F.lit(2.0), -F.col(name) / F.lit(scale)))


def _blocks(forest: Forest, spark: SparkSession) -> list[tuple[int, int]]:
    """Ranges of trees with at most MOST_NODES nodes; a tree with more is a range of its own."""
    sizes = forest.nodes(spark).groupBy("tree").agg(F.count(F.lit(1)).alias("n")).orderBy("tree").collect()
    blocks, first, nodes = [], sizes[0]["tree"], 0
    for row in sizes:
        if nodes and nodes + row["n"] > MOST_NODES:
            blocks.append((first, row["tree"] - 1))
            first, nodes = row["tree"], 0
        nodes += row["n"]
    return [*blocks, (first, sizes[-1]["tree"])]


def _path_column(forest: Forest, spark: SparkSession, first: int, last: int) -> Column:
    """Summed length of the paths of a row through a block of trees."""
    return _walk(forest, spark, first, last)[0]


def _packed(nodes: pa.Table) -> pa.Table:
    """Features, values (threshold, of a leaf its length) and both children of the nodes of a tree, in a row.

    The root comes first, then the children of each split, side by side; a leaf is its own child. Nodes may have any numbers.
    """
    nodes = nodes.sort_by("node")
    number, feature = nodes["node"].to_numpy(), nodes["feature"].to_numpy()
    splits = np.flatnonzero(feature >= 0)
    left, right = (np.searchsorted(number, nodes[side].to_numpy()[splits]) for side in ("left", "right"))
    place = np.zeros(len(number), np.int64)
    place[left] = 1 + 2 * np.arange(len(splits))
    place[right] = place[left] + 1
    children = np.repeat(place, 2).reshape(-1, 2)
    children[splits] = np.column_stack((place[left], place[right]))
    order = np.argsort(place, kind="stable")
    value = np.where(feature < 0, nodes["length"].to_numpy(), nodes["threshold"].to_numpy())
    found = np.maximum(feature, 0).astype(np.int16), value, children.astype(np.int32)
    return pa.table({"tree": nodes["tree"][:1].cast(pa.int32()), "n": pa.array([len(number)]), **{
        k: pa.array([v[order].tobytes()], pa.binary()) for k, v in zip(("feature", "value", "children"), found)}})


def _packed_trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each tree of a task; all its nodes are there."""
    held = list(batches)
    if held:
        nodes = pa.Table.from_batches(held)
        for tree in nodes["tree"].unique():
            yield from _packed(nodes.filter(pc.equal(nodes["tree"], tree))).to_batches()


# One block of trees at a time is put together on the driver.
_PACKING = threading.Lock()


def _together(trees: pa.Table) -> tuple[np.ndarray, ...]:
    """Roots, features, values and both children of the nodes of all trees."""
    trees = trees.sort_by("tree")
    n = trees["n"].to_numpy()
    roots = np.cumsum(n) - n
    feature, value, children = (np.empty(n.sum() * each, kind) for each, kind in ((1, np.int16), (1, np.float64), (2, np.int32)))
    for i, root in enumerate(roots):
        here = slice(root, root + n[i])
        feature[here] = np.frombuffer(trees["feature"][i].as_buffer(), np.int16)
        value[here] = np.frombuffer(trees["value"][i].as_buffer(), np.float64)
        np.add(np.frombuffer(trees["children"][i].as_buffer(), np.int32), np.int32(root), out=children[2 * root:2 * (root + n[i])])
    return roots, feature, value, children


def _walk(forest: Forest, spark: SparkSession, first: int, last: int) -> tuple[Column, Broadcast]:
    """Summed length of the paths of a row through a block of trees, and the nodes that it needs."""
    block = forest.nodes(spark).filter(F.col("tree").between(first, last))
    # As many tasks as there is work for; left to itself, Spark makes few of a table that is small when compressed.
    parts = max(1, min(last - first + 1, 2 * forest.tree_rows * (last - first + 1) // PACKED_ROWS))
    packed = block.repartitionById(parts, (F.col("tree") - first) % parts).mapInArrow(
        _packed_trees, "tree int, n bigint, feature binary, value binary, children binary")
    with _PACKING:
        shared = spark.sparkContext.broadcast(_together(packed.toArrow()))  # at most MOST_NODES nodes, or a tree
    levels = math.ceil(math.log2(max(forest.tree_rows, 2)))

    @F.pandas_udf("double")
    def walk(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        roots, *nodes = shared.value
        held = []
        for columns in batches:
            columns = [columns] if isinstance(columns, pd.Series) else columns  # a single feature
            held.append(np.column_stack([*(c.to_numpy(dtype=np.float64) for c in columns), np.full(len(columns[0]), -np.inf)]))
            if sum(map(len, held)) >= HELD_ROWS:
                yield from map(pd.Series, path_lengths(held, levels, roots, *nodes))
                held = []
        yield from map(pd.Series, path_lengths(held, levels, roots, *nodes))

    return walk(*_numbers(forest.features)), shared


_NODE = np.dtype([("value", np.float64), ("child", np.int32), ("feature", np.int32)])


def path_lengths(batches: list[np.ndarray], levels: int, roots, feature, value, children) -> list[np.ndarray]:
    """Summed path lengths of the rows of each batch through all trees; the last value of a row is below all others.

    A tree is unpacked so that a level reads a node at once, and all rows go down a level at a time. A leaf compares the
    last value with its length, so rows stay there.
    """
    totals = [np.zeros(len(values)) for values in batches]
    if not batches:
        return totals
    width = batches[0].shape[1]
    parts = [(values[start:start + SCORE_ROWS], total[start:start + SCORE_ROWS])
             for values, total in zip(batches, totals) for start in range(0, len(values), SCORE_ROWS)]
    for root, end in zip(roots, [*roots[1:], len(feature)]):
        nodes = np.empty(end - root, _NODE)
        nodes["value"], nodes["child"] = value[root:end], children[2 * root:2 * end:2] - np.int32(root)
        nodes["feature"] = np.where(nodes["child"] == np.arange(end - root), width - 1, feature[root:end])
        whole = nodes.view(np.complex128)  # numbers of the same size, which are read faster
        for values, total in parts:
            n = len(values)
            flat, begin, at = values.ravel(), np.arange(n) * width, np.zeros(n, np.intp)
            here, place, seen, right = np.empty(n, _NODE), np.empty(n, np.intp), np.empty(n), np.empty(n, bool)
            taken = here.view(np.complex128)
            for _ in range(levels):
                whole.take(at, out=taken, mode="clip")
                np.add(begin, here["feature"], out=place)
                flat.take(place, out=seen, mode="clip")
                np.greater(seen, here["value"], out=right)
                np.add(here["child"], right, out=at)
            total += value[root:end].take(at)
    return totals


def is_outlier(forest: Forest, score: str = "forest_score") -> Column:
    return F.coalesce(F.col(score) < F.lit(forest.cut), F.lit(False))


def batch_range(df: DataFrame, score: str = "forest_score") -> tuple[float | None, float | None]:
    ends = df.agg(F.min(score).alias("low"), F.max(score).alias("high")).first()
    return ends["low"], ends["high"]


def probability(score: str, low: float | None, high: float | None, clipped: bool = False) -> Column:
    """1 for the lowest score of the range, 0 for the highest; NULL for a range of
    no width. With the range of one batch this is the batch mode; with the fitted
    range and ``clipped`` it also serves streams."""
    low_, high_ = F.lit(low).cast("double"), F.lit(high).cast("double")
    value = F.lit(1.0) - F.try_divide(F.col(score) - low_, high_ - low_)
    if not clipped:
        return value
    return F.when(value.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)))
