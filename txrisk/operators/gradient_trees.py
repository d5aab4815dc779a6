"""Boosted trees by first and second derivatives of the log loss (Chen and Guestrin, 2016), with penalties and a stop on AUC.

Values are put into bins once, at quantiles of the training rows. A tree grows level by level: a pass over the rows adds up
first and second derivatives per open node, feature and bin, in arrays per task and then by one aggregate whose size
depends on depth, features and bins, not on rows; the best splits follow from the sums. Derivatives are added as whole
numbers, so the trees do not depend on the order of the rows. The rows' margins are stored every few trees, so that a
pass walks only the trees since.

With validation rows the AUC of every number of trees is taken, and boosting stops once it has not risen for ``patience``
trees; the trees up to the best remain.
"""

from __future__ import annotations

import json
import math
import os
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from txrisk.constants import FEATURES, SAMPLE_SEED
from txrisk.operators import forest
from txrisk.session import discard, reliable, scratch_path

BINS = 256
#: Trees between two times that margins are stored and the AUC is taken.
STRIDE = 10
#: Steps of the probability in which the AUC is taken.
STEPS = 1 << 16
#: A split has to gain more than this, and more than gamma.
LEAST_GAIN = 1e-6
LEAST_HESSIAN = 1e-16


@dataclass(frozen=True)
class Settings:
    n_estimators: int = 200
    max_depth: int = 6
    learning_rate: float = 0.1
    subsample: float = 0.8
    colsample: float = 0.8
    min_child_weight: float = 1.0
    gamma: float = 0.0
    reg_alpha: float = 0.0
    reg_lambda: float = 1.0
    scale_pos_weight: float | None = 10.0  # None: negatives per positive
    patience: int = 20
    seed: int = SAMPLE_SEED
    features: list[str] = field(default_factory=lambda: list(FEATURES))


@dataclass(frozen=True)
class Node:
    feature: int = -1
    bin: int = 0
    gain: float = 0.0
    value: float = 0.0  # of a leaf


Tree = dict[int, Node]  # by place: root 1, children 2n and 2n + 1


@dataclass(frozen=True)
class Boosted:
    path: str  # table of nodes, as of a forest; ``length`` is the value of a leaf
    features: list[str]
    trees: int
    depth: int
    aucs: list[float]  # after each tree that was tried, where there were validation rows
    gains: list[float]  # per feature, the mean gain of its splits

    def walked(self) -> forest.Forest:
        return forest.Forest(self.path, self.features, self.trees, 1 << self.depth, 0.0)

    def save(self, spark: SparkSession, path: str) -> None:
        nodes = os.path.join(path, "nodes")
        spark.read.schema(forest.NODE_SCHEMA).parquet(self.path).write.mode("overwrite").parquet(nodes)
        settings = json.dumps({**self.__dict__, "path": nodes})
        spark.createDataFrame([(settings,)], "settings string").write.mode("overwrite").parquet(os.path.join(path, "settings"))


def load(spark: SparkSession, path: str) -> Boosted:
    row = spark.read.parquet(os.path.join(path, "settings")).first()
    return Boosted(**{**json.loads(row["settings"]), "path": os.path.join(path, "nodes")})


# ---------------------------------------------------------------- one split


def shrunk(g, alpha: float):
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0.0)


def score(g, h, s: Settings):
    return shrunk(g, s.reg_alpha) ** 2 / (h + s.reg_lambda)


def weight(g: float, h: float, s: Settings) -> float:
    return float(-shrunk(g, s.reg_alpha) / (h + s.reg_lambda)) if h + s.reg_lambda > 0 else 0.0


def best_split(g: np.ndarray, h: np.ndarray, columns: np.ndarray, s: Settings) -> Node | None:
    """The split that gains most, of sums per (feature, bin); rows up to a bin go left. The first one among equals."""
    left_g, left_h = np.cumsum(g, 1)[columns, :-1], np.cumsum(h, 1)[columns, :-1]
    all_g, all_h = g[columns[0]].sum(), h[columns[0]].sum()
    right_g, right_h = all_g - left_g, all_h - left_h
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = score(left_g, left_h, s) + score(right_g, right_h, s) - score(all_g, all_h, s)
    fits = (left_h >= s.min_child_weight) & (right_h >= s.min_child_weight) & (left_h > 0) & (right_h > 0)
    gain = np.where(fits & np.isfinite(gain), gain, -np.inf)
    at = int(np.argmax(gain))
    i, b = divmod(at, gain.shape[1])
    if not gain[i, b] > max(s.gamma, LEAST_GAIN):
        return None
    return Node(int(columns[i]), b, float(gain[i, b]))


@dataclass(frozen=True)
class Walk:
    """A tree as arrays: its nodes by number and those its splits lead to; a node without children leads to itself."""

    number: np.ndarray
    feature: np.ndarray
    bin: np.ndarray
    child: np.ndarray  # of the node at place i at 2i and 2i + 1
    value: np.ndarray
    levels: int

    @staticmethod
    def of(tree: Tree) -> Walk:
        splits = [n for n, x in tree.items() if x.feature >= 0]
        number = np.array(sorted({1, *tree, *(c for n in splits for c in (2 * n, 2 * n + 1))}), np.int64)
        nodes = [tree.get(n, Node()) for n in number.tolist()]
        inner = np.array([x.feature >= 0 for x in nodes])
        child = np.stack([np.where(inner, np.searchsorted(number, 2 * number + side), np.arange(len(number))) for side in (0, 1)], 1)
        return Walk(number, np.array([max(x.feature, 0) for x in nodes]), np.array([x.bin for x in nodes]), child.ravel(),
                    np.array([x.value for x in nodes]), max((n.bit_length() for n in splits), default=0))

    def places(self, bins: np.ndarray) -> np.ndarray:
        """The place of the node that each row comes to, for bins as (row, feature)."""
        flat, offset, at = bins.ravel(), np.arange(len(bins)) * bins.shape[1], np.zeros(len(bins), np.intp)
        for _ in range(self.levels):
            goes_right = flat.take(offset + self.feature.take(at)) > self.bin.take(at)
            at = self.child.take(2 * at + goes_right)
        return at


def places(bins: np.ndarray, tree: Tree) -> np.ndarray:
    """The node that each row comes to, for bins as (row, feature)."""
    walk = Walk.of(tree)
    return walk.number[walk.places(bins)]


def margins(bins: np.ndarray, walks: list[Walk]) -> np.ndarray:
    """What each tree adds, as (row, tree)."""
    out = np.zeros((len(bins), len(walks)))
    for i, walk in enumerate(walks):
        out[:, i] = walk.value[walk.places(bins)]
    return out


def derivatives(margin: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = 1.0 / (1.0 + np.exp(-margin))
    return w * (p - y), np.maximum(w * p * (1 - p), LEAST_HESSIAN)


# ---------------------------------------------------------------- the rows


def edges_of(rows: DataFrame, features: list[str], bins: int = BINS) -> list[np.ndarray]:
    """The upper ends of all bins but the last of each feature, in one aggregate of quantile sketches."""
    shares = [i / bins for i in range(1, bins)]
    found = rows.agg(*[F.percentile_approx(f, shares, 100 * bins).alias(f) for f in features]).first()
    return [np.unique(np.array(found[f], float)) for f in features]


def binned(rows: DataFrame, features: list[str], edges: list[np.ndarray], others: list[str]) -> DataFrame:
    """``others`` and the bins of a row, a byte each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.empty((batch.num_rows, len(features)), np.uint8)
            for i, f in enumerate(features):
                codes[:, i] = np.searchsorted(edges[i], batch.column(f).to_numpy())
            raw = codes.tobytes()
            packed = pa.array([raw[j:j + len(features)] for j in range(0, len(raw), len(features))], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(o) for o in others), packed], names=[*others, "bins"])

    kinds = ", ".join(f"{o} {rows.schema[o].dataType.simpleString()}" for o in others)
    return rows.select(*others, *features).mapInArrow(run, f"{kinds}, bins binary")


def codes_of(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """The bins of the rows, ``width`` bytes each, which lie one after the other."""
    column = batch.column("bins")
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    begin = int(np.frombuffer(offsets, kind, 1, column.offset * kind().itemsize)[0]) if len(column) else 0
    return np.frombuffer(data or b"", np.uint8, len(column) * width, begin).reshape(len(column), width)


def sums(rows: DataFrame, recent: list[Tree], tree: Tree, open_nodes: list[int], width: int, bins: int, scale: int, number: int,
         s: Settings) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """First and second derivatives per open node as (feature, bin) arrays, over the rows that the tree samples."""
    walk, walks, cells = Walk.of(tree), [Walk.of(t) for t in recent], len(open_nodes) * bins
    place = {n: i for i, n in enumerate(open_nodes)}
    known_at = np.array([place.get(n, -1) for n in walk.number.tolist()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_feature = np.zeros((2, width, cells), np.int64)  # of each feature the bins of the first open node, of the second ..
        for batch in batches:
            codes = codes_of(batch, width)
            margin = batch.column("margin").to_numpy() + margins(codes, walks).sum(1)
            g, h = derivatives(margin, batch.column("y").to_numpy(), batch.column("w").to_numpy())
            known = known_at[walk.places(codes)]
            use = known >= 0
            first, codes = known[use] * bins, np.ascontiguousarray(codes[use].T)
            parts = []
            for k, d in enumerate((g, h)):
                whole = np.rint(d[use] * 2.0 ** scale).astype(np.int64)
                # bincount adds doubles; two halves keep whole numbers exact
                parts += [(k, 26, (whole >> 26).astype(float)), (k, 0, (whole & ((1 << 26) - 1)).astype(float))]
            for f in range(width):
                cell = first + codes[f]
                for k, shift, part in parts:
                    by_feature[k, f] += np.bincount(cell, part, cells).astype(np.int64) << shift
        total = by_feature.reshape(2, width, len(open_nodes), bins).swapaxes(1, 2).reshape(2, -1)
        used = np.flatnonzero(total[0] | total[1])
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[0, used]), pa.array(total[1, used])], names=["cell", "g", "h"])

    u = F.pmod(F.xxhash64(F.lit(s.seed), F.lit(number), F.col("k")), F.lit(1 << 40)) / float(1 << 40)
    sampled = rows.filter("NOT val") if s.subsample >= 1 else rows.filter("NOT val").filter(u < s.subsample)
    found = sampled.select("y", "w", "margin", "bins").mapInArrow(run, "cell bigint, g bigint, h bigint").groupBy("cell").agg(
        F.sum("g").alias("g"), F.sum("h").alias("h"))
    out = np.zeros((2, len(open_nodes) * width * bins))
    for r in found.collect():  # nodes of a level x features x bins
        out[:, r["cell"]] = r["g"] / 2.0 ** scale, r["h"] / 2.0 ** scale
    shaped = out.reshape(2, len(open_nodes), width, bins)
    return {n: (shaped[0, i], shaped[1, i]) for i, n in enumerate(open_nodes)}


def grown(add_up, width: int, number: int, s: Settings) -> Tree:
    """One tree; ``add_up(tree, nodes)`` gives the sums of the open nodes."""
    rng = np.random.default_rng([s.seed, number])
    columns = np.sort(rng.choice(width, max(1, round(s.colsample * width)), replace=False))
    tree, open_nodes = {}, [1]
    for depth in range(s.max_depth + 1):
        found = add_up(tree, open_nodes)
        following = []
        for n in open_nodes:
            g, h = found[n]
            split = best_split(g, h, columns, s) if depth < s.max_depth else None
            tree[n] = split or Node(value=s.learning_rate * weight(g[0].sum(), h[0].sum(), s))
            following += [2 * n, 2 * n + 1] if split else []
        open_nodes = following
        if not open_nodes:
            break
    return tree


def aucs_of(rows: DataFrame, recent: list[Tree], width: int) -> list[float]:
    """The AUC on the validation rows after each of the recent trees, of probabilities in steps; ties count half."""
    n, walks = len(recent), [Walk.of(t) for t in recent]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {}
        for batch in batches:
            margin = batch.column("margin").to_numpy()[:, None] + np.cumsum(margins(codes_of(batch, width), walks), 1)
            step = np.floor(STEPS / (1.0 + np.exp(-margin))).astype(np.int64)
            cell = (np.arange(n) * (STEPS + 1) + step) * 2 + batch.column("y").to_numpy().astype(np.int64)[:, None]
            for c, k in zip(*(x.tolist() for x in np.unique(cell, return_counts=True))):
                total[c] = total.get(c, 0) + k
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["cell", "n"])

    found = rows.filter("val").select("y", "margin", "bins").mapInArrow(run, "cell bigint, n bigint")
    found = found.select(F.expr(f"cell div {2 * (STEPS + 1)}").alias("tree"), F.expr(f"(cell div 2) % {STEPS + 1}").alias("step"),
                         F.when(F.expr("cell % 2 = 1"), F.col("n")).otherwise(0).alias("p"), F.when(F.expr("cell % 2 = 0"), F.col("n")).otherwise(0).alias("q"))
    cells = found.groupBy("tree", "step").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    up = Window.partitionBy("tree").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)  # at most STEPS rows
    won = F.col("p").cast("double") * (F.coalesce(F.sum("q").over(up), F.lit(0)) + F.col("q") / 2)
    per = cells.select("tree", "p", "q", won.alias("won")).groupBy("tree").agg(
        F.try_divide(F.sum("won"), F.sum("p").cast("double") * F.sum("q")).alias("auc"))
    known = {r["tree"]: r["auc"] for r in per.collect()}
    return [known.get(i) if known.get(i) is not None else 0.5 for i in range(n)]


def fit(train: DataFrame, settings: Settings = Settings(), val: DataFrame | None = None, label: str = "isFraud",
        key: str = "event_id", bins: int = BINS, path: str | None = None) -> Boosted:
    spark, features = train.sparkSession, settings.features
    inner = {f: f"_x{i}" for i, f in enumerate(features)}

    def numeric(df: DataFrame, is_val: bool) -> DataFrame:
        values = [F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(inner[f]) for f in features]
        return df.select(F.xxhash64(key).alias("k"), (F.col(label) == 1).cast("double").alias("y"), F.lit(is_val).alias("val"), *values)

    of_train = numeric(train, False).fillna(0.0, ["y"])
    counts = of_train.agg(F.count_if(F.col("y") == 1).alias("p"), F.count(F.lit(1)).alias("n")).first()
    if not counts["n"]:
        raise ValueError("boosting needs rows to learn from")
    heavier = settings.scale_pos_weight
    if heavier is None:
        heavier = (counts["n"] - counts["p"]) / counts["p"] if counts["p"] else 1.0
    edges = edges_of(of_train, list(inner.values()), bins)
    rows = of_train if val is None else of_train.unionByName(numeric(val, True).fillna(0.0, ["y"]))
    rows = rows.withColumns({"w": F.when(F.col("y") == 1, F.lit(float(heavier))).otherwise(F.lit(1.0)), "margin": F.lit(0.0)})
    stored = reliable(binned(rows, list(inner.values()), edges, ["k", "y", "val", "w", "margin"]))
    width = len(features)
    scale = min(40, int(62 - math.log2(counts["n"] * max(heavier, 1.0) + 1)))
    trees, recent, aucs = [], [], []

    for number in range(settings.n_estimators):
        add_up = lambda tree, nodes: sums(stored, recent, dict(tree), nodes, width, bins, scale, number, settings)  # noqa: E731, B023
        recent = [*recent, grown(add_up, width, number, settings)]
        if len(recent) == STRIDE or number == settings.n_estimators - 1:
            trees += recent
            if val is not None:
                aucs += aucs_of(stored, recent, width)
                if len(aucs) - 1 - int(np.argmax(aucs)) >= settings.patience:
                    break
            stored, old = reliable(moved(stored, recent, width)), stored
            discard(old)
            recent = []
    discard(stored)
    if val is not None:
        trees, aucs = kept(trees, aucs, settings.patience)
    path = path or os.path.join(scratch_path(spark, "boosted"), "nodes")
    spark.createDataFrame(table(trees, edges), forest.NODE_SCHEMA).write.mode("overwrite").parquet(path)
    return Boosted(path, list(features), len(trees), settings.max_depth, aucs, mean_gains(trees, width))


def kept(trees: list[Tree], aucs: list[float], patience: int) -> tuple[list[Tree], list[float]]:
    """The trees up to the best AUC before it failed to rise for ``patience`` trees, and the AUCs until then."""
    best = 0
    for i, auc in enumerate(aucs):
        if auc > aucs[best]:
            best = i
        if i - best >= patience:
            return trees[:best + 1], aucs[:i + 1]
    return trees[:best + 1], aucs


def moved(rows: DataFrame, recent: list[Tree], width: int) -> DataFrame:
    """The rows with the margins after the recent trees."""
    walks = [Walk.of(t) for t in recent]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margin = batch.column("margin").to_numpy() + margins(codes_of(batch, width), walks).sum(1)
            yield batch.set_column(batch.schema.get_field_index("margin"), "margin", pa.array(margin))

    return rows.mapInArrow(run, rows.schema)


def table(trees: list[Tree], edges: list[np.ndarray]) -> list[tuple]:
    """Nodes as a forest has them; a value up to the threshold goes left."""
    out = []
    for i, tree in enumerate(trees):
        for n, x in tree.items():
            if x.feature >= 0:
                out.append((i, n, x.feature, float(edges[x.feature][x.bin]), 2 * n, 2 * n + 1, 0.0))
            else:
                out.append((i, n, -1, 0.0, n, n, float(x.value)))
    return out


def mean_gains(trees: list[Tree], width: int) -> list[float]:
    gains = [[x.gain for t in trees for x in t.values() if x.feature == f] for f in range(width)]
    return [float(np.mean(g)) if g else 0.0 for g in gains]


def scored(df: DataFrame, model: Boosted, name: str = "boosted_probability") -> DataFrame:
    """Add the probability of fraud and the verdict ``<name>_verdict``."""
    walked = model.walked()
    total = F.lit(0.0)
    for block in forest._blocks(walked, df.sparkSession):
        total = total + forest._path_column(walked, df.sparkSession, *block)
    rows = df.withColumn(name, 1.0 / (1.0 + F.exp(-total)))
    return rows.withColumn(f"{name}_verdict", (F.col(name) > 0.5).cast("int"))


def importance(model: Boosted, spark: SparkSession) -> DataFrame:
    """Features by falling share of the mean gain."""
    total = sum(model.gains) or 1.0
    rows = [(f, g / total) for f, g in zip(model.features, model.gains)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def of_params(params: dict, features: list[str]) -> Settings:
    """Settings from searched parameters; others keep their defaults."""
    known = {k: v for k, v in params.items() if k in Settings.__dataclass_fields__}
    return replace(Settings(features=list(features)), **known)
