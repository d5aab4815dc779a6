"""Quality scores by random Fourier features, ridge normal equations and isotonic calibration.

Each text becomes a short vector of statistics. Random cosines of the scaled vector approximate a Gaussian kernel;
the ridge regression of the label on them needs only the sums of outer products, which every partition adds up for
itself and a tree of groups adds up between them. The sums are kept per fold, so the model without a fold is a
subtraction. Scores of rows by the model that has not seen their fold are counted in buckets, and the isotonic fit
over the buckets turns scores into probabilities.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txrisk.session import reliable

COSINES = 384
RIDGE = 1e-3
#: Width of the kernel, in standard deviations per square root of the number of statistics.
WIDTH = 1.0
SEED = 20240607
CUT = 0.7
BUCKETS = 4096
LOW, HIGH = -1.0, 2.0
HELD_OUT, FOLDS = 2, 4
LANES = 32  # of the first level of the sum

CLASSES = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b"\t\r\x0b\x0c", b"#", b"*", b"$",
           b"%", b"&", b"|", b"<>{}[]\\^~`=_", b"!", b"?", b".", b",", b";:", b"'\"()-/@+", bytes(range(128, 256))]
MEMBERS = np.zeros((256, len(CLASSES)))
for _i, _c in enumerate(CLASSES):
    MEMBERS[list(_c), _i] = 1.0


def statistics(text: str | None) -> np.ndarray:
    """The statistics of a whole text; an empty one has zeros."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    out = np.zeros(len(CLASSES) + 10)
    if not words:
        return out
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = counts / len(raw)
    out[:len(CLASSES)] = np.sqrt(share @ MEMBERS)
    n = len(words)
    kinds = len(set(words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    seen = share[share > 0]
    pairs = len(set(zip(words, words[1:]))) if n > 1 else 1
    triples = len(set(zip(words, words[1:], words[2:]))) if n > 2 else 1
    out[len(CLASSES):] = (
        math.log1p(n), math.log1p(len(raw) / n), math.log(kinds + 1) / math.log(n + 1), kinds / n, pairs / max(1, n - 1),
        triples / max(1, n - 2), len(set(lines)) / len(lines), math.log1p(n / len(lines)), -float(seen @ np.log(seen)),
        sum(map(bytes.isupper, words)) / n,
    )
    return out


STATISTICS = len(CLASSES) + 10


def described(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, x): the statistics of every row."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([statistics(t) for t in batch.column(1).to_pylist()], np.float32).reshape(-1, STATISTICS)
            x = pa.ListArray.from_arrays(pa.array(np.arange(len(made) + 1, dtype=np.int32) * STATISTICS), pa.array(made.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), x], names=["key", "x"])

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, x array<float>")


def matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), STATISTICS)


def summed(rows: DataFrame, of) -> dict[int, np.ndarray]:
    """``of(x, y, fold)`` makes {number: vector} of a batch; adds up all batches: within the partition, then by number
    and lane, then by number. What reaches the driver has a fixed size."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                for i, v in of(matrix(batch.column("x")), *[batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "fold")]).items():
                    total[i] = total[i] + v if i in total else v
        lane = TaskContext.get().partitionId() % LANES
        if total:
            yield pa.RecordBatch.from_pydict({"i": pa.array(list(total), pa.int32()), "lane": pa.array([lane] * len(total), pa.int32()),
                                              "v": pa.array([v.astype("<f8").tobytes() for v in total.values()], pa.binary())})

    def add(t: pa.Table) -> pa.Table:
        v = np.sum([np.frombuffer(b, "<f8") for b in t["v"].to_pylist()], axis=0)
        return pa.table({"i": t["i"].slice(0, 1), "lane": t["lane"].slice(0, 1), "v": pa.array([v.astype("<f8").tobytes()], pa.binary())})

    schema = "i int, lane int, v binary"
    parts = rows.mapInArrow(partial, schema).groupBy("i", "lane").applyInArrow(add, schema).groupBy("i").applyInArrow(add, schema)
    return {r.i: np.frombuffer(r.v, "<f8") for r in parts.collect()}


@dataclass
class Model:
    centre: np.ndarray
    scale: np.ndarray
    turn: np.ndarray
    phase: np.ndarray
    weights: dict[int, np.ndarray]  # by the fold left out; -1: none
    levels: tuple[np.ndarray, np.ndarray] = (np.array([0.0]), np.array([0.5]))

    def cosines(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -6, 6) @ self.turn + self.phase
        return np.hstack((np.cos(z) * math.sqrt(2 / z.shape[1]), np.ones((len(z), 1))))

    def raw(self, x: np.ndarray, without: int = -1) -> np.ndarray:
        return self.cosines(x) @ self.weights[without]

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), *self.levels)


def isotonic(at: np.ndarray, n: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the places and levels of a rising curve. Each level is drawn a little to the mean."""
    mean = ones.sum() / n.sum()
    blocks: list[list[float]] = []
    for a, k, o in zip(at, n, ones):
        blocks.append([a * k, k, o])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    return (np.array([s / k for s, k, _ in blocks]), np.array([(o + mean) / (k + 1) for _, k, o in blocks]))


def fit(training: DataFrame, cosines: int = COSINES, ridge: float = RIDGE, width: float = WIDTH, seed: int = SEED) -> Model | None:
    """(x, y, fold) -> the model; None without rows. Two passes over the rows, and one for the calibration."""
    moments = summed(training, lambda x, y, fold: {0: np.concatenate(([len(x)], x.sum(0), (x * x).sum(0)))})
    if not moments:
        return None
    n, total, squares = moments[0][0], moments[0][1:1 + STATISTICS], moments[0][1 + STATISTICS:]
    centre = total / n
    scale = np.sqrt(np.maximum(squares / n - centre ** 2, 0))
    scale = np.where(scale > 1e-6, scale, 1.0)
    rng = np.random.default_rng(seed)
    turn = rng.normal(size=(STATISTICS, cosines)) / (width * math.sqrt(STATISTICS))
    model = Model(centre, scale, turn, rng.uniform(0, 2 * math.pi, cosines), {})

    def outer(x, y, fold):
        out = {}
        for f in np.unique(fold).tolist():
            z = np.hstack((model.cosines(x[fold == f]), y[fold == f, None]))
            products = z.T @ z
            out |= {f * (cosines + 2) + i: row for i, row in enumerate(products)}
        return out

    rows = summed(training, outer)
    folds: dict[int, np.ndarray] = {}
    for i, v in rows.items():
        folds.setdefault(i // (cosines + 2), np.zeros((cosines + 2, cosines + 2)))[i % (cosines + 2)] = v
    whole = sum(folds.values())
    for left_out in [-1, *folds]:
        a = whole - folds[left_out] if left_out >= 0 and len(folds) > 1 else whole
        penalty = np.full(cosines + 1, ridge * max(1.0, a[cosines, cosines]))
        penalty[-1] = 1e-6
        model.weights[left_out] = np.linalg.solve(a[:-1, :-1] + np.diag(penalty), a[:-1, -1])
    step = (HIGH - LOW) / BUCKETS

    def counted(x, y, fold):
        s = np.concatenate([model.raw(x[fold == f], f) for f in np.unique(fold).tolist()])
        label = np.concatenate([y[fold == f] for f in np.unique(fold).tolist()])
        at = np.clip(((s - LOW) / step).astype(int), 0, BUCKETS - 1)
        return {0: np.concatenate((np.bincount(at, minlength=BUCKETS), np.bincount(at, label, minlength=BUCKETS)))}

    counts = summed(training, counted)[0]
    seen, ones = counts[:BUCKETS], counts[BUCKETS:]
    there = seen > 0
    model.levels = isotonic((LOW + (np.arange(BUCKETS) + 0.5) * step)[there], seen[there], ones[there])
    return model


def scored(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
           cut: float = CUT, **settings) -> DataFrame:
    """One row per row of ``docs``: key, held_out, score, predicted.

    Labels are read only of keys that are not held out, and only the statistics of the text go into a score. Missing
    texts are empty, and empty ones get a score like any other; rows without a key are scored, never learnt from;
    missing labels are not learnt from; rows that repeat each other get one score; a key labelled twice counts twice.
    Without any label, each score is 0.5. No rows give no rows. Other columns may have any name.
    """
    rest = F.crc32(F.col("key").cast("string").cast("binary")) % FOLDS
    rows = reliable(described(docs, key, text).withColumn("fold", rest.cast("int")))
    known = labels.select(F.col(key).alias("key"), F.col(label).cast("double").alias("y")).filter(
        F.col("key").isNotNull() & F.col("y").isNotNull() & (rest != HELD_OUT))
    training = reliable(rows.filter(F.col("fold") != HELD_OUT).join(known, "key").select("x", "y", "fold"))
    model = fit(training, **settings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("x"))
            made = model.score(x) if model else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("fold"), pa.array(made)], names=["key", "fold", "score"])

    out = rows.select("key", "x", "fold").mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, fold int, score double")
    return out.select(F.col("key").alias(key), F.coalesce(F.col("fold") == HELD_OUT, F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= cut).cast("int").alias("predicted"))
