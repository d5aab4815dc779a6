"""SimHash near-duplicates through segment popcounts.

A fingerprint of 64 bits is mapped to the bit counts of its 32 segments of two bits. A differing bit moves one count by
one, so the Manhattan distance of the counts is a lower bound of the Hamming distance. If it is at most three, one of
the two halves (16 counts) is at most one apart. So a grid with the counts of a half as its cell finds every pair: a
fingerprint goes to its own cell as an owner and, one count raised by one, to the cells above it as a visitor; owners
meet owners and visitors there. What meets is held against the lower bound, then compared exactly.

Counts are kept in unary (00, 01, 11), so that the Manhattan distance is the number of differing bits of two codes.

Equal fingerprints are one vertex. A cell emits a spanning forest of its links, never all of them; a cell with many
fingerprints is cut into blocks, and each pair of blocks is a task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txrisk.llm.common import prefix
from txrisk.llm.graph import components
from txrisk.session import reliable

SHINGLE = 3
MOST_BITS = 3
SEED = 42
ODD = np.uint64(0x5555555555555555)
LOW = np.uint64(0xFFFFFFFF)
#: Rows of a cell beyond which it is cut into blocks, and rows of a block.
CELL_ROWS = 2048
#: Runs up to this length emit their links; longer ones a spanning forest.
SMALL = 8


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The SimHash of a text, unsigned; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    take = xxhash.xxh64_intdigest
    hashes = np.fromiter((take(joined[b:e], SEED) for b, e in zip(begins[: len(words) - shingle + 1].tolist(),
                                                                 ends[shingle - 1:].tolist())), np.uint64, len(words) - shingle + 1)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        bits = np.unpackbits(hashes[i:i + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * counts > len(hashes)).tolist()))


def signed(values) -> np.ndarray:
    return np.asarray(values, np.uint64).view(np.int64)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(key, fp): fp is the fingerprint's 64 bits as a signed number. A missing text has no words."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = signed([fingerprint(t, shingle) for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.int64())], names=["key", "fp"])

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, fp bigint")


def unary(fp: np.ndarray) -> np.ndarray:
    """The counts of the two-bit segments, in unary."""
    either, both = (fp | (fp >> np.uint64(1))) & ODD, (fp & (fp >> np.uint64(1))) & ODD
    return either | (both << np.uint64(1))


def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fp) -> (cell, fp, own): the cell of each half, and the cells with one count more."""
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        code = unary(fp)
        out = []
        for half in (0, 1):
            part = (code >> np.uint64(32 * half)) & LOW
            mark = np.uint64(half) << np.uint64(32)
            out.append((part | mark, fp, np.ones(len(fp), bool)))
            for i in range(0, 32, 2):
                low, high = np.uint64(1) << np.uint64(i), np.uint64(2) << np.uint64(i)
                room = (part & high) == 0
                one = part[room]
                raised = np.where(one & low, one | high, one | low)
                out.append((raised | mark, fp[room], np.zeros(len(one), bool)))
        cell, who, own = (np.concatenate(x) for x in zip(*out))
        yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), pa.array(who.view(np.int64)), pa.array(own)],
                                         names=["cell", "fp", "own"])


def near(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Which pairs are within the distance: the lower bound first, the exact one for what is left."""
    ok = np.bitwise_count(unary(a) ^ unary(b)) <= most
    ok[ok] = np.bitwise_count(a[ok] ^ b[ok]) <= most
    return ok


def forest(own: np.ndarray, rest: np.ndarray, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """A spanning forest of the links own-own and own-rest. Walks from node to node; each looks at those not yet reached."""
    nodes = np.concatenate((own, rest))
    codes, owner = unary(nodes), np.arange(len(nodes)) < len(own)
    open_ = np.arange(len(nodes))
    stack: list[int] = []
    out = []
    while len(open_):
        if stack:
            at = stack.pop()
        else:
            at, open_ = int(open_[0]), open_[1:]
        left = open_[np.bitwise_count(codes[open_] ^ codes[at]) <= most]
        hit = left[np.bitwise_count(nodes[left] ^ nodes[at]) <= most]
        if not owner[at]:
            hit = hit[owner[hit]]
        if len(hit):
            out.append((np.full(len(hit), nodes[at]), nodes[hit]))
            stack += hit.tolist()
            open_ = open_[~np.isin(open_, hit, assume_unique=True)]
    return out


def links(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows (cell, part, fp, own), sorted by cell and part -> links (a, b). Holds one run of equal cell and part at a time."""
    held: tuple | None = None

    def put(found) -> pa.RecordBatch:
        a, b = (np.concatenate(x) if x else np.empty(0, np.uint64) for x in (list(zip(*found)) or ((), ())))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    def work(cell, part, fp, own) -> list:
        if not len(cell):
            return []
        starts = np.flatnonzero(np.concatenate(([True], (cell[1:] != cell[:-1]) | (part[1:] != part[:-1]))))
        sizes = np.diff(np.concatenate((starts, [len(cell)])))
        found = []
        for size in range(2, SMALL + 1):
            at = starts[sizes == size]
            for i in range(size):
                for j in range(i + 1, size):
                    a, b, either = fp[at + i], fp[at + j], own[at + i] | own[at + j]
                    ok = either & (a != b)
                    ok[ok] = near(a[ok], b[ok], most)
                    if ok.any():
                        found.append((a[ok], b[ok]))
        for s, size in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
            run, mine = fp[s:s + size], own[s:s + size]
            owners = np.unique(run[mine])
            if len(owners):
                found += forest(owners, np.setdiff1d(run[~mine], owners), most)
        return found

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        cols[2] = cols[2].view(np.uint64)
        if held is not None:
            cols = [np.concatenate((h, c)) for h, c in zip(held, cols)]
        cell, part = cols[0], cols[1]
        other = np.flatnonzero((cell != cell[-1]) | (part != part[-1]))
        cut = int(other[-1]) + 1 if len(other) else 0
        found = work(*[c[:cut] for c in cols])
        held = tuple(c[cut:] for c in cols)
        if found:
            yield put(found)
    if held is not None:
        found = work(*held)
        if found:
            yield put(found)


def linked(vertices: DataFrame, most: int = MOST_BITS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(fp), distinct -> links (a, b) that connect exactly what pairs at ``most`` or fewer differing bits connect."""
    if not 0 <= most <= 3:
        raise ValueError("two halves find distances up to 3")
    spread = vertices.select("fp").mapInArrow(cells, "cell bigint, fp bigint, own boolean")
    crowded = reliable(spread.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("own").alias("some"))
                       .filter("n > 1 AND some").select("cell", F.ceil(F.col("n") / cell_rows).cast("int").alias("blocks")))
    rows = spread.join(crowded, "cell")
    block = F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")).otherwise(0)
    all_blocks = F.sequence(F.lit(0), F.col("blocks") - 1)
    # The pair (i, j) gets the owners of block i and everybody of block j.
    left = F.when(F.col("own"), F.transform(all_blocks, lambda j: F.col("block") * F.col("blocks") + j))
    right = F.transform(all_blocks, lambda i: i * F.col("blocks") + F.col("block"))
    parts = F.array_distinct(F.concat(right, F.coalesce(left, F.array().cast("array<int>"))))
    rows = rows.withColumn("block", block).select("cell", F.explode(parts).alias("part"), "fp", "own")
    sorted_rows = rows.repartition("cell", "part").sortWithinPartitions("cell", "part")
    return sorted_rows.mapInArrow(lambda it: links(it, most), "a bigint, b bigint")


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, most: int = MOST_BITS,
           cell_rows: int = CELL_ROWS) -> DataFrame:
    """One row per row of ``docs``: key, fp, component_id (the smallest key that links lead to, its own included).

    Texts without words have fingerprint zero and link like any other. Rows that repeat each other share a component;
    rows without a key are linked, but never name a component unless nobody else is in it. No rows give no rows. Other
    columns may have any name.
    """
    marks = reliable(fingerprints(docs, key, text, shingle))
    vertices = reliable(marks.groupBy("fp").agg(F.min("key").alias("least")))
    labels = components(linked(vertices, most, cell_rows))
    rooted = vertices.join(labels, vertices["fp"] == labels["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = rooted.join(named, "root").select("fp", "component_id")
    return marks.join(by_fp, "fp").select(F.col("key").alias(key), "fp", "component_id")


def digits(fp: str) -> Column:
    """The fingerprint as 16 lowercase hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def first_of_groups(docs: DataFrame, **settings) -> DataFrame:
    """The document with the smallest doc_id of every group, all columns as they were; of rows that repeat each other
    with one doc_id, all stay. A group without any doc_id stays whole."""
    own = f"{prefix(docs)}id"
    firsts = (groups(docs, **settings).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
              .select(F.col("doc_id").alias(own)).distinct())
    return docs.join(firsts.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col(own)), "left_semi")
