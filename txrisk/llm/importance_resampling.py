"""Importance resampling of documents towards a target distribution.

Features of a text are its runs of one to three words, hashed into buckets. Every task adds up the buckets of its rows in an
array; the sums of the documents and of the target give each bucket a gain, an array of fixed size that every task gets. A
document's weight is the sum of the gains of its features. A keyed draw of the extreme-value distribution is added, so the
highest scores are a sample without replacement, in proportion to the weights.

How many are drawn is a share of the rows, so no row is sorted to find them: distributed quickselect draws random pivots
among the rows that may still be the k-th, counts exactly which rows come before, at and after each pivot, and narrows to
the stretch that holds the k-th key. Keys are (score, id, row), and no two are equal. Only the winners are sorted, by
range partitions, and numbered from the partitions' counts.

CRC-32 of a run follows from those of its words: appending n bytes is a linear map of the register, so the checksums of
all runs of a batch are a few table lookups on arrays.

Odd input: a missing text has no words; a missing id draws as an empty one and comes last among ties. Rows that repeat each
other are rows of their own, drawn one by one. Without target texts, or without documents, gains and weights are defined all the
same; an empty table gives no rows. Texts longer than a piece are worked through in pieces that share two words. Other
columns may have any name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txrisk.llm.common import whole
from txrisk.session import reliable

BUCKETS = 10_000
LONGEST_RUN = 3
LEAST_WORDS = 20
PERCENT = 5
SEED = 42
#: Bytes of text that are worked on at a time.
PIECE = 2_000_000
#: Words of more bytes are checked byte by byte with the runs they are in.
LONG_WORD = 64
#: Random pivots of a round.
PIVOTS = 31

#: Bytes of words, and what ASCII capitals become.
_IS_WORD = np.zeros(256, bool)
_IS_WORD[ord("0"):ord("9") + 1] = _IS_WORD[ord("a"):ord("z") + 1] = _IS_WORD[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32


@lru_cache(1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """The checksum's table for one byte, and for n = 0 .. LONG_WORD + 1 and each byte of the register what it is after n bytes of
    zeros."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1).astype(np.uint32)
    shift = np.empty((LONG_WORD + 2, 4, 256), np.uint32)
    for byte in range(4):
        shift[0, byte] = np.arange(256, dtype=np.uint32) << np.uint32(8 * byte)
    for n in range(1, LONG_WORD + 2):
        shift[n] = step[shift[n - 1] & 255] ^ (shift[n - 1] >> np.uint32(8))
    return step, shift


def appended(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The checksum of two strings, from their checksums and the second's length."""
    _, shift = tables()
    moved = shift[length, 0, first & 255]
    for byte in (1, 2, 3):
        moved ^= shift[length, byte, (first >> np.uint32(8 * byte)) & 255]
    return moved ^ second


def word_sums(data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Checksums of the words of at most LONG_WORD bytes, all words a byte further at a time."""
    step, _ = tables()
    order = np.argsort(-length, kind="stable")
    at, left = begin[order], length[order]
    register = np.full(len(order), 0xFFFFFFFF, np.uint32)
    alive = len(order)
    for i in range(int(left[0]) if len(left) else 0):
        alive = int(np.searchsorted(-left, -i, "left"))  # words longer than i come first
        part = register[:alive]
        register[:alive] = step[(part ^ data[at[:alive] + i]) & 255] ^ (part >> np.uint32(8))
    out = np.empty(len(order), np.uint32)
    out[order] = register ^ np.uint32(0xFFFFFFFF)
    return out


def features(data: np.ndarray, doc: np.ndarray, begin: np.ndarray, length: np.ndarray, fresh: np.ndarray,
             buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of the last word, bucket) of every run that ends with a fresh word; words of a document follow each other."""
    short = length <= LONG_WORD
    sums = np.zeros(len(begin), np.uint32)
    sums[short] = word_sums(data, begin[short], length[short])
    space = np.full(len(begin), np.uint32(zlib.crc32(b" ")))
    clipped = np.minimum(length, LONG_WORD)
    run, fits = sums, short
    ends, found = [], []
    for n in range(1, LONGEST_RUN + 1):
        if n > 1:  # the run that begins a word later, behind this word and a space
            if len(run) < 2:
                break
            kept = run[:-1]
            kept = appended(kept, space[n - 1:], np.ones(len(kept), np.int64))
            run = appended(kept, sums[n - 1:], clipped[n - 1:])
            fits = fits[:-1] & short[n - 1:]
        last = np.arange(n - 1, len(begin))
        use = fresh[last] & (doc[last] == doc[last - (n - 1)])
        plain = use & fits
        ends.append(last[plain])
        found.append(run[plain] % np.uint32(buckets))
        odd = last[use & ~fits]
        if len(odd):
            words = lambda i: b" ".join(data[begin[j]:begin[j] + length[j]].tobytes() for j in range(i - n + 1, i + 1))
            ends.append(odd)
            found.append(np.array([zlib.crc32(words(i)) % buckets for i in odd], np.uint32))
    return np.concatenate(ends), np.concatenate(found).astype(np.int64)


def pieces(offsets: np.ndarray, data: np.ndarray, size: int) -> Iterator[tuple[int, int, int, int]]:
    """(first text, end text, begin byte, end byte): as many whole texts as a piece holds, or a piece of one text, cut between
    words."""
    text, n = 0, len(offsets) - 1
    while text < n:
        end = max(text + 1, int(np.searchsorted(offsets, offsets[text] + size, "right")) - 1)
        at, stop = int(offsets[text]), int(offsets[end])
        while stop - at > size:  # one long text
            cut = at + size
            while cut < stop and _IS_WORD[data[cut]]:
                cut += 1
            yield text, end, at, cut
            at = cut
        yield text, end, at, stop
        text = end


def counted(texts: pa.Array, buckets: int, size: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text of each word, text of each run, bucket of each run), piece by piece."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = _LOWER[np.frombuffer(held, np.uint8)] if held is not None else np.zeros(0, np.uint8)
    before = (-1, np.zeros(0, np.int64), np.zeros(0, np.int64))  # the last words of the piece before: text, begins, lengths
    for text, end, at, stop in pieces(offsets, data, size):
        edges = np.flatnonzero(np.diff(_IS_WORD[data[at:stop]].view(np.int8), prepend=0, append=0))
        # A word that runs over the border of two texts is two words.
        borders = offsets[text + 1:end] - at
        inside = np.unique(borders[(borders > 0) & (borders < stop - at)])
        within = _IS_WORD[data[at + inside]] & _IS_WORD[data[at + inside - 1]]
        begin, finish = edges[::2], edges[1::2]
        if within.any():
            begin, finish = np.sort(np.concatenate([begin, inside[within]])), np.sort(np.concatenate([finish, inside[within]]))
        begin, finish = begin + at, finish + at
        doc = np.searchsorted(offsets[text + 1:end + 1], begin, "right") + text
        fresh = np.ones(len(begin), bool)
        if before[0] == text and at > offsets[text]:
            fresh = np.concatenate([np.zeros(len(before[1]), bool), fresh])
            doc = np.concatenate([np.full(len(before[1]), text), doc])
            begin, finish = np.concatenate([before[1], begin]), np.concatenate([before[1] + before[2], finish])
        length = finish - begin
        if len(begin):
            last, bucket = features(data, doc, begin, length, fresh, buckets)
            yield doc[fresh], doc[last], bucket
        keep = LONGEST_RUN - 1
        mine = doc == end - 1
        before = (end - 1, begin[mine][-keep:], length[mine][-keep:])


def bucket_sums(df: DataFrame, text: str, buckets: int) -> DataFrame:
    """(bucket, n): how many features of all texts fall into each bucket; a task hands on its array of sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, bucket in counted(batch.column(0), buckets):
                total += np.bincount(bucket, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    sums = df.select(whole(text).alias("text")).mapInArrow(run, "bucket bigint, n bigint")
    return sums.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 * ln of the smoothed share of the target by that of the documents), for each bucket."""
    sums = np.zeros((2, buckets), np.int64)
    found = bucket_sums(docs, text, buckets).withColumn("side", F.lit(0)).unionByName(
        bucket_sums(target, target_text, buckets).withColumn("side", F.lit(1)))
    for r in found.collect():  # at most two rows per bucket
        sums[r["side"], r["bucket"]] = r["n"]
    s, t = sums.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def noise(key: Column, seed: int = SEED) -> Column:
    """A draw of the extreme-value distribution, in thousandths, from a hash of the seed and the key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def weighed(docs: DataFrame, gain: np.ndarray, key: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """(id, n_words, n_features, weight, score) of every document."""
    rows = docs.select(F.col(key).alias("id"), whole(text).alias("text"))
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            words, runs, weight = (np.zeros(n, np.int64) for _ in range(3))
            for word, of, bucket in counted(batch.column(1), buckets):
                words += np.bincount(word, minlength=n)
                runs += np.bincount(of, minlength=n)
                weight += np.bincount(of, gain[bucket], n).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (words, runs, weight))],
                                             names=["id", "n_words", "n_features", "weight"])

    kind = rows.schema["id"].dataType.simpleString()
    made = rows.mapInArrow(run, f"id {kind}, n_words bigint, n_features bigint, weight bigint")
    return made.withColumn("score", F.col("weight") + noise(F.col("id"), seed))


# ------------------------------------------------------------ distributed quickselect


def before(pivot: dict, equal: bool = False) -> Column:
    """The row comes before the pivot: a higher score, then a smaller id (missing ones last), then a smaller row."""
    p = {name: F.lit(v) for name, v in pivot.items()}
    score, key, row = F.col("score"), F.col("id"), F.col("row")
    if pivot["id"] is None:
        smaller, same = key.isNotNull(), key.isNull()
    else:
        smaller, same = F.coalesce(key < p["id"], F.lit(False)), F.coalesce(key == p["id"], F.lit(False))
    here = row <= p["row"] if equal else row < p["row"]
    return (score > p["score"]) | ((score == p["score"]) & (smaller | (same & here)))


def selected(rows: DataFrame, k: int, pivots: int = PIVOTS) -> dict | None:
    """The key (score, id, row) of the k-th row of ``rows``, which has that many; none for k = 0.

    A round draws pivots by a hash of the row and the round, and counts in one pass how many rows come before and at each;
    the pivots around the k-th row bound what is looked at next. The stretch becomes about ``pivots`` times shorter.
    """
    if k < 1:
        return None
    above, below, passed, turn = None, None, 0, 0  # the k-th lies after `above` and before `below`; `passed` rows are up to `above`
    while True:
        open_rows = rows
        if above is not None:
            open_rows = open_rows.filter(~before(above, equal=True))
        if below is not None:
            open_rows = open_rows.filter(before(below))
        drawn = open_rows.select("score", "id", "row").orderBy(F.xxhash64("row", F.lit(turn)), "row").limit(pivots).collect()
        if not drawn:
            raise ValueError(f"fewer than {k} rows")
        keys = [r.asDict() for r in drawn]
        keys.sort(key=lambda p: (-p["score"], p["id"] is None, p["id"] if p["id"] is not None else 0, p["row"]))
        counts = open_rows.agg(*[F.count_if(before(p)).alias(f"b{i}") for i, p in enumerate(keys)]).first()
        for i, p in enumerate(keys):
            place = passed + counts[f"b{i}"] + 1
            if place == k:
                return p
            if place > k:
                below = p
                break
        else:
            i = len(keys)
        if i:
            above, passed = keys[i - 1], passed + counts[f"b{i - 1}"] + 1
        turn += 1


def ranked(winners: DataFrame) -> DataFrame:
    """``rank`` from 1, by score and id: partitions by range, sorted each, numbered behind the partitions before."""
    order = [F.desc("score"), F.col("id").asc_nulls_last(), F.col("row")]
    place = F.monotonically_increasing_id()
    laid = winners.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", place)
    laid = reliable(laid.withColumn("part", F.shiftright("place", 33)).withColumn("nth", F.col("place").bitwiseAND((1 << 33) - 1)))
    counts = laid.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("earlier"))  # a row per partition
    return laid.join(counts, "part").withColumn("rank", F.col("earlier") + F.col("nth") + 1).drop("place", "part", "nth", "earlier")


def resampled(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text",
              percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """Every document with n_features, weight, score and rank: of the N documents with at least ``least_words`` words, the
    floor(percent * N / 100) of highest score are drawn and ranked from 1; the others' rank is missing."""
    made = weighed(docs, gains(docs, target, text, target_text, buckets), key, text, seed)
    stored = reliable(made.withColumn("row", F.monotonically_increasing_id()))  # stored, so that rows keep their numbers
    fit = stored.filter(F.col("n_words") >= least_words)
    last = selected(fit, percent * fit.count() // 100)
    if last is None:
        out = stored.withColumn("rank", F.lit(None).cast("long"))
    else:
        wins = (F.col("n_words") >= least_words) & before(last, equal=True)
        out = ranked(stored.filter(wins)).unionByName(stored.filter(~wins).withColumn("rank", F.lit(None).cast("long")))
    return out.select(F.col("id").alias(key), "n_words", "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))

