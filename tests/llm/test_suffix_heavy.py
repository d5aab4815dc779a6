"""Byte strings that meet by a frequent gram: no bucket grows with it."""

import numpy as np
import pyarrow as pa
import pytest

from test_operators import check_suffix
from txrisk.llm import suffix_dedup

GRAM, SIZE = suffix_dedup.GRAM, suffix_dedup.SIZE
SHARED = "=licence:ok="


def common_gram(count, seed=0, passage=""):
    """A third of the texts hold one gram (and a passage behind it) between neighbours of their own; some repeat others."""
    rng = np.random.default_rng(seed)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    rows = []
    for i in range(count):
        text = "".join(rng.choice(letters, 240))
        if i % 3 == 0:
            text = text[:120] + SHARED + passage + text[120:]
        if i % 7 == 3:
            text = text[:100] + rows[int(rng.integers(len(rows)))][1][60:200] + text[100:]
        rows.append((i, text))
    return rows


def smallest_gram(seeds=200):
    """A shared gram that is the smallest of its neighbourhood more often than most: the worst case."""
    best = None
    for i in range(seeds):
        gram = f"=licence:{i:03d}"
        h = suffix_dedup.minimizers(suffix_dedup.eight(np.frombuffer(gram.encode(), np.uint8)), GRAM, GRAM)[0]
        best = min(best or (h, gram), (h, gram))
    return best[1]


@pytest.fixture(scope="module", autouse=True)
def worst_gram():
    global SHARED
    SHARED = smallest_gram()


def bucket_sizes(rows, heavy, buckets=160):
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array(range(len(rows)), pa.int64()),
                                        pa.array([r[1] for r in rows])], names=["key", "mark", "text"])
    out = np.zeros(buckets, np.int64)
    for made in suffix_dedup.shards(iter([batch]), SIZE, GRAM, 20_000, 10_000, buckets, heavy):
        for bucket, segments in zip(made["bucket"].to_pylist(), made["segments"].to_pylist()):
            if segments is not None:
                out[bucket] += suffix_dedup.unbundle(segments, SIZE, GRAM)[5].sum()
    return out


@pytest.mark.parametrize("passage", ["", " all rights are reserved by us"])
def test_no_bucket_grows_with_a_frequent_gram(spark, passage):
    rows = common_gram(3000, passage=passage)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    total = sum(len(t) for _, t in rows)
    hashed = df.selectExpr("doc_id as key", "xxhash64(text) as mark", "text")
    heavy = suffix_dedup.heavy_names(hashed, total, SIZE, GRAM, 4 * total // 160)
    nothing = (np.empty(0, np.uint64), np.empty(0, np.uint64))
    before, after = bucket_sizes(rows, nothing), bucket_sizes(rows, heavy)
    assert len(heavy[0]) and before.max() > 3 * np.median(before)
    assert after.max() < 2 * np.median(after)
    assert bool(len(heavy[1])) == bool(passage)


@pytest.mark.parametrize("passage", ["", " all rights are reserved by us", " all rights are reserved by us and by all that come after"])
def test_split_names_find_the_same(spark, passage):
    rows = common_gram(300, seed=1, passage=passage) + [(900, None), (901, ""), (902, "-" * 400), (903, "-" * 90), (904, SHARED * 20), (905, SHARED * 9)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    check_suffix(rows, suffix_dedup.cleaned(df, shard_bytes=8_000, bucket_bytes=6_000, array_bytes=2_000).collect())


def test_equal_strings_have_equal_names():
    """The names depend on the 50 bytes only, wherever the string lies."""
    rng = np.random.default_rng(3)
    passage = rng.integers(97, 100, SIZE, dtype=np.uint8)  # three letters: smallest grams more than once
    names = set()
    for before in range(40):
        buffer = np.concatenate([rng.integers(97, 100, before, dtype=np.uint8), passage, rng.integers(97, 100, 30, dtype=np.uint8)])
        words = suffix_dedup.eight(buffer)
        minimal = suffix_dedup.minimizers(words, SIZE, GRAM)
        place = suffix_dedup.gram_places(words, minimal, SIZE, GRAM)
        at = np.array([before])
        name = minimal[at] >> np.uint64(24)
        names.add((int(name[0]), int(suffix_dedup.sided(words, at, name, place[at], SIZE, GRAM)[0]), int(suffix_dedup.whole_strings(words, at, SIZE)[0])))
    assert len(names) == 1


def test_places_in_long_buffers():
    buffer = np.random.default_rng(4).integers(0, 256, (1 << 24) + 5000, dtype=np.uint8)
    words = suffix_dedup.eight(buffer)
    minimal = suffix_dedup.minimizers(words, SIZE, GRAM)
    place = suffix_dedup.gram_places(words, minimal, SIZE, GRAM)
    assert place.min() >= 0 and place.max() == SIZE - GRAM
    for lo in ((1 << 23) - 30, (1 << 24) - 30):
        part = suffix_dedup.minimizers(words[lo:lo + 200], SIZE, GRAM)
        assert (place[lo:lo + len(part)] == (part & suffix_dedup.PLACE).astype(int) - np.arange(len(part))).all()


def test_ids_have_to_be_numbers(spark):
    with pytest.raises(TypeError):
        suffix_dedup.cleaned(spark.createDataFrame([("a", "text")], "doc_id string, text string"))
