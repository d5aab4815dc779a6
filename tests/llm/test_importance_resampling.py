"""Importance resampling against a plain version."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import brute
from test_operators import CLASHING, DOCUMENT, LONG, ODD, PROSE, SF_DIR, bag
from txrisk.llm import importance_resampling as ir
from txrisk.llm import queries
from txrisk.session import reliable

RESULT = ["doc_id", "n_features", "weight", "score", "rank"]


def texts(spark, name, key):
    return [(r[key], r.text) for r in spark.read.parquet(f"{SF_DIR}/{name}.parquet").collect()]


def test_query(spark):
    want = brute.resampled(texts(spark, "documents", "doc_id"), [t for _, t in texts(spark, "benchmark", "item_id")])
    made = queries.op13_importance_resampling(spark, SF_DIR)
    assert made.columns == RESULT and {t for _, t in made.dtypes} == {"bigint"}
    assert bag(tuple(r) for r in made.collect()) == bag(want)


def test_odd_rows(spark):
    rows = ODD + [(200 + i // 3, f"{PROSE} number {i // 3}", "en", "a", 1) for i in range(90)] + [(None, PROSE + " and more", None, "a", None)] * 3
    rows += [(400, "x" * 500 + " " + PROSE + " " + "é" * 300, "en", "a", 1), (401, "AKb \x00 CÉ", "en", "a", 1)]
    target = [PROSE, None, "", "dog " * 5]
    docs = spark.createDataFrame(rows, DOCUMENT).withColumns({name: F.lit("clash") for name in (*CLASHING, "row", "score", "weight", "rank", "place", "part")})
    made = ir.resampled(docs.repartition(3), spark.createDataFrame([(t, 1) for t in target], "text string, n int"))
    want = brute.resampled([r[:2] for r in rows], target)
    assert bag(tuple(r) for r in made.select(RESULT).collect()) == bag(want) and sum(r[4] is not None for r in want) == 5


def test_no_rows(spark):
    nothing, some = spark.createDataFrame([], DOCUMENT), spark.createDataFrame(ODD, DOCUMENT)
    assert ir.resampled(nothing, some).count() == 0
    assert bag(tuple(r) for r in ir.resampled(some, nothing).select(RESULT).collect()) == bag(brute.resampled([r[:2] for r in ODD], []))


@pytest.mark.parametrize("size", [1, 40, 2_000_000])
def test_pieces_change_nothing(size):
    rows = [r[1] or "" for r in ODD] + ["ab", "cd", "", "tail1", "1head two", "é", "é x"] + ["w" * 90 + " a b " + "z" * 70]
    if size == 1:
        rows = [r if len(r) < 1000 else r[-300:] for r in rows]
    array = pa.array(["skipped", *rows])[1:]
    words, found = np.zeros(len(rows), int), [[] for _ in rows]
    for word, of, bucket in ir.counted(array, ir.BUCKETS, size):
        words += np.bincount(word, minlength=len(rows))
        for d, b in zip(of.tolist(), bucket.tolist()):
            found[d].append(b)
    for row, n, made in zip(rows, words, found):
        want = brute.run_buckets(row)
        assert n == want[0] and sorted(made) == sorted(want[1])
    assert len(LONG) > 100_000


def test_checksums_of_appended_strings():
    rng = np.random.default_rng(1)
    a = [rng.bytes(int(n)) for n in rng.integers(0, 40, 200)]
    b = [rng.bytes(int(n)) for n in rng.integers(0, ir.LONG_WORD + 1, 200)]
    crc = lambda xs: np.array([zlib.crc32(x) for x in xs], np.uint32)
    made = ir.appended(crc(a), crc(b), np.array([len(x) for x in b]))
    assert list(made) == [zlib.crc32(x + y) for x, y in zip(a, b)]


def test_quickselect_finds_every_place(spark):
    """Ties in score, in id, and missing ids: the k-th key is that of the sorted rows, whatever k."""
    rng = np.random.default_rng(2)
    rows = [(int(s), None if i % 17 == 0 else int(i), n) for n, (s, i) in enumerate(zip(rng.integers(0, 4, 300), rng.integers(0, 30, 300)))]
    df = reliable(spark.createDataFrame(rows, "score bigint, id bigint, row bigint"))
    order = sorted(rows, key=lambda r: (-r[0], r[1] is None, r[1] or 0, r[2]))
    for k in (1, 2, 150, 299, 300):
        assert tuple(ir.selected(df, k, pivots=3).values()) == order[k - 1]
    assert ir.selected(df, 0) is None
    with pytest.raises(ValueError):
        ir.selected(df, 301)
    assert [(r.score, r.id, r.row) for r in sorted(ir.ranked(df).collect(), key=lambda r: r["rank"])] == order
