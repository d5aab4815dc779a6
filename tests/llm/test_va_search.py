"""Exact search against all products."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from test_operators import CLASHING, SF_DIR, bag
from txrisk.llm import queries, va_search

VECTORS = "vec_id bigint, embedding array<double>, label int"


def found(df):
    return bag(tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect())


def test_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()]
    assert found(queries.op12_va_search(spark, SF_DIR)) == bag(brute.top_products(rows))


@pytest.mark.parametrize("file_block, query_block", [(16_384, 4_096), (40, 7)])
def test_odd_rows(spark, monkeypatch, file_block, query_block):
    monkeypatch.setattr(va_search, "FILE_BLOCK", file_block)
    monkeypatch.setattr(va_search, "QUERY_BLOCK", query_block)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).round(3).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[50][1]) for i in range(120)] + [(50, rows[50][1]), (50, rows[7][1]), (None, rows[50][1])]  # copies of a query
    rows += [(2000 + i, (np.array(rows[100][1]) + rng.normal(size=8) * 1e-3).tolist()) for i in range(60)]  # near copies
    rows += [(3000, None), (3050, [None] * 8), (3100, [float("nan")] * 8), (3150, [1.0] * 7 + [float("inf")]), (3200, [1e307] * 8)]
    rows += [(3250, [0.0] * 8), (3300, []), (3301, []), (3350, [1.0, 2.0]), (3351, [2.0, -1.0]), (3400, [-0.0, 0.001] * 4)]
    rows += [(3450, [1e12, -3e11] * 4), (3451, [1e17] * 8), (3500, [1e300, -1e300] + [0.5] * 6), (3501, [1e40] * 8)]
    df = spark.createDataFrame([(k, v, 1) for k, v in rows], VECTORS).withColumns(
        {name: F.lit("clash") for name in (*CLASHING, "row", "exact", "dims", "qb", "fb", "query", "mark", "rank", "score")})
    assert found(va_search.searched(df.repartition(3))) == bag(brute.top_products(rows))


def test_no_rows_and_no_queries(spark):
    assert va_search.searched(spark.createDataFrame([], VECTORS)).count() == 0
    assert va_search.searched(spark.createDataFrame([(1, [1.0], 0), (2, [1.0], 0)], VECTORS)).count() == 0
    assert va_search.searched(spark.createDataFrame([(50, [1.0], 0)], VECTORS)).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(5)
    x = np.floor(rng.normal(size=(400, 16)) * 256)
    x[3, 2], x[4, 4] = 1e15, -1e29
    cells = va_search.Cells(*va_search.Cells.ends(x))
    codes = cells.codes(x)
    low, high = va_search.Bounds(cells, codes).of(x)
    exact = np.array([[sum(int(a) * int(b) for a, b in zip(p, q)) for q in x] for p in x[:40]], dtype=object)
    assert all(low[i, j] <= exact[i, j] <= high[i, j] for i in range(40) for j in range(400))
    plain = np.abs(x).max(1) < 1e4
    spread = (high - low)[np.ix_(plain, plain)]
    assert np.median(spread) < 0.2 * np.std(x[plain] @ x[plain].T)


def test_few_vectors_are_read():
    """Reading stops once no bound that is left can reach the last result."""
    rng = np.random.default_rng(6)
    x = np.floor(rng.normal(size=(5000, 16)) * 256)
    cells = va_search.Cells(*va_search.Cells.ends(x))
    _, high = va_search.Bounds(cells, cells.codes(x)).of(x[:1])
    read = []
    real = va_search.products
    try:
        va_search.products = lambda q, v: (read.append(len(v)), real(q, v))[1]
        top = va_search.certain(x[0], -np.inf, high[0], x, np.arange(5000), 6)
    finally:
        va_search.products = real
    assert [p for _, p in top] == np.lexsort((np.arange(5000), -(x @ x[0])))[:6].tolist() and sum(read) < 500
