"""NN-descent: the registered query, rare links, long lists, double precision."""

import numpy as np
import pytest

import brute
from test_operators import SF_DIR
from txrisk.llm import nn_descent, queries

VECTORS = "vec_id bigint, embedding array<double>"


def plain(keys, x):
    """key -> (n_links, component_id) by comparing all pairs."""
    x = x / np.abs(x).max(1, keepdims=True)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    pairs = [(i, j) for lo in range(0, len(x), 2000) for i, j in zip(*np.nonzero(x[lo:lo + 2000] @ x.T >= 0.9)) for i in [i + lo] if i > j]
    n = np.bincount(np.array(pairs, int).ravel(), minlength=len(x)) if pairs else np.zeros(len(x), int)
    root = brute.classes(len(x), pairs)
    return {k: (int(n[i]), keys[root[i]]) for i, k in enumerate(keys)}


def made(df):
    rows = df.collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in rows)
    return {r.vec_id: (r.n_links, r.component_id) for r in rows}


@pytest.fixture
def never_all(monkeypatch):
    def refuse(*_):
        raise AssertionError("all were compared with all")

    monkeypatch.setattr(nn_descent, "exact_ties", refuse)


def test_query(spark):
    """The registered query over the whole table."""
    rows = sorted((r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect())
    assert made(queries.op4_nn_descent(spark, SF_DIR)) == plain([k for k, _ in rows], np.array([v for _, v in rows], float))


def test_rare_links_are_found_by_descent(spark, never_all):
    """20 linked vectors among 20,000: too few for the audit to tell, and still not by comparing all."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(20_000, 24))
    x[:10] = x[100:110] + rng.normal(size=(10, 24)) * 0.35
    keys = list(range(len(x)))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in zip(keys, x)], VECTORS)
    want = plain(keys, x)
    assert 10 <= sum(n > 0 for n, _ in want.values()) <= 60
    assert made(nn_descent.linked(df.repartition(8))) == want


def test_saturated_lists_grow(spark, monkeypatch):
    """A group of 25 near vectors saturates lists of 4; all links are counted, and its lists become longer."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 16))
    x[:25] = x[0] + rng.normal(size=(25, 16)) * 0.1
    lengths = []
    real = nn_descent.enlarged

    def told(vertices, graph, most, threshold):
        out = real(vertices, graph, most, threshold)
        if out:
            lengths.append(max(r["n"] for r in out[0].selectExpr("size(list) AS n").collect()))
        return out

    monkeypatch.setattr(nn_descent, "enlarged", told)
    keys = list(range(300))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in zip(keys, x)], VECTORS)
    assert made(nn_descent.linked(df, neighbours=4)) == plain(keys, x)
    assert max(lengths) >= 16


def test_sizes_that_floats_do_not_have(spark):
    rows = [(1, [1e-50, 0.0]), (2, [1.0, 0.0]), (3, [1e300, 0.0]), (4, [0.0, 1e-300]), (5, [0.0, 0.0])]
    got = made(nn_descent.linked(spark.createDataFrame(rows, VECTORS)))
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4), 5: (0, 5)}
