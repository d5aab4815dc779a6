"""Walks through trees of gradient_trees, and the bins they read."""

import numpy as np
import pyarrow as pa
import pytest

from txrisk.operators import gradient_trees as gt


def test_walks_of_half_grown_and_uneven_trees():
    rng = np.random.default_rng(2)
    bins = rng.integers(0, 9, (500, 3)).astype(np.uint8)
    tree = {1: gt.Node(0, 4, 1.0), 2: gt.Node(value=0.5), 3: gt.Node(2, 2, 1.0), 6: gt.Node(1, 7, 1.0), 7: gt.Node(value=-0.25)}
    at = np.where(bins[:, 0] <= 4, 2, np.where(bins[:, 2] > 2, 7, np.where(bins[:, 1] <= 7, 12, 13)))
    assert (gt.places(bins, tree) == at).all()  # 12 and 13 are still open
    assert (gt.margins(bins, [gt.Walk.of(tree)])[:, 0] == np.select([at == 2, at == 7], [0.5, -0.25])).all()
    assert (gt.places(bins, {}) == 1).all()


@pytest.mark.parametrize("kind", [pa.binary(), pa.large_binary()])
def test_bins_of_a_slice_are_read_in_place(kind):
    codes = np.arange(60, dtype=np.uint8).reshape(20, 3)
    batch = pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in codes], kind)], names=["bins"])
    assert (gt.codes_of(batch, 3) == codes).all()
    assert (gt.codes_of(batch.slice(5, 9), 3) == codes[5:14]).all()
    assert gt.codes_of(batch.slice(0, 0), 3).shape == (0, 3)
