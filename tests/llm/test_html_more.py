"""The field of the page extraction: Viterbi against all labellings, its sample, held-out pages."""

import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_operators import SF_DIR
from txrisk.llm import html_extraction as he


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet(f"{SF_DIR}/pages.parquet")


@pytest.fixture(scope="module")
def field(pages):
    return he.learnt(pages)


def test_math_stays_in_its_paragraph():
    blocks = he.leaf_blocks("<article><p>Energy is <math><mi>E</mi><mo>=</mo><mi>m</mi><annotation>E=m</annotation></math> here</p></article>")
    assert [b.text for b in blocks] == ["Energy is E=m here"]


def test_sample_is_fetched_by_key(spark, pages):
    drawn = he.drawn(pages, "page_id", "html", 7)
    rows = pages.select("html", F.xxhash64(F.col("page_id").cast("string"), F.length("html")).alias("m")).orderBy("m").limit(7).collect()
    assert drawn == [r.html for r in rows]
    odd = spark.createDataFrame([(1, "<p>a</p>"), (1, "<p>a</p>"), (None, "<p>b</p>"), (2, None), (3, "x" * (he.TRAINING_LENGTH + 1))],
                                "page_id int, html string")
    assert sorted(he.drawn(odd, "page_id", "html", 10)) == ["<p>a</p>", "<p>b</p>"]
    assert he.drawn(odd.limit(0), "page_id", "html", 10) == []


def test_words_of_pages_held_out(spark, field):
    """Word by word on the pages of another table, as far as they label themselves."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").limit(400).collect()
    hit = said = real = 0
    for row in pages:
        blocks = he.leaf_blocks(row.html)
        labels = he.own_labels(blocks)
        if not labels:
            continue
        made = field.decode(blocks)
        for b, got, want in zip(blocks, made, labels):
            n = len(re.findall(r"\w+", b.text))
            hit, said, real = hit + n * (got and want), said + n * bool(got), real + n * bool(want)
    assert real > 1000 and 2 * hit / (said + real) > 0.95


def test_viterbi_is_the_best_of_all_labellings(field):
    """On short pages the decoded labels score highest of all; ties go to the smaller label."""
    rng = np.random.default_rng(5)
    for n in (1, 2, 5, 9):
        blocks = he.leaf_blocks("".join(f"<{t}>{'word ' * int(k)}</{t}>" for t, k in zip(rng.choice(["p", "li", "h2"], n), rng.integers(1, 30, n))))
        for steps in (field.steps, rng.normal(size=(2, 2)) * 2):
            other = he.Field(field.weights, steps)
            e = other.emissions(blocks)
            score = lambda y: sum(e[i] for i in range(len(y)) if y[i]) + sum(steps[a][b] for a, b in zip(y, y[1:]))  # noqa: B023, E731
            best = max(itertools.product((0, 1), repeat=len(blocks)), key=score)
            assert score([int(x) for x in other.decode(blocks)]) == pytest.approx(score(best))
