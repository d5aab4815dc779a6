"""Rows that repeat each other in the mix."""

from collections import Counter

import brute
from txrisk.llm import mixing


def test_repeated_rows_meet_one_set_of_ranges_each(spark):
    text = " ".join(f"w{i}" for i in range(12))
    rows = [(7, text, "a", i) for i in range(300)] + [(8, None, "a", 0), (None, "one two three", "b", 1), (None, "one two three", "b", 2), (9, "x y", None, 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, extra int").repartition(4)
    shares = mixing.shares(docs.select("doc_id", "text", "source"), block_words=5).collect()
    made = mixing.mixed(docs, block_words=5)
    out = made.collect()
    taken, got = Counter(), Counter()
    for r in shares:
        taken[r.doc_id] += r.taken
    for r in out:
        got[r.doc_id] += len(brute.words(r.text))
    assert {k: v for k, v in taken.items() if v} == dict(got)
    # A copy is written at most as often as its most repeated block is taken.
    times = max((x.times for r in shares for x in r.runs), default=0)
    assert max(Counter(r.extra for r in out if r.doc_id == 7).values()) <= times
    sets = [r for r in shares if r.doc_id == 7 and r.taken]
    assert len([r for r in out if r.doc_id == 7]) == sum(max(x.times for x in r.runs) for r in sets)
