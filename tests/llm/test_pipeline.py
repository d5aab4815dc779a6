"""Every stage of the pipeline against brute force over its own input."""

import pytest

import brute
from test_operators import DOCUMENT, ODD, SF_DIR, bag
from txrisk.llm import mixing, quality_rules
from txrisk.session import reliable


@pytest.fixture(scope="module")
def stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(reliable(stage(spark, out[-1], SF_DIR)))
    return out


def rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages_keep_the_columns(stages):
    assert all(df.columns == stages[0].columns for df in stages[1:5])


def test_quality_stage(stages):
    kept = {r.doc_id for r in quality_rules.judged(stages[0]).filter("kept").collect()}
    assert bag(rows(stages[1])) == bag(r for r in rows(stages[0]) if r[0] in kept)


def test_near_dedup_stage(stages):
    before = sorted(rows(stages[1]))
    smallest = brute.near_classes([brute.simhash(t) for _, t in before])
    assert bag(rows(stages[2])) == bag(r for i, r in enumerate(before) if smallest[i] == i)


def test_secret_stage(stages):
    after = dict(rows(stages[3]))
    assert after.keys() == dict(rows(stages[2])).keys()
    for doc_id, text in rows(stages[2]):
        spans = brute.secret_spans(text)
        assert (after[doc_id] == text) == (not spans)
        assert all(text[b:e] not in after[doc_id] for _, b, e in spans)
    assert {r.doc_id for r in stages[3].collect() if r.n_chars != len(r.text)} <= {r.doc_id for r in stages[0].collect() if r.n_chars != len(r.text or "")}


def test_mixing_stage(stages):
    taken = {r.doc_id: r.taken for r in mixing.shares(stages[3]).collect()}
    source = dict(rows(stages[3]))
    made = brute.spread(rows(stages[4]))
    assert {d: sum(len(brute.words(t)) for t in texts) for d, texts in made.items()} == {d: n for d, n in taken.items() if n}
    for doc_id, texts in made.items():
        words = brute.words(source[doc_id])
        for text in texts:
            at = iter(words)
            assert all(w in at for w in brute.words(text))  # in order
            assert text == source[doc_id] or len(brute.words(text)) < len(words)


def test_packing_stage(stages):
    by_doc = brute.spread((r.doc_id, r) for r in stages[5].collect())
    before = brute.spread(rows(stages[4]))
    assert by_doc.keys() == before.keys()
    unique = [(d, t[0]) for d, t in before.items() if len(t) == 1]
    keep = {d for d, _ in unique}
    assert sum(r.length for group in by_doc.values() for r in group) > 0
    from test_operators import ids
    for (doc_id, _), tokens in zip(unique, ids(unique)):
        assert sum(r.length for r in by_doc[doc_id]) == len(tokens) and keep


def test_run_is_the_stages_in_turn(spark, stages):
    import corpus_pipeline

    assert bag(tuple(r) for r in corpus_pipeline.run(spark, SF_DIR).select("doc_id", "start", "length", "ids_crc32").collect()) == bag(
        tuple(r) for r in stages[5].select("doc_id", "start", "length", "ids_crc32").collect())


def test_stages_of_odd_and_no_rows(spark):
    import corpus_pipeline

    for given in (ODD, []):
        docs = spark.createDataFrame(given, DOCUMENT)
        for _, stage in corpus_pipeline.STAGES:
            docs = reliable(stage(spark, docs, SF_DIR))
        assert (docs.count() > 0) == bool(given)
