"""Alignment of two tokenizers against byte-by-byte alignment."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from test_operators import CLASHING, DOCUMENT, ODD, SF_DIR, bag
from txrisk.llm import queries, token_alignment

SPACED = "word " * 30 + " " * 3000 + "\n" * 1500 + "end of it"
TEXTS = [
    "<|endoftext|> and <s> and </s> <unk> <0x41> are plain", "a▁b is not space", "café naïve 中文 \U0001F600\U0001F3FD", "tab\tand\x00\x1f\x7f nul",
    "  two  spaces   three", "  no break 　 wide", "é combining, ﬁ ligature, Ａ wide", " ", "\n", "x", SPACED,
    " ".join(f"word{i % 97}, and So{i % 13}; café{i % 5}" for i in range(4000)),
]


@pytest.fixture(scope="module")
def make():
    return token_alignment.Aligner()


def columns(df):
    return [tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()]


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    want = [(d, *x) for (d, _), x in zip(rows, brute.alignments([t for _, t in rows]))]
    assert bag(columns(queries.op11_token_alignment(spark, SF_DIR))) == bag(want)
    assert sum(x[1] > 0 for x in want) > 150


def test_odd_rows(spark):
    rows = ODD + [(100 + i, t, "en", "a", 0) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, DOCUMENT).withColumns({name: F.lit("clash") for name in (*CLASHING, "block", "place", "pairs", "times")})
    want = [(r[0], *x) for r, x in zip(rows, brute.alignments([r[1] for r in rows]))]
    assert bag(columns(token_alignment.digests(docs.repartition(3)))) == bag(want)
    assert any(x[1] == 0 for x in want if x[0] in (101, 103))


def test_no_rows(spark):
    nothing = spark.createDataFrame([], DOCUMENT)
    assert token_alignment.digests(nothing).count() == 0
    assert token_alignment.pair_counts(nothing).count() == 0 and token_alignment.groups(nothing).count() == 0


def test_parts_and_chunks_change_nothing(make):
    """Texts cut into parts and worked through in small chunks give what they give whole."""
    texts = [r[1] for r in ODD] + TEXTS
    whole = list(token_alignment.documents_of(make, texts, 10**9, 10**9))
    cut = list(token_alignment.documents_of(make, texts, 700, 150))
    assert max(len(make.parts(t or "", 150)) for t in texts) > 100
    for a, b in zip(whole, cut, strict=True):
        assert a[0] == b[0] and list(a[1]) == list(b[1]) and a[2] == b[2] and list(a[3]) == list(b[3]) and list(a[4]) == list(b[4])


def test_groups_give_the_text_back(spark, make):
    docs = spark.createDataFrame([(1, TEXTS[2]), (2, TEXTS[-1]), (3, None)], "doc_id int, text string")
    for key, text in ((1, TEXTS[2]), (2, TEXTS[-1])):
        rows = sorted(token_alignment.groups(docs).filter(F.col("doc_id") == key).collect(), key=lambda r: r.number)
        raw = (" " + text).encode()
        assert [r.number for r in rows] == list(range(len(rows))) and rows[-1].end == len(raw)
        for r in rows:
            for side, ids in zip(make.sides, (r.a_ids, r.b_ids)):
                assert b"".join(side.bytes[i] for i in ids) == raw[r.begin:r.end]


def test_pair_counts(spark):
    texts = ["one two three", "one two", "one two", None, "three"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    held = brute.Counter(p for t in texts if t for p in set(brute.token_links(t)[3]))
    rows = token_alignment.pair_counts(docs).collect()
    assert {(r.a_id, r.b_id): r.docs for r in rows} == dict(held)
    assert all(r.best == (r.docs == max(n for (a, _), n in held.items() if a == r.a_id)) for r in rows)


def test_both_encoders_of_bytes_agree(make):
    """The fast one gives the ids of the vocabulary's own library around every character."""
    side = make.sides[0]
    assert side.fast
    points = [c for c in [*range(0x3400), *range(0x3400, 0x110000, 11)] if not 0xD800 <= c < 0xE000]
    texts = [" a{0} {0}1{0}{0}  {0} !{0}a  {0}".format(chr(c)) for c in points]
    plain = [e.ids for e in side.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert side.encode(texts) == plain


def test_squeezed_numbers_come_back():
    for x in (np.array([], np.int64), np.array([0, 5, 70_000, 2**31 - 1]), np.array([9, 1, 1, 4])):
        assert list(token_alignment.unsqueezed(token_alignment.squeezed(x), len(x))) == list(x)
