"""Planted names, given here and not by the detector: none is left, and mentions of one person agree."""

import re
import time

import pytest

from txrisk.llm import surrogates

NAMES = [
    ("Dr Maria Lopez Garcia met Smith.", ["Maria", "Lopez", "Garcia"]),
    ("Frau Anna Maria Schmidt kam. Schmidt ging, Anna blieb.", ["Anna", "Maria", "Schmidt"]),
    ("Mr J. Smith called. Smith said yes. John Smith left; Smith's car, SMITH too.", ["Smith", "SMITH", "John"]),
    ("Mr John met Mr John Smith and Dr John Smith.", ["John", "Smith"]),
    ("Señora Carmen de la Cruz y Herr Ludwig von Stein-Berg. De Cruz nada.", ["Carmen", "Cruz", "Ludwig", "Stein"]),
    ("Earlier Miller wrote to Mrs O'Neil and Prof. Miller.", ["Miller", "Neil"]),
]


def made(text):
    return surrogates.replaced(text, "k", {})[0]


@pytest.mark.parametrize("text, names", NAMES)
def test_no_planted_name_is_left(text, names):
    out = made(text)
    words = set(re.findall(r"[^\W\d_]+", out))
    assert not words & set(names), out
    # What is no name stays: the same words in lower case, in order.
    keep = [w for w in re.findall(r"[^\W\d_]+", text) if w[0].islower() and w != "s"]
    assert [w for w in re.findall(r"[^\W\d_]+", out) if w[0].islower() and w != "s"] == keep


def test_mentions_of_one_person_agree():
    a = made("Mr John met Mr John Smith and Dr John Smith.").replace(".", "").split()
    assert a[1] == a[4] == a[8] and a[5] == a[9] and a[1] != a[5]
    b = made("Mr J. Smith called. Smith said yes. John Smith left.").replace(".", "").split()
    assert b[1] == "J" and b[2] == b[4] == b[8] and b[7] != "John"


def test_text_without_forms_of_address_stays():
    for text in ("Alice Johnson went to Berlin.", "the mr of all, dr no", "MRS"):
        assert made(text) == text


def test_capitals_throughout_are_not_all_names():
    out = made("MR JOHN SMITH WENT HOME TO BERLIN")
    assert out.endswith(" WENT HOME TO BERLIN") and "SMITH" not in out


def test_two_hundred_thousand_addresses():
    text = " ".join(f"a{i}@example{i % 9}.org" for i in range(200_000))
    began = time.perf_counter()
    assert len(surrogates.entities(text)) == 200_000
    assert time.perf_counter() - began < 10
