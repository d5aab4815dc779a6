"""Words of letters alone get the ids of the tokenizer without being normalized and cut by it."""

import json
import random

import numpy as np

from txrisk.llm import packing

LETTERS = "abzABZÀÉÖØÞßàéöøþÿ"
OTHERS = LETTERS + "×÷µªºİıſKΣσς'’.,-_<|>12²ﬁ\t\n ́"


def made(coder, text):
    return np.frombuffer(coder.raw([text])[0], "<u4").tolist()


def test_words_of_letters_are_merged_only():
    coder, draw, sent = packing.Ids(packing.VOCABULARY), random.Random(5), []
    plain = ["".join(draw.choice(LETTERS) for _ in range(draw.randint(1, 12))) for _ in range(2000)]
    expected = [coder.tokenizer.encode(w, add_special_tokens=False).ids for w in plain]
    encode = coder.encode
    coder.encode = lambda words: (sent.extend(words), encode(words))
    assert [made(coder, w) for w in plain] == expected
    assert not sent
    odd = ["".join(draw.choice(OTHERS) for _ in range(draw.randint(0, 12))) for _ in range(5000)]
    assert [made(coder, t) for t in odd] == [coder.tokenizer.encode(t, add_special_tokens=False).ids for t in odd]
    assert sent


def test_other_vocabularies_are_asked():
    spec = json.loads(packing.Ids(packing.VOCABULARY).tokenizer.to_str())
    assert packing.letters_alike(spec)
    for part in ("normalizer", "pre_tokenizer"):
        assert not packing.letters_alike({**spec, part: None})
    assert not packing.letters_alike({**spec, "model": {**spec["model"], "dropout": 0.1}})
    assert not packing.letters_alike({**spec, "normalizer": {"type": "Lowercase"}})
