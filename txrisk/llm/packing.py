"""Harmonic packing of token sequences.

A bin of ``capacity`` tokens has reciprocal-capacity classes: class j holds pieces of at most capacity / j tokens, and
a bin of class j always holds j pieces. A document is cut so that its pieces fill their classes exactly: whole
sequences first, then the longest class length that still fits, and so on down to one token. Every worker cuts and
numbers its own pieces; all that workers share is how many pieces of each class the workers before them have. Bins of
a class are then full but for the last. Of the last bin of a class whose length is a power of two, the pieces are
dealt to shorter sequences, also of powers of two, which need no padding.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txrisk.session import reliable

CAPACITY = 2048
VOCABULARY = "word_bpe_49k.json"
END = 1
#: Pieces per bin of the classes; beyond 8, powers of two.
SMALL_CLASSES = (1, 2, 3, 4, 5, 6, 7, 8)
#: Words of each of the two generations that a worker process remembers the ids of.
REMEMBERED = 500_000
#: Characters of the texts whose words are held at a time.
HELD = 1_000_000


def class_lengths(capacity: int) -> list[int]:
    """The piece length of each class, longest first; the last is 1."""
    counts = [j for j in SMALL_CLASSES if j <= capacity]
    while counts[-1] * 2 <= capacity:
        counts.append(counts[-1] * 2)
    lengths = [capacity // j for j in counts]
    return lengths if lengths[-1] == 1 else lengths + [1]


def cuts(length: int, lengths: list[int]) -> list[int]:
    """The classes of a document's pieces, in order."""
    out = [0] * (length // lengths[0])
    rest = length % lengths[0]
    for c, size in enumerate(lengths[1:], 1):
        out += [c] * (rest // size)
        rest %= size
    return out


#: New words that are encoded in one call.
JOINED = 4_000
#: The marks that end a word, begun after a letter or digit that no normalization changes into anything else. They share no token
#: with it; an apostrophe may, as in 's.
ENDING = re.compile(r"([!-&(-/:-@\[-`{-~](?<=[A-Za-z0-9À-ÖØ-öø-ÿ].)[!-&(-/:-@\[-`{-~]*) ")
#: Words of these letters alone are one piece each, whose tokens are those of its bytes in lower case, where a vocabulary is prepared so.
LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
NORMALIZED = [("NFC", None), ("Replace", "\\s+"), ("Lowercase", None)]
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PARTED = [("Split", PIECES, "Removed", True), ("ByteLevel", None, None, False)]


def letters_alike(spec: dict) -> bool:
    """Whether a vocabulary lower-cases words and takes runs of letters as bytes to be merged, so that ``LETTERS`` holds."""
    def steps(part: str, inner: str) -> list[dict]:
        return (spec.get(part) or {}).get(inner, [])

    def pattern(step: dict) -> str | None:
        return step.get("pattern", {}).get("Regex")

    normalized = [(x["type"], pattern(x)) for x in steps("normalizer", "normalizers")]
    parted = [(x["type"], pattern(x), x.get("behavior"), x.get("invert", x.get("use_regex"))) for x in steps("pre_tokenizer", "pretokenizers")]
    plain = not any(x.get("add_prefix_space") for x in steps("pre_tokenizer", "pretokenizers")) and not spec.get("truncation") and not spec.get("padding")
    return (normalized, parted) == (NORMALIZED, PARTED) and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout") and plain


def byte_letters() -> dict[int, str]:
    """The bytes of the letters of two bytes as byte-level vocabularies write them: bytes that are no visible character of Latin-1
    count on from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    name = {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
    return {c: "".join(name[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}


BYTE_LETTERS = byte_letters()


class Ids:
    """Token ids of texts, for vocabularies whose tokens cross neither white space nor the border of letters and
    punctuation. So words are encoded once each."""

    def __init__(self, vocabulary: str, remembered: int = REMEMBERED):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        if not os.path.exists(vocabulary):
            import public_tokenizers

            vocabulary = public_tokenizers.path(vocabulary)
        tokenizer = Tokenizer.from_file(vocabulary)
        special = tokenizer.get_added_tokens_decoder()
        self.parting = next(((t.content, i) for i, t in special.items() if t.special and not (t.normalized or t.lstrip or t.rstrip)
                             and len(t.content) > 4 and not t.content.isalnum()), None)
        self.special = [t.content for t in special.values()]
        spec = json.loads(tokenizer.to_str())
        self.folds = '"Lowercase"' in json.dumps(spec["normalizer"])
        self.merged = tokenizer.model.tokenize if letters_alike(spec) else None
        self.tokenizer, self.known, self.older, self.remembered = tokenizer, {}, {}, remembered

    def raw(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit numbers."""
        out = []
        at = 0
        while at < len(texts):
            words, counts, held = [], [], 0
            while at < len(texts) and held < HELD:
                text = texts[at] or ""
                held += len(text)
                if self.folds and text.isascii() and "<|" not in text:
                    text = text.lower()  # special tokens are looked for before case is dropped
                text = text.replace("\n", " ")
                if not any(token in text for token in self.special):
                    text = ENDING.sub(r" \1 ", text)  # fewer kinds of words
                split = text.split(" ")
                words += split
                counts.append(len(split))
                at += 1
            found = iter(self.learned(words))
            out += [b"".join(islice(found, n)) for n in counts]
        return out

    def learned(self, words: list[str]) -> list[bytes]:
        """The ids of each word; those not known are learned. When too many are known, those not met again are forgotten."""
        if len(self.known) > self.remembered:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        found = list(map(known.get, words))
        missing = [i for i, raw in enumerate(found) if raw is None]
        new = dict.fromkeys(map(words.__getitem__, missing))
        known.update({w: older[w] for w in new if w in older})
        new = [w for w in new if w not in known]
        if self.merged:
            new = [w for w in new if not self.merge(w)]
        for i in range(0, len(new), JOINED):
            self.encode(new[i:i + JOINED])
        for i in missing:
            found[i] = known[words[i]]
        return found

    def merge(self, word: str) -> bool:
        """Learns a word of letters alone by the merges of its bytes, which need neither normalization nor cutting; tells whether it is one."""
        if not LETTERS(word):
            return False
        small = word.lower()
        raw = self.known.get(small)
        if raw is None:
            made = self.merged(small if small.isascii() else small.translate(BYTE_LETTERS))
            raw = struct.pack(f"<{len(made)}I", *[token.id for token in made])
        self.known[word] = raw
        return True

    def encode(self, words: list[str]) -> None:
        """Learns new words: all in one call, parted by a special token, which is looked for before anything else is done to
        a text. Words that may hold a part of one are encoded one by one."""
        alone = words
        if self.parting:
            mark, number = self.parting
            alone = [w for w in words if mark[:2] in w]
            words = [w for w in words if mark[:2] not in w] if alone else words
            (made,) = self.tokenizer.encode_batch_fast([mark.join(words)], add_special_tokens=False)
            ids = np.array(made.ids, "<u4")
            ends = np.append(np.flatnonzero(ids == number), len(ids))
            raw, begins = ids.tobytes(), np.concatenate(([0], ends[:-1] + 1))
            if words:
                self.known.update(zip(words, [raw[a:b] for a, b in zip((4 * begins).tolist(), (4 * ends).tolist())]))
        for w in alone:
            self.known[w] = np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes()


#: One for each vocabulary in a worker process, kept from task to task.
WORKERS: dict[str, Ids] = {}


def ids_of(vocabulary: str) -> Ids:
    if vocabulary not in WORKERS:
        WORKERS[vocabulary] = Ids(vocabulary)
    return WORKERS[vocabulary]


SCHEMA = ("key {key}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, class int, worker int, "
          "place bigint")


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
           vocabulary: str = VOCABULARY, end: int = END) -> DataFrame:
    """The pieces of every document with their class and their place among the worker's pieces of that class."""
    lengths = class_lengths(capacity)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, worker = ids_of(vocabulary), TaskContext.get().partitionId()
        last = np.array([end], "<u4").tobytes()
        placed, crc = [0] * len(lengths), zlib.crc32
        for batch in batches:
            whose, out = [], []
            for i, raw in enumerate(ids.raw(batch.column(1).to_pylist())):
                raw, start = raw + last, 0
                total = len(raw) // 4
                for c in cuts(total, lengths):
                    size = lengths[c]
                    whose.append(i)
                    out.append((start, size, crc(raw[4 * start:4 * (start + size)]), total, c, placed[c]))
                    placed[c] += 1
                    start += size
            keys = batch.column(0).take(pa.array(whose, pa.int64()))
            start, size, crcs, total, cls, place = (np.array(x, np.int64) for x in zip(*out)) if out else [np.empty(0, np.int64)] * 6
            yield pa.RecordBatch.from_arrays(
                [keys, *map(pa.array, (start, size, crcs, total, cls.astype(np.int32), np.full(len(cls), worker, np.int32), place))],
                names=["key", "start", "length", "ids_crc32", "doc_tokens", "class", "worker", "place"])

    return rows.mapInArrow(run, SCHEMA.format(key=rows.schema["key"].dataType.simpleString()))


def packed(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
           vocabulary: str = VOCABULARY, end: int = END) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens, padded_to.

    A missing or empty text is the end token alone. Rows that repeat each other, or lack a key, are packed one by one.
    No rows give no rows. Other columns may have any name.
    """
    lengths = class_lengths(capacity)
    # The pieces are stored with their numbers: a task that runs again can't number them anew.
    made = reliable(pieces(docs, key, text, capacity, vocabulary, end))
    counts = made.groupBy("class", "worker").agg(F.count(F.lit(1)).alias("n"))
    by_class = Window.partitionBy("class")
    counts = counts.select("class", "worker", (F.sum("n").over(by_class.orderBy("worker")) - F.col("n")).alias("before"),
                           F.sum("n").over(by_class).alias("all"))  # a row per class and worker
    rows = made.join(counts, ["class", "worker"]).withColumn("at", F.col("before") + F.col("place"))
    per_bin = F.element_at(F.array(*[F.lit(capacity // size) for size in lengths]), F.col("class") + 1)
    rows = rows.withColumn("per", per_bin).withColumn("bin", F.expr("at div per")).withColumn("slot", F.expr("at % per"))
    left = F.expr("all % per")
    rows = rows.withColumn("left", F.when(F.expr("bin = all div per"), left).otherwise(F.col("per")).cast("int"))
    # In a last bin of powers of two, slots 0 .. left - 1 go to runs as long as the bits of left, the largest first.
    # The slot's run is the highest bit in which left has a one and the slot, compared from the top, has a zero.
    dyadic = (F.expr("bin = all div per") & (F.col("per").bitwiseAND(F.col("per") - 1) == 0)
              & (F.col("length").bitwiseAND(F.col("length") - 1) == 0))
    differ = F.col("left").bitwiseXOR(F.col("slot").cast("int"))
    bit = F.floor(F.log2(differ.cast("double") + 0.5)).cast("int")
    run_size = F.when(dyadic, F.pow(F.lit(2.0), bit).cast("int")).otherwise(F.col("left"))
    rows = rows.withColumn("run", run_size)
    rows = rows.withColumn("first", F.when(dyadic, F.col("slot") - F.col("slot") % F.col("run")).otherwise(0))
    classes = len(lengths)
    sequence = (F.col("bin") * (capacity + 1) + F.col("first")) * classes + F.col("class")
    tokens = F.col("run") * F.col("length")
    power = tokens.bitwiseAND(tokens - 1) == 0
    return rows.select(F.col("key").alias(key), "start", "length", "ids_crc32", "doc_tokens", sequence.cast("long").alias("sequence_id"),
                       ((F.col("slot") - F.col("first")) * F.col("length")).cast("long").alias("offset"),
                       tokens.cast("long").alias("sequence_tokens"), F.when(power, tokens).otherwise(F.lit(capacity)).cast("long").alias("padded_to"))
