"""Alignment of two tokenizers over the same texts.

A text, with a space before it, is encoded by a byte-level vocabulary (A) and by a piece vocabulary (B). In a batch, keyed
by document, ``pandas.merge_asof`` finds for the start of every token the token of the other side that covers it. The
union of both directions is every pair of tokens whose byte ranges overlap (a link): of two overlapping tokens the one
that starts later starts inside the other. Byte offsets at which tokens of both sides end cut a document into groups.

How many documents hold a pair of ids linked is counted over the whole corpus. Documents travel in blocks: a block lists
its distinct pairs once, with the number of its documents that hold each, and a document refers to the list of its block by
number. So the shuffle by pair gets a row for a pair and a block, not for a link. Very long texts are cut into parts where
both vocabularies begin a new token whatever surrounds them, so the memory of a task is that of a block.

Odd input: a missing or empty text, and one whose tokens do not give its bytes back, has no tokens, zeros and an empty digest;
rows that repeat each other or lack a key are documents of their own; no rows give no rows; other columns may have any name.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txrisk.llm.common import whole
from txrisk.session import reliable

BYTE_VOCABULARY = "byte_bpe_50k.json"
PIECE_VOCABULARY = "piece_bpe_32k.model"
#: Characters that are aligned in one go.
CHUNK = 500_000
#: Characters of a block of documents; a document lies in one block.
BLOCK = 4_000_000
#: Longer texts are cut into parts of about this many characters.
PART = 200_000
#: White space of such a length is left to the slower of two encoders, whose matcher has no limit.
LONG_SPACE = re.compile(r"\s{1000}")
#: Before a space that stands between a printable ASCII character and an ASCII letter, both vocabularies begin a token.
SAFE = re.compile(r"(?<=[!-~]) (?=[A-Za-z])")
#: How byte-level vocabularies split a text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE = "▁"


def found(vocabulary: str) -> str:
    if os.path.exists(vocabulary):
        return vocabulary
    import public_tokenizers

    return public_tokenizers.path(vocabulary)


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: printable ones stand for themselves, others follow from 256."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteTokens:
    """Ids and bytes of a byte-level vocabulary; the strings of special tokens are plain text."""

    def __init__(self, vocabulary: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(found(vocabulary))
        self.tokenizer.encode_special_tokens = True
        letters, model = byte_letters(), json.loads(self.tokenizer.to_str())["model"]
        size = max(model["vocab"].values()) + 1
        self.bytes = [b""] * size
        for token, i in model["vocab"].items():
            self.bytes[i] = bytes(map(letters.__getitem__, token))
        # Where merges are numbered in their order, an encoder that merges by rank gives the same ids, several times faster.
        merged = [model["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "", 1)] for m in model["merges"]]
        self.fast = None
        if merged == list(range(256, 256 + len(merged))) and size == 256 + len(merged):
            import tiktoken

            self.fast = tiktoken.Encoding("byte-level", pat_str=SPLIT, special_tokens={},
                                          mergeable_ranks={b: i for i, b in enumerate(self.bytes)})

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self.fast is None:
            return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return [self.tokenizer.encode(t, add_special_tokens=False).ids if LONG_SPACE.search(t) else self.fast.encode_ordinary(t)
                for t in texts]


class PieceTokens:
    """Ids and bytes of a piece vocabulary, which puts a space before a text itself."""

    def __init__(self, vocabulary: str):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=found(vocabulary))
        pieces = [self.processor.id_to_piece(i) for i in range(self.processor.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.processor.is_byte(i) else p.replace(SPACE, " ").encode()
                      for i, p in enumerate(pieces)]
        #: No piece goes on over a space, so that the pieces before and after one do not depend on each other.
        self.parted = not any(SPACE in p.lstrip(SPACE) for p in pieces)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.processor.encode(texts, num_threads=1)


@dataclass
class Aligned:
    """Tokens, links and groups of texts laid end to end, token by token; ``doc`` is a text's place."""

    n: int
    ids: tuple[np.ndarray, np.ndarray]
    doc: tuple[np.ndarray, np.ndarray]
    end: tuple[np.ndarray, np.ndarray]  # bytes up to the token's end, from the first text's begin
    last: tuple[np.ndarray, np.ndarray]  # the token is the last of its group on its side
    links: tuple[np.ndarray, np.ndarray]  # places of tokens


class Aligner:
    def __init__(self, left: str = BYTE_VOCABULARY, right: str = PIECE_VOCABULARY):
        self.sides = (ByteTokens(left), PieceTokens(right))
        self.lengths = [np.array([len(b) for b in s.bytes], np.int64) for s in self.sides]
        digits = max(len(str(len(s.bytes))) for s in self.sides)
        self.digits = np.zeros((max(len(s.bytes) for s in self.sides), digits), np.uint8)
        for i in range(len(self.digits)):
            said = str(i).encode()
            self.digits[i, :len(said)] = list(said)

    @property
    def radix(self) -> int:
        return len(self.sides[1].bytes)

    def parts(self, text: str, size: int) -> list[str]:
        """The text, cut before spaces (which are left out, as both sides begin with one) where it is longer than ``size``."""
        out, at = [], 0
        while self.sides[1].parted and len(text) - at > size:
            cut = SAFE.search(text, at + size)
            if not cut:
                break
            out.append(text[at:cut.start()])
            at = cut.end()
        return [*out, text[at:]]

    def align(self, texts: list[str]) -> Aligned:
        """Texts whose bytes do not come back have no tokens."""
        raw = [" " + t for t in texts]
        tokens = (self.sides[0].encode(raw), self.sides[1].encode(texts))
        for i, text in enumerate(raw):
            said = text.encode()
            if not texts[i] or any(b"".join(map(s.bytes.__getitem__, t[i])) != said for s, t in zip(self.sides, tokens)):
                tokens[0][i], tokens[1][i] = [], []
        ids, doc, end, begin = [], [], [], []
        for lists, lengths in zip(tokens, self.lengths):
            counts = np.array([len(x) for x in lists], np.int64)
            flat = np.fromiter((i for x in lists for i in x), np.int64, counts.sum())
            ids.append(flat)
            doc.append(np.repeat(np.arange(len(texts)), counts))
            end.append(np.cumsum(lengths[flat]))
            begin.append(end[-1] - lengths[flat])
        cover = [self.covering(begin[s], doc[s], begin[1 - s], doc[1 - s]) for s in (0, 1)]
        both = np.arange(len(ids[1]))
        # A pair whose tokens start together is found from both sides.
        again = cover[0][cover[1]] == both if len(both) else np.zeros(0, bool)
        links = (np.concatenate([np.arange(len(ids[0])), cover[1][~again]]), np.concatenate([cover[0], both[~again]]))
        last = tuple(self.met(end[s], end[1 - s]) for s in (0, 1))
        return Aligned(len(texts), tuple(ids), tuple(doc), tuple(end), last, links)

    @staticmethod
    def covering(begin: np.ndarray, doc: np.ndarray, others: np.ndarray, their_doc: np.ndarray) -> np.ndarray:
        """For each start the other side's token that covers it: the last one of the document that starts no later."""
        if not len(begin):
            return np.zeros(0, np.int64)
        mine = pd.DataFrame({"at": begin, "doc": doc})
        theirs = pd.DataFrame({"at": others, "doc": their_doc, "token": np.arange(len(others))})
        return pd.merge_asof(mine, theirs, on="at", by="doc")["token"].to_numpy(np.int64)

    @staticmethod
    def met(end: np.ndarray, others: np.ndarray) -> np.ndarray:
        if not len(end):
            return np.zeros(0, bool)
        return others[np.minimum(np.searchsorted(others, end), len(others) - 1)] == end

    def written(self, x: Aligned) -> list[bytes]:
        """Each text's groups as ``a1,a2|b1;a3|b2,b3``."""
        if not len(x.ids[0]):
            return [b""] * x.n
        group = [np.cumsum(last) - last for last in x.last]
        ends = [np.flatnonzero(last) + 1 for last in x.last]  # tokens of a side up to the end of each group
        begins = [np.concatenate(([0], e[:-1])) for e in ends]
        place = (np.arange(len(x.ids[0])) + begins[1][group[0]], np.arange(len(x.ids[1])) + ends[0][group[1]])
        width = self.digits.shape[1]
        table = np.zeros((len(x.ids[0]) + len(x.ids[1]), width + 1), np.uint8)
        for s in (0, 1):
            table[place[s], :width] = self.digits[x.ids[s]]
            table[place[s], width] = np.where(x.last[s], ord("|;"[s]), ord(","))
        sizes = np.zeros(x.n, np.int64)
        counts = np.count_nonzero(table, axis=1)
        for s in (0, 1):
            sizes += np.bincount(x.doc[s], counts[place[s]], x.n).astype(np.int64)
        flat = table.ravel()
        said, stop = flat[flat != 0].tobytes(), np.cumsum(sizes)
        return [said[b - n:b - 1] if n else b"" for b, n in zip(stop.tolist(), sizes.tolist())]


WORKERS: dict[tuple[str, str], Aligner] = {}


def aligner(left: str, right: str) -> Aligner:
    if (left, right) not in WORKERS:
        WORKERS[left, right] = Aligner(left, right)
    return WORKERS[left, right]


class Document:
    """What is known of a document whose parts come one after the other."""

    def __init__(self, key: int):
        self.key, self.failed, self.counts = key, False, np.zeros(4, np.int64)
        self.hash, self.codes, self.times = hashlib.sha256(), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, counts, said: bytes, codes: np.ndarray, times: np.ndarray) -> None:
        if not said:
            self.failed = True  # a part without tokens: the bytes did not come back
            return
        self.hash.update(b";" + said if self.counts[0] else said)
        self.counts += counts
        if len(self.codes):
            codes, at = np.unique(np.concatenate([self.codes, codes]), return_inverse=True)
            times = np.bincount(at, np.concatenate([self.times, times])).astype(np.int64)
        self.codes, self.times = codes, times

    def close(self) -> tuple:
        if self.failed or not self.counts[0]:
            return self.key, np.zeros(4, np.int64), "", np.zeros(0, np.int64), np.zeros(0, np.int64)
        return self.key, self.counts, self.hash.hexdigest(), self.codes, self.times


def documents_of(make: Aligner, texts: list[str | None], chunk: int, part: int) -> Iterator[tuple]:
    """(place, counts, digest, distinct pairs, times) of every text, a chunk of parts at a time."""
    held, size, open_doc = [], 0, None

    def worked() -> Iterator[tuple]:
        nonlocal open_doc
        x = make.align([p for _, p in held])
        said, radix = make.written(x), make.radix
        code = x.ids[0][x.links[0]] * radix + x.ids[1][x.links[1]]
        pairs, times = np.unique(x.doc[0][x.links[0]] * (len(make.sides[0].bytes) * radix) + code, return_counts=True)
        whose, code = np.divmod(pairs, len(make.sides[0].bytes) * radix)
        bounds = np.searchsorted(whose, np.arange(x.n + 1))
        counts = np.stack([np.bincount(x.doc[0], minlength=x.n), np.bincount(x.doc[1], minlength=x.n),
                           np.bincount(x.doc[0], x.last[0], x.n).astype(np.int64),
                           np.bincount(x.doc[0][x.links[0]], minlength=x.n)], 1)
        for i, (place, _) in enumerate(held):
            if open_doc is not None and open_doc.key != place:
                yield open_doc.close()
                open_doc = None
            open_doc = open_doc or Document(place)
            a, b = bounds[i], bounds[i + 1]
            if texts[place]:
                open_doc.add(counts[i], said[i], code[a:b], times[a:b])

    for place, text in enumerate(texts):
        for piece in make.parts(text or "", part):
            held.append((place, piece))
            size += len(piece)
            if size >= chunk:
                yield from worked()
                held, size = [], 0
    if held:
        yield from worked()
    if open_doc is not None:
        yield open_doc.close()


def squeezed(numbers: np.ndarray) -> bytes:
    """Whole numbers, rising ones best, in few bytes."""
    steps = np.diff(numbers, prepend=0).astype("<i4")
    return pa.compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes(), "zstd", asbytes=True)


def unsqueezed(raw: bytes, n: int) -> np.ndarray:
    flat = np.frombuffer(pa.decompress(raw, 4 * n, "zstd", asbytes=True), np.uint8)
    return np.cumsum(np.ascontiguousarray(flat.reshape(4, -1).T).view("<i4").ravel(), dtype=np.int64)


DIGEST = "key {key}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, block bigint"
BLOCKED = DIGEST + ", n_pairs int, places binary, times binary, pairs array<bigint>, held array<int>"


def blocks(docs: DataFrame, key: str, text: str, left: str, right: str) -> DataFrame:
    """A row for each document; the first one of a block also has the block's pairs and how many of its documents hold each."""
    rows = docs.select(F.col(key).alias("key"), whole(text).alias("text"))
    names = ["key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "block", "n_pairs", "places", "times", "pairs", "held"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, block = aligner(left, right), TaskContext.get().partitionId() << 32
        for batch in batches:
            sizes = np.cumsum(batch.column(1).cast(pa.large_string()).to_pandas().str.len().to_numpy(np.int64))
            cuts = np.searchsorted(sizes // BLOCK, np.arange(1, sizes[-1] // BLOCK + 1)) if len(sizes) else []
            for begin, end in zip([0, *cuts], [*cuts, batch.num_rows]):
                if begin == end:
                    continue
                made = list(documents_of(make, batch.column(1).slice(begin, end - begin).to_pylist(), CHUNK, PART))
                pairs, at, held = np.unique(np.concatenate([m[3] for m in made]), return_inverse=True, return_counts=True)
                at = np.split(at, np.cumsum([len(m[3]) for m in made])[:-1])
                counts = np.stack([m[1] for m in made])
                keys = batch.column(0).slice(begin, end - begin)
                nothing = [None] * (len(made) - 1)
                yield pa.RecordBatch.from_arrays([
                    keys, *(pa.array(counts[:, i]) for i in range(4)), pa.array([m[2] for m in made], pa.string()),
                    pa.array(np.full(len(made), block)), pa.array([len(a) for a in at], pa.int32()),
                    pa.array([squeezed(a) for a in at], pa.binary()), pa.array([squeezed(m[4]) for m in made], pa.binary()),
                    pa.array([pairs, *nothing], pa.list_(pa.int64())), pa.array([held.astype(np.int32), *nothing], pa.list_(pa.int32()))],
                    names=names)
                block += 1

    return rows.mapInArrow(run, BLOCKED.format(key=rows.schema["key"].dataType.simpleString()))


def listed(stored: DataFrame) -> DataFrame:
    """(block, place, code, held): the pairs that blocks list."""
    lists = stored.select("block", "pairs", "held").filter("pairs IS NOT NULL")
    return lists.select("block", F.posexplode(F.arrays_zip("pairs", "held")).alias("place", "pair")).select(
        "block", "place", F.col("pair.pairs").alias("code"), F.col("pair.held").alias("held"))


def counted(pairs: DataFrame, radix: int) -> DataFrame:
    """(code, a_id, b_id, docs, best): how many documents hold each pair, and whether none of the A id's pairs is held by more.
    An A id has at most as many pairs as B has ids."""
    totals = pairs.groupBy("code").agg(F.sum("held").cast("long").alias("docs"))
    totals = totals.select("code", F.expr(f"code div {radix}").alias("a_id"), F.expr(f"code % {radix}").alias("b_id"), "docs")
    return totals.withColumn("best", F.col("docs") == F.max("docs").over(Window.partitionBy("a_id")))


def pair_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", left: str = BYTE_VOCABULARY,
                right: str = PIECE_VOCABULARY) -> DataFrame:
    """(a_id, b_id, docs, best) of every pair of ids that some document holds linked."""
    stored = reliable(blocks(docs, key, text, left, right))
    return counted(listed(stored), aligner(left, right).radix).drop("code")


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", left: str = BYTE_VOCABULARY,
           right: str = PIECE_VOCABULARY) -> DataFrame:
    """One row per group: the document's key, the group's number, its bytes of space + text [begin, end) and its ids on both sides."""
    rows = docs.select(F.col(key).alias("key"), whole(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = aligner(left, right)
        for batch in batches:
            for i, text in enumerate(batch.column(1).to_pylist()):
                parts = [(p, make.align([p])) for p in make.parts(text, PART)]
                if not all(len(x.ids[0]) for _, x in parts):
                    continue
                number = base = 0
                for part, x in parts:
                    cuts = [np.flatnonzero(last) + 1 for last in x.last]
                    ends = x.end[0][x.last[0]]
                    lists = [pa.ListArray.from_arrays(pa.array(np.concatenate(([0], c)), pa.int32()), pa.array(v, pa.int32()))
                             for c, v in zip(cuts, x.ids)]
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0).take(pa.array(np.full(len(ends), i))), pa.array(number + np.arange(len(ends))),
                        pa.array(base + np.concatenate(([0], ends[:-1]))), pa.array(base + ends), *lists],
                        names=["key", "number", "begin", "end", "a_ids", "b_ids"])
                    number, base = number + len(ends), base + int(ends[-1])

    schema = f"key {rows.schema['key'].dataType.simpleString()}, number bigint, begin bigint, end bigint, a_ids array<int>, b_ids array<int>"
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", left: str = BYTE_VOCABULARY,
            right: str = PIECE_VOCABULARY) -> DataFrame:
    """Per document its counts of tokens, groups and links, the digest of its groups, how many of its links are the best of
    their A id (n_best), and the sum over its links of how many documents hold them (count_sum)."""
    stored = reliable(blocks(docs, key, text, left, right))
    kind = stored.schema["key"].dataType.simpleString()
    pairs = listed(stored)
    radix = aligner(left, right).radix
    # A frequent pair is in every block; Spark splits such a key of the join, whose other side has one row for it.
    known = pairs.select("block", "place", "code").join(counted(pairs, radix).select("code", "docs", "best"), "code").select(
        F.col("block").alias("listed_in"), "place", "docs", "best")

    def run(of_docs: pa.Table, of_pairs: pa.Table) -> pa.Table:
        place = of_pairs["place"].to_numpy()
        docs_of, best_of = np.zeros(len(place), np.int64), np.zeros(len(place), bool)
        docs_of[place], best_of[place] = of_pairs["docs"].to_numpy(), of_pairs["best"].to_numpy()
        n_best, total = [], []
        for n, places, times in zip(*(of_docs[c].to_pylist() for c in ("n_pairs", "places", "times"))):
            at, often = unsqueezed(places, n), unsqueezed(times, n)
            n_best.append(int(often[best_of[at]].sum()))
            total.append(int((often * docs_of[at]).sum()))
        return of_docs.drop_columns(["n_pairs", "places", "times", "block"]).append_column("n_best", pa.array(n_best, pa.int64())).append_column(
            "count_sum", pa.array(total, pa.int64()))

    made = stored.drop("pairs", "held").groupBy("block").cogroup(known.groupBy("listed_in")).applyInArrow(
        run, DIGEST.format(key=kind).removesuffix(", block bigint") + ", n_best bigint, count_sum bigint")
    return made.select(F.col("key").alias(key), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
