"""Removal of repeated byte strings with suffix arrays.

A byte goes if a string of ``size`` bytes that covers it also starts in a document with a smaller id.

Every string of ``size`` bytes is named by its minimizer: the smallest hash of the 12-byte grams in it. Equal strings
have equal minimizers, so only strings of one minimizer are compared. Neighbouring strings with one minimizer are kept
together as a segment.

1. A shard is some megabytes of documents. Where a minimizer comes from several of its documents, equal segments are
   made one, and those that agree with another in sixteen bytes beside the gram are sorted. A suffix array of
   those segments (Larsson-Sadakane refinement: sorted by eight bytes, then each group of equal rank by the rank
   eight, sixteen, thirty-two bytes on) and the common prefixes of neighbours (Kasai's rule: one less than at the
   position before, if both neighbours moved on by one) show which strings are equal. What repeats an earlier document
   of the shard is settled. Only strings at their shard's first document go on.
2. Segments meet by minimizer. In a bucket, minimizers with one document are dropped; the rest is sorted in shards of
   bounded size as before. A minimizer too large for one shard is cut into shards in the order of documents; the sorted
   strings of a shard are looked up in those of the earlier ones by binary search, then merged into them.
3. The spans found are joined to the documents by id and text.

No bucket grows with a frequent gram. Bytes per minimizer are estimated from a fixed share of all slices of all texts. The
strings of a heavy minimizer are named by the gram and the bytes beside it on the side where the string has more of them;
where that name is heavy too, by the whole string. Equal strings have equal names in each case, so nothing is lost
where the estimate is wrong; only sizes change.
"""

from __future__ import annotations

import gc
import hashlib
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F, types as T

from txrisk.llm.common import whole
from txrisk.session import reliable

SIZE = 50
GRAM = 12
SHARD_BYTES = 6_000_000
#: Bytes of segments that a bucket holds, and that one suffix array is built over.
BUCKET_BYTES = 28_000_000
ARRAY_BYTES = 2_000_000
#: Bytes from which a name counts as heavy, as a share of a bucket, and the most names that are; tasks carry eight bytes of each.
HEAVY_SHARE = 0.25
MOST_HEAVY = 1_000_000
#: Texts are weighed by slices of these bytes, one in WEIGHED (fewer bytes a bucket: more of them, down to all).
SLICE = 4096
WEIGHED = 32
LAST = np.iinfo(np.int64).max  # stands for a missing id: after all others
U = np.uint64
PLACE = U((1 << 24) - 1)
MANY = 255


def eight(buffer: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, the first one highest; zeros follow the end."""
    padded = np.zeros(len(buffer) + 8, np.uint8)
    padded[:len(buffer)] = buffer
    return np.ndarray((len(buffer),), ">u8", padded, strides=(1,)).astype(U)


def minimizers(words: np.ndarray, size: int, gram: int) -> np.ndarray:
    """For each position the smallest hash of the grams in the next ``size`` bytes, in the upper forty bits; below, where
    the first gram with this hash is (its position modulo 2 to the 24th)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, U)
    last = words[gram - 8:]
    h = words[:len(last)] * U(0x9E3779B97F4A7C15)
    h ^= h >> U(29)
    h ^= last * U(0xC2B2AE3D27D4EB4F)
    h *= U(0xFF51AFD7ED558CCD)
    h ^= h >> U(32)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(31)
    h &= ~PLACE
    h |= np.arange(len(h), dtype=U) & PLACE
    width, span = size - gram + 1, 1
    while 2 * span <= width:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    if span < width:
        h = np.minimum(h[:len(h) - (width - span)], h[width - span:])
    return h[:n]


def segments(minimal: np.ndarray, starts: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """(minimizer, anchor, document, begin in the buffer, bytes) of the runs of strings with one minimizer."""
    valid = np.zeros(len(minimal) + 1, np.int8)
    long = lengths >= size
    np.add.at(valid, starts[long], 1)
    np.add.at(valid, starts[long] + lengths[long] - size + 1, -1)
    valid = np.cumsum(valid[:-1]).astype(bool)
    name = minimal >> U(24)
    fresh = valid.copy()
    fresh[1:] &= ~valid[:-1] | (name[1:] != name[:-1])
    fresh[starts[long]] = True
    begin = np.flatnonzero(fresh)
    document = np.searchsorted(starts, begin, side="right") - 1
    # Documents of no bytes share their start with the next one.
    end = np.minimum(np.append(begin[1:], len(minimal)), starts[document] + lengths[document] - size + 1)
    return (*named(minimal, begin, end - begin + size - 1, size), document, begin, end - begin + size - 1)


def gram_places(words: np.ndarray, minimal: np.ndarray, size: int, gram: int) -> np.ndarray:
    """Where in its string the first gram of the smallest hash is, for every string of the buffer."""
    step = 1 << 23  # places are known modulo 2 to the 24th
    if len(minimal) < 2 * step:
        return ((minimal & PLACE).astype(np.int64) - np.arange(len(minimal))) % (2 * step)
    parts = [minimizers(words[lo:lo + step + size - 1], size, gram) for lo in range(0, len(minimal), step)]
    return np.concatenate([(x & PLACE).astype(np.int64) - np.arange(len(x)) for x in parts])


def mixed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(29))) * U(0xBF58476D1CE4E5B9) + y * U(0x94D049BB133111EB)
    return x ^ (x >> U(32))


def sided(words: np.ndarray, at: np.ndarray, name: np.ndarray, place: np.ndarray, size: int, gram: int) -> np.ndarray:
    """Names of the strings at ``at``: their minimizer and the bytes beside the gram on the longer side."""
    width = (size - gram) // 2
    behind = place <= size - gram - width
    here = at + np.where(behind, place + gram, place - width)
    out = mixed(name, behind.astype(U) + U(1))
    for step in range(0, width - 7, 8):
        out = mixed(out, words[here + step])
    return out


def whole_strings(words: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Names of the strings at ``at`` by all their bytes."""
    out = np.full(len(at), 3, U)
    for step in [*range(0, size - 7, 8), size - 8]:
        out = mixed(out, words[at + step])
    return out


def is_in(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array ``known``."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def split(words: np.ndarray, minimal: np.ndarray, name: np.ndarray, begin: np.ndarray, length: np.ndarray, heavy: tuple[np.ndarray, np.ndarray],
          size: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(segment, name, begin, bytes): segments of heavy minimizers cut into runs of strings of one finer name, the others as
    they are. ``heavy`` has the heavy minimizers and the heavy names of :func:`sided`, each sorted."""
    large = is_in(name, heavy[0])
    few = np.flatnonzero(~large)
    cut = np.flatnonzero(large)
    if not len(cut):
        return few, name, begin, length
    per = length[cut] - size + 1
    segment = np.repeat(cut, per)
    at = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per) + np.repeat(begin[cut], per)
    finer = sided(words, at, name[segment], gram_places(words, minimal, size, gram)[at], size, gram)
    again = is_in(finer, heavy[1])
    finer[again] = whole_strings(words, at[again], size)
    fresh = np.flatnonzero(np.concatenate(([True], (finer[1:] != finer[:-1]) | (segment[1:] != segment[:-1]))))
    count = np.diff(np.append(fresh, len(at)))
    parts = (np.concatenate(x) for x in ((few, segment[fresh]), (name[few], finer[fresh]), (begin[few], at[fresh]),
                                         (length[few], count + size - 1)))
    which, finer, begin, length = parts
    by = np.lexsort((begin, which))
    return which[by], finer[by], begin[by], length[by]


def named(minimal: np.ndarray, begin: np.ndarray, length: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(minimizer, anchor) of segments. The anchor is where its gram is in the segment, or MANY if it is there more than
    once."""
    first, last = minimal[begin], minimal[begin + length - size]
    anchor = ((first & PLACE).astype(np.int64) - begin) % (1 << 24)
    once = ((first & PLACE) == (last & PLACE)) & (anchor < MANY) & (len(minimal) < 1 << 24)
    return first >> U(24), np.where(once, anchor, MANY).astype(np.uint8)


def gathered(buffer: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The bytes of the segments, one after the other."""
    raw = buffer.tobytes()
    return np.frombuffer(b"".join([raw[b:e] for b, e in zip(begin.tolist(), (begin + length).tolist())]), np.uint8)


def suffix_array(words: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
    """The positions of the buffer in the order of their first ``depth`` bytes within their segment.

    words: eight bytes from each position; left: bytes up to the segment's end.
    """
    n = len(words)
    short = left < 8
    key = words.copy()
    key[short] &= ~((U(1) << (U(8) * (U(8) - left[short].astype(U)))) - U(1))
    order = np.argsort(key)
    sorted_key = key[order]
    fresh = np.concatenate(([True], sorted_key[1:] != sorted_key[:-1]))
    first = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    rank = np.empty(n, np.int64)
    rank[order] = first
    h = 8
    while h < depth:
        # Places in the order whose group has more than one member.
        alone = fresh & np.append(fresh[1:], True)
        places = np.flatnonzero(~alone)
        if not len(places):
            break
        who = order[places]
        ahead = np.where(left[who] > h, rank[np.minimum(who + h, n - 1)] + 1, 0)
        group = rank[who]
        by = np.argsort(group.astype(U) * U(n + 1) + ahead.astype(U))
        who, ahead, group = who[by], ahead[by], group[by]
        order[places] = who
        new = np.concatenate(([True], (group[1:] != group[:-1]) | (ahead[1:] != ahead[:-1])))
        fresh[places] = new
        rank[who] = places[np.flatnonzero(new)[np.cumsum(new) - 1]]
        h *= 2
    return order


def common(words: np.ndarray, left: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Common prefixes of the positions a and b, byte for byte, up to ``depth`` and the segments' ends."""
    out = np.zeros(len(a), np.int64)
    top = np.minimum(np.minimum(left[a], left[b]), depth)
    going = np.arange(len(a))
    at = 0
    while len(going) and at < depth:
        going = going[top[going] > at]
        x = words[a[going] + at] ^ words[b[going] + at]
        same = np.full(len(going), 8)
        differ = x != 0
        # The first differing byte, from the highest set bit.
        same[differ] = 7 - (np.frexp((x[differ] >> U(32)).astype(float) * 4294967296.0 + (x[differ] & U(0xFFFFFFFF)).astype(float))[1] - 1) // 8
        out[going] = np.minimum(at + same, top[going])
        going = going[~differ]
        at += 8
    return out


def kasai(words: np.ndarray, left: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """The common prefix of each position in ``order`` with the one before it, up to ``depth``.

    By Kasai's rule a position whose neighbour is one on from the neighbour of the position before has one byte less
    in common; only the others are compared, and those where the rule starts from a prefix that was cut at ``depth``.
    """
    n = len(words)
    before = np.full(n, -2, np.int64)
    before[order[1:]] = order[:-1]
    prefix = np.zeros(n, np.int64)
    there = before >= 0
    follows = np.zeros(n, bool)
    follows[1:] = there[1:] & there[:-1] & (before[1:] == before[:-1] + 1) & (left[1:] == left[:-1] - 1)
    follows[1:] &= left[before[1:]] == left[before[:-1]] - 1
    seeds = np.flatnonzero(there & ~follows)
    prefix[seeds] = common(words, left, seeds, before[seeds], depth)
    seed = np.maximum.accumulate(np.where(there & ~follows, np.arange(n), 0))
    chained = np.flatnonzero(follows)
    value = prefix[seed[chained]] - (chained - seed[chained])
    unsure = (prefix[seed[chained]] >= depth) | (value < 0)
    prefix[chained] = np.maximum(value, 0)
    again = chained[unsure]
    prefix[again] = common(words, left, again, before[again], depth)
    return prefix[order]


def strings(buffer: np.ndarray, length: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The strings of ``size`` bytes in the segments: their positions in sorted order, the number of the group of equal
    ones that each belongs to, and the segment of each."""
    words = eight(buffer)
    ends = np.cumsum(length)
    left = np.repeat(ends, length) - np.arange(len(buffer))
    order = suffix_array(words, left, size)
    order = order[left[order] >= size]
    prefix = kasai(words, left, order, size)
    group = np.cumsum(prefix < size) - 1 if len(order) else np.empty(0, np.int64)
    if len(group):
        group -= group[0]
    return order, group, np.searchsorted(ends, order, side="right")


def later(buffer: np.ndarray, length: np.ndarray, document: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, segment) of the strings that also start in a segment with a smaller document; one suffix array."""
    order, group, segment = strings(buffer, length, size)
    if not len(order):
        return order, segment
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    least = np.minimum.reduceat(document[segment], starts)
    late = document[segment] > least[group]
    return order[late], segment[late]


def merged(buffer: np.ndarray, length: np.ndarray, document: np.ndarray, size: int, array_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """The same over shards in the order of documents: each has its own array; its strings are looked up among those of
    the shards before by binary search."""
    by = np.argsort(document, kind="stable")
    begins = np.cumsum(length) - length
    cuts = np.flatnonzero(np.diff(np.cumsum(length[by]) // array_bytes, prepend=0)) if len(by) else []
    known, owner = np.empty(0, f"S{size + 1}"), np.empty(0, np.int64)
    found = []
    for part in np.split(by, [c for c in np.asarray(cuts).tolist() if 0 < c < len(by)]):
        own = gathered(buffer, begins[part], length[part])
        order, group, segment = strings(own, length[part], size)
        if not len(order):
            continue
        starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        whose = document[part][segment]
        least = np.minimum.reduceat(whose, starts)
        # A last byte that is not zero keeps zeros at the end of a string.
        rows = np.ones((len(starts), size + 1), np.uint8)
        rows[:, :size] = own[order[starts][:, None] + np.arange(size)]
        distinct = rows.reshape(-1).view(f"S{size + 1}")
        at = np.searchsorted(known, distinct)
        seen = np.zeros(len(distinct), bool)
        inside = at < len(known)
        seen[inside] = known[at[inside]] == distinct[inside]
        least[seen] = np.minimum(least[seen], owner[at[seen]])
        late = whose > least[group]
        offset = order[late] - (np.cumsum(length[part]) - length[part])[segment[late]]
        found.append((begins[part][segment[late]] + offset, part[segment[late]]))
        known = np.insert(known, at[~seen], distinct[~seen])
        owner = np.insert(owner, at[~seen], least[~seen])
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 2


def in_several(name: np.ndarray, document: np.ndarray) -> np.ndarray:
    """Which rows have a name that comes from at least two documents."""
    by = np.lexsort((document, name))
    n, d = name[by], document[by]
    starts = np.flatnonzero(np.concatenate(([True], n[1:] != n[:-1])))[:len(n)]
    sizes = np.diff(np.append(starts, len(n)))
    out = np.zeros(len(n), bool)
    if len(n):
        out[by] = np.repeat(d[starts] != d[starts + sizes - 1], sizes)
    return out


def beside(buffer: np.ndarray, at: np.ndarray, there: np.ndarray) -> np.ndarray:
    """A hash of the sixteen bytes at each place; where they are not there, no other is like it."""
    view = np.ndarray((max(0, len(buffer) - 7),), "<u8", buffer, strides=(1,))
    out = np.arange(len(at), dtype=U)
    x = view[at[there]] * U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(31))) * U(0xC2B2AE3D27D4EB4F) + view[at[there] + 8] * U(0xFF51AFD7ED558CCD)
    out[there] = x ^ (x >> U(29))
    return out


def comparable(minimizer: np.ndarray, document: np.ndarray, length: np.ndarray, anchor: np.ndarray, begin: np.ndarray, buffer: np.ndarray,
               gram: int) -> np.ndarray:
    """Which segments may share a string with another document. Of a string's bytes beside the gram, sixteen or more lie
    on one side; so the segments agree in the sixteen bytes before their anchors or in those behind them."""
    many = anchor == MANY
    unclear = np.isin(minimizer, minimizer[many])
    where = begin + anchor
    out = unclear & in_several(minimizer, document)
    for at, there in ((where + gram, anchor + gram + 16 <= length), (where - 16, anchor >= 16)):
        there = there & ~unclear
        side = beside(buffer, at, there) ^ (minimizer * U(0xD6E8FEB86659FD93))
        side[~there] = np.flatnonzero(~there).astype(U)
        out |= in_several(side, document) & there
    return out


def resolved(minimizer: np.ndarray, document: np.ndarray, length: np.ndarray, anchor: np.ndarray, begin: np.ndarray, buffer: np.ndarray,
             size: int, gram: int, array_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """(segment, offset in it) of all strings that repeat a smaller document.

    Segments of a minimizer with one document are not looked at. Equal segments are one, that of the smallest document;
    the others repeat it whole. What is left, segments that are alike in part, is sorted; those of whole minimizers share
    an array as far as it goes.
    """
    rows = np.flatnonzero(in_several(minimizer, document))
    if not len(rows):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    rows = rows[np.argsort(document[rows], kind="stable")]
    raw = buffer.tobytes()
    seen: dict[bytes, int] = {}
    first = np.array([seen.setdefault(raw[b:e], i) for i, (b, e) in enumerate(zip(begin[rows].tolist(), (begin[rows] + length[rows]).tolist()))])
    del seen
    copies = np.flatnonzero(document[rows] > document[rows[first]])
    strings_in = length[rows[copies]] - size + 1
    out = [(np.repeat(rows[copies], strings_in), np.arange(strings_in.sum()) - np.repeat(np.cumsum(strings_in) - strings_in, strings_in))]
    # Equal segments of the smallest document, too, get what is found of the first.
    same = np.flatnonzero((first != np.arange(len(rows))) & (document[rows] == document[rows[first]]))
    lone = rows[first == np.arange(len(rows))]
    columns = [x[lone] for x in (minimizer, document, length, anchor.astype(np.int64), begin)]
    lone = lone[comparable(*columns, buffer, gram)]
    by = lone[np.lexsort((document[lone], minimizer[lone]))]
    group = np.cumsum(np.concatenate(([True], minimizer[by][1:] != minimizer[by][:-1])))[:len(by)] - 1
    weight = np.bincount(group, length[by]).astype(np.int64)
    lots, lot, held = [], 0, 0
    for w in weight.tolist():
        if held and held + w > array_bytes:
            lot, held = lot + 1, 0
        lots.append(lot)
        held += w
    found = []
    for part in np.split(by, np.flatnonzero(np.diff(np.array(lots, np.int64)[group])) + 1) if len(by) else []:
        own = gathered(buffer, begin[part], length[part])
        look = merged if len(own) > 2 * array_bytes else later
        position, segment = look(own, length[part], document[part], size, *([array_bytes] if look is merged else []))
        found.append((part[segment], position - (np.cumsum(length[part]) - length[part])[segment]))
    if found:
        segment, offset = (np.concatenate(x) for x in zip(*found))
        out.append((segment, offset))
        if len(same):
            by = np.argsort(segment, kind="stable")
            segment, offset = segment[by], offset[by]
            owner = rows[first[same]]
            low, high = np.searchsorted(segment, owner), np.searchsorted(segment, owner, side="right")
            n = high - low
            take = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
            out.append((np.repeat(rows[same], n), offset[take]))
    return tuple(np.concatenate(x) for x in zip(*out))


def runs(at: np.ndarray, document: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, begin, end) of the bytes covered by strings at (document, at)."""
    by = np.lexsort((at, document))
    at, document = at[by], document[by]
    fresh = np.concatenate(([True], (document[1:] != document[:-1]) | (at[1:] > at[:-1] + size)))[:len(at)]
    starts = np.flatnonzero(fresh)
    return document[starts], at[starts], (at[np.append(starts[1:], len(at)) - 1] if len(at) else at) + size


class Spans:
    """Spans by document, as rows for the other side of the shuffle."""

    @staticmethod
    def pack(key: np.ndarray, mark: np.ndarray, begin: np.ndarray, end: np.ndarray) -> bytes:
        return np.concatenate([np.asarray(x, "<i8") for x in (key, mark, begin, end)]).tobytes()

    @staticmethod
    def unpack(blob: bytes) -> np.ndarray:
        return np.frombuffer(blob, "<i8").reshape(4, -1)


def bundle(key: np.ndarray, mark: np.ndarray, start: np.ndarray, length: np.ndarray, raw: bytes) -> bytes:
    """Segments in the order of documents: the table of documents, then starts and lengths, then the bytes. Minimizers are
    found again on the other side."""
    change = np.concatenate(([True], (key[1:] != key[:-1]) | (mark[1:] != mark[:-1])))
    columns = [np.array([len(key), change.sum()], "<i8"), key[change].astype("<i8"), mark[change].astype("<i8"),
               np.bincount(np.cumsum(change) - 1).astype("<u4"), np.diff(start, prepend=0).astype("<i4"), length.astype("<u4")]
    return zstandard.ZstdCompressor(level=3).compress(b"".join([c.tobytes() for c in columns] + [raw]))


def unbundle(blob: bytes, size: int, gram: int) -> tuple[np.ndarray, ...]:
    """(minimizer, anchor, key, mark, start, bytes of each, the bytes)."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, docs = np.frombuffer(raw, "<i8", 2).tolist()
    at = 16
    out = []
    for kind, count in (("<i8", docs), ("<i8", docs), ("<u4", docs), ("<i4", n), ("<u4", n)):
        out.append(np.frombuffer(raw, kind, count, at))
        at += out[-1].nbytes
    key, mark, per, start, length = out
    length, body = length.astype(np.int64), np.frombuffer(raw, np.uint8, -1, at)
    minimal = minimizers(eight(body), size, gram)
    return (*named(minimal, np.cumsum(length) - length, length, size), np.repeat(key, per), np.repeat(mark, per),
            np.cumsum(start.astype(np.int64)), length, body)


def shards(batches: Iterator[pa.RecordBatch], size: int, gram: int, shard_bytes: int, array_bytes: int, buckets: int,
           heavy: tuple[np.ndarray, np.ndarray] = (np.empty(0, U), np.empty(0, U))) -> Iterator[pa.RecordBatch]:
    """(key, mark, text) -> rows (bucket, spans, segments) of each shard."""
    key, mark, texts, held = [], [], [], 0

    def shard() -> pa.RecordBatch:
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        starts = np.cumsum(lengths) - lengths
        buffer = np.frombuffer(b"".join(texts), np.uint8)
        keys, marks = np.array(key, np.int64), np.array(mark, np.int64)
        words = eight(buffer)
        minimal = minimizers(words, size, gram) if len(buffer) >= size else np.empty(0, U)
        m, anchor, d, begin, length = segments(minimal, starts, lengths, size)
        late, offset = resolved(m, keys[d], length, anchor, begin, buffer, size, gram, array_bytes)
        rows: dict[str, list] = {"bucket": [], "spans": [], "segments": []}
        if len(late):
            at = begin[late] + offset
            who, b, e = runs(at - starts[d[late]], d[late], size)
            to = keys[who].astype(U) % U(buckets)
            for bucket in np.unique(to).tolist():
                mine = to == bucket
                rows["bucket"].append(bucket)
                rows["spans"].append(Spans.pack(keys[who][mine], marks[who][mine], b[mine], e[mine]))
                rows["segments"].append(None)
        # A segment all of whose strings are settled need not go on.
        settled = np.bincount(late, minlength=len(m)) >= length - size + 1 if len(m) else np.empty(0, bool)
        m, d, begin, length = (x[~settled] for x in (m, d, begin, length))
        part, m, begin, length = split(words, minimal, m, begin, length, heavy, size, gram)
        d = d[part]
        bucket = (m % U(buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        d, begin, length, bucket = (x[by] for x in (d, begin, length, bucket))
        edges = np.flatnonzero(np.diff(bucket)) + 1
        raw = buffer.tobytes()
        for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(d)]):
            if hi > lo:
                body = b"".join([raw[b:e] for b, e in zip(begin[lo:hi].tolist(), (begin[lo:hi] + length[lo:hi]).tolist())])
                rows["bucket"].append(int(bucket[lo]))
                rows["spans"].append(None)
                rows["segments"].append(bundle(keys[d[lo:hi]], marks[d[lo:hi]], begin[lo:hi] - starts[d[lo:hi]], length[lo:hi], body))
        return pa.RecordBatch.from_arrays([pa.array(rows["bucket"], pa.int32()), pa.array(rows["spans"], pa.binary()),
                                           pa.array(rows["segments"], pa.binary())], names=["bucket", "spans", "segments"])

    for batch in batches:
        for k, x, t in zip(*[batch.column(i).to_pylist() for i in range(3)]):
            raw = (t or "").encode("utf-8", "surrogatepass")
            if len(raw) < size:
                continue
            key.append(LAST if k is None else k)
            mark.append(x)
            texts.append(raw)
            held += len(raw)
            if held >= shard_bytes:
                yield shard()
                key, mark, texts, held = [], [], [], 0
    if texts:
        yield shard()


def weighed(batches: Iterator[pa.RecordBatch], size: int, gram: int, every: int, heavy: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """(mark, text) -> (name, bytes) of the segments in one slice of ``every``: by minimizer, or, for the strings of the given
    heavy ones, by :func:`sided`."""
    for batch in batches:
        parts = []
        for mark, text in zip(*[batch.column(i).to_pylist() for i in range(2)]):
            raw = (text or "").encode("utf-8", "surrogatepass")
            slices = np.arange(-(-len(raw) // SLICE))
            drawn = mixed(slices.astype(U), np.full(len(slices), mark % (1 << 64), U)) % U(every) == 0
            # A string belongs to the slice that it begins in.
            parts += [raw[i * SLICE:(i + 1) * SLICE + size - 1] for i in slices[drawn].tolist()]
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        buffer = np.frombuffer(b"".join(parts), np.uint8)
        if len(buffer) < size:
            continue
        words = eight(buffer)
        minimal = minimizers(words, size, gram)
        name, _, _, begin, length = segments(minimal, np.cumsum(lengths) - lengths, lengths, size)
        if heavy is not None:
            mine = is_in(name, heavy)
            _, name, _, length = split(words, minimal, name[mine], begin[mine], length[mine], (heavy, np.empty(0, U)), size, gram)
        names, place = np.unique(name, return_inverse=True)
        total = np.bincount(place, length, len(names)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(names.astype(np.int64)), pa.array(total)], names=["name", "bytes"])


def heavy_names(rows: DataFrame, total: int, size: int, gram: int, bucket_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """The heavy minimizers, and the heavy ones among the finer names of their strings; at most MOST_HEAVY of each."""
    every = int(min(WEIGHED, max(1, bucket_bytes * HEAVY_SHARE // 250_000)))
    # Segments have some four times the bytes of the texts, so no more than MOST_HEAVY names can weigh so much.
    least = max(bucket_bytes * HEAVY_SHARE, 4 * total / MOST_HEAVY) / every
    out = []
    for _ in range(2):
        known = out[0] if out else None
        if known is not None and not len(known):
            return known, known
        names = rows.select("mark", "text").mapInArrow(lambda it, k=known: weighed(it, size, gram, every, k), "name bigint, bytes bigint")
        large = names.groupBy("name").agg(F.sum("bytes").alias("bytes")).filter(F.col("bytes") >= least)
        listed = large.orderBy(F.desc("bytes")).limit(MOST_HEAVY).select("name").toArrow()["name"].to_numpy()
        out.append(np.sort(listed.astype(np.int64).view(U)))
    return out[0], out[1]


NO_SPANS = {"bucket": pa.int32(), "spans": pa.binary()}


def met(table: pa.Table, size: int, gram: int, array_bytes: int, buckets: int) -> pa.Table:
    """All rows of a bucket -> spans, (bucket by document, spans)."""
    settled = [Spans.unpack(x) for x in table["spans"].to_pylist() if x is not None]
    bundles = [unbundle(x, size, gram) for x in table["segments"].to_pylist() if x is not None]
    if bundles:
        m, anchor, key, mark, start, length, body = (np.concatenate(x) for x in zip(*bundles))
        del bundles
        begin = np.cumsum(length) - length
        segment, offset = resolved(m, key, length, anchor, begin, body, size, gram, array_bytes)
        if len(segment):
            # Documents are told apart by key and mark.
            by = np.lexsort((mark[segment], key[segment]))
            segment, offset = segment[by], offset[by]
            k, x = key[segment], mark[segment]
            number = np.cumsum(np.concatenate(([True], (k[1:] != k[:-1]) | (x[1:] != x[:-1])))) - 1
            first = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1])))
            who, b, e = runs(start[segment] + offset, number, size)
            settled.append(np.stack((k[first][who], x[first][who], b, e)))
    if not settled:
        return pa.table({c: pa.array([], t) for c, t in NO_SPANS.items()})
    spans = np.concatenate(settled, axis=1)
    to = spans[0].astype(U) % U(buckets)
    by = np.argsort(to, kind="stable")
    cuts = np.flatnonzero(np.diff(to[by])) + 1
    parts = np.split(by, cuts)
    return pa.table({"bucket": pa.array([int(to[p[0]]) for p in parts], pa.int32()), "spans": pa.array([Spans.pack(*spans[:, p]) for p in parts], pa.binary())})


def by_document(table: pa.Table) -> pa.Table:
    """All spans of a bucket of documents -> (key, mark, spans): begin and end of the bytes to remove, one after the other."""
    key, mark, begin, end = np.concatenate([Spans.unpack(x) for x in table["spans"].to_pylist()], axis=1)
    by = np.lexsort((begin, mark, key))
    key, mark, begin, end = key[by], mark[by], begin[by], end[by]
    first = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (mark[1:] != mark[:-1]))))
    both = np.stack((begin, end), axis=1).astype("<i8")
    return pa.table({"key": pa.array(key[first]), "mark": pa.array(mark[first]),
                     "spans": pa.array([x.tobytes() for x in np.split(both, first[1:])], pa.binary())})


def free(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of frames that nobody holds any more; else they stay until the driver happens to
    collect its garbage. Files go a moment after their frame, and a frame a moment after what refers to it."""
    for _ in range(3):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.7)


def spans_found(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, gram: int = GRAM, shard_bytes: int = SHARD_BYTES,
                bucket_bytes: int = BUCKET_BYTES, array_bytes: int = ARRAY_BYTES) -> DataFrame:
    """(key, mark, spans), stored: the pieces to remove of every document that has some."""
    if not isinstance(docs.schema[key].dataType, T.IntegralType):
        raise TypeError(f"ids have to be whole numbers: {key}")
    rows = docs.select(F.col(key).cast("long").alias("key"), F.xxhash64(whole(text)).alias("mark"), F.col(text).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # Segments overlap: together they have about four times the bytes.
    buckets = min((1 << 31) - 1, max(1, -(-4 * total // bucket_bytes)))
    heavy = heavy_names(rows, total, size, gram, bucket_bytes)
    sent = rows.mapInArrow(lambda it: shards(it, size, gram, shard_bytes, array_bytes, buckets, heavy), "bucket int, spans binary, segments binary")
    # A task for each bucket; by hash several would fall to one.
    found = sent.repartitionById(buckets, "bucket").groupBy("bucket").applyInArrow(lambda t: met(t, size, gram, array_bytes, buckets), "bucket int, spans binary")
    return reliable(found.groupBy("bucket").applyInArrow(by_document, "key bigint, mark bigint, spans binary"))


def kept_bytes(raw: bytes, spans: bytes | None) -> tuple[bytes, int, int]:
    """What is left, how many bytes went, and in how many runs."""
    if not spans:
        return raw, 0, 0
    pairs = np.frombuffer(spans, "<i8").reshape(-1, 2)
    reach = np.maximum.accumulate(pairs[:, 1])
    fresh = np.concatenate(([True], pairs[1:, 0] > reach[:-1]))
    begin = pairs[fresh, 0].tolist()
    end = reach[np.append(np.flatnonzero(fresh)[1:], len(pairs)) - 1].tolist()
    left = b"".join([raw[a:b] for a, b in zip([0, *end], [*begin, len(raw)])])
    return left, len(raw) - len(left), len(begin)


def cleaned(docs: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """One row per row of ``docs``: key, n_bytes, n_removed, n_spans, kept (the bytes that are left).

    A missing text is empty. A missing id is larger than any other; documents with one id never count as repeats of
    each other, so rows that repeat each other are treated alike. No rows give no rows. Other columns may have any name.
    A very long text is held by one task as a whole. Ids that are no whole numbers are an error.
    """
    spans = spans_found(docs, key, text, **settings)
    free(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).withColumn("mark", F.xxhash64(whole("text")))
    rows = rows.withColumn("whole_key", F.coalesce(F.col("key").cast("long"), F.lit(int(LAST))))
    side = spans.withColumnsRenamed({"key": "whole_key"}).hint("shuffle_hash")
    joined = rows.join(side, ["whole_key", "mark"], "left").select("key", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            made = [kept_bytes(r, s) for r, s in zip(raw, batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(len, raw), pa.int64()), *[pa.array([x[i] for x in made], pa.int64()) for i in (1, 2)],
                 pa.array([hashlib.sha256(x[0]).hexdigest() for x in made]), pa.array([x[0] for x in made], pa.binary())],
                names=["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    out = joined.mapInArrow(run, f"key {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
    return out.withColumnRenamed("key", key)
