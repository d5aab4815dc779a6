"""Plain Python versions of what the operators compute."""

import bisect
import hashlib
import itertools
import re
from collections import Counter, defaultdict

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return SPACE.findall(text or "")


def base_counts(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if SPACE.search(x)]
    windows = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    often = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if often[x] > 1 for k in range(5)}
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed)


KINDS = ["assign", "access", "hex"]


def secret_spans(text):
    text = text or ""
    out = []
    rule = (r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"""
            r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    out += [("assign", m.start(), m.end()) for m in re.finditer(rule, text) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def secret_digest(text):
    spans = secret_spans(text)
    joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    return tuple(sum(s[0] == k for s in spans) for k in KINDS) + (hashlib.sha256(joined.encode()).hexdigest(),)


def simhash(text):
    import xxhash

    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(n, pairs):
    """Smallest member reachable, for 0 .. n - 1."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def near_classes(marks, most=3):
    pairs = [(i, j) for i in range(len(marks)) for j in range(i) if (marks[i] ^ marks[j]).bit_count() <= most]
    return classes(len(marks), pairs)


def removed_spans(docs, size=50):
    """doc_id -> (bytes, mask) for (doc_id, text) rows."""
    first = {}
    raw = [(d, (t or "").encode()) for d, t in docs]
    for d, b in raw:
        for i in range(len(b) - size + 1):
            w = b[i:i + size]
            first[w] = min(first.get(w, d), d)
    out = {}
    for d, b in raw:
        mask = [False] * len(b)
        for i in range(len(b) - size + 1):
            if first[b[i:i + size]] < d:
                mask[i:i + size] = [True] * size
        out[d] = (b, mask)
    return out


def mix_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """source -> target for source -> size, by sharing again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total = share * sum(sizes.values())
    target, open_ = {}, set(order)
    while open_:
        rest = total - sum(target.values())
        over = [s for s in open_ if rest * weight[s] / sum(weight[x] for x in open_) > most * sizes[s]]
        if not over:
            return target | {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        target |= {s: most * sizes[s] for s in over}
        open_ -= set(over)
    return target


def spread(rows):
    out = defaultdict(list)
    for k, v in rows:
        out[k].append(v)
    return out


def byte_alphabet():
    """Letters of byte-level vocabularies -> bytes."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def token_bytes(text):
    """((ids, bytes) of space + text in both vocabularies), or none where the bytes do not come back."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    if not hasattr(token_bytes, "made"):
        t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        t.encode_special_tokens = True
        token_bytes.made = t, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model")), byte_alphabet()
    t, sp, letters = token_bytes.made
    raw = " " + (text or "")
    a, b = t.encode(raw, add_special_tokens=False).ids, sp.encode(text or "")
    in_a = [bytes(letters[c] for c in t.id_to_token(i)) for i in a]
    in_b = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if not text or b"".join(in_a) != raw.encode() or b"".join(in_b) != raw.encode():
        return None
    return (a, in_a), (b, in_b)


def token_links(text):
    """(ids of A, ids of B, groups as lists of ids, linked pairs of ids) byte by byte."""
    sides = token_bytes(text)
    if sides is None:
        return None
    owner, ends = [], []
    for ids, parts in sides:
        owner.append([i for i, p in enumerate(parts) for _ in p])
        ends.append([n for n in itertools.accumulate(map(len, parts))])
    pairs = sorted(set(zip(*owner)))
    cuts = sorted(set(ends[0]) & set(ends[1]))
    groups = [([], []) for _ in cuts]
    for side, ((ids, _), end) in enumerate(zip(sides, ends)):
        for i, e in zip(ids, end):
            groups[bisect.bisect_left(cuts, e)][side].append(i)
    return sides[0][0], sides[1][0], groups, [(sides[0][0][i], sides[1][0][j]) for i, j in pairs]


def alignments(texts):
    """Per text (n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)."""
    made = [token_links(t) for t in texts]
    held = Counter(p for m in made if m for p in set(m[3]))
    best = defaultdict(int)
    for (a, _), n in held.items():
        best[a] = max(best[a], n)
    out = []
    for m in made:
        if m is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        said = ";".join("|".join(",".join(map(str, ids)) for ids in g) for g in m[2])
        out.append((len(m[0]), len(m[1]), len(m[2]), len(m[3]), sum(held[p] == best[p[0]] for p in m[3]), sum(held[p] for p in m[3]),
                    hashlib.sha256(said.encode()).hexdigest()))
    return out


def top_products(rows, every=50, best=5, scale=256):
    """(query id, rank, id, score) for (id, vector) rows."""
    import math

    held = []
    for i, (key, v) in enumerate(rows):
        if v is not None and all(x is not None and math.isfinite(x) and math.isfinite(scale * x) for x in v):
            held.append((i, key, [math.floor(scale * x) for x in v]))
    out = []
    for i, key, q in held:
        if key is None or key % every:
            continue
        scores = [(min(max(sum(a * b for a, b in zip(q, v)), -2**63), 2**63 - 1), other) for j, other, v in held if j != i and len(v) == len(q)]
        scores.sort(key=lambda s: (-s[0], s[1] is None, s[1] or 0))
        out += [(key, n, other, s) for n, (s, other) in enumerate(scores[:best], 1)]
    return out


RUN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def run_buckets(text):
    """(number of words, buckets of all runs of one to three words)."""
    import zlib

    w = RUN.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(w), [zlib.crc32(" ".join(w[i:i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def resampled(docs, target):
    """(doc_id, n_features, weight, score, rank) for (doc_id, text) rows and texts."""
    import math

    found = [(d, *run_buckets(t)) for d, t in docs]
    s, t = Counter(b for _, _, f in found for b in f), Counter(b for x in target for b in run_buckets(x)[1])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10_000) / ((s[b] + 1) * (t.total() + 10_000)))) for b in range(10_000)]
    out = []
    for d, n, f in found:
        weight = sum(gain[b] for b in f)
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append((d, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    fit = sorted((x for x in out if x[1] >= 20), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    drawn = fit[:5 * len(fit) // 100]
    rest = Counter(x for x in out)
    rest.subtract(Counter(drawn))
    return [(x[0], *x[2:], r) for r, x in enumerate(drawn, 1)] + [(x[0], *x[2:], None) for x, n in rest.items() for _ in range(n)]
