"""Plain reference versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def in_fold(doc_id, folds, held_out):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == held_out


def removed(docs, length):
    """(n_bytes, n_removed, n_spans, sha256 of what stays) of (doc_id, text) rows, in their order."""
    order = sorted(range(len(docs)), key=lambda i: (docs[i][0] is not None, docs[i][0] or 0, i))
    seen, out = set(), {}
    for i in order:
        b = (docs[i][1] or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if b[s:s + length] in seen:
                gone[s:s + length] = b"\x01" * length
            seen.add(b[s:s + length])
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, x in zip(b, gone) if not x)).hexdigest())
    return [out[i] for i in range(len(docs))]


def fingerprint(text, k=3):
    w = [x.translate(FOLD) for x in words(text)]
    if not w:
        return 0
    shingles = [" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints, most):
    """doc_id -> smallest doc_id reachable over links of at most ``most`` bits."""
    ids = list(prints)
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= most:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def lm(docs, folds, held_out, order=3):
    """(held_out, n_tokens, n_known, train_tokens, base, score) of (doc_id, text) rows."""
    tokens = [[x.translate(FOLD) for x in words(t)] + ["\0end"] for _, t in docs]
    held = [in_fold(i, folds, held_out) for i, _ in docs]
    grams = lambda t: [tuple((["\0end"] * (order - 1) + t)[i:i + order]) for i in range(len(t))]
    uni, level = Counter(), {order: Counter()}
    for t, h in zip(tokens, held):
        if not h:
            uni.update(t)
            level[order].update(grams(t))
    for k in range(order - 1, 0, -1):
        level[k] = Counter(g[1:] for g in level[k + 1])
    n, v = sum(uni.values()), len(uni)

    def discounts(counts):
        of = [sum(1 for c in counts if c == k) for k in (1, 2, 3, 4)]
        y = of[0] / (of[0] + 2 * of[1]) if of[0] else 0.5
        return [0.0] + [min(max(k - (k + 1) * y * of[k] / of[k - 1] if of[k - 1] else k / 2, 0.1), k) for k in (1, 2, 3)]

    d = {k: discounts(level[k].values()) for k in level}
    total, free = defaultdict(int), defaultdict(float)
    for k in level:
        for g, c in level[k].items():
            total[g[:-1]] += c
            free[g[:-1]] += d[k][min(c, 3)]

    def p(g):
        if not g:
            return 1 / (v + 1)
        lower = p(g[1:])
        if not total[g[:-1]]:
            return lower
        c = level[len(g)][g]
        return max(c - d[len(g)][min(c, 3)], 0) / total[g[:-1]] + free[g[:-1]] / total[g[:-1]] * lower

    return [(h, len(t), sum(uni[w] > 0 for w in t), n, sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in t),
             sum(math.log10(p(g)) for g in grams(t))) for t, h in zip(tokens, held)]
