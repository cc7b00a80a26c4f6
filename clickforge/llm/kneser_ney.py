"""Interpolated modified Kneser-Ney language model, counted in Spark.

Words are counted in the tasks, merged by bucket, and each bucket is written as
a shard of sorted word hashes to the shared folder; a word's id is its rank
among all. N-grams of the model's order are counted as columns of ids. Their
shard is that of their last word but one, so a shard holds contexts whole, and
with them the suffixes, whose numbers of distinct words before are the counts of
the order below; and so on down to single words. A shard keeps sorted hashes of
n-grams with counts, and of contexts with their totals. N-grams whose last word
but one is very frequent are spread over all shards; their contexts' totals are
summed by one more exchange. Workers map the shards into memory and look up the
n-grams of a block shard by shard, so a worker holds pages it has touched, not
the model.

    P(w | u v) = max(c(u v w) - D, 0) / c(u v) + g(u v) P(w | v)

c counts occurrences in the highest order and distinct words before the n-gram
in lower ones; D is one of three discounts by count (1, 2, 3 and more), from the
order's counts of counts; g makes the sum one, and single words leave one share
of V + 1 for words never seen. A context never seen leaves all to the order
below. A text begins after ``order - 1`` end tokens and ends with one.

A shard of n-grams or contexts is one file (:func:`_put_table`). A key's upper
half gives its cell, about four keys, and 40 more bits are kept of each key, all
64 where two keys of a shard would fall together; so what was counted is found
exactly, and an n-gram never counted is taken for one that was once in 10**11.
Counts, or a context's totals, are a byte: the code of a frequent one.

The shared folder (``spark.checkpoint.dir``) must be a file system that is
mounted on all machines, for files elsewhere can't be mapped into memory.

Cases: null or empty text is one end token; null doc_ids are learnt from;
without training texts every token has probability 1; empty tables give empty
results; repeated rows and ids count each; further columns are ignored; texts
of any length are read whole.
"""

from __future__ import annotations

import os
import uuid
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import (
    PrefixHash, documents, drop, mix64, new_path, pack_arrays, save, shuffle_partitions, space_table, text_blocks,
    unpack_arrays, word_spans, worker_cache)

END_HASH = np.uint64(0x9E3779B97F4A7C15)
#: Distinct keys a task gathers before it merges them.
GATHER = 4_000_000
#: N-grams a task gathers before it merges them, and hands them on if most are distinct.
GRAMS = 1_500_000
#: Bytes of text a bucket has at least, but for the first eight.
BUCKET_BYTES = 4 << 20
#: Keys a cell of a table has on average.
CELL = 4
#: Places of a cell that all keys look at together.
STEPS = 5
#: Frequent values with a code of a byte; the next code: listed apart.
LIST = 255
ENTRIES = "bucket int, n int, body binary"
ENTRIES_ARROW = pa.schema([("bucket", pa.int32()), ("n", pa.int32()), ("body", pa.binary())])
PARTS = "kind int, bucket int, n int, body binary"
PARTS_ARROW = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("n", pa.int32()), ("body", pa.binary())])
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
SCORES_ARROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                          ("base_score", pa.float64()), ("score", pa.float64())])


def local_path(path: str) -> str:
    """The mounted folder behind a path of the shared folder."""
    url = urlparse(path)
    if url.scheme not in ("", "file"):
        raise ValueError(f"{path} can't be mapped into memory; name a mounted folder in spark.checkpoint.dir")
    return unquote(url.path) if url.scheme else path


def _put(folder: str, name: str, array: np.ndarray) -> None:
    """Write an array whole or not at all; attempts of a task write the same."""
    os.makedirs(folder, exist_ok=True)
    part = f"{folder}/.{name}-{uuid.uuid4().hex}"
    array.tofile(part)
    os.replace(part, f"{folder}/{name}")


def _get(folder: str, name: str, kind) -> np.ndarray:
    path = f"{folder}/{name}"
    return np.memmap(path, kind, "r") if os.path.exists(path) and os.path.getsize(path) else np.zeros(0, kind)


def merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sums of their counts."""
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k)
    k, c = k[order], c[order]
    first = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
    return k[first], (np.add.reduceat(c, first) if len(first) else c).astype(np.int64)


class Tokens:
    """Hashes of a block's tokens: lower-cased words, and an end after each text."""

    def __init__(self):
        self.hashing, self.space = PrefixHash(23), space_table()
        self.lower = np.frombuffer(bytes(range(256)).lower(), np.uint8)

    def __call__(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(offs) - 1
        low = self.lower[data]
        start, end = word_spans(low, offs, self.space)
        doc = np.searchsorted(offs, start, "right") - 1
        at = np.append(0, np.cumsum(np.bincount(doc, minlength=n) + 1))
        out = np.full(at[-1], END_HASH, np.uint64)
        out[np.arange(len(start)) + doc] = self.hashing.spans(self.hashing.prefix(low), start, end)
        return out, at


def coded(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes, and the place of each token's among them."""
    found = pa.array(hashes).dictionary_encode()
    words = found.dictionary.to_numpy()
    order = np.argsort(words)
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    return words[order], rank[found.indices.to_numpy()]


class Gathered:
    """Counts of keys over the blocks of a task."""

    def __init__(self):
        self.keys, self.counts, self.size = [], [], 0

    def add(self, keys: np.ndarray) -> None:
        k, c = np.unique(keys, return_counts=True)
        self.keys.append(k)
        self.counts.append(c)
        self.size += len(k)
        if self.size > GATHER:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        k, c = merge(self.keys or [np.zeros(0, np.uint64)], self.counts or [np.zeros(0, np.int64)])
        self.keys, self.counts, self.size = [k], [c], 0
        return k, c

    def rows(self, bucket_of):
        """Merged entries, a row a bucket."""
        k, c = self.merge()
        bucket = bucket_of(k)
        order = np.argsort(bucket, kind="stable")
        k, c, bucket = k[order], c[order], bucket[order]
        used, first = np.unique(bucket, return_index=True)
        ends = np.append(first[1:], len(k))
        for b, x, y in zip(used, first, ends):
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([y - x], pa.int32()),
                                              pa.array([pack_arrays(k[x:y], c[x:y].astype(np.uint32))], pa.binary())], schema=ENTRIES_ARROW)
        self.__init__()


def _entries(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    parts = [unpack_arrays(x.as_py(), n, np.uint64, np.uint32) for x, n in zip(t.column("body"), t.column("n").to_pylist())]
    return merge([p[0] for p in parts], [p[1] for p in parts])


def _of_counts(c: np.ndarray) -> np.ndarray:
    """How many entries have count 1, 2, 3, 4, and the sum of all counts."""
    return np.array([*(np.count_nonzero(c == k) for k in (1, 2, 3, 4)), c.sum()], np.int64)


def discounts(of_counts: np.ndarray) -> np.ndarray:
    """Discounts of counts 0, 1, 2, and 3 or more."""
    n = of_counts.astype(float)
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    d = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else k / 2 for k in (1, 2, 3)]
    return np.array([0.0, *(min(max(x, 0.1), k) for k, x in zip((1, 2, 3), d))])


def gram_key(cols: list[np.ndarray]) -> np.ndarray:
    """64-bit hashes of n-grams given as columns of word ids."""
    key = np.zeros(len(cols[0]), np.uint64)
    for c in cols:
        key = mixed(key, c)
    return key


def mixed(key: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Hashes of the n-grams of hash ``key`` with one more word each."""
    return mix64(key * np.uint64(0x9E3779B97F4A7C15) + ids.astype(np.uint64) + np.uint64(1))


def distinct(key: np.ndarray, cols: list[np.ndarray], n: np.ndarray | None = None):
    """Distinct keys, sorted, with their columns and summed counts (without ``n``: occurrences)."""
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    if n is None:
        n = np.diff(np.append(first, len(key)))
    elif len(first):
        n = np.add.reduceat(n[order], first)
    return key[first], [c[order[first]] for c in cols], n.astype(np.int64)


def pack_grams(cols: list[np.ndarray], n: np.ndarray) -> bytes:
    """The first words ascend within the last but one (see :func:`by_bucket`), so their differences pack better."""
    halves = [x for c in cols for x in ((c & np.uint64(0xFFFFFFFF)).astype(np.uint32), (c >> np.uint64(32)).astype(np.uint8))]
    halves[0] = np.diff(halves[0], prepend=np.zeros(1, np.uint32))  # modulo 2 ** 32
    return pack_arrays(*halves, n.astype(np.uint64))


def unpack_grams(t: pa.Table, width: int):
    """Distinct n-grams of a group's rows, as :func:`distinct` gives them."""
    parts = [unpack_arrays(x.as_py(), n, *[np.uint32, np.uint8] * width, np.uint64) for x, n in zip(t.column("body"), t.column("n").to_pylist())]
    for p in parts:
        p[0] = np.cumsum(p[0], dtype=np.uint32)
    cols = [np.concatenate([p[2 * j].astype(np.uint64) | p[2 * j + 1].astype(np.uint64) << np.uint64(32) for p in parts]) for j in range(width)]
    return distinct(gram_key(cols), cols, np.concatenate([p[-1] for p in parts]).astype(np.int64))


def by_bucket(bucket: np.ndarray, cols: list[np.ndarray], n: np.ndarray):
    """(bucket, entries, body) of each bucket; n-grams in an order that packs well."""
    sort = cols[0] if len(cols) == 1 else cols[-2] << np.uint64(32) | cols[0] & np.uint64(0xFFFFFFFF)
    order = np.argsort(sort)
    order = order[_bucket_order(bucket[order])]
    cols, n = [c[order] for c in cols], n[order]
    for b, part in _groups(bucket[order]):
        yield b, part.stop - part.start, pack_grams([c[part] for c in cols], n[part])


class Grams:
    """Counts of n-grams over the blocks of a task."""

    def __init__(self, width: int):
        self.width, self.parts, self.size = width, [], 0

    def add(self, cols: list[np.ndarray]) -> None:
        self.parts.append(distinct(gram_key(cols), cols))
        self.size += len(self.parts[-1][0])

    def merge(self) -> int:
        if len(self.parts) > 1:
            cols = [np.concatenate([p[1][j] for p in self.parts]) for j in range(self.width)]
            self.parts = [distinct(np.concatenate([p[0] for p in self.parts]), cols, np.concatenate([p[2] for p in self.parts]))]
        self.size = len(self.parts[0][0]) if self.parts else 0
        return self.size

    def rows(self, model: Model):
        """Merged entries, a row a bucket; then none are held."""
        if self.merge():
            key, cols, n = self.parts[0]
            for row in by_bucket(model.gram_bucket(key, cols[-2]), cols, n):
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, ENTRIES_ARROW)], schema=ENTRIES_ARROW)
        self.__init__(self.width)


def histories(w: np.ndarray, at: np.ndarray, end: int, order: int) -> list[np.ndarray]:
    """The ``order - 1`` words before each token, farthest first; before a text all are ends."""
    here = np.arange(len(w))
    place = here - np.repeat(at[:-1], np.diff(at))
    return [np.where(place >= j, w[np.maximum(here - j, 0)], end) for j in range(order - 1, 0, -1)]


def _bucket_order(bucket: np.ndarray) -> np.ndarray:
    """A stable order by bucket; numbers of 16 bits take numpy's radix sort."""
    small = len(bucket) and bucket.max() < 1 << 16
    return np.argsort(bucket.astype(np.uint16) if small else bucket, kind="stable")


def _cells(keys: np.ndarray, cells: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(cells) >> np.uint64(32)).astype(np.int64)


def _put_table(folder: str, name: str, k: int, keys: np.ndarray, values: list[np.ndarray]) -> None:
    """A shard of sorted distinct keys with values, in one file: the cells' first keys as differences
    from an even spread, 32 and 8 more bits of each key (32 and 32 where two would be the same), and
    the values' codes."""
    n, m, cells = len(keys), len(values), max(1, len(keys) // CELL)
    cell = _cells(keys, cells)
    even = np.arange(cells + 1) * n // cells
    off = np.searchsorted(cell, np.arange(cells + 1)) - even
    off = off.astype(np.int16) if np.abs(off).max() < 1 << 15 else off.astype(np.int64)
    low = keys.astype(np.uint32)
    short = np.sort((cell.astype(np.uint64) << np.uint64(40)) | (keys & np.uint64((1 << 40) - 1)))
    tag = (keys >> np.uint64(32)).astype(np.uint32 if cells >= 1 << 24 or (short[1:] == short[:-1]).any() else np.uint8)
    bits = 20 // m
    packed, plain = np.zeros(n, np.int64), np.ones(n, bool)
    for j, v in enumerate(values):
        plain &= v < 1 << bits
        packed |= np.minimum(v, (1 << bits) - 1) << (bits * j)
    often = np.bincount(packed[plain], minlength=1 << 20)
    used = np.flatnonzero(often)
    used = used[np.argsort(-often[used], kind="stable")][:LIST]
    code_of = np.full(1 << 20, LIST, np.uint8)
    code_of[used] = np.arange(len(used))
    code = np.where(plain, code_of[packed], LIST).astype(np.uint8)
    book = np.array([used >> (bits * j) & ((1 << bits) - 1) for j in range(m)], np.int64)
    at = np.flatnonzero(code == LIST)
    rare = np.array([v[at] for v in values], np.int64)
    head = np.array([n, cells, off.itemsize, tag.itemsize, len(used), len(at), m])
    planes = sorted([np.append(low, np.zeros(STEPS + 1, np.uint32)), off, tag, code], key=lambda x: -x.itemsize)  # aligned so
    _put(folder, f"{name}-{k}", np.concatenate([np.ascontiguousarray(x).reshape(-1).view(np.uint8) for x in (head, book, rare, at, *planes)]))


class Table:
    """A file of :func:`_put_table`, mapped."""

    def __init__(self, folder: str, name: str):
        raw = np.asarray(_get(folder, name, np.uint8))
        self.n = 0
        if not len(raw):
            return
        self.n, self.cells, off, tag, used, listed, m = (int(x) for x in raw[:56].view(np.int64))
        place = 56

        def take(kind, *shape):
            nonlocal place
            x = np.ndarray(shape, kind, raw, place)
            place += x.nbytes
            return x

        self.book = np.append(take(np.int64, m, used), np.zeros((m, LIST + 1 - used), np.int64), axis=1)
        self.rare, self.at = take(np.int64, m, listed), take(np.int64, listed)
        planes = [("low", np.dtype(np.uint32), self.n + STEPS + 1), ("off", np.dtype(f"i{off}"), self.cells + 1),
                  ("tag", np.dtype(f"u{tag}"), self.n), ("code", np.dtype(np.uint8), self.n)]
        for x, kind, size in sorted(planes, key=lambda x: -x[1].itemsize):
            setattr(self, x, take(kind, size))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of keys; -1: not there."""
        out = np.full(len(keys), -1, np.int64)
        if not self.n:
            return out
        cell = _cells(keys, self.cells)
        at, end = (c * self.n // self.cells + self.off[c] for c in (cell, cell + 1))
        low, tag = keys.astype(np.uint32), (keys >> np.uint64(32)).astype(self.tag.dtype)
        for _ in range(STEPS):  # all at once: on, where these 32 bits differ
            at += self.low[at] != low
        left = np.flatnonzero(at < end)
        while len(left):  # then those not settled
            here = at[left]
            same = self.low[here] == low[left]
            same[same] = self.tag[here[same]] == tag[left[same]]
            out[left[same]] = here[same]
            left = left[~same & (here + 1 < end[left])]
            at[left] += 1
        return out

    def values(self, at: np.ndarray, of) -> np.ndarray:
        """What ``of`` makes of the values at these places; it is asked once a code."""
        code = self.code[at]
        out = np.take(of(self.book), code, axis=1)
        listed = np.flatnonzero(code == LIST)
        if len(listed):
            out[:, listed] = of(self.rare[:, np.searchsorted(self.at, at[listed])])
        return out


def _put_counts(folder: str, name: str, k: int, n: np.ndarray) -> None:
    """Counts in half the bytes where they fit."""
    _put(folder, f"{name}-{k}", n.astype(np.uint32) if not len(n) or n.max() < 1 << 32 else n.astype(np.uint64))


STATS = 4  #: total, and words behind with count 1, 2 and more


class Model:
    """The sharded arrays, as the workers see them."""

    OPEN = 4096  #: arrays kept mapped

    def __init__(self, folder: str, sizes: np.ndarray, tokens: int, order: int):
        self.folder, self.sizes, self.tokens, self.order = folder, sizes, tokens, order
        self.base = np.append(0, np.cumsum(sizes))
        self.words = int(self.base[-1])
        self.kinds = 0
        self.hot = np.zeros(0, np.int64)
        self.of_counts = np.zeros((order + 1, 5), np.int64)
        self.open: dict[str, np.ndarray | Table] = {}

    def __getstate__(self):
        return self.__dict__ | {"open": {}}

    def _opened(self, key: str, make):
        if key not in self.open:
            if len(self.open) >= self.OPEN:
                self.open.clear()
            self.open[key] = make()
        return self.open[key]

    def shard(self, name: str, k: int, kind) -> np.ndarray:
        return self._opened(f"{name}-{k}", lambda: np.asarray(_get(self.folder, f"{name}-{k}", kind)))

    def counts(self, name: str, k: int) -> np.ndarray:
        raw = self.shard(name, k, np.uint8)
        return raw.view(np.uint32 if len(raw) == 4 * self.sizes[k] else np.uint64)

    def table(self, name: str, k: int) -> Table:
        return self._opened(f"{name}-{k}", lambda: Table(self.folder, f"{name}-{k}"))

    @property
    def buckets(self) -> int:
        return len(self.sizes)

    def hash_bucket(self, h: np.ndarray) -> np.ndarray:
        return ((h >> np.uint64(48)) * np.uint64(self.buckets) >> np.uint64(16)).astype(np.int64)

    def word_bucket(self, ids: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.base, ids.astype(np.int64), "right") - 1

    def is_hot(self, ids: np.ndarray) -> np.ndarray:
        return np.isin(ids.astype(np.int64), self.hot)

    def gram_bucket(self, keys: np.ndarray, v: np.ndarray) -> np.ndarray:
        """The shard of the last word but one; for very frequent ones, of the hash."""
        return self.spread_hot(keys, self.word_bucket(v), self.is_hot(v))

    def spread(self, keys: np.ndarray) -> np.ndarray:
        """Shards by other bits than tables tell keys by."""
        return (mix64(keys) % np.uint64(self.buckets)).astype(np.int64)

    def spread_hot(self, keys: np.ndarray, bucket: np.ndarray, hot: np.ndarray) -> np.ndarray:
        which, out = np.flatnonzero(hot), bucket.copy()
        out[which] = self.spread(keys[which])
        return out

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of sorted distinct hashes; -1: not a training word."""
        out = np.full(len(hashes), -1, np.int64)
        for k, part in _groups(self.hash_bucket(hashes)):
            have = self.shard("word", k, np.uint64)
            if len(have):
                at = np.minimum(np.searchsorted(have, hashes[part]), len(have) - 1)
                out[part] = np.where(have[at] == hashes[part], at + self.base[k], -1)
        return out

    def of_words(self, ids: np.ndarray) -> tuple[np.ndarray, ...]:
        """Count, and count in the lowest order, by sorted ids."""
        out = [np.zeros(len(ids), np.int64) for _ in range(2)]
        known = np.flatnonzero(ids >= 0)
        for k, part in _groups(self.word_bucket(ids[known])):
            at = ids[known][part] - self.base[k]
            for o, name in zip(out, ("count", "before")):
                o[known[part]] = self.counts(name, k)[at]
        return tuple(out)

    def find(self, name: str, keys: np.ndarray, bucket: np.ndarray, of, width: int, absent: float = 0) -> np.ndarray:
        """The ``width`` numbers that ``of`` makes of the values of keys; ``absent`` for keys that aren't there."""
        out, found = np.empty((width, len(keys))), np.full((width, len(keys)), absent, float)
        order = _bucket_order(bucket)
        keys = keys[order]
        for k, part in _groups(bucket[order]):
            table = self.table(name, k)
            at = table.find(keys[part])
            there = np.flatnonzero(at >= 0)
            if len(there):
                found[:, part.start + there] = table.values(at[there], of)
        for o, x in zip(out, found):
            o[order] = x
        return out

    def contexts(self, order: int, keys: np.ndarray, bucket: np.ndarray, hot: np.ndarray) -> np.ndarray:
        """Total, and share left to the order below, of contexts; 0: never seen. ``bucket``, ``hot``: of their last word."""
        d, out = discounts(self.of_counts[order]), np.zeros((2, len(keys)))
        of = lambda v: np.array([v[0], sum(x * y for x, y in zip(d[1:], v[1:])) / np.maximum(v[0], 1)])
        for name, which in ((f"ctx{order}", np.flatnonzero(~hot)), (f"hot{order}", np.flatnonzero(hot))):
            if len(which):
                own = keys[which]
                out[:, which] = self.find(name, own, bucket[which] if name.startswith("ctx") else self.spread(own), of, 2)
        return out

    def grams(self, order: int, keys: np.ndarray, bucket: np.ndarray, hot: np.ndarray) -> np.ndarray:
        """Counts of n-grams less their discounts, which may leave 0; -1: never seen."""
        d = discounts(self.of_counts[order])
        of = lambda v: np.maximum(v - d[np.minimum(v, 3)], 0)
        return self.find(f"gram{order}", keys, self.spread_hot(keys, bucket, hot), of, 1, -1)[0]

    def score(self, hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
        """n_tokens, n_known, base and model log10 probability of each text."""
        words, w = coded(hashes)
        ids = self.ids(words)
        count, before = self.of_words(ids)
        d, n, total = discounts(self.of_counts[1]), self.of_counts[1], float(self.of_counts[1][4])
        if total:
            left = (d[1] * n[0] + d[2] * n[1] + d[3] * (self.kinds - n[0] - n[1])) / total
            low = np.maximum(before - d[np.minimum(before, 3)], 0) / total + left / (self.words + 1)
        else:
            low = np.full(len(words), 1 / (self.words + 1))
        base = np.log10((count + 1) / (self.tokens + self.words + 1))
        p = low[w]
        if self.order > 1 and self.tokens:
            end = int(np.searchsorted(words, END_HASH))
            known, bucket, hot = ids >= 0, np.maximum(self.word_bucket(ids), 0), self.is_hot(ids)
            last, first = np.append(end, w[:-1]).astype(w.dtype), at[:-1]  # the word before each token
            last[first] = end
            own_id, own_known, last_bucket, last_hot = ids.astype(np.uint64)[w], known[w], bucket[last], hot[last]
            one = gram_key([ids.astype(np.uint64)])
            key, ends = one[last], one[end:end + 1]  # hashes of the contexts, and of the one before a text
            for k in range(2, self.order + 1):
                sums, share = np.zeros(len(w)), np.zeros(len(w))
                if k == 2:  # a context is a word
                    which, of_word = np.flatnonzero(known), np.zeros((2, len(words)))
                    of_word[:, which] = self.contexts(k, one[which], bucket[which], hot[which])
                    sums, share = of_word[:, last]
                else:
                    which = np.flatnonzero(seen)
                    sums[which], share[which] = self.contexts(k, key[which], last_bucket[which], last_hot[which])
                gram = mixed(key, own_id)
                there = sums > 0
                which = np.flatnonzero(own_known & there)
                c = np.full(len(w), -1.0)
                c[which] = self.grams(k, gram[which], last_bucket[which], last_hot[which])
                p = np.where(there, np.maximum(c, 0) / np.maximum(sums, 1) + share * p, p)
                # the next context is what was looked up for the token before
                seen, key = np.append(True, c[:-1] >= 0), np.append(ends, gram[:-1])
                ends = mixed(ends, ids.astype(np.uint64)[end:end + 1])
                seen[first], key[first] = True, ends
        per = lambda x: np.add.reduceat(x, at[:-1]) if len(at) > 1 else np.zeros(0)
        return np.diff(at), per((count > 0).astype(np.int64)[w]), per(base[w]), per(np.log10(p))


def _groups(sorted_keys: np.ndarray):
    """(key, slice) of each run of equal keys."""
    first = np.flatnonzero(np.append(True, sorted_keys[1:] != sorted_keys[:-1])) if len(sorted_keys) else np.zeros(0, np.int64)
    for a, b in zip(first, np.append(first[1:], len(sorted_keys))):
        yield int(sorted_keys[a]), slice(int(a), int(b))


def train(texts: DataFrame, order: int = 3) -> Model:
    """Count words, then n-grams, of (doc_id, text) and write the model's shards."""
    spark: SparkSession = texts.sparkSession
    # A bucket hands a row to each bucket of the next level: few texts get few buckets, however many partitions there are.
    size = texts.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    folder, buckets = local_path(new_path(spark, "lm")), min(2 * shuffle_partitions(spark), max(8, -(-size // BUCKET_BYTES)))
    empty = Model(folder, np.zeros(buckets, np.int64), 0, order)

    def count_words(batches):
        tokens, held = Tokens(), Gathered()
        for _, data, offs in text_blocks(batches):
            held.add(tokens(data, offs)[0])
        yield from held.rows(empty.hash_bucket)

    def write_words(t: pa.Table) -> pa.Table:
        k = t.column("bucket")[0].as_py()
        keys, counts = _entries(t)
        _put(folder, f"word-{k}", keys)
        _put_counts(folder, "count", k, counts)
        # replaced once counted; with order one these are the lowest order's counts
        _put_counts(folder, "before", k, counts if order == 1 else 0 * counts)
        return pa.table({"bucket": pa.array([k], pa.int32()), "n": [len(keys)], "total": [int(counts.sum())], "body": [pack_arrays(_of_counts(counts))]})

    # a row a shard; saved, for then what the words shuffled goes before the n-grams are
    shards = save(texts.mapInArrow(count_words, ENTRIES).groupBy("bucket")
                  .applyInArrow(lambda t: write_words(t), "bucket int, n long, total long, body binary"), "lm-words")
    written = shards.collect()
    drop(shards)
    sizes = np.zeros(buckets, np.int64)
    for r in written:
        sizes[r["bucket"]] = r["n"]
    model = Model(folder, sizes, sum(r["total"] for r in written), order)
    of_counts = lambda rows: sum(unpack_arrays(r["body"], 5, np.int64)[0] for r in rows)
    if not model.tokens:
        return model
    if order == 1:
        model.kinds, model.of_counts[1] = model.words, of_counts(written)
        return model

    # Words of at least a quarter of a shard's mean share of the tokens: at most four a shard.
    limit = max(1, model.tokens // (4 * buckets))

    def frequent(batches):
        for b in batches:
            for k in b.column(0).to_pylist():
                at = np.flatnonzero(model.counts("count", k) > limit)
                yield pa.record_batch([pa.array(at + model.base[k], pa.int64())], names=["id"])

    hot = spark.range(buckets).repartition(min(buckets, shuffle_partitions(spark)), "id").mapInArrow(frequent, "id long").collect()
    model.hot = np.sort(np.array([r["id"] for r in hot], np.int64))

    most = GRAMS

    def count_grams(batches):
        tokens, held = Tokens(), Grams(order)
        for _, data, offs in text_blocks(batches):
            hashes, at = tokens(data, offs)
            words, inverse = coded(hashes)
            ids = model.ids(words)
            w = ids[inverse]
            held.add([c.astype(np.uint64) for c in (*histories(w, at, int(ids[np.searchsorted(words, END_HASH)]), order), w)])
            if held.size > most and held.merge() > most // 2:
                yield from held.rows(model)
        yield from held.rows(model)

    def write_level(t: pa.Table, k: int) -> pa.Table:
        """Write a shard of n-grams of ``k`` words; rows of kind 0: counts of counts,
        1: suffixes for the order below, 2: sums of spread contexts."""
        b = t.column("bucket")[0].as_py()
        keys, cols, n = unpack_grams(t, k)
        _put_table(folder, f"gram{k}", b, keys, [n])
        out = [(0, b, 5, pack_arrays(_of_counts(n)))]
        ctx, hot = gram_key(cols[:-1]), model.is_hot(cols[-2])
        for which in (~hot, hot):
            order = np.argsort(ctx[which])
            own, c = ctx[which][order], n[which][order]
            first = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, np.int64)
            stats = [np.add.reduceat(x.astype(np.int64), first) if len(first) else np.zeros(0, np.int64) for x in (c, c == 1, c == 2, c >= 3)]
            if which is not hot:
                _put_table(folder, f"ctx{k}", b, own[first], stats)
                continue
            owner = model.spread(own[first])
            order = _bucket_order(owner)
            for o, part in _groups(owner[order]):
                here = order[part]
                out.append((2, o, len(here), pack_arrays(own[first][here], *(x[here] for x in stats))))
        rest, rest_cols, rest_n = distinct(gram_key(cols[1:]), cols[1:])
        bucket = model.word_bucket(rest_cols[0]) if k == 2 else model.gram_bucket(rest, rest_cols[-2])
        out += [(1, *row) for row in by_bucket(bucket, rest_cols, rest_n)]
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out), PARTS_ARROW)], schema=PARTS_ARROW)

    def write_hot(t: pa.Table, k: int) -> pa.Table:
        b = t.column("bucket")[0].as_py()
        parts = [unpack_arrays(x.as_py(), n, np.uint64, *[np.int64] * 4) for x, n in zip(t.column("body"), t.column("n").to_pylist())]
        keys, *stats = (np.concatenate([p[j] for p in parts]) for j in range(5))
        _put_table(folder, f"hot{k}", b, distinct(keys, [])[0], [distinct(keys, [], x)[2] for x in stats])
        return pa.table([pa.array([b], pa.int32()), pa.array([len(keys)], pa.int32()), pa.array([b""], pa.binary())], schema=ENTRIES_ARROW)

    def write_before(t: pa.Table) -> pa.Table:
        b = t.column("bucket")[0].as_py()
        _, (ids,), n = unpack_grams(t, 1)
        before = np.zeros(int(model.sizes[b]), np.int64)
        before[ids.astype(np.int64) - model.base[b]] = n
        _put_counts(folder, "before", b, before)
        return pa.table([pa.array([0], pa.int32()), pa.array([len(ids)], pa.int32()), pa.array([pack_arrays(_of_counts(n))], pa.binary())], schema=ENTRIES_ARROW)

    at_level = lambda write, k: lambda t: write(t, k)
    entries, last = texts.mapInArrow(count_grams, ENTRIES), None
    for k in range(order, 1, -1):
        parts = save(entries.groupBy("bucket").applyInArrow(at_level(write_level, k), PARTS), "lm-parts")
        if last is not None:
            drop(last)
        model.of_counts[k] = of_counts(parts.where("kind = 0").collect())  # a row a shard
        parts.where("kind = 2").drop("kind").groupBy("bucket").applyInArrow(at_level(write_hot, k), ENTRIES).count()
        entries, last = parts.where("kind = 1").drop("kind"), parts
    words = entries.groupBy("bucket").applyInArrow(lambda t: write_before(t), ENTRIES).collect()  # a row a shard
    model.of_counts[1], model.kinds = of_counts(words), sum(r["n"] for r in words)
    drop(last)
    return model


def score(docs: DataFrame, folds: int = 7, held_out: int = 2, order: int = 3) -> DataFrame:
    """Score every whole text by a model of those outside fold ``held_out``."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == held_out, F.lit(False))
    d = documents(docs).withColumn("held_out", held)
    model = train(d.where("not held_out").select("doc_id", "text"), order)

    def run(batches):
        tokens, own = Tokens(), worker_cache(model.folder, lambda: model)
        for rows, data, offs in text_blocks(batches, 4 << 20):
            n, known, base, full = own.score(*tokens(data, offs))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array(n, pa.int64()), pa.array(known, pa.int64()),
                                              pa.array(base, pa.float64()), pa.array(full, pa.float64())], schema=SCORES_ARROW)

    return d.mapInArrow(run, SCORES).withColumn("train_tokens", F.lit(model.tokens).cast("long"))
