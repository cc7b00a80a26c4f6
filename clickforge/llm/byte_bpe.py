"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

A text is split by the pattern of the vocabulary (one in which white space only
begins a match); each match is encoded on its own. For a match of n bytes a
segment tree over its positions holds, in every node, the least (rank, position)
of the live pairs below, so its root is the leftmost pair of the lowest rank. A
merge takes the root's pair, removes the right half's leaf and renews the leaves
of the pairs with both live neighbours: three updates from leaf to root, so a
match takes n log n steps, whatever it holds. The trees of short matches are
worked on side by side. A match that is itself a token is that token, as in the
library.

Texts are cut with numpy where a match surely ends (before ASCII white space
or, after an ASCII letter, ASCII punctuation); Arrow finds the distinct units
of a block, each worker encodes a unit once while it remembers it, and ids and
decoded bytes are gathered by array operations. Long texts are read in slices,
so a task holds some megabytes of a text and the ids of one slice.

Cases: null or empty text has no ids; null doc_ids, repeated rows and ids keep
a row each; empty tables give empty results; further columns are ignored;
special strings are ordinary text; a text without any place to cut is one unit.
"""

from __future__ import annotations

import base64
import hashlib
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import documents, string_array, text_slices, worker_cache

SLICE_BYTES = 2 << 20
#: Bytes of units and ids that a worker remembers, about; beyond, it starts afresh, which costs time only.
REMEMBERED = 160 << 20
#: Sizes of the trees that are worked on side by side; a longer match has a tree of its own.
SIZES = (4, 8, 16, 32)
NONE, FULL = (1 << 63) - 1, (1 << 31) - 1

CODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
CODED_ARROW = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
IDS = "doc_id long, n_tokens long, ids binary"
IDS_ARROW = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

_BYTE = np.arange(256)
_SPACE = np.isin(_BYTE, [0x20, *range(0x09, 0x0E)])
_VISIBLE = (_BYTE > 0x20) & (_BYTE < 0x7F)
_LETTER = _VISIBLE & np.isin(_BYTE | 0x20, np.arange(97, 123))
_MARK = _VISIBLE & ~_LETTER & ~np.isin(_BYTE, np.arange(48, 58))


def may_cut(before: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a match of the pattern surely begins at a byte, by it and the one before."""
    return (_SPACE[at] & _VISIBLE[before]) | (_MARK[at] & _LETTER[before])


class LowestPairs:
    """Segment trees over byte positions, one for each of many matches.

    A node holds the least rank * size + position of the live pairs below it (a
    pair lies at its left half), so a root is the leftmost pair of the lowest
    rank. Many matches of like length are worked on side by side.
    """

    def __init__(self, size: int, ranks: np.ndarray):
        self.size = size
        self.node = np.full((len(ranks), 2 * size), FULL, np.int32)
        self._put(self.node[:, size:], ranks)
        at = size
        while at > 1:
            self.node[:, at // 2:at] = np.minimum(self.node[:, at:2 * at:2], self.node[:, at + 1:2 * at:2])
            at //= 2

    def _put(self, leaves: np.ndarray, ranks: np.ndarray) -> None:
        leaves[:] = np.where(ranks >= 0, ranks * self.size + np.arange(self.size), FULL)

    def lowest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The rows that still have a pair, its position and its rank."""
        top = self.node[rows, 1].astype(np.int64)
        live = top != FULL
        return rows[live], top[live] % self.size, top[live] // self.size

    def set(self, rows: np.ndarray, at: np.ndarray, rank: np.ndarray) -> None:
        """Renew one leaf in each row, and the nodes up to the root."""
        node, k = self.node.reshape(-1), rows * (2 * self.size)
        low = at + self.size
        node[k + low] = np.where(rank >= 0, rank * self.size + at, FULL)
        level = self.size
        while level > 1:
            low, level = low >> 1, level >> 1
            below = k + 2 * low
            node[k + low] = np.minimum(node[below], node[below + 1])


class LowestPair:
    """The same for one long match, whose nodes are renewed only as far as they change."""

    def __init__(self, ranks: list[int | None]):
        self.size = 1 << max(len(ranks) - 1, 0).bit_length()
        self.node = array("q", [NONE]) * (2 * self.size)
        for at, rank in enumerate(ranks):
            if rank is not None:
                self.node[self.size + at] = rank << 32 | at
        for k in range(self.size - 1, 0, -1):
            self.node[k] = min(self.node[2 * k], self.node[2 * k + 1])

    def lowest(self) -> tuple[int, int] | None:
        top = self.node[1]
        return None if top == NONE else (top >> 32, top & 0xFFFFFFFF)

    def set(self, at: int, rank: int | None) -> None:
        node, k = self.node, self.size + at
        node[k] = NONE if rank is None else rank << 32 | at
        k >>= 1
        while k:
            least = min(node[2 * k], node[2 * k + 1])
            if node[k] == least:
                return
            node[k] = least
            k >>= 1


class ByteBpe:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.rank = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.pattern = regex.compile(pattern)
        self.longest = max(map(len, self.rank))
        token = [b""] * (max(self.rank.values()) + 1)
        for t, r in self.rank.items():
            token[r] = t
        self.token_size = np.array([len(t) for t in token], np.int64)
        self.token_at = np.cumsum(self.token_size) - self.token_size
        self.token_bytes = np.frombuffer(b"".join(token), np.uint8)
        self.of_byte = np.array([self.rank[bytes([k])] for k in range(256)], np.int64)
        # Every two tokens that together are a token, in the order of (left, right).
        halves = sorted((self.rank[t[:k]] << 32 | self.rank[t[k:]], r) for t, r in self.rank.items()
                        for k in range(1, len(t)) if t[:k] in self.rank and t[k:] in self.rank)
        self.pairs, self.pair_rank = (np.array(x, np.int64) for x in zip(*halves)) if halves else (np.zeros(0, np.int64),) * 2
        self._forget()

    def _forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.start, self.count = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.pool, self.used, self.held = np.zeros(1 << 16, np.uint32), 0, 0

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of tokens; -1: no token."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where((self.pairs[at] == key) & (left >= 0) & (right >= 0), self.pair_rank[at], -1)

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one match."""
        if (whole := self.rank.get(piece)) is not None:
            return [whole]
        n, rank, longest = len(piece), self.rank, self.longest
        tree = LowestPair([*(rank.get(piece[k:k + 2]) for k in range(n - 1)), None])
        ids = array("q", [rank[piece[k:k + 1]] for k in range(n)])
        after, before = array("q", range(1, n + 1)), array("q", range(-1, n - 1))
        pair = lambda a, b: rank.get(piece[a:b]) if b - a <= longest else None
        while (found := tree.lowest()) is not None:
            ids[found[1]], left = found
            right = after[left]
            behind = after[left] = after[right]
            tree.set(right, None)
            if behind < n:
                before[behind] = left
                tree.set(left, pair(left, after[behind]))
            else:
                tree.set(left, None)
            if before[left] >= 0:
                tree.set(before[left], pair(before[left], behind))
        out, at = [], 0
        while at < n:
            out.append(ids[at])
            at = after[at]
        return out

    def merge_many(self, pieces: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many matches of at most ``size`` bytes, end to end, and how many each has."""
        n = np.array([len(x) for x in pieces])
        rows, col = np.arange(len(pieces)), np.arange(size)
        ids = np.full((len(pieces), size), -1, np.int64)
        ids[col < n[:, None]] = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        after, before = np.tile(col + 1, (len(pieces), 1)), np.tile(col - 1, (len(pieces), 1))
        ranks = np.full(ids.shape, -1, np.int64)
        ranks[:, :-1] = self.ranks(ids[:, :-1], ids[:, 1:])
        tree = LowestPairs(size, ranks)
        while True:
            rows, left, rank = tree.lowest(rows)
            if not len(rows):
                break
            right = after[rows, left]
            behind = after[rows, right]
            ids[rows, left], ids[rows, right] = rank, -1
            after[rows, left] = behind
            more = behind < n[rows]
            before[rows[more], behind[more]] = left[more]
            tree.set(rows, right, np.full(len(rows), -1))
            ahead = np.full(len(rows), -1, np.int64)
            ahead[more] = self.ranks(rank[more], ids[rows[more], behind[more]])
            tree.set(rows, left, ahead)
            last = before[rows, left]
            has = last >= 0
            tree.set(rows[has], last[has], self.ranks(ids[rows[has], last[has]], rank[has]))
        return ids[ids >= 0], np.count_nonzero(ids >= 0, axis=1)

    def matches(self, unit: bytes) -> list[bytes]:
        if unit.isalpha() or unit[:1] == b" " and unit[1:].isalpha():  # ASCII letters, with a space before them or none: one match
            return [unit]
        return [m.group().encode() for m in self.pattern.finditer(unit.decode())]

    def encode_units(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units, end to end, and how many each has."""
        pieces, of = [], []
        for k, u in enumerate(units):
            found = self.matches(u)
            pieces += found
            of += [k] * len(found)
        whole = np.fromiter((self.rank.get(x, -1) for x in pieces), np.int64, len(pieces))
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        count, done = np.ones(len(pieces), np.int64), []
        for size, least in zip(SIZES, (0, *SIZES)):
            here = np.flatnonzero((whole < 0) & (sizes > least) & (sizes <= size))
            if len(here):
                ids, count[here] = self.merge_many([pieces[k] for k in here.tolist()], size)
                done.append((here, ids))
        for k in np.flatnonzero((whole < 0) & (sizes > SIZES[-1])).tolist():
            ids = np.array(self.merge(pieces[k]), np.int64)
            count[k] = len(ids)
            done.append((np.array([k]), ids))
        start = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.uint32)
        out[start[whole >= 0]] = whole[whole >= 0]
        for here, ids in done:
            n = count[here]
            out[np.repeat(start[here] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        return out, np.bincount(np.array(of, np.int64), count, len(units)).astype(np.int64)

    def encode(self, text: str) -> list[int]:
        return self.encode_units([text.encode()])[0].tolist() if text else []

    def _learn(self, units: list[bytes]) -> None:
        ids, count = self.encode_units(units)
        k, to = len(self.place), self.used + len(ids)
        if k + len(units) > len(self.start):
            more = np.zeros(k + len(units), np.int64)
            self.start, self.count = np.append(self.start, more), np.append(self.count, more)
        if to > len(self.pool):
            self.pool = np.append(self.pool, np.zeros(to, np.uint32))
        self.pool[self.used:to] = ids
        self.start[k:k + len(units)], self.count[k:k + len(units)] = self.used + np.cumsum(count) - count, count
        self.used = to
        self.place.update(zip(units, range(k, k + len(units))))
        self.held += sum(map(len, units)) + 4 * len(ids) + 150 * len(units)

    def encode_slice(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts of a block, end to end, and where each text's begin."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
        first = np.zeros(len(data), bool)
        first[1:] = may_cut(data[:-1], data[1:])
        first[offs[:-1][offs[:-1] < len(data)]] = True
        starts = np.flatnonzero(first)
        units = string_array(data, starts, np.append(starts[1:], len(data)), pa.large_binary()).dictionary_encode()
        distinct = units.dictionary.to_pylist()
        if self.held > REMEMBERED:
            self._forget()
        new = [u for u in distinct if u not in self.place]
        if new:
            self._learn(new)
        at = np.fromiter(map(self.place.__getitem__, distinct), np.int64, len(distinct))
        which = units.indices.to_numpy()
        count = self.count[at][which]
        ends = np.cumsum(count)
        ids = self.pool[np.repeat(self.start[at][which] - (ends - count), count) + np.arange(ends[-1])]
        return ids, np.append(0, ends)[np.searchsorted(starts, offs)]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids, as one array."""
        size = self.token_size[ids]
        ends = np.cumsum(size)
        return self.token_bytes[np.repeat(self.token_at[ids] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


def encode(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian uint32) of every whole text."""

    def run(batches):
        bpe = worker_cache(f"byte_bpe:{ranks}:{pattern}", lambda: ByteBpe(ranks, pattern))
        long: list[bytes] = []
        for rows, data, offs, first, last in text_slices(batches, SLICE_BYTES, may_cut):
            ids, at = bpe.encode_slice(data, offs)
            raw = ids.astype("<u4").tobytes()
            if not (first and last):
                long.append(raw)
                if not last:
                    continue
                raw, long = b"".join(long), []
                at = np.array([0, len(raw) // 4])
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(at)), pa.array(
                [raw[4 * a:4 * b] for a, b in zip(at.tolist(), at[1:].tolist())], pa.binary())], schema=IDS_ARROW)

    return documents(docs).mapInArrow(run, IDS)


def decode(coded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, decoded bytes of rows that :func:`encode` gave."""

    def run(batches):
        bpe = worker_cache(f"byte_bpe:{ranks}:{pattern}", lambda: ByteBpe(ranks, pattern))
        for b in batches:
            for k in range(b.num_rows):
                ids = np.frombuffer(b.column(2)[k].as_buffer(), "<u4")
                raw = b"".join(bpe.decode(ids[a:a + SLICE_BYTES]).tobytes() for a in range(0, len(ids), SLICE_BYTES))
                yield pa.record_batch([b.column(0)[k:k + 1], b.column(1)[k:k + 1], pa.array([raw], pa.binary())], names=["doc_id", "n_tokens", "decoded"])

    return coded.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id long, n_tokens long, decoded binary")


def digests(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and the sha256 of ids and of the bytes decoded from them.

    Encoded and decoded slice by slice in one task; the digests grow with the
    slices, so no text's ids are held whole.
    """

    def run(batches):
        bpe = worker_cache(f"byte_bpe:{ranks}:{pattern}", lambda: ByteBpe(ranks, pattern))
        n, of_ids, of_text = 0, hashlib.sha256(), hashlib.sha256()
        for rows, data, offs, first, last in text_slices(batches, SLICE_BYTES, may_cut):
            ids, at = bpe.encode_slice(data, offs)
            raw, back = memoryview(ids.astype("<u4").tobytes()), memoryview(bpe.decode(ids).tobytes())
            if first and last:
                to = np.append(0, np.cumsum(bpe.token_size[ids]))[at].tolist()
                at = at.tolist()
                yield pa.RecordBatch.from_arrays([
                    rows.column(0), pa.array(np.diff(at)),
                    pa.array([hashlib.sha256(raw[4 * a:4 * b]).hexdigest() for a, b in zip(at, at[1:])], pa.string()),
                    pa.array([hashlib.sha256(back[a:b]).hexdigest() for a, b in zip(to, to[1:])], pa.string())], schema=CODED_ARROW)
                continue
            n += len(ids)
            of_ids.update(raw)
            of_text.update(back)
            if last:
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([n], pa.int64()), pa.array([of_ids.hexdigest()]),
                                                  pa.array([of_text.hexdigest()])], schema=CODED_ARROW)
                n, of_ids, of_text = 0, hashlib.sha256(), hashlib.sha256()

    return documents(docs).mapInArrow(run, CODED)
