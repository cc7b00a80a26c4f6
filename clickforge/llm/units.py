"""Token ids of whole texts by the tokenizers library, each distinct unit once.

Both kinds of vocabulary used here (byte-level, and lower-cased words) always
start a new token at white space after other text, and at ASCII punctuation
after a letter. Blocks of texts are cut there with numpy; the library encodes
each distinct unit once per worker, and the ids of a text are gathered from
that cache. Units are found by a hash and compared byte by byte. Where a cut is not certain (white space outside ASCII, say), none
is made and the unit is longer; a text that holds a special string goes to the
library whole.
"""

from __future__ import annotations

import json
import os

import numpy as np

from .common import PrefixHash

#: Units a worker's cache may hold; a full cache is emptied, which costs time only.
CACHE_UNITS = 1_000_000
#: Units the library encodes at a time; what it returns for one takes a kilobyte or so.
BATCH_UNITS = 4096


class UnitEncoder:
    """``encode_block(data, offs)``: the ids of a block's texts laid end to end
    (uint16), and n + 1 offsets. Empty texts have no ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ["RAYON_NUM_THREADS"] = "1"
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        self.whole = Tokenizer.from_file(path)
        self.plain = Tokenizer.from_file(path)
        self.plain.encode_special_tokens = True  # units hold no special strings; not looking for them is faster
        if self.whole.get_vocab_size() > 1 << 16:
            raise ValueError("ids over 65,535 are not supported")
        self.special = [x["content"].encode() for x in spec["added_tokens"]]
        table = np.arange(256, dtype=np.uint8)
        if spec["normalizer"] is not None:  # lower-cased by the library anyway: fewer distinct units
            table[65:91] += 32
        self.fold = table
        byte = np.arange(256)
        self.space = np.isin(byte, [0x20, 0x09, 0x0A, 0x0D])
        self.visible = (byte > 0x20) & (byte < 0x7F)
        self.letter = self.visible & np.isin(byte | 0x20, np.arange(97, 123))
        self.mark = self.visible & ~self.letter & ~np.isin(byte, np.arange(48, 58))
        self.hash = PrefixHash(7)
        self._clear()

    def _clear(self) -> None:
        self.keys, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # sorted; where the unit's other numbers are
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint16)
        self.text_start, self.text_size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.text = np.zeros(0, np.uint8)  # of the units, to tell apart those of one hash

    def _cuts(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Sorted starts of the block's units; every text's start is one."""
        prev, cur = data[:-1], data[1:]
        two = np.zeros(len(prev), bool)  # prev ends a letter of two bytes, U+00C0 to U+024F but for two signs
        two[1:] = (data[:-2] >= 0xC3) & (data[:-2] <= 0xC8) & (prev[1:] >= 0x80)
        two[1:] &= ~((data[:-2] == 0xC3) & ((prev[1:] == 0x97) | (prev[1:] == 0xB7)))
        cut = self.space[cur] & (self.visible[prev] | two)
        cut |= self.mark[cur] & (self.letter[prev] | two)
        first = np.zeros(len(data), bool)
        first[1:] = cut
        first[offs[:-1][offs[:-1] < len(data)]] = True
        return np.flatnonzero(first)

    def _learn(self, keys: np.ndarray, units: list[bytes]) -> None:
        size, parts = np.zeros(len(units), np.int64), []
        for k in range(0, len(units), BATCH_UNITS):
            found = [e.ids for e in self.plain.encode_batch_fast([u.decode() for u in units[k:k + BATCH_UNITS]], add_special_tokens=False)]
            size[k:k + len(found)] = [len(x) for x in found]
            parts.append(np.fromiter((i for x in found for i in x), np.uint16))
        ids = np.concatenate(parts)
        start = len(self.pool) + np.cumsum(size) - size
        at = np.searchsorted(self.keys, keys)
        self.slot = np.insert(self.slot, at, np.arange(len(self.keys), len(self.keys) + len(keys), dtype=np.int32))
        self.keys = np.insert(self.keys, at, keys)
        self.start, self.size = np.append(self.start, start), np.append(self.size, size)
        self.pool = np.concatenate([self.pool, ids])
        raw = np.frombuffer(b"".join(units), np.uint8)
        wide = np.fromiter(map(len, units), np.int64, len(units))
        self.text_start = np.append(self.text_start, len(self.text) + np.cumsum(wide) - wide)
        self.text_size = np.append(self.text_size, wide)
        self.text = np.concatenate([self.text, raw])

    def encode_block(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(offs) - 1
        raw = data.tobytes()
        alone = sorted({int(np.searchsorted(offs, at, "right")) - 1 for s in self.special for at in _places(raw, s)})
        if not len(data):
            return np.zeros(0, np.uint16), np.zeros(n + 1, np.int64)
        folded = self.fold[data]
        starts = self._cuts(data, offs)
        prefix = self.hash.prefix(folded)
        ends = np.append(starts[1:], len(data))
        keys, first, inverse = np.unique(self.hash.spans(prefix, starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > CACHE_UNITS:
            self._clear()
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        new = np.flatnonzero(self.keys[at] != keys) if len(self.keys) else np.arange(len(keys))
        if len(new):
            low = folded.tobytes()
            spans = zip(starts[first[new]].tolist(), ends[first[new]].tolist())
            self._learn(keys[new], [low[a:b] for a, b in spans])
            at = np.searchsorted(self.keys, keys)
        at = self.slot[at]
        # Units of one hash but other bytes, which some texts are made for: their texts go to the library whole.
        here, wide = starts[first], ends[first] - starts[first]
        other = _differ(folded, here, wide, self.text, self.text_start[at], self.text_size[at])[inverse]
        other |= _differ(folded, starts, ends - starts, folded, here[inverse], wide[inverse])
        if other.any():
            alone = sorted({*alone, *(np.searchsorted(offs, starts[other], "right") - 1).tolist()})
        size = self.size[at][inverse]
        ends_at = np.cumsum(size)
        where = np.repeat(self.start[at][inverse] - (ends_at - size), size) + np.arange(ends_at[-1])
        ids = self.pool[where]
        before = np.append(0, ends_at)[np.searchsorted(starts, offs)]
        if not alone:
            return ids, before
        parts, counts = [], np.diff(before)
        done = 0
        for d in alone:
            own = np.array(self.whole.encode(raw[offs[d]:offs[d + 1]].decode(), add_special_tokens=False).ids, np.uint16)
            parts += [ids[before[done]:before[d]], own]
            counts[d], done = len(own), d + 1
        parts.append(ids[before[done]:])
        return np.concatenate(parts), np.append(0, np.cumsum(counts))


def _differ(a: np.ndarray, a_at: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_at: np.ndarray, b_size: np.ndarray) -> np.ndarray:
    """Whether the spans of ``a`` and ``b`` hold other bytes."""
    out = a_size != b_size
    size = np.where(out, 0, a_size)
    ends = np.cumsum(size)
    step = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size, size)
    unlike = np.flatnonzero(a[np.repeat(a_at, size) + step] != b[np.repeat(b_at, size) + step])
    out[np.searchsorted(ends, unlike, "right")] = True
    return out


def _places(raw: bytes, what: bytes):
    at = raw.find(what)
    while at >= 0:
        yield at
        at = raw.find(what, at + 1)
