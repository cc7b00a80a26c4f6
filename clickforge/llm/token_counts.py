"""Token counts by compiled finite-state transducers.

A byte-level BPE tokenizer is compiled into two deterministic machines:

* the *cutter* reads classes of characters and marks where the library's
  pre-tokenizer starts a word. It has 13 states, so a chunk of text is a map
  from entry state to exit state; the maps of all chunks compose through a
  parallel prefix scan, which gives every chunk its true entry state. The class
  of a character is read off the library's own pre-tokenizer.
* the *counter* reads the bytes of a word; each transition is annotated with
  the change of the number of tokens that BPE gives the bytes read so far. Its
  states hold what later bytes can still depend on: the longest open token
  prefix, and the last token and count at each place where a token may still
  start. Two tokens may follow each other if BPE of their joint bytes gives
  them back. States are made when first reached and kept by the worker, within
  a bound; beyond it the table starts anew, which costs time only.

Both run side by side over all chunks or words of a block in numpy.

Cases: null or empty text has 0 bytes and 0 tokens; special strings inside a
text count as one token, as the library's default does; repeated rows and ids
are counted each; an empty table gives an empty result; further columns are
ignored; texts of any length are read whole.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, text_blocks, worker_cache

CHUNK = 512
#: All letters, numbers and spaces that any Unicode version so far assigns lie below.
CLASSED = 0x323B0
#: States of the counter that a worker keeps.
MAX_STATES = 150_000

LETTER, STMD, R, V, L_, E, NUMBER, OTHER, QUOTE, BLANK, SPACE, END = range(12)
START, IN_LETTERS, IN_NUMBERS, IN_OTHER, AT_QUOTE, QUOTE_R, QUOTE_V, QUOTE_L, AFTER_SUFFIX, BLANK1, SPACE1, BLANKS, SPACES = range(13)
#: Marks a transition carries: a word starts here; a word starts one character before.
HERE, BEFORE = 1, 2
COUNTS = "doc_id long, n_bytes long, n_tokens long"
COUNTS_ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])


def cutter() -> tuple[np.ndarray, np.ndarray]:
    """Next state and marks, by state and class, of the byte-level pattern
    ``'s|'t|'re|'ve|'m|'ll|'d| ?letters| ?numbers| ?others|spaces(?!\\S)|spaces``."""
    begin = [IN_LETTERS] * 6 + [IN_NUMBERS, IN_OTHER, AT_QUOTE, BLANK1, SPACE1, START]
    after_blank = [IN_LETTERS] * 6 + [IN_NUMBERS, IN_OTHER, IN_OTHER]
    stays = {IN_LETTERS: range(6), IN_NUMBERS: (NUMBER,), IN_OTHER: (OTHER, QUOTE)}
    wanted = {QUOTE_R: E, QUOTE_V: E, QUOTE_L: L_}
    after_quote = {STMD: AFTER_SUFFIX, R: QUOTE_R, V: QUOTE_V, L_: QUOTE_L, OTHER: IN_OTHER, QUOTE: IN_OTHER}
    step, marks = np.zeros((13, 12), np.uint8), np.zeros((13, 12), np.uint8)
    for s in range(13):
        for c in range(12):
            to, mark = begin[c], HERE if c != END else 0
            if c in stays.get(s, ()):
                to, mark = s, 0
            elif s == AT_QUOTE and c in after_quote:
                to, mark = after_quote[c], 0
            elif s in wanted:
                if c == wanted[s]:
                    to, mark = AFTER_SUFFIX, 0
                else:  # no suffix: the letter after the quote starts a word
                    to, mark = (IN_LETTERS, BEFORE) if c < 6 else (to, mark | BEFORE)
            elif s in (BLANK1, SPACE1, BLANKS, SPACES) and c != END:
                if c in (BLANK, SPACE):
                    to, mark = BLANKS if c == BLANK else SPACES, 0
                else:  # the last space of a run stands apart; a blank belongs to what follows
                    if s in (BLANK1, BLANKS):
                        to, mark = after_blank[c], 0
                    mark |= BEFORE if s in (BLANKS, SPACES) else 0
            step[s, c], marks[s, c] = to, mark
    return step, marks


def character_classes(path: str) -> np.ndarray:
    """The class of each character, probed from the library's pre-tokenizer."""
    from tokenizers import Tokenizer

    cut = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    out = np.full(CLASSED, SPACE, np.uint8)
    for base in range(0, CLASSED, 1 << 14):
        points = [c for c in range(base, min(base + (1 << 14), CLASSED)) if not 0xD800 <= c < 0xE000]
        if not points:
            continue
        for before, other, kind in (("a", "1", LETTER), ("1", "a", NUMBER), ("!", "a", OTHER)):
            text = "".join([other + before + chr(c) for c in points])
            starts = np.zeros(len(text) + 1, bool)
            starts[[a for _, (a, _) in cut(text)]] = True
            joined = ~starts[np.arange(len(points)) * 3 + 2]
            out[np.array(points)[joined]] = kind
    for c, kind in zip("stmdrvle'", (STMD, STMD, STMD, STMD, R, V, L_, E, QUOTE)):
        out[ord(c)] = kind
    out[0x20] = BLANK
    out[0xD800:0xE000] = OTHER
    return out


def word_starts(classes: np.ndarray, step: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Where words start in a stream of classes that ends with END."""
    n = -(-len(classes) // CHUNK)
    grid = np.full(n * CHUNK, END, np.uint8)
    grid[:len(classes)] = classes
    grid = np.ascontiguousarray(grid.reshape(n, CHUNK).T).astype(np.intp)  # a row a step, a column a chunk
    flat, flat_marks = step.reshape(-1).astype(np.intp) * 12, marks.reshape(-1)
    # 1. The state map of each chunk; once all entry states meet, one is followed.
    maps = np.repeat(np.arange(13)[:, None] * 12, n, 1)
    for k in range(16):
        maps = flat[maps + grid[k]]
    met = (maps == maps[0]).all(0)
    one, rest = np.flatnonzero(met), np.flatnonzero(~met)
    a, b, ga, gb = maps[0, one], maps[:, rest], grid[:, one], grid[:, rest]
    for k in range(16, CHUNK):
        a = flat[a + ga[k]]
        b = flat[b + gb[k]]
    maps[:, one], maps[:, rest] = a, b
    maps //= 12
    # 2. Prefix scan: maps[:, i] becomes the composition of the chunks up to i.
    by = 1
    while by < n:
        maps[:, by:] = np.take_along_axis(maps[:, by:], maps[:, :-by], 0)
        by *= 2
    # 3. Again from the true entry states, with marks.
    state = np.append(START, maps[START, :-1]) * 12
    seen = np.zeros((CHUNK, n), np.uint8)
    for k in range(CHUNK):
        at = state + grid[k]
        seen[k] = flat_marks[at]
        state = flat[at]
    seen = seen.T.reshape(-1)[:len(classes)]
    out = (seen & HERE).astype(bool)
    out[:-1] |= (seen[1:] & BEFORE).astype(bool)
    return out


class Counter:
    """The counting machine of one vocabulary."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        if spec["normalizer"] is not None or spec["pre_tokenizer"]["type"] != "ByteLevel" or model["type"] != "BPE":
            raise ValueError("only byte-level BPE vocabularies without a normalizer are compiled")
        self.special = [x["content"].encode() for x in spec["added_tokens"]]
        # The byte-level alphabet: printable Latin-1 stands for itself, the rest follows from 256.
        keep = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        byte_of = {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*keep}))}
        self.id = {bytes(byte_of[c] for c in t): i for t, i in model["vocab"].items() if all(c in byte_of for c in t)}
        self.text = {i: t for t, i in self.id.items()}
        self.rank = {}
        for k, m in enumerate(model["merges"]):
            x, y = m.split(" ") if isinstance(m, str) else m
            x, y = (bytes(byte_of[c] for c in s) for s in (x, y))
            self.rank[self.id[x], self.id[y]] = (k, self.id[x + y])
        self.open = {t[:k] for t in self.id for k in range(1, len(t))}  # what a longer token may start with
        self.fits: dict[tuple[int, int], bool] = {}
        self._clear()

    def bpe(self, raw: bytes) -> list[int]:
        ids = [self.id[raw[i:i + 1]] for i in range(len(raw))]
        while len(ids) > 1:
            best = min(((self.rank.get(p, (1 << 60,))[0], i) for i, p in enumerate(zip(ids, ids[1:]))))
            if best[0] == 1 << 60:
                break
            k, i = best
            pair, new = (ids[i], ids[i + 1]), self.rank[ids[i], ids[i + 1]][1]
            out, j = [], 0
            while j < len(ids):  # all places of this pair, from the left
                if j + 1 < len(ids) and (ids[j], ids[j + 1]) == pair:
                    out.append(new)
                    j += 2
                else:
                    out.append(ids[j])
                    j += 1
            ids = out
        return ids

    def may_follow(self, last: int, token: int) -> bool:
        """Whether BPE keeps ``token`` whole after ``last`` (-1: at a word's start)."""
        key = (last, token)
        if key not in self.fits:
            raw = self.text[token]
            self.fits[key] = self.bpe(raw) == [token] if last < 0 else (
                self.may_follow(-1, token) and self.bpe(self.text[last] + raw) == [last, token])
        return self.fits[key]

    def _clear(self) -> None:
        self.fits.clear()
        self.states: dict[tuple, int] = {}
        self.about: list[tuple] = []
        self.column = np.full(256, -1, np.intp)
        self.bytes_seen = 0
        self.next = np.full((1024, 32), -1, np.int32)
        self.change = np.zeros((1024, 32), np.int16)
        self._state((b"", ((0, -1, 0),)))

    def _state(self, key: tuple) -> int:
        """key: the longest open prefix before this place, and (bytes back, last
        token there, count there less the count here) for each open prefix."""
        if key not in self.states:
            self.states[key] = len(self.about)
            self.about.append(key)
            if len(self.about) > len(self.next):
                self.next = np.concatenate([self.next, np.full_like(self.next, -1)])
                self.change = np.concatenate([self.change, np.zeros_like(self.change)])
        return self.states[key]

    def _make(self, state: int, byte: int) -> None:
        prefix, places = self.about[state]
        read = prefix + bytes([byte])
        for back, last, count in places:  # the longest first; one token only fits
            token = self.id.get(read[len(read) - back - 1:])
            if token is not None and self.may_follow(last, token):
                break
        else:
            raise ValueError("no token fits: the vocabulary isn't closed under its merges")
        change = count + 1
        still = [(b + 1, t, c - change) for b, t, c in places if read[len(read) - b - 1:] in self.open]
        longest = still[0][0] if still else 0
        to = self._state((read[len(read) - longest:], (*still, (0, token, 0))))
        self.next[state, self.column[byte]] = to
        self.change[state, self.column[byte]] = change

    def count(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The number of tokens of each word data[start:start + size]."""
        if len(self.about) > MAX_STATES:
            self._clear()
        for b in np.flatnonzero(np.bincount(data, minlength=256)):
            if self.column[b] < 0:
                self.column[b] = self.bytes_seen
                self.bytes_seen += 1
        while self.bytes_seen > self.next.shape[1]:
            self.next = np.concatenate([self.next, np.full_like(self.next, -1)], 1)
            self.change = np.concatenate([self.change, np.zeros_like(self.change)], 1)
        order = np.argsort(-size, kind="stable")
        start, longest_first = start[order], -size[order]
        state = np.zeros(len(start), np.int64)
        tokens = np.zeros(len(start), np.int64)
        columns = self.column[data]
        for k in range(int(size.max(initial=0))):
            live = int(np.searchsorted(longest_first, -k))
            at = state[:live] * self.next.shape[1] + columns[start[:live] + k]
            to = self.next.reshape(-1)[at]
            if (to < 0).any():
                for i in np.unique(at[to < 0]):
                    s, c = divmod(int(i), self.next.shape[1])
                    self._make(s, int(np.flatnonzero(self.column == c)[0]))
                to = self.next.reshape(-1)[at]
            tokens[:live] += self.change.reshape(-1)[at]
            state[:live] = to
        out = np.empty_like(tokens)
        out[order] = tokens
        return out


def count_block(counter: Counter, classes_of: np.ndarray, machine: tuple, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The number of tokens of each text of a block."""
    raw = data.tobytes()
    n = len(offs) - 1
    total = np.zeros(n, np.int64)
    # Segments: texts, cut at special strings.
    start, end, doc = offs[:-1], offs[1:], np.arange(n)
    found = sorted((raw.index(s, a), len(s)) for s in counter.special for a in _places(raw, s))
    if found:
        cuts = [(int(np.searchsorted(offs, at, "right")) - 1, at, size) for at, size in found]
        cuts = [(d, at, size) for d, at, size in cuts if at + size <= offs[d + 1]]
        total += np.bincount([d for d, _, _ in cuts], minlength=n)
        start = np.concatenate([start, [at + size for _, at, size in cuts]]).astype(np.int64)
        doc = np.concatenate([doc, [d for d, _, _ in cuts]]).astype(np.int64)
        order = np.lexsort((start, doc))
        start, doc = start[order], doc[order]
        stops = {(d, k): at for k, (d, at, _) in enumerate(cuts)}
        end = np.append(start[1:], len(data))
        for (d, _), at in stops.items():
            i = int(np.searchsorted(start, at, "right")) - 1
            while start[i] > at or doc[i] != d:
                i -= 1
            end[i] = at
    keep = end > start
    start, end, doc = start[keep], end[keep], doc[keep]
    if not len(start):
        return total
    first = (data & 0xC0) != 0x80  # the first byte of each character
    points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
    kind = np.where(points < CLASSED, classes_of[np.minimum(points, CLASSED - 1)], OTHER).astype(np.uint8)
    before = np.append(0, np.cumsum(first))
    from_char, to_char = before[start], before[end]
    size = to_char - from_char + 1
    place = np.cumsum(size) - size
    stream = np.full(int(size.sum()), END, np.uint8)
    inside = np.ones(len(stream), bool)
    inside[place + size - 1] = False
    chosen = np.repeat(from_char - place, size)[inside] + np.flatnonzero(inside)
    stream[inside] = kind[chosen]
    word = word_starts(stream, *machine)[inside]
    byte_at = np.flatnonzero(first)[chosen[word]]
    owner = np.searchsorted(start, byte_at, "right") - 1
    stop = np.minimum(np.append(byte_at[1:], len(data)), end[owner])
    tokens = counter.count(data, byte_at, stop - byte_at)
    return total + np.bincount(doc[owner], tokens, n).astype(np.int64)


def _places(raw: bytes, what: bytes):
    at = raw.find(what)
    while at >= 0:
        yield at
        at = raw.find(what, at + len(what))


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each whole text."""
    classes, machine = character_classes(tokenizer), cutter()

    def count(batches):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        counter = worker_cache(f"counter:{tokenizer}", lambda: Counter(tokenizer))
        for rows, data, offs in text_blocks(batches):
            tokens = count_block(counter, classes, machine, data, offs)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(offs)), pa.array(tokens)], schema=COUNTS_ARROW)

    return documents(docs).mapInArrow(count, COUNTS).withColumn("over_limit", F.col("n_tokens") > limit)
