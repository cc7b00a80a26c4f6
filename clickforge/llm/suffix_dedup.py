"""Removal of repeated byte strings by blockwise suffix sorting with a difference cover.

Every byte covered by a string of ``length`` bytes that also starts earlier (in
an earlier document, by doc_id, or earlier in the same one) is removed. Nothing
is as large as a suffix array of the corpus: suffixes are sorted bucket by
bucket, a bucket being a range of fingerprints that one task holds, and only
suffixes that can have an equal are sorted at all.

* The cover: of each ``v`` successive positions of a document, those in a
  perfect difference set modulo v are samples (8 of 57). Two equal strings have,
  whatever their offsets, samples at the same place within their first v bytes.
* First the samples are sorted, by the ``length - v + 1`` bytes at each. Unique
  ones are done with; ranks of the others are their classes.
* Long ties are resolved by these sample ranks alone: each sample of a class is
  ranked by its whole context, from v - 1 bytes before it to ``length`` bytes
  behind. A sample whose context also stands at an earlier sample settles all v
  suffixes before it at once, so the inside of copies, however long or many, is
  never sorted suffix by suffix.
* Only suffixes around samples whose class holds several contexts (the ends of
  repeats, and short repeats) are sorted, by their first ``length`` bytes, and
  in a tie all but the earliest are marked.

Bytes are compared by 64-bit fingerprints within a class of 40 bits or more, and
suffixes by about 110 bits; sort order within a bucket is that of fingerprints,
which is as good as any here, for only equality and place matter.

Documents travel as compressed blocks, each with the marks for it; a task holds
one block or one bucket, and the number of buckets follows the input.

Cases: null or empty text keeps nothing and loses nothing; documents shorter
than ``length`` stay whole; null doc_ids count as the smallest; rows with the
same doc_id are in the order of the blocks they were read into, each a document
of its own; empty tables give empty results; overlaps with itself count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PrefixHash, documents, drop, mix64, pack_arrays, save, shuffle_partitions, text_blocks, unpack_arrays

BLOCK_BYTES = 1 << 20
#: Samples that a bucket holds at most, about; more input makes more buckets.
BUCKET_SAMPLES = 2_000_000
NO_ID = -(1 << 63)

SORT_KEYS = "bucket int, block long, n int, body binary, local binary"
KEYS_ARROW = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("n", pa.int32()), ("body", pa.binary()), ("local", pa.binary())])
MARKS = "block long, first int, done binary, open binary"
MARKS_ARROW = pa.schema([("block", pa.int64()), ("first", pa.int32()), ("done", pa.binary()), ("open", pa.binary())])


def difference_cover(v: int) -> list[int]:
    """The first perfect difference set modulo v = q * q + q + 1 that holds 0 and 1."""
    size = next(k for k in range(2, v) if k * (k - 1) + 1 >= v)

    def grow(have: list[int], seen: set[int]) -> list[int] | None:
        if len(have) == size:
            return have
        for x in range(have[-1] + 1, v):
            new = {d for h in have for d in ((x - h) % v, (h - x) % v)}
            if len(new) == 2 * len(have) and not new & seen and (found := grow([*have, x], seen | new)):
                return found
        return None

    found = grow([0, 1], {1, v - 1})
    if found is None:
        raise ValueError(f"no perfect difference set modulo {v}")
    return found


def cover_size(length: int) -> int:
    """The largest of a few cover moduli that leaves samples of two fifths of ``length``."""
    fit = [v for v in (7, 13, 21, 31, 57, 73, 91) if v <= 0.6 * length]
    if not fit:
        raise ValueError("strings of under 12 bytes are too short for a cover")
    return fit[-1]


def _low40(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).reshape(-1).view("V5")


def _from40(v: np.ndarray) -> np.ndarray:
    out = np.zeros((len(v), 8), np.uint8)
    out[:, :5] = v.view(np.uint8).reshape(-1, 5)
    return out.reshape(-1).view("<u8")


def to_blocks(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Blocks of whole documents: ids, sizes, compressed text, and kept columns as arrays."""
    d = documents(docs, *keep)
    fields = [f for f in d.schema.fields if f.name in keep]
    schema = "block long, n_bytes long, ids array<long>, sizes array<int>, text binary" + "".join(
        f", `keep_{f.name}` array<{f.dataType.simpleString()}>" for f in fields)

    def pack(batches):
        block = TaskContext.get().partitionId() << 32
        for rows, data, offs in text_blocks(batches, BLOCK_BYTES):
            n = rows.num_rows
            lists = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), rows.column(i)) for i in (0, *range(2, 2 + len(keep)))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([block]), pa.array([len(data)], pa.int64()), lists[0], pa.array([np.diff(offs)], pa.list_(pa.int32())),
                 pa.array([pa.compress(data.tobytes(), "zstd", asbytes=True) if len(data) else b""], pa.binary()), *lists[1:]],
                names=["block", "n_bytes", "ids", "sizes", "text", *(f"keep_{f.name}" for f in fields)])
            block += 1

    return d.mapInArrow(pack, schema)


class Block:
    """One block's text and the places in it."""

    def __init__(self, block, size, ids, sizes, text, length: int, v: int, cover: list[int]):
        self.block, self.length, self.v = block, length, v
        self.data = np.frombuffer(pa.decompress(text, size, "zstd", asbytes=True), np.uint8) if size else np.zeros(0, np.uint8)
        self.sizes = np.asarray(sizes, np.int64)
        self.offs = np.append(0, np.cumsum(self.sizes))
        self.ids = np.array([NO_ID if i is None else i for i in ids], np.int64)
        order = np.argsort(self.ids, kind="stable")
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order))
        self.cover = np.zeros(v, bool)
        self.cover[cover] = True

    def doc(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offs, at, "right") - 1

    def samples(self) -> np.ndarray:
        """Places of the cover with enough bytes behind, in documents of enough bytes."""
        depth = self.length - self.v + 1
        last = np.where(self.sizes >= self.length, self.sizes - depth + 1, 0)  # sample starts of each document
        doc = np.flatnonzero(last)
        # A document's places, from a pattern of the cover; only samples are ever laid out.
        turns, places = -(-last[doc] // self.v), np.flatnonzero(self.cover)
        turn = np.arange(int(turns.sum())) - np.repeat(np.cumsum(turns) - turns, turns)
        at = (turn[:, None] * self.v + places).reshape(-1)
        of = np.repeat(np.repeat(doc, turns), len(places))
        fit = at < last[of]
        return at[fit] + self.offs[of[fit]]

    def earliest(self, *keys: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether each place is the first of its keys, in the order of the corpus."""
        order = np.lexsort((at, self.rank[self.doc(at)], *keys))
        new = np.ones(len(at), bool)
        new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys]) if len(at) else False
        out = np.empty(len(at), bool)
        out[order] = new
        return out

    def suffixes(self, at: np.ndarray) -> np.ndarray:
        """Marks the starts of strings that reach over one of the samples ``at``."""
        d = self.doc(at)
        low, high = np.maximum(at - self.v + 1, self.offs[d]), np.minimum(at, self.offs[d + 1] - self.length)
        fit = low <= high
        step = np.bincount(low[fit], minlength=len(self.data) + 2)
        step -= np.bincount(high[fit] + 1, minlength=len(self.data) + 2)
        return np.cumsum(step, out=step)[:len(self.data)] > 0


class Deduplicator:
    """The work of the tasks; fingerprints are the same in all of them."""

    def __init__(self, length: int, buckets: int):
        self.length, self.buckets = length, buckets
        self.v = cover_size(length)
        self.cover = difference_cover(self.v)
        self.depth = length - self.v + 1

    def open(self, t: pa.Table) -> Block:
        r = {c: t.column(c)[0].as_py() for c in ("block", "n_bytes", "ids", "sizes", "text")}
        return Block(r["block"], r["n_bytes"], r["ids"], r["sizes"], r["text"], self.length, self.v, self.cover)

    def bucket(self, h: np.ndarray) -> np.ndarray:
        return ((h >> np.uint64(32)) * np.uint64(self.buckets) >> np.uint64(32)).astype(np.int64)

    def _rows(self, block: int, sorted_hash: np.ndarray, local: bytes, body) -> pa.Table:
        """A row for each bucket; ``body(a, b)`` packs the entries of one."""
        cuts = np.searchsorted(self.bucket(sorted_hash), np.arange(self.buckets + 1))
        used = np.flatnonzero(np.diff(cuts))
        return pa.table([pa.array(used, pa.int32()), pa.array([block] * len(used), pa.int64()),
                         pa.array(np.diff(cuts)[used], pa.int32()), pa.array([body(cuts[k], cuts[k + 1]) for k in used], pa.binary()),
                         pa.array([local if i == 0 else b"" for i in range(len(used))], pa.binary())], schema=KEYS_ARROW)

    # 1. Samples that stand twice or more.

    def sample_hashes(self, b: Block) -> tuple[np.ndarray, np.ndarray]:
        at = b.samples()
        hashing = PrefixHash(11)
        return at, hashing.spans(hashing.prefix(b.data), at, at + self.depth)

    def emit_samples(self, batches):
        for batch in batches:
            for i in range(batch.num_rows):
                b = self.open(pa.table(batch.slice(i, 1)))
                keys, count = np.unique(self.sample_hashes(b)[1], return_counts=True)
                twice = (count > 1).astype(np.uint8)
                yield from self._rows(b.block, keys, b"", lambda a, z: pack_arrays(_low40(keys[a:z]), twice[a:z])).to_batches()

    @staticmethod
    def mark_samples(t: pa.Table) -> pa.Table:
        """Sort one bucket: a bit for each entry whose hash stands in several places."""
        n, blocks, buckets = (t.column(c).to_pylist() for c in ("n", "block", "bucket"))
        parts = [unpack_arrays(x.as_py(), k, "V5", np.uint8) for x, k in zip(t.column("body"), n)]
        keys = np.concatenate([_from40(p[0]) for p in parts])
        twice = np.concatenate([p[1] for p in parts])
        _, inverse, count = np.unique(keys, return_inverse=True, return_counts=True)
        marked = (count[inverse] > 1) | (twice > 0)
        ends = np.cumsum(n)
        out = [np.packbits(marked[e - k:e]).tobytes() for e, k in zip(ends, n)]
        return pa.table([pa.array(blocks, pa.int64()), pa.array(buckets, pa.int32()), pa.array(out, pa.binary()),
                         pa.array([int(k).to_bytes(4, "little") for k in n], pa.binary())], schema=MARKS_ARROW)

    # 2. Their contexts: long ties.

    def emit_contexts(self, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return KEYS_ARROW.empty_table()
        b = self.open(left)
        at, h = self.sample_hashes(b)
        marks = sorted(zip(right.column("first").to_pylist(), right.column("done").to_pylist(), right.column("open").to_pylist()))
        bits = [np.unpackbits(np.frombuffer(m, np.uint8), count=int.from_bytes(k, "little")) for _, m, k in marks]
        keys = np.unique(h)
        again = np.concatenate(bits).astype(bool)[np.searchsorted(keys, h)]
        at, h = at[again], h[again]
        d = b.doc(at)
        low, high = np.maximum(at - self.v + 1, b.offs[d]), np.minimum(at + self.length, b.offs[d + 1])
        hashing = PrefixHash(13)
        context = hashing.spans(hashing.prefix(b.data), low, high)
        context = mix64(context ^ mix64(((at - low) << 32 | (high - at)).astype(np.uint64)))
        first = b.earliest(context, h, at=at)
        local = pack_arrays(at[~first].astype(np.uint32))
        local = int((~first).sum()).to_bytes(4, "little") + local
        at, h, context = at[first], h[first], context[first]
        order = np.argsort(h, kind="stable")
        at, h, context = at[order], h[order], context[order]
        doc = b.ids[b.doc(at)]
        return self._rows(b.block, h, local, lambda a, z: pack_arrays(_low40(h[a:z]), context[a:z], doc[a:z], at[a:z].astype(np.uint32)))

    @staticmethod
    def _sorted(t: pa.Table, *types):
        """The bucket's entries in corpus order within equal keys, and where each began."""
        n, blocks = t.column("n").to_numpy(), t.column("block").to_numpy()
        parts = [unpack_arrays(x.as_py(), int(k), *types, np.int64, np.uint32) for x, k in zip(t.column("body"), n)]
        *keys, doc, at = (np.concatenate(p) for p in zip(*parts))
        keys = [_from40(k) if k.dtype.kind == "V" else k for k in keys]
        order = np.lexsort((at, np.repeat(blocks, n), doc, *reversed(keys)))
        differs = np.ones(len(order), bool)
        differs[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
        return n, blocks, keys, at, order, differs

    @staticmethod
    def _marks(t: pa.Table, n, blocks, at, done: np.ndarray, still: np.ndarray | None) -> pa.Table:
        local = [(int.from_bytes(x[:4], "little"), x[4:]) if x else (0, b"") for x in t.column("local").to_pylist()]
        ends, out = np.cumsum(n), []
        for e, k, (m, body) in zip(ends, n, local):
            here = slice(e - k, e)
            settled = at[here][done[here]]
            if m:
                settled = np.concatenate([settled, unpack_arrays(body, m, np.uint32)[0]])
            out.append((settled.astype("<u4").tobytes(), b"" if still is None else at[here][still[here]].astype("<u4").tobytes()))
        return pa.table([pa.array(blocks, pa.int64()), pa.array([0] * len(out), pa.int32()), pa.array([x for x, _ in out], pa.binary()),
                         pa.array([x for _, x in out], pa.binary())], schema=MARKS_ARROW)

    @classmethod
    def mark_contexts(cls, t: pa.Table) -> pa.Table:
        """done: samples whose context stands earlier; open: the first samples of
        each context, in classes of several contexts."""
        n, blocks, (h, _), at, order, first = cls._sorted(t, "V5", np.uint64)
        classes, of = np.unique(h[order], return_inverse=True)
        several = np.bincount(of, first, len(classes)) > 1
        done, still = np.empty(len(order), bool), np.empty(len(order), bool)
        done[order], still[order] = ~first, first & several[of]
        return cls._marks(t, n, blocks, at, done, still)

    # 3. Suffixes around the samples left open.

    def emit_suffixes(self, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return KEYS_ARROW.empty_table()
        b = self.open(left)
        done, still = (np.frombuffer(b"".join(right.column(c).to_pylist()), "<u4").astype(np.int64) for c in ("done", "open"))
        at = np.flatnonzero(b.suffixes(still) & ~b.suffixes(done))
        h, h2 = (p.spans(p.prefix(b.data), at, at + self.length) for p in map(PrefixHash, (17, 19)))
        first = b.earliest(h2, h, at=at)
        local = int((~first).sum()).to_bytes(4, "little") + pack_arrays(at[~first].astype(np.uint32))
        at, h, h2 = at[first], h[first], h2[first]
        order = np.argsort(h, kind="stable")
        at, h, h2 = at[order], h[order], h2[order]
        doc = b.ids[b.doc(at)]
        return self._rows(b.block, h, local, lambda a, z: pack_arrays(_low40(h[a:z]), h2[a:z], doc[a:z], at[a:z].astype(np.uint32)))

    @classmethod
    def mark_suffixes(cls, t: pa.Table) -> pa.Table:
        """done: suffixes whose first bytes also stand earlier (first = 1: suffixes, no samples)."""
        n, blocks, _, at, order, first = cls._sorted(t, "V5", np.uint64)
        done = np.empty(len(order), bool)
        done[order] = ~first
        out = cls._marks(t, n, blocks, at, done, None)
        return out.set_column(1, "first", pa.array([1] * out.num_rows, pa.int32()))

    def remove(self, left: pa.Table, right: pa.Table, keep: list[str], schema: pa.Schema) -> pa.Table:
        if not left.num_rows:
            return schema.empty_table()
        b = self.open(left)
        kind = right.column("first").to_pylist()
        raw = right.column("done").to_pylist()
        samples, places = (np.frombuffer(b"".join(x for x, k in zip(raw, kind) if k == w), "<u4").astype(np.int64) for w in (0, 1))
        start = b.suffixes(samples)
        start[places] = True
        step = np.zeros(len(b.data) + 1, np.int64)
        starts = np.flatnonzero(start)
        step[starts] += 1
        np.subtract.at(step, starts + self.length, 1)
        gone = np.cumsum(step[:-1]) > 0
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        begins[b.offs[:-1][b.offs[:-1] < len(gone)]] |= gone[b.offs[:-1][b.offs[:-1] < len(gone)]]
        total, spans = (np.append(0, np.cumsum(x)) for x in (gone, begins))
        kept = b.data[~gone].tobytes()
        cut = b.offs - total[b.offs]
        texts = [kept[x:y] for x, y in zip(cut, cut[1:])]
        if schema.field("kept").type == pa.string():  # a removed run may have cut characters
            texts = [x.decode("utf-8", "ignore") for x in texts]
        return pa.table([left.column("ids").combine_chunks().flatten(), pa.array(b.sizes), pa.array(np.diff(total[b.offs])),
                         pa.array(np.diff(spans[b.offs])), pa.array(texts, schema.field("kept").type),
                         *(left.column(f"keep_{c}").combine_chunks().flatten() for c in keep)], schema=schema)


def deduplicate(docs: DataFrame, length: int = 100, keep: list[str] | None = None, as_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (the bytes
    that stay; as_text: as a string, without the rest of characters that a run
    has cut) of every document, with the columns named in ``keep``."""
    spark, keep = docs.sparkSession, keep or []
    blocks = save(to_blocks(docs, keep), "blocks")
    size = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    work = Deduplicator(length, 1)
    work.buckets = int(max(4 * shuffle_partitions(spark), size * len(work.cover) / work.v / BUCKET_SAMPLES))
    text = blocks.select("block", "n_bytes", "ids", "sizes", "text")

    def with_marks(marks: DataFrame, f, schema: str, of: DataFrame = text) -> DataFrame:
        return of.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(lambda left, right: f(left, right), schema)

    def by_bucket(keys: DataFrame, f) -> DataFrame:
        return keys.groupBy("bucket").applyInArrow(lambda t: f(t), MARKS)

    marks = save(by_bucket(text.mapInArrow(work.emit_samples, SORT_KEYS), work.mark_samples), "marks")
    contexts = with_marks(marks, work.emit_contexts, SORT_KEYS)
    settled = save(by_bucket(contexts, work.mark_contexts), "contexts")
    drop(marks)
    suffixes = with_marks(settled, work.emit_suffixes, SORT_KEYS)
    rest = save(by_bucket(suffixes, work.mark_suffixes), "suffixes")
    fields = [(f.name, f.dataType.simpleString()) for f in documents(docs, *keep).schema.fields if f.name in keep]
    schema = ("doc_id long, n_bytes long, n_removed long, n_spans long, kept " + ("string" if as_text else "binary")
              + "".join(f", `{n}` {t}" for n, t in fields))
    kept_types = {f.name: f.type for f in _arrow(blocks)}
    arrow = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
                       ("kept", pa.string() if as_text else pa.binary()), *((n, kept_types[f"keep_{n}"].value_type) for n, _ in fields)])
    return with_marks(settled.unionAll(rest).select("block", "first", "done"),
                      lambda left, right: work.remove(left, right, [n for n, _ in fields], arrow), schema, blocks)


def _arrow(df: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.schema)
