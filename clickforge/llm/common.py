"""Shared helpers: intermediate tables, Arrow text blocks, vectorised hashing."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickforge.session import ensure_checkpoint_dir

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ASCII_SPACE = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder that ``spark.checkpoint.dir`` names."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str, **options) -> DataFrame:
    """Write an intermediate table to the shared folder and read it again: cuts
    lineage, so lost executors never send later jobs back before this point.
    ``options`` are the writer's."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")  # what the write shuffled goes when it ends, not at some later garbage collection
    try:
        df.write.option("compression", "zstd").options(**options).parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete a table that :func:`save` wrote, once nothing reads it any more."""
    jvm = df.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(df.shared_path)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (null: empty), with the named extra columns."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def worker_cache(name: str, make: Callable):
    """What ``make`` gives, kept between the tasks of one Python worker."""
    held = sys.modules.setdefault("clickforge_worker_cache", types.ModuleType("clickforge_worker_cache"))
    if name not in held.__dict__:
        held.__dict__[name] = make()
    return held.__dict__[name]


def text_blocks(batches: Iterable[pa.RecordBatch], max_bytes: int = 2 << 20) -> Iterator[tuple]:
    """Cut record batches of (key, text, ...) into blocks of about ``max_bytes``.

    Yields (rows, data, offsets): the batch slice, its texts as one uint8 array,
    and n + 1 int64 offsets into it. A longer text is a block of its own.
    """
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        text = batch.column(1).cast(pa.large_string())
        if text.null_count:
            text = text.fill_null("")
        offs = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + n + 1]
        data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
        at = 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + max_bytes, "right")) - 1)
            to = min(to, n)
            yield batch.slice(at, to - at), data[offs[at]:offs[to]], offs[at:to + 1] - offs[at]
            at = to


def out_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection on uint64 that spreads all bits."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class PrefixHash:
    """Hashes of substrings in O(1) each: polynomial prefix sums modulo 2**64
    over a random table of byte values, finished with :func:`mix64`. Strings can
    be made that share a hash: what must be exact compares bytes as well."""

    #: Of all seeds, which differ in their byte values; so a process holds the powers once.
    BASE = 0x4F1BBCDCBFA53E0B * 8 + 5 & (1 << 64) - 1
    POWERS_KEPT = 4 << 20
    _powers = _inverses = np.ones(1, np.uint64)

    def __init__(self, seed: int = 1):
        self.table = np.random.default_rng(seed).integers(0, 2**64, 256, dtype=np.uint64)

    @classmethod
    def _grow(cls, n: int) -> None:
        have = len(cls._powers)
        if n <= have <= max(cls.POWERS_KEPT, 2 * n):
            return
        for name, base in (("_powers", cls.BASE), ("_inverses", pow(cls.BASE, -1, 1 << 64))):
            p = np.ones(1, np.uint64)
            while len(p) < n:
                p = np.concatenate([p, p * np.uint64(pow(base, len(p), 1 << 64))])
            setattr(cls, name, p)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.take(self.table, data, out=out[1:])
        out[1:] *= self._powers[:len(data)]
        np.cumsum(out[1:], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        self._grow(len(prefix))
        out = prefix[end]
        out -= prefix[start]
        out *= self._inverses[start]
        return mix64(out)


def word_spans(data: np.ndarray, offs: np.ndarray, delimiters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a block; ``delimiters``: 256 booleans.
    Words never cross a text's end."""
    cut = delimiters[data]
    inside = np.empty(len(data) + 1, bool)
    np.logical_not(cut, out=inside[:-1])
    inside[-1] = False
    start = inside[:-1].copy()
    start[1:] &= cut[:-1]
    first = offs[:-1][offs[:-1] < len(data)]
    start[first] = inside[first]
    stop = np.zeros(len(data) + 1, bool)
    stop[1:] = inside[:-1]
    stop[1:-1] &= ~inside[1:-1]
    last = offs[1:][offs[1:] > 0]
    stop[last] = inside[last - 1]
    return np.flatnonzero(start), np.flatnonzero(stop)


def space_table() -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(ASCII_SPACE)] = True
    return t


def pack_arrays(*arrays: np.ndarray) -> bytes:
    """Arrays of equal length, their bytes in planes, compressed."""
    raw = b"".join(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() for a in arrays)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True) if raw else b""


def unpack_arrays(body: bytes, n: int, *types) -> list[np.ndarray]:
    """The arrays of ``n`` entries that :func:`pack_arrays` packed."""
    if not n:
        return [np.zeros(0, t) for t in types]
    raw = np.frombuffer(pa.decompress(body[8:], int.from_bytes(body[:8], "little"), "zstd", asbytes=True), np.uint8)
    out, at = [], 0
    for t in types:
        width = np.dtype(t).itemsize
        out.append(np.ascontiguousarray(raw[at:at + n * width].reshape(width, n).T).reshape(-1).view(t))
        at += n * width
    return out


def text_slices(batches: Iterable[pa.RecordBatch], max_bytes: int, may_cut: Callable) -> Iterator[tuple]:
    """As :func:`text_blocks`, but a text of more than ``max_bytes`` comes in slices.

    ``may_cut(before, at)`` tells for arrays of neighbouring bytes where a slice
    may begin. Yields (rows, data, offsets, first, last): a slice of a long text
    is its only row; first and last are true for the text's first and last one.
    Where nothing may be cut for long, a slice is as long as need be.
    """
    for rows, data, offs in text_blocks(batches, max_bytes):
        if rows.num_rows > 1 or len(data) <= max_bytes:
            yield rows, data, offs, True, True
            continue
        at = 0
        while at < len(data):
            to = at + max_bytes
            if to >= len(data):
                to = len(data)
            else:
                back = np.flatnonzero(may_cut(data[at:to], data[at + 1:to + 1]))
                if len(back):
                    to = at + 1 + int(back[-1])
                else:
                    while to < len(data) - 1:
                        ahead = np.flatnonzero(may_cut(data[to:to + max_bytes][:-1], data[to + 1:to + max_bytes]))
                        if len(ahead):
                            to += 1 + int(ahead[0])
                            break
                        to = min(to + max_bytes - 1, len(data))
                    else:
                        to = len(data)
            yield rows, data[at:to], np.array([0, to - at]), at == 0, to == len(data)
            at = to


def string_array(data: np.ndarray, start: np.ndarray, end: np.ndarray, kind: pa.DataType = pa.large_string()) -> pa.Array:
    """The spans of ``data`` as an Arrow array; spans are in order and don't overlap."""
    size = end - start
    at = np.append(0, np.cumsum(size))
    step = np.zeros(len(data) + 1, np.int8)
    step[start[size > 0]] = 1
    np.subtract.at(step, end[size > 0], 1)
    inside = np.cumsum(step[:-1], dtype=np.int8).view(bool)
    return pa.Array.from_buffers(kind, len(start), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data[inside])])
