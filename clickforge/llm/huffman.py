"""Token ids as files of canonical, length-limited Huffman codes.

Code lengths come from the global counts of ids by package-merge, limited to 16
bits, so one table of 65,536 entries decodes any code in one step. A file is a
Parquet part of blocks; a block holds whole documents in ascending doc_id
order, their ids as one bit string, and the bit offset of every 256th id. Each
block decodes alone, and the checkpoints within it decode side by side in
numpy. Spark's writer commits the parts, so lost executors leave no half file.

Cases: null or empty text gives the end id alone; rows that repeat a doc_id are
kept, in order of their ids; null doc_ids come first; an empty table gives an
empty file; a document longer than a block's usual size is a block of its own;
further columns are ignored.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, drop, new_path, save, shuffle_partitions, text_blocks, worker_cache
from .units import UnitEncoder

MAX_BITS = 16
CHECKPOINT = 256
BLOCK_IDS = 1 << 18

TOKENS = "doc_id long, ids binary"
TOKENS_ARROW = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])
BLOCKS = "part int, block int, first long, n_ids long, doc_ids array<long>, sizes array<int>, checkpoints binary, bits binary"
BLOCKS_ARROW = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()),
                          ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())),
                          ("checkpoints", pa.binary()), ("bits", pa.binary())])
DECODED = "part int, doc_id long, local_start long, n_tokens long, ids binary"
DECODED_ARROW = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("local_start", pa.int64()),
                           ("n_tokens", pa.int64()), ("ids", pa.binary())])


def tokenize(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """doc_id and the ids (little-endian uint16) of each whole text with ``end_id``."""

    def encode(batches):
        encoder = worker_cache(f"units:{tokenizer}", lambda: UnitEncoder(tokenizer))
        end = np.uint16(end_id).tobytes()
        for rows, data, offs in text_blocks(batches):
            ids, at = encoder.encode_block(data, offs)
            raw, at = ids.tobytes(), (at * 2).tolist()
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array([raw[a:b] + end for a, b in zip(at, at[1:])], pa.binary())], schema=TOKENS_ARROW)

    return documents(docs).mapInArrow(encode, TOKENS)


def id_counts(tokens: DataFrame) -> dict[int, int]:
    """How often each id occurs in all documents; at most 65,536 entries."""

    def count(batches):
        total = np.zeros(1 << 16, np.int64)
        for b in batches:
            for x in b.column(0).to_pylist():
                total += np.bincount(np.frombuffer(x, np.uint16), minlength=1 << 16)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["id", "n"])

    rows = tokens.select("ids").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    return {r["id"]: r["n"] for r in rows}


def code_lengths(counts: dict[int, int], max_bits: int = MAX_BITS) -> dict[int, int]:
    """Optimal code lengths of at most ``max_bits`` bits, by package-merge."""
    symbols = sorted(counts, key=lambda i: (counts[i], i))
    if len(symbols) < 2:
        return {i: 1 for i in symbols}
    if len(symbols) > 1 << max_bits:
        raise ValueError(f"{len(symbols)} symbols need more than {max_bits} bits")
    leaf = np.array([counts[i] for i in symbols], np.float64)
    level, is_leaf = leaf, [np.ones(len(leaf), bool)]
    for _ in range(max_bits - 1):
        pairs = len(level) // 2 * 2
        merged = np.concatenate([leaf, level[0:pairs:2] + level[1:pairs:2]])
        order = np.argsort(merged, kind="stable")
        level = merged[order]
        is_leaf.append(order < len(leaf))
    length, take = np.zeros(len(leaf), np.int64), 2 * len(leaf) - 2
    for flags in reversed(is_leaf):
        leaves = int(flags[:take].sum())
        length[:leaves] += 1
        take = 2 * (take - leaves)
    return dict(zip(symbols, length.tolist()))


class Code:
    """Canonical codes from lengths, for encoding and for decoding by table."""

    def __init__(self, lengths: dict[int, int]):
        self.length = np.zeros(1 << 16, np.int64)
        self.code = np.zeros(1 << 16, np.uint64)
        self.symbol_at = np.zeros(1 << MAX_BITS, np.uint16)
        self.length_at = np.ones(1 << MAX_BITS, np.int64)
        code, last = 0, 0
        for i in sorted(lengths, key=lambda i: (lengths[i], i)):
            code <<= lengths[i] - last
            last = lengths[i]
            self.length[i], self.code[i] = last, code
            low = code << (MAX_BITS - last)
            self.symbol_at[low:low + (1 << (MAX_BITS - last))] = i
            self.length_at[low:low + (1 << (MAX_BITS - last))] = last
            code += 1

    def encode(self, ids: np.ndarray) -> tuple[bytes, bytes]:
        """Bits (big-endian 32-bit words) and the bit offsets of the checkpoints."""
        size = self.length[ids]
        ends = np.cumsum(size)
        at = ends - size
        words = int(ends[-1] if len(ends) else 0) // 32 + 2
        wide = self.code[ids] << (64 - (at & 31) - size).astype(np.uint64)
        word = at >> 5
        high = np.bincount(word, (wide >> np.uint64(32)).astype(np.float64), words)
        high[1:] += np.bincount(word, (wide & np.uint64(0xFFFFFFFF)).astype(np.float64), words)[:-1]
        return high.astype(">u4").tobytes(), at[::CHECKPOINT].astype("<u4").tobytes()

    def decode(self, bits: bytes, checkpoints: bytes, n: int) -> np.ndarray:
        words = np.append(np.frombuffer(bits, ">u4").astype(np.uint64), np.zeros(2, np.uint64))
        pairs = words[:-1] << np.uint64(32) | words[1:]
        at = np.frombuffer(checkpoints, "<u4").astype(np.int64)
        out = np.zeros((len(at), CHECKPOINT), np.uint16)
        last = n - (len(at) - 1) * CHECKPOINT  # ids of the last run
        for k in range(min(CHECKPOINT, n)):
            live = len(out) - (k >= last)
            at = at[:live]
            seen = (pairs[at >> 5] << (at & 31).astype(np.uint64)) >> np.uint64(64 - MAX_BITS)
            out[:live, k] = self.symbol_at[seen]
            at = at + self.length_at[seen]
        return out.reshape(-1)[:n]


def write_ids(tokens: DataFrame, path: str) -> None:
    """Write the ids of a saved token table below ``path``: ``codes`` (id, bits)
    and ``blocks``, the parts in ascending order of doc_id."""
    spark = tokens.sparkSession
    lengths = code_lengths(id_counts(tokens))
    spark.createDataFrame(sorted(lengths.items()), "id int, bits int").coalesce(1).write.parquet(f"{path}/codes")

    def blocks(batches):
        code, part = Code(lengths), TaskContext.get().partitionId()
        block, first, docs, parts, held = 0, 0, [], [], 0

        def flush():
            ids = np.concatenate(parts)
            bits, points = code.encode(ids)
            return pa.RecordBatch.from_arrays(
                [pa.array([v], f.type) for v, f in zip((part, block, first, len(ids), docs, [len(x) for x in parts], points, bits), BLOCKS_ARROW)],
                schema=BLOCKS_ARROW)

        for b in batches:
            for doc, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = np.frombuffer(raw, np.uint16)
                if docs and held + len(own) > BLOCK_IDS:
                    yield flush()
                    block, first, docs, parts, held = block + 1, first + held, [], [], 0
                docs.append(doc)
                parts.append(own)
                held += len(own)
        if docs:
            yield flush()

    (tokens.repartitionByRange(shuffle_partitions(spark), "doc_id").sortWithinPartitions("doc_id", "ids")
     .mapInArrow(blocks, BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """The documents of files written by :func:`write_ids`: doc_id, start (ids of
    all documents before), n_tokens, ids (little-endian uint32)."""
    lengths = {r["id"]: r["bits"] for r in spark.read.schema("id int, bits int").parquet(f"{path}/codes").collect()}
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")

    def decode(batches):
        code = Code(lengths)
        for b in batches:
            for r in b.to_pylist():
                ids = code.decode(r["bits"], r["checkpoints"], r["n_ids"]).astype("<u4")
                ends = np.cumsum(r["sizes"])
                starts = ends - r["sizes"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["part"]] * len(ends), pa.int32()), pa.array(r["doc_ids"], pa.int64()),
                     pa.array(starts + r["first"], pa.int64()), pa.array(r["sizes"], pa.int64()),
                     pa.array([ids[x:y].tobytes() for x, y in zip(starts, ends)], pa.binary())], schema=DECODED_ARROW)

    # One row a part: as many as the write had partitions.
    parts = (blocks.groupBy("part").agg(F.max(F.col("first") + F.col("n_ids")).alias("n"))
             .withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n")).drop("n"))
    return (blocks.mapInArrow(decode, DECODED).join(F.broadcast(parts), "part")
            .select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids"))


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Tokenize, write in the shared folder, and read back."""
    spark = docs.sparkSession
    tokens = save(tokenize(docs, tokenizer, end_id), "tokens")
    path = new_path(spark, "ids")
    write_ids(tokens, path)
    drop(tokens)
    return read_ids(spark, path)
