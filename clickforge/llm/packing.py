"""Packing of tokenized documents into windows by minimum bin slack.

Documents are tokenized, cut at multiples of the window size, and the pieces
packed. Only the histogram of piece lengths (at most ``window`` rows, whatever
the input) reaches the driver. There each window takes the longest length left
and the multiset of remaining lengths that comes closest to capacity: a subset
sum over bitsets, length by length with bounded multiplicity, whose counts are
found by going back over the bitsets. A multiset is repeated as often as the
counts allow, so the plan grows with the distinct lengths, not the documents.
On the cluster every piece knows its number among its task's pieces of the same
length; the counts of the tasks before give its rank within its length, and the
rank its sequence and offset in the plan. Ids are written once where they are
cut, and neither shuffled nor sorted.

Cases: null text is empty text and holds the end id alone; empty tables give
empty results; repeated rows and ids are packed as documents of their own;
further columns of the input are ignored; a text of any length is cut into
windows, so no piece exceeds one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, save, text_blocks, worker_cache
from .units import UnitEncoder

PIECES = "doc_id long, start long, length int, doc_tokens long, part int, nth long, ids binary"
PIECE_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int32()), ("doc_tokens", pa.int64()),
                         ("part", pa.int32()), ("nth", pa.int64()), ("ids", pa.binary())])
#: Tasks up to which their counts before (window longs a task) are broadcast; beyond, pieces meet them by a shuffle.
BROADCAST_PARTS = 2048


def pieces(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1) -> DataFrame:
    """Token ids of every document and ``end_id``, cut at multiples of ``window``
    (ids: little-endian uint32). ``nth`` numbers the pieces of one length that a
    task (``part``) cuts; to be written before it is used, for both belong to one run."""

    def cut(batches):
        encoder = worker_cache(f"units:{tokenizer}", lambda: UnitEncoder(tokenizer))
        part, seen = TaskContext.get().partitionId(), np.zeros(window + 1, np.int64)
        for rows, data, offs in text_blocks(batches):
            ids, at = encoder.encode_block(data, offs)
            own = np.diff(at)
            # The ids of all texts with an end behind each, and the pieces as ranges of them.
            whole = np.full(len(ids) + len(own), end_id, "<u4")
            whole[np.arange(len(ids)) + np.repeat(np.arange(len(own)), own)] = ids
            total = own + 1
            n = -(-total // window)
            doc = np.repeat(np.arange(len(n)), n)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * window
            length = np.minimum(total[doc] - start, window)
            order = np.argsort(length, kind="stable")
            sizes, first, count = np.unique(length[order], return_index=True, return_counts=True)
            nth = np.empty(len(doc), np.int64)
            nth[order] = np.arange(len(doc)) - np.repeat(first, count) + seen[length[order]]
            seen[sizes] += count
            # Pieces lie end to end, so the array of their bytes is the ids as they are.
            ends = np.append(0, np.cumsum(length)) * 4
            for a in range(0, len(doc), PIECE_ROWS):
                z = min(a + PIECE_ROWS, len(doc))
                body = pa.Array.from_buffers(pa.binary(), z - a, [None, pa.py_buffer((ends[a:z + 1] - ends[a]).astype(np.int32)),
                                                                  pa.py_buffer(whole[ends[a] // 4:ends[z] // 4])])
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0).take(pa.array(doc[a:z])), pa.array(start[a:z]), pa.array(length[a:z], pa.int32()), pa.array(total[doc[a:z]]),
                     pa.array(np.full(z - a, part, np.int32)), pa.array(nth[a:z]), body], schema=PIECE_ARROW)

    return documents(docs).mapInArrow(cut, PIECES)


#: Bytes of ids that a writer gathers before it writes them; Spark's default would hold 128 MB a task.
ROW_GROUP = 16 << 20
#: Pieces of a batch: a few megabytes of ids.
PIECE_ROWS = 1024


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset that fills one window: the longest length, and those whose
    sum with it is the largest within ``capacity``."""
    seed = max(counts)
    room, bits, steps = capacity - seed, 1, []
    mask = (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if x <= room), reverse=True):
        most = min(counts[length] - (length == seed), room // length)
        if most < 1:
            continue
        steps.append((length, most, bits))
        step, left = 1, most
        while left:  # 1, 2, 4, ... copies at a time reach every number up to most
            take = min(step, left)
            bits |= (bits << (take * length)) & mask
            left, step = left - take, step * 2
        if bits >> room & 1:
            break
    total = bits.bit_length() - 1
    chosen = {seed: 1}
    for length, most, before in reversed(steps):
        n = next(n for n in range(most + 1) if total >= n * length and before >> (total - n * length) & 1)
        if n:
            chosen[length] = chosen.get(length, 0) + n
            total -= n * length
    return chosen


def plan(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(multiset of lengths, how many windows it fills), until no piece is left."""
    counts, out = {k: n for k, n in counts.items() if n}, []
    while counts:
        chosen = fill(counts, capacity)
        times = min(counts[k] // n for k, n in chosen.items())
        out.append((chosen, times))
        for k, n in chosen.items():
            counts[k] -= n * times
            if not counts[k]:
                del counts[k]
    return out


def lookup(windows: list[tuple[dict[int, int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first rank, first sequence, copies a window, and offset there, by entry."""
    out: dict[int, list] = {}
    used: dict[int, int] = {}
    first = 0
    for chosen, times in windows:
        offset = 0
        for length, n in chosen.items():
            out.setdefault(length, []).append((used.get(length, 0), first, n, offset))
            used[length] = used.get(length, 0) + n * times
            offset += n * length
        first += times
    return {k: tuple(np.array(x, np.int64) for x in zip(*v)) for k, v in out.items()}


def pack(cut: DataFrame, window: int = 2048) -> DataFrame:
    """Sequence and offset of every piece of a written table of :func:`pieces`.

    A piece's rank within its length is its number in its task, and the pieces
    of that length in the tasks before: a row of sums a task, at most.
    """
    tallies = save(cut.groupBy("part", "length").agg(F.count("*").alias("n")), "tallies")
    windows = plan({r["length"]: r["n"] for r in tallies.groupBy("length").agg(F.sum("n").alias("n")).collect()}, window)
    table = lookup(windows)
    before = tallies.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("n"))

    def lay_out(t: pa.Table) -> pa.Table:
        row = np.zeros(window, np.int64)
        row[t.column("length").to_numpy() - 1] = t.column("n").to_numpy()
        return pa.table([t.column("part")[:1].combine_chunks(), pa.array([row], pa.list_(pa.int64()))], names=["of_part", "before"])

    by_part = save(before.groupBy("part").applyInArrow(lambda t: lay_out(t), "of_part int, before array<long>"), "before")
    few = by_part.limit(BROADCAST_PARTS + 1).count() <= BROADCAST_PARTS

    @F.pandas_udf("sequence_id long, offset long")
    def place(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        length, rank = lengths.to_numpy(), ranks.to_numpy()
        sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        for k in np.unique(length):
            mine = np.flatnonzero(length == k)
            first_rank, first_seq, copies, first_off = table[int(k)]
            e = np.searchsorted(first_rank, rank[mine], "right") - 1
            turn = rank[mine] - first_rank[e]
            sequence[mine] = first_seq[e] + turn // copies[e]
            offset[mine] = first_off[e] + turn % copies[e] * k
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    ranked = cut.join(F.broadcast(by_part) if few else by_part, F.col("part") == F.col("of_part")).withColumn(
        "rank", F.col("nth") + F.get("before", F.col("length") - 1)).drop("before", "of_part", "nth", "part")
    return (ranked.withColumn("place", place("length", "rank"))
            .select("doc_id", "start", "length", "doc_tokens", "place.sequence_id", "place.offset", "ids"))


def sequences(packed: DataFrame, window: int = 2048, pad_id: int = 0) -> DataFrame:
    """The token sequences: pieces in order of their offset, padded to ``window``
    unless the length is a power of two. A sequence holds at most ``window`` ids."""
    whole = (packed.groupBy("sequence_id")
             .agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"), F.sum("length").alias("length"))
             .select("sequence_id", "length", F.expr("aggregate(transform(p, x -> hex(x.ids)), '', (a, x) -> concat(a, x))").alias("h")))
    pad = F.when(F.expr("bit_count(length)") == 1, 0).otherwise(window - F.col("length"))
    padding = F.repeat(F.lit(int(pad_id).to_bytes(4, "little").hex()), pad.cast("int"))
    return whole.select("sequence_id", "length", F.unhex(F.concat("h", padding)).alias("ids"))


def pack_documents(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1) -> DataFrame:
    cut = pieces(docs, tokenizer, window, end_id)
    return pack(save(cut, "pieces", **{"parquet.block.size": ROW_GROUP}), window)
