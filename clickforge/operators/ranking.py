"""Global order without a single task.

Ranking metrics, frequency codes, folds and generated ids all need "how many
rows come before this one" under a total order. A window with no partition
key would move the whole table into one task. Instead:

1. every row gets a *bucket* that is a pure function of its order key and is
   monotone in that order (value quantile boundaries, or a prefix of a hex
   key), so ties share a bucket and recomputation after a lost executor gives
   the same answer;
2. per-(group, bucket) totals form a small table whose running sums are the
   bucket offsets;
3. a window partitioned by (group, bucket) adds the in-bucket running sum.

The bucket count bounds the per-task share of a hot group: a group holding a
third of all rows is still spread over ``buckets`` window partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickforge.session import materialize


def join_small(big: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "left",
               bounded: bool = False) -> DataFrame:
    """Null-safe equi-join of ``big`` with a small, aggregated table.

    ``bounded=True`` is for tables whose row count is fixed by construction
    (a handful of models x a fixed bucket count) and gets a broadcast hint.
    Otherwise the join is left to AQE, which turns it into a broadcast at run
    time only when the materialised side is under the broadcast threshold and
    splits skewed partitions when it is not.
    """
    keys = list(keys)
    if not keys:
        return big.crossJoin(F.broadcast(small) if bounded else small)
    ren = {k: f"__r_{k}" for k in keys}
    right = small.select(*[F.col(c).alias(ren.get(c, c)) for c in small.columns])
    if bounded:
        right = F.broadcast(right)
    cond = None
    for k in keys:
        c = big[k].eqNullSafe(right[ren[k]])
        cond = c if cond is None else cond & c
    out = big.join(right, cond, how)
    return out.drop(*ren.values())


def prefix_sums_bucketed(df: DataFrame, keys: Sequence[str], bucket: str,
                         order: Sequence[Column], sums: Sequence[str],
                         bucket_desc: bool = False, inclusive: bool = False,
                         bounded: bool = False, suffix: str = "_before") -> DataFrame:
    """Running sums of ``sums`` within ``keys`` under the order (bucket, *order).

    ``bucket`` must be monotone in the order given by ``order`` (ties in the
    order key must share a bucket). Adds ``<c><suffix>`` columns: sum of ``c``
    over rows strictly ahead (or up to and including the row if ``inclusive``).
    """
    keys = list(keys)
    b = F.col(bucket)
    tot = df.groupBy(*keys, bucket).agg(*[F.sum(c).alias(c) for c in sums])
    wb = Window.orderBy(b.desc() if bucket_desc else b.asc())
    if keys:
        wb = Window.partitionBy(*keys).orderBy(b.desc() if bucket_desc else b.asc())
    wb = wb.rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select(*keys, bucket,
                     *[F.coalesce(F.sum(c).over(wb), F.lit(0)).alias(f"__off_{c}") for c in sums])
    j = join_small(df, off, [*keys, bucket], "left", bounded=bounded)
    hi = 0 if inclusive else -1
    w = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, hi)
    cols = [(F.col(f"__off_{c}") + F.coalesce(F.sum(c).over(w), F.lit(0))).alias(f"{c}{suffix}")
            for c in sums]
    return j.select(*df.columns, *cols)


def default_buckets(spark) -> int:
    """Buckets per group: one per shuffle partition (16 at least), so a single
    group can use the whole cluster, whatever its size."""
    return max(16, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def default_prefix(spark) -> int:
    """Hex digits of a bucket prefix: enough for 16 buckets a shuffle partition."""
    buckets, digits = 16 * default_buckets(spark), 3
    while 16 ** digits < buckets:
        digits += 1
    return digits


def with_bucket(df: DataFrame, bounds: str, value: Column, buckets: int, name: str) -> DataFrame:
    """Adds ``name``: how many of the sorted array ``bounds`` are below ``value``.

    A binary search, one projection a step, all inside generated code (a lambda
    over the array would be interpreted row by row); drops ``bounds``.
    """
    step = 1
    while step * 2 < buckets:
        step *= 2
    out = df.withColumn("__at", F.lit(0)).withColumn("__value", value)
    while step:
        out = out.withColumn("__at", F.col("__at") + F.when(F.get(bounds, F.col("__at") + (step - 1)) < F.col("__value"), step).otherwise(0))
        step //= 2
    return out.withColumnRenamed("__at", name).drop(bounds, "__value")


def value_prefix_sums(df: DataFrame, keys: Sequence[str], value: str, sums: Sequence[str],
                      descending: bool = True, buckets: int | None = None, inclusive: bool = False,
                      bounded: bool = False, accuracy: int | None = None) -> DataFrame:
    """Running sums over a table with one row per (keys, value).

    Buckets come from per-group quantile boundaries of the distinct values
    (``percentile_approx``, a mergeable sketch), so each bucket holds about
    1/``buckets`` of a group's distinct values whatever the value skew.
    """
    keys = list(keys)
    buckets = buckets or default_buckets(df.sparkSession)
    accuracy = accuracy or max(1000, 20 * buckets)  # balances the buckets, no more
    probs = [i / buckets for i in range(1, buckets)]
    bounds = df.groupBy(*keys).agg(
        F.percentile_approx(F.col(value).cast("double"), probs, accuracy).alias("__bounds"))
    bounds = materialize(bounds)  # a row a group, read by the totals and by the rows
    j = join_small(df, bounds, keys, "left", bounded=bounded)
    j = with_bucket(j, "__bounds", F.col(value).cast("double"), buckets, "__bk")
    order = [F.col(value).desc() if descending else F.col(value).asc()]
    out = prefix_sums_bucketed(j, keys, "__bk", order, sums, bucket_desc=descending,
                               inclusive=inclusive, bounded=bounded)
    return out.drop("__bk")


def laid_out(df: DataFrame, keys: Sequence[str], order: Sequence[Column], sums: Sequence[str] = (),
             parts: int | None = None, keep: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """The rows in the order (keys, *order), by ONE range shuffle: a written table
    of keys, sums, what ``keep`` names, ``__part`` and ``__i`` (a row's place within its part), and what each
    part carries into the next ones: one row per (keys, __part) with ``__first``
    (the place of the group's first row there), and ``__n_before`` and
    ``<c>_before`` of the parts before.

    A row's position in its group is ``__n_before + __i - __first``. The order
    has to be total for a defined result; then no value, however many rows
    share it, has to stay in one part. Places are numbered as the sorted parts
    are written, without a window; the carry has at most parts + groups rows.
    """
    keys = list(keys)
    parts = parts or default_buckets(df.sparkSession)
    by = [F.col(k).asc() for k in keys] + list(order)
    d = df.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    row = F.monotonically_increasing_id()  # a part's number, and the row's in it
    d = materialize(d.select(*keys, *sums, *keep, row.alias("__row")).select(
        *keys, *sums, *keep, F.shiftright("__row", 33).cast("int").alias("__part"), F.col("__row").bitwiseAND((1 << 33) - 1).alias("__i")))
    totals = d.groupBy(*keys, "__part").agg(F.min("__i").alias("__first"), F.count(F.lit(1)).alias("__n"),
                                            *[F.sum(c).alias(c) for c in sums])
    w = Window.partitionBy(*keys).orderBy("__part") if keys else Window.orderBy("__part")  # parts + groups rows
    w = w.rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*keys, "__part", "__first", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__n_before"),
                          *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"{c}_before") for c in sums])
    return d, carry


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "row_idx", parts: int | None = None) -> DataFrame:
    """0-based position of each row within ``keys`` (few groups: the carry is
    broadcast) under a total order of any type. Parts come from sampled range
    bounds of the values themselves, so texts that share a prefix fill them evenly."""
    rows, carry = laid_out(df, keys, order, parts=parts, keep=[c for c in df.columns if c not in keys])
    rows = join_small(rows, carry, [*keys, "__part"], bounded=True)  # at most parts + groups rows
    return rows.select(*df.columns, (F.col("__n_before") + F.col("__i") - F.col("__first")).alias(name))


BLOCK = {"__part": "int", "__block": "boolean", "__s": "double", "__n": "long", "__pos": "long", "__n_before": "long", "__pos_before": "long",
         "__top_n": "long", "__top_pos": "long", "__low_pos": "long"}


def tie_blocks(df: DataFrame, keys: Sequence[str], score: str, y: str, top: float, low: float,
               parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of equal score in descending order, by ONE range shuffle of (keys, score, y).

    Each task reads its sorted part once and keeps running counts, which no
    window can do without a second shuffle. It writes the blocks (rows of one
    group and score) that hold a positive, with the rows and positives before
    them in the part, the part's first and last block, and sums per group. Of
    a score that many rows share every part has a piece, for the input's
    partition breaks ties in the range; pieces of a block are put together here.

    Returns (blocks: keys, ``__s``, ``__n``, ``__pos``, ``__n_before``,
    ``__pos_before`` over the whole group; totals: keys, ``__n``, ``__pos``,
    ``__top_n`` and ``__top_pos`` of scores from ``top`` on, ``__low_pos`` of those up to ``low``).
    """
    keys = list(keys)
    parts = parts or default_buckets(df.sparkSession)
    d = df.select(*keys, F.xxhash64(*keys).alias("__g") if keys else F.lit(0).cast("long").alias("__g"),
                  F.col(score).cast("double").alias("__s"), F.col(y).cast("long").alias("__y"), F.spark_partition_id().alias("__from"))
    by = [*[F.col(k).asc() for k in keys], F.col("__s").desc()]
    d = d.repartitionByRange(parts, *by, "__from").drop("__from").sortWithinPartitions(*by)
    names = [*keys, *BLOCK]

    def run(batches):
        part, held, before, first = TaskContext.get().partitionId(), None, None, True

        def rows(values, block, s, n, pos, nb, pb, top_n=None, top_pos=None, low_pos=None):
            zero = np.zeros(len(n), np.int64)
            numbers = [s, n, pos, nb, pb, *(zero if x is None else x for x in (top_n, top_pos, low_pos))]
            return pa.RecordBatch.from_arrays([*values, pa.array(np.full(len(n), part, np.int32)), pa.array(np.full(len(n), block)),
                                               *map(pa.array, numbers)], names=names)

        def sums(values, s, n, pos, group):
            add = lambda x: np.add.reduceat(x, group)
            high = s >= top
            return rows(values, False, s[group], add(n), add(pos), 0 * group, 0 * group,
                        add(np.where(high, n, 0)), add(np.where(high, pos, 0)), add(np.where(s <= low, pos, 0)))

        for b in batches:
            if not b.num_rows:
                continue
            g, s, y_ = (b.column(len(keys) + k).to_numpy() for k in range(3))
            n, values = np.ones(len(g), np.int64), [b.column(k) for k in range(len(keys))]
            if held is not None:  # the block that the last batch ended with goes on as one heavy row
                g, s, n, y_ = (np.append(h, x) for h, x in zip(held[0], (g, s, n, y_)))
                values = [pa.concat_arrays([h, v]) for h, v in zip(held[1], values)]
            other = np.append(True, g[1:] != g[:-1])
            at = np.flatnonzero(other | np.append(True, s[1:] != s[:-1]))
            size, pos = np.add.reduceat(n, at), np.add.reduceat(y_, at)
            group = np.flatnonzero(other[at])
            of = np.cumsum(other[at]) - 1
            nb, pb = np.cumsum(size) - size, np.cumsum(pos) - pos
            nb, pb = nb - nb[group][of], pb - pb[group][of]
            if before is not None:  # the first group's counts so far
                nb[of == 0] += before[0]
                pb[of == 0] += before[1]
            last = len(at) - 1
            held = ((g[at[last]], s[at[last]], size[last], pos[last]), [v.slice(int(at[last]), 1) for v in values])
            before = (nb[last], pb[last])
            if last:
                keep = np.flatnonzero(pos[:last] > 0)
                if first:
                    keep = np.union1d(0, keep)
                take = lambda k: [v.take(pa.array(at[k])) for v in values]
                yield rows(take(keep), True, s[at[keep]], size[keep], pos[keep], nb[keep], pb[keep])
                whole = group[group < last]
                yield sums(take(whole), s[at[:last]], size[:last], pos[:last], whole)
                first = False
        if held is not None:
            (_, s, n, pos), values = held
            one = lambda x, kind=np.int64: np.array([x], kind)
            yield rows(values, True, one(s, float), one(n), one(pos), one(before[0]), one(before[1]))
            yield sums(values, one(s, float), one(n), one(pos), one(0))

    types = {f.name: f.dataType.simpleString() for f in d.schema.fields}
    schema = ", ".join([f"`{k}` {types[k]}" for k in keys] + [f"{c} {t}" for c, t in BLOCK.items()])
    found = materialize(d.mapInArrow(run, schema))
    by_part = found.where("not __block").groupBy(*keys, "__part").agg(*[F.sum(c).alias(c) for c in ("__n", "__pos", "__top_n", "__top_pos", "__low_pos")])
    by_part = materialize(by_part)  # at most parts + groups rows, read for the carry and the totals
    w = (Window.partitionBy(*keys) if keys else Window).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carry = by_part.select(*keys, "__part", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"__carried{c}") for c in ("__n", "__pos")])
    blocks = join_small(found.where("__block"), carry, [*keys, "__part"]).groupBy(*keys, "__s").agg(
        F.sum("__n").alias("__n"), F.sum("__pos").alias("__pos"),
        *[F.min(F.col(f"{c}_before") + F.col(f"__carried{c}")).alias(f"{c}_before") for c in ("__n", "__pos")])
    totals = by_part.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("__n", "__pos", "__top_n", "__top_pos", "__low_pos")])
    return blocks.where("__pos > 0"), totals


def row_index(df: DataFrame, keys: Sequence[str], hex_key: Column, prefix_len: int | None = None,
              sums: Sequence[str] = (), bounded: bool = True, name: str = "row_idx") -> DataFrame:
    """0-based position of each row within ``keys`` ordered by a unique hex
    string (an md5), plus optional inclusive running sums in that order.

    The bucket is the first ``prefix_len`` hex digits (by default as many as
    the shuffle partitions ask for): monotone in the key and uniformly filled,
    at most ``16**prefix_len`` buckets per group, so the offsets table has a
    proven size bound and is broadcast when the group keys are themselves
    bounded. Any other text orders right too, but shares buckets by prefix.
    """
    keys = list(keys)
    prefix_len = prefix_len or default_prefix(df.sparkSession)
    d = df.withColumn("__hk", hex_key).withColumn("__pf", F.substring("__hk", 1, prefix_len)) \
        .withColumn("__one", F.lit(1))
    out = prefix_sums_bucketed(d, keys, "__pf", [F.col("__hk").asc()], ["__one", *sums],
                               inclusive=True, bounded=bounded, suffix="__cum")
    out = out.withColumn(name, F.col("__one__cum") - 1)
    for c in sums:
        out = out.withColumnRenamed(f"{c}__cum", f"{c}_cum")
    return out.drop("__hk", "__pf", "__one", "__one__cum")
